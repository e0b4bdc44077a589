"""Staged tables, and the index as versioned Parquet."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecscore.functions.quantize import signature_of_codes

#: Version of the stored layout; readers refuse any other.
FORMAT = 1


def new_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: what spark.checkpoint.dir names.

    Only a local session, whose executors are this machine, may leave the setting out; a cluster
    without it is an error, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: staged tables need a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/vs-{uuid.uuid4().hex}"


_settled = 0.0


def settle(spark: SparkSession, now: bool = False) -> None:
    """Collect the driver's garbage and give its memory back: Python's, the JVM's heap and, where it can trim it, its native heap.

    A driver collects by itself only when its heap is full, and until then holds that memory, and on
    disk the shuffles of finished steps. At most a twentieth of the time is spent here, but for calls
    with `now`, after steps of large shuffles.
    """
    global _settled
    began = time.monotonic()
    if began < _settled and not now:
        return
    gc.collect()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    of = jvm.java.lang.Class.forName
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)
    try:
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:  # a JVM without this command
        pass
    _settled = time.monotonic() + 20 * (time.monotonic() - began)


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet in that folder, and read it again. The shuffles that led to it need no disk from then on: see settle()."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what staged() wrote for this frame, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_index(points: DataFrame, cells: DataFrame, path: str) -> None:
    """Points laid out by cell, so that row-group statistics prune them, and the cells' table."""
    points.repartitionByRange("cell").sortWithinPartitions("cell", "ref_id").write.mode("overwrite").parquet(f"{path}/points")
    cells.withColumn("format", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/cells")


def save_buckets(points: DataFrame, path: str) -> None:
    """Points (ref_id, is_fraud, codes) laid out by signature: a reader that asks for some signatures reads their folders alone."""
    rows = points.withColumn("sig", signature_of_codes(F.col("codes")))
    # Salted, so that a frequent signature is written by several tasks.
    rows.repartition("sig", F.pmod(F.xxhash64("ref_id"), F.lit(8))).write.mode("overwrite").partitionBy("sig").parquet(path)
    settle(points.sparkSession)


def load_buckets(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, is_fraud, codes, sig) of save_buckets()."""
    return spark.read.schema("ref_id bigint, is_fraud boolean, codes array<int>, sig int").parquet(path)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(points, cells), or None if there is no index of this format under path: not ready, never an error."""
    try:
        points, cells = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/cells")
        if "format" not in cells.columns or cells.filter(F.col("format") != FORMAT).limit(1).count():
            return None
    except Exception as e:  # a missing or unreadable index means that it isn't ready
        if type(e).__name__ not in ("AnalysisException", "Py4JJavaError", "SparkException"):
            raise
        return None
    return points, cells.drop("format")


def is_ready(spark: SparkSession, path: str) -> bool:
    return load_index(spark, path) is not None
