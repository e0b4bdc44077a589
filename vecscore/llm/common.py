"""What the corpus operators share: table reading, staged writes, bounded samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from vecscore.sources.store import drop_staged as drop_staged
from vecscore.sources.store import settle

#: Rows of a batch handed to Python. Spark's default of 10,000 whole texts would not be small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, read by Spark alone, with small batches for Python."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Whole texts can be long, so batches for Python hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
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


def stage(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again: cuts the lineage.

    Unlike a local checkpoint, what is written outlives the executors that wrote it. What led to it
    is no longer needed: see store.settle().
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    settle(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a fit may use.
SAMPLE_BYTES = 24 << 20


def bounded_sample(df: DataFrame, key: str, rows: int, columns: list[str], text: str | None = None) -> DataFrame:
    """At most `rows` rows, those with the smallest key hashes: the same at every run.

    With a text column, fewer if their texts would exceed SAMPLE_BYTES. Only hashes and lengths
    reach the driver (`rows` of them).
    """
    h = F.xxhash64(F.col(key).cast("string"))
    size = F.coalesce(F.octet_length(text), F.lit(0)) if text else F.lit(0)
    low = df.select(h.alias("h"), size.alias("size")).orderBy("h", "size").limit(rows).collect()
    upto = np.cumsum([r["size"] for r in low])
    low = [r["h"] for r, n in zip(low, upto, strict=True) if n <= SAMPLE_BYTES]
    return df.filter(h <= low[-1] if low else F.lit(False)).select(*columns).limit(rows)


def trim() -> None:
    """Give freed memory back to the system, where the libraries can: a worker that is kept for later tasks should not hold it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Collect garbage and trim(), after a fit."""
    gc.collect()
    trim()


def crc_mod(key: str, n: int):
    """crc32 of the key as text, modulo n, as a column (null key: null)."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % n


def text_lists(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[list[list]]:
    """Lists of column values, cut where the texts (the last column) exceed `chars` bytes; a row is never cut.

    Spark itself ends a batch at spark.sql.execution.arrow.maxBytesPerBatch, so whole texts of any
    length come in batches of bounded size.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(upto):
            stop = min(len(upto), 1 + int(np.searchsorted(upto, upto[start] - sizes[start] + chars)))
            yield [c.to_pylist() for c in batch.slice(start, stop - start).columns]
            start = stop


def text_map(df: DataFrame, function: Callable[[list], dict], columns: list[str], schema: str, chars: int = 4_000_000) -> DataFrame:
    """Apply `function` to lists of column values, a bounded number of characters at a time.

    `function` gets one list per column and returns a dict of output lists.
    """
    out = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in text_lists(batches, chars):
            made = function(*lists)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
        trim()

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list], list], chars: int = 1_000_000) -> DataFrame:
    """The whole rows of df for whose text `keep` says true; it gets lists of texts of bounded length."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for (texts,) in text_lists([batch.select([at])], chars):
                yield batch.slice(start, len(texts)).filter(pa.array(keep(texts), pa.bool_()))
                start += len(texts)
        trim()

    return df.mapInArrow(run, df.schema)


#: A side of a join is broadcast if it measures less than this, else both sides are shuffled.
BROADCAST_BYTES = 8 << 20


def join_measured(big: DataFrame, small: DataFrame, on: list[str], size, salt_by, salt: int = 32) -> DataFrame:
    """big left join small (one row per key), without a shuffle of big if small measures few bytes.

    size: a column that bounds the bytes of a row of small, which is staged and measured. Beyond
    BROADCAST_BYTES, big is salted by the column salt_by and small repeated for each salt, so that
    a frequent key is spread over tasks. The keys must not be null. Either way gives the same rows.
    """
    small = stage(small)
    total = small.agg(F.sum(size + 64)).first()[0] or 0
    if total <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, "left")
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salt)).cast("int")).join(small, [*on, "__salt"], "left").drop("__salt")
