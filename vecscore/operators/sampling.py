"""Samples of exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecscore.sources.store import staged


def seeded(df: DataFrame, key: list[str], n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, those of the smallest digests of seed and key: the same in any engine; all, if there are no more."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]).cast("binary")), *key).limit(n)


def first(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(*key).limit(n)


def strided(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Every (size div n)-th row by key, the first included, n at most.

    Positions come from counts of range partitions and places within them, so no task sorts
    all rows.
    """
    size = df.count()
    stride = max(1, size // n) if n else 1
    dealt = staged(df.repartitionByRange(*key).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = counts.select("__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*key)) - 1 + F.col("__before")
    rows = dealt.join(counts, "__part").withColumn("__i", place).filter((F.col("__i") % stride == 0) & (F.col("__i") < stride * n))
    return rows.select(df.columns)
