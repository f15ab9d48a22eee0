"""Picks that are the same on every run: "first", "mode" and "limit 1" as total orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row_id(df: DataFrame, order: Sequence[Column | str], name: str = "_row_id") -> DataFrame:
    """Rows numbered from 1 in ``order`` (E3), by a range partitioning and each partition's offset, so no task sorts all.

    ``order`` must be a total one, or the numbers of equal rows are free.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id())
    inner = spread.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*cols)))
    sizes = inner.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return inner.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_start")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; Spark keeps only each task's first before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def counted(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """Rows, first row and share of each value of a key: ``n``, ``first_id``, ``total``."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def mode_first_seen(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """The most frequent value of each key, the one seen first on ties."""
    return first_by(counted(df, keys, value, row_id), keys, [F.desc("n"), "first_id", value])
