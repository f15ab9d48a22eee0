"""Dedupe, set operations, orders and chunks of whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import rank


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rank.first_by(df, key, order)


def keep_best(df: DataFrame, key: str, better: Column, row_id: str) -> DataFrame:
    """``kept`` for every row: the first of its key, one that is ``better`` before others (E2). Rows with a blank key are all kept.

    A key's best row is a partial minimum, and rows find out by their unique id: no task sees all rows of a common key.
    """
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    least = F.min(F.struct(F.when(better, 0).otherwise(1).alias("worse"), F.col(row_id).alias("id")))
    best = df.where(~blank).groupBy(key).agg(least.alias("_b")).select(F.col("_b.id").alias(row_id), F.lit(True).alias("_best"))
    return df.join(best, row_id, "left").withColumn("kept", blank | F.coalesce("_best", F.lit(False))).select(*df.columns, "kept")


def union_by_name(frames: Sequence[DataFrame], fill: str = "") -> DataFrame:
    """All rows under the first header and what others add, absent text blank, technical columns out (G1)."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    text = [c for c, kind in whole.dtypes if kind == "string" and not c.startswith("_")]
    return whole.select(*[c for c in whole.columns if not c.startswith("_")]).fillna(fill, text)


def index_diff(before: DataFrame, after: DataFrame, key: str, signature: Sequence[str]) -> DataFrame:
    """Keys that were added, updated or removed between two states (G5); a key is one row in each."""
    a = before.select(key, F.struct(*signature).alias("_a"))
    b = after.select(key, F.struct(*signature).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "updated")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def chunked(df: DataFrame, order: Sequence[Column | str], size: int = 300) -> DataFrame:
    """``chunk`` numbers from 1, ``size`` rows in each, in a total order."""
    return rank.with_row_id(df, order).withColumn("chunk", F.floor((F.col("_row_id") - 1) / size).cast("long") + 1).drop("_row_id")


def house_order(number: Column) -> list[Column]:
    """House numbers by value, then as text."""
    return [F.asc_nulls_last(F.regexp_extract(number, r"(\d+)", 1).try_cast("int")), F.lower(number)]


def address_order(row_id: str = "_row_id", first: Sequence[Column] = ()) -> list[Column]:
    """Street, suburb, house, then the row's place (F1)."""
    return [*first, F.lower("Street"), F.lower("Suburb"), *house_order(F.col("Number")), F.col(row_id)]


def dotted_key(c: Column | str) -> Column:
    """A key by which ``1.2`` comes before ``1.10`` and ``1.2a`` after ``1.2`` (F2): the numbers, then the rest. Other texts come last."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    head = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)", 1)
    return F.struct((head == "").alias("odd"), F.when(head != "", F.transform(F.split(head, r"\."), lambda p: p.cast("long"))).otherwise(F.array().cast("array<long>")).alias("numbers"), F.lower(F.substring(t, F.length(head) + 1, F.length(t))).alias("rest"))


def natural_key(c: Column | str) -> Column:
    """Digits compare as numbers, the rest as text (F2): an array of (is text, number, text)."""
    parts = F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct((~p.rlike(r"^\d")).alias("text"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n"), p.alias("t")))


def sampled(df: DataFrame, keys: Sequence[str], row_id: str, most: int = 20, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each key, drawn by a seeded hash."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def letter_columns(df: DataFrame, value: str, letters: Sequence[str]) -> DataFrame:
    """Distinct values in columns by first letter, a row for each place (F8)."""
    d = df.select(F.upper(F.substring(value, 1, 1)).alias("letter"), value).distinct()
    placed = d.withColumn("place", F.row_number().over(Window.partitionBy("letter").orderBy(value)))
    return placed.groupBy("place").pivot("letter", list(letters)).agg(F.min(value)).orderBy("place")


def searched(df: DataFrame, value: str, query: str, row_id: str, most: int = 100) -> DataFrame:
    """The first ``most`` values that begin with, have a word that begins with, or hold the query, in that order (F9); if none
    begins with it, the query is shortened from its end until one does."""
    t, q = F.lower(F.col(value)), query.lower().strip()
    begins = F.max(F.coalesce(F.greatest(*[F.when(t.startswith(q[:n]), n) for n in range(1, len(q) + 1)], F.lit(0), F.lit(0)), F.lit(0)))
    longest = df.agg(begins.alias("_n"))
    held = df.crossJoin(F.broadcast(longest))
    cut = F.substring(F.lit(q), F.lit(1), F.col("_n"))
    tier = F.when((F.col("_n") > 0) & t.startswith(cut), 1).when(F.contains(F.concat(F.lit(" "), t), F.lit(" " + q)), 2).when(F.contains(t, F.lit(q)), 3)
    return held.withColumn("tier", tier).where("tier is not null").drop("_n").orderBy("tier", row_id).limit(most)


def examples(df: DataFrame, order: Sequence[Column | str], most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The number of rows (``n``), and the first ``most`` of them for a report."""
    return df.agg(F.count(F.lit(1)).alias("n")), df.orderBy(*order).limit(most)
