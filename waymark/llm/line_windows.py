"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines of a text form a window, compared by 128 bits of hashes of their lines. Of a
window that the corpus has several times, the first (smallest ``doc_id``, null last, then place) stays; the
lines that later ones cover go, overlaps merged. Windows are counted after a partial aggregation, so a passage
that stands in every document weighs no more than another, and its places are joined by a plain equality that
adaptive execution can split.

Defined results: a null text is empty; texts under three lines and windows without any word are left alone;
a text all of whose lines go becomes empty; rows that repeat both ``doc_id`` and text count as one place and keep
the same lines; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import scratch


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def deduplicated(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, ``n_lines`` (before) and ``n_removed``."""
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    lines = keyed.select("_k", F.col("doc_id").alias("_d"), _lines().alias("_l")).where(F.size("_l") >= width)
    at = lambda i: [F.get(F.col("_l"), i + j) for j in range(width)]
    word = r"[^\x20\x09-\x0D]"
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("_l") - width),
        lambda i: F.when(F.concat(*at(i)).rlike(word), F.struct(i.alias("p"), F.xxhash64(*at(i)).alias("g"), F.xxhash64(F.lit(width), *at(i)[::-1]).alias("h"))),
    )
    windows = lines.select("_k", "_d", F.inline(F.filter(hashed, lambda x: x.isNotNull())))
    place = F.struct(F.col("_d").isNull().alias("last"), F.col("_d").alias("d"), F.col("_k").alias("k"), F.col("p").alias("p"))
    repeated = windows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = scratch.stored(repeated.selectExpr("g", "h", "first.k as first_k", "first.p as first_p"), "windows")
    later = windows.join(repeated, ["g", "h"]).where("_k <> first_k or p <> first_p")
    covered = later.groupBy("_k").agg(F.collect_set("p").alias("_p"))
    d = keyed.join(covered, "_k", "left").withColumn("_l", _lines())
    gone = F.flatten(F.transform(F.col("_p"), lambda p: F.sequence(p, p + width - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), gone)
    d = d.withColumn("_left", F.when(F.col("_p").isNotNull(), left))
    text = F.when(F.col("_p").isNotNull(), F.array_join(F.transform(F.col("_left"), lambda i: F.get(F.col("_l"), i)), "\n")).otherwise(F.coalesce("text", F.lit("")))
    d = d.withColumns({"n_lines": F.size("_l").cast("long"), "n_removed": F.coalesce(F.size("_l") - F.size("_left"), F.lit(0)).cast("long"), "text": text})
    return d.select(*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in docs.columns])
