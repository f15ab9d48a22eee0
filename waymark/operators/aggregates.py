"""Votes, shares, centres, audits and histograms by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import rank
from waymark.functions.geo import flat_m


def policy_mode(df: DataFrame, keys: Sequence[str], value: str, majority: Column, near: Column) -> DataFrame:
    """The most frequent value; on ties the majority's, then one near it, then by name (D3). The conditions are over ``value``."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.desc(majority.cast("int")), F.desc(near.cast("int")), value]
    return rank.first_by(c, keys, order)


def dominant(df: DataFrame, keys: Sequence[str], value: str, row_id: str, share: float, support: int = 1) -> DataFrame:
    """The mode of each key where it has enough of the rows, and enough rows."""
    return rank.mode_first_seen(df, keys, value, row_id).where((F.col("n") >= support) & (F.col("n") >= share * F.col("total")))


def pulled(df: DataFrame, keys: Sequence[str], value: str, row_id: str, settled: Column, share: float = 0.6, support: int = 3) -> DataFrame:
    """Rows that aren't settled take their key's dominant value among the settled ones."""
    lead = dominant(df.where(settled), keys, value, row_id, share, support).select(*keys, F.col(value).alias("_lead"))
    return df.join(lead, list(keys), "left").withColumn(value, F.when(settled, F.col(value)).otherwise(F.coalesce("_lead", value))).drop("_lead")


def plurality(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """The mode where it is the only value, or has 70 % of the rows and three at least."""
    lead = rank.mode_first_seen(df, keys, value, row_id)
    return lead.where((F.col("n") == F.col("total")) | (F.col("n") >= F.greatest(F.lit(3), F.floor(F.lit(0.7) * F.col("total")))))


def centres(df: DataFrame, keys: Sequence[str], lat: str, lon: str) -> DataFrame:
    """D7."""
    return df.groupBy(*keys).agg(F.avg(lat).alias("c_lat"), F.avg(lon).alias("c_lon"))


def nearest_vote(df: DataFrame, keys: Sequence[str], label: str, lat: str, lon: str, row_id: str, k: int) -> DataFrame:
    """The label that most of the k rows nearest to the centre have; on ties the one that is nearer on average."""
    d = df.join(centres(df, keys, lat, lon), list(keys)).withColumn("_d", flat_m(F.col(lat), F.col(lon), F.col("c_lat"), F.col("c_lon")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_d", row_id))
    votes = d.withColumn("_nth", nth).where(F.col("_nth") <= k).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("votes"), F.avg("_d").alias("mean_m"))
    return rank.first_by(votes, keys, [F.desc("votes"), "mean_m", label])


def nearest_mean(df: DataFrame, keys: Sequence[str], label: str, lat: str, lon: str, tie: float = 1e-6) -> DataFrame:
    """The label whose rows are nearest to the centre on average; within ``tie``, the more frequent, then the last by name."""
    d = df.join(centres(df, keys, lat, lon), list(keys)).withColumn("_d", flat_m(F.col(lat), F.col(lon), F.col("c_lat"), F.col("c_lon")))
    means = d.groupBy(*keys, label).agg(F.avg("_d").alias("mean_m"), F.count(F.lit(1)).alias("n"))
    least = F.min("mean_m").over(Window.partitionBy(*keys))
    return rank.first_by(means.withColumn("_least", least).where(F.col("mean_m") <= F.col("_least") + tie), keys, [F.desc("n"), F.desc(label)]).drop("_least")


def distinct_folded(df: DataFrame, value: str, key: Column, row_id: str) -> DataFrame:
    """One spelling of each folded value, the first seen."""
    return df.withColumn("_key", key).groupBy("_key").agg(F.min_by(value, row_id).alias(value)).drop("_key")


def spanning(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with several values, and which."""
    d = df.select(*keys, value).distinct().groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return d.withColumn("n", F.size("values").cast("long")).where("n > 1")


def repeated(df: DataFrame, keys: Sequence[str], kind: str | None = None) -> DataFrame:
    """All rows of a key that has several (D12), with ``copies`` and, if ``kind`` names a column, whether its values agree."""
    aggs = [F.count(F.lit(1)).alias("copies")]
    if kind:
        aggs.append((F.min(kind) == F.max(kind)).alias("exact"))
    return df.join(df.groupBy(*keys).agg(*aggs).where("copies > 1"), list(keys))


def summed(df: DataFrame, key: str, value: str) -> DataFrame:
    """D13."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), key)


def listed(df: DataFrame, keys: Sequence[str], item: str, order: str, most: int = 20, between: str = "; ") -> DataFrame:
    """The first ``most`` items of each key as one text, ``...`` if there are more, and the count (D14). Only ``most`` items of a
    key are ever held together."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_nth") <= most)
    text = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", item))), lambda x: x[item]), between).alias("items"))
    d = n.join(text, list(keys))
    return d.withColumn("items", F.when(F.col("n") > most, F.concat("items", F.lit(f"{between}..."))).otherwise(F.col("items")))


def any_in_group(df: DataFrame, keys: Sequence[str], condition: Column, name: str) -> DataFrame:
    """Whether any row of the key meets a condition, on all of its rows."""
    marks = df.groupBy(*keys).agg(F.max(F.coalesce(condition, F.lit(False))).alias(name))
    return df.join(marks, list(keys), "left")


def group_stats(df: DataFrame, keys: Sequence[str], empty: Column, out: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(empty).alias("all_blank"), F.max(out).alias("any_out"), F.count(F.lit(1)).alias("total"))


def lookup_lists(df: DataFrame, columns: Sequence[str], pinned: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Each column's distinct values (``field``, ``value``, ``n``, ``position``): pinned ones first, then by frequency and name."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    first = F.lit(None).cast("int")
    for name, values in (pinned or {}).items():
        for i, v in enumerate(values):
            first = F.when((F.col("field") == name) & (F.col("value") == v), i).otherwise(first)
    number = F.when(F.col("value").rlike(r"^\d+$"), F.col("value").try_cast("long"))
    order = Window.partitionBy("field").orderBy(F.asc_nulls_last(first), F.desc("n"), F.desc(number.isNotNull().cast("int")), number, F.lower("value"), "value")
    return counts.withColumn("position", F.row_number().over(order))


def suffix_counts(df: DataFrame, base: str, suffix: str) -> DataFrame:
    """How often each base has each suffix, and whether it has one only."""
    c = df.where(F.col(suffix) != "").groupBy(base, suffix).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("only", F.count(F.lit(1)).over(Window.partitionBy(base)) == 1)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 64, smooth: int = 5) -> DataFrame:
    """``bin``, ``n``, the moving mean over ``smooth`` bins either side and the running sum, for all bins."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    whole = every.join(counts, "bin", "left").fillna(0, ["n"])
    order = Window.orderBy("bin")  # one row for each bin
    return whole.withColumns({"smoothed": F.avg("n").over(order.rowsBetween(-smooth, smooth)), "running": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def valleys(hist: DataFrame, parts: int, reach: int = 3) -> DataFrame:
    """Cut bins for ``parts`` of equal counts, each moved to the least smoothed bin within ``reach``."""
    total = hist.agg(F.max("running").alias("total"))
    cuts = hist.sparkSession.range(1, parts).select(F.col("id").cast("int").alias("cut"))
    reached = hist.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(cuts)).where(F.col("running") * parts >= F.col("total") * F.col("cut"))
    at = reached.groupBy("cut").agg(F.min("bin").alias("at"))
    near = hist.join(F.broadcast(at), F.abs(F.col("bin") - F.col("at")) <= reach)
    return rank.first_by(near, ["cut"], ["smoothed", F.abs(F.col("bin") - F.col("at")), "bin"]).select("cut", "at", "bin")


def principal_axis(df: DataFrame, x: str, y: str) -> DataFrame:
    """The angle of the axis along which points spread most."""
    c = df.agg(F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    return c.withColumn("angle", 0.5 * F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")))


def profile(calls: DataFrame, top: int = 100) -> DataFrame:
    """Calls, own and total time of each function, the ``top`` by either."""
    p = calls.groupBy("function").agg(F.count(F.lit(1)).alias("calls"), F.sum("own_s").alias("own_s"), F.sum("total_s").alias("total_s"))
    return p.orderBy(F.desc("own_s"), "function").limit(top).union(p.orderBy(F.desc("total_s"), "function").limit(top)).distinct()
