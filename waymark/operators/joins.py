"""Gates and lookups: what is missing, what is there already, and values found by key in several ways."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import rank


def missing(df: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from ``present``, or blank or null in any part (C1, C2): a blank key is never present."""
    blank_key = reduce(lambda a, b: a | b, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    there = present.select(*keys).distinct()
    return df.where(~blank_key).join(there, list(keys), "left_anti").unionByName(df.where(blank_key))


def completed(df: DataFrame, *outputs: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Rows that are in none of the outputs, by row id."""
    there = reduce(DataFrame.unionByName, [o.select(row_id) for o in outputs])
    return df.join(there, row_id, "left_anti")


def gated(df: DataFrame, reference: DataFrame, key: str, name: str = "duplicate") -> DataFrame:
    """Whether a row's key (a text; blank: no) is in the reference (C5, C6, C11). The reference's keys are made distinct first,
    and Spark broadcasts them only if they are small."""
    there = reference.select(key).where(F.col(key) != "").distinct().withColumn("_there", F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there").select(*df.columns, name)


def real_duplicates(clean: DataFrame, fail: DataFrame, key: str, outcome: str) -> tuple[DataFrame, DataFrame]:
    """Failed rows labelled duplicates whose key isn't among the clean ones become clean."""
    marked = gated(fail, clean, key, "_real")
    promote = (F.lower(F.trim(outcome)) == "duplicate") & ~F.col("_real")
    promoted = marked.where(promote).drop("_real").withColumn(outcome, F.lit("Pass"))
    return clean.unionByName(promoted), marked.where(~F.coalesce(promote, F.lit(False))).drop("_real")


def looked_up(df: DataFrame, table: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """A left join to one row of the table for each key, the first in ``order``."""
    return df.join(rank.first_by(table, keys, order), list(keys), "left")


def tiered(df: DataFrame, row_id: str, tiers: Sequence[tuple[DataFrame, Sequence[str]]], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Values from the first tier that has a match, and the ``tier`` (from 1; null: none).

    A tier is a table and the columns that it shares with ``df``; its rows are first cut to one for each key, so a common
    key matches once and no join grows.
    """
    found = None
    for i, (table, keys) in enumerate(tiers, 1):
        one = rank.first_by(table.select(*{*keys, *values, *order}), keys, list(order)).select(*keys, *[F.col(v).alias(f"_v_{v}") for v in values])
        hit = df.select(row_id, *keys).where(reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string"), F.lit("")) != "" for k in keys])).join(one, list(keys))
        hit = hit.select(row_id, F.lit(i).alias("tier"), *[f"_v_{v}" for v in values])
        found = hit if found is None else found.unionByName(hit)
    first = found.groupBy(row_id).agg(F.min_by(F.struct("tier", *[F.col(f"_v_{v}").alias(v) for v in values]), "tier").alias("_hit"))
    return df.join(first, row_id, "left").select(*[c for c in df.columns if c not in values], "_hit.*")


def restored(df: DataFrame, row_id: str, candidates: Sequence[Column], source: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A value from the first of several candidate keys that the source has; of a key's rows, the first."""
    one = rank.first_by(source.where(F.col(key) != ""), [key], [order]).select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    asked = df.select(row_id, F.posexplode(F.array(*candidates)).alias("_nth", "_key"))
    hit = asked.join(one, "_key").groupBy(row_id).agg(F.min_by("_value", "_nth").alias(value))
    return df.join(hit, row_id, "left")


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side with its rows on each and ``state``: same, missing (from b), extra (in b) or count."""
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    both = count(a, "n_a").join(count(b, "n_b"), list(keys), "full_outer").fillna(0, ["n_a", "n_b"])
    state = F.when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "extra").when(F.col("n_a") != F.col("n_b"), "count").otherwise("same")
    return both.withColumn("state", state)


def containing(df: DataFrame, names: DataFrame, column: str, name: str, gram: int = 4) -> DataFrame:
    """Pairs where ``column`` contains ``name`` (C14), for names that aren't blank. A name meets the texts that hold its first
    ``gram`` signs, or the whole of it if it is shorter: an equality join on the distinct stretches of a text, of those
    lengths only that names ask for. Only distinct texts are cut to stretches; rows find their names by their text.

    Both joins are sorted ones by a hint: from the size of a file Spark takes a table of stretches for a small one, and would send
    it to the driver to be broadcast.
    """
    head = names.where(F.length(name) > 0).withColumn("_g", F.substring(name, 1, gram))
    sizes = [r[0] for r in head.select(F.length("_g")).distinct().collect()]  # ``gram`` at most
    if not sizes:
        return df.join(names.where("false"), F.lit(True))
    text = F.col("_t")
    stretch = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    grams = F.explode(F.array_distinct(F.concat(*map(stretch, sorted(sizes)))))
    texts = df.select(F.col(column).alias("_t")).where("_t is not null").distinct()
    held = texts.withColumn("_g", grams).join(head.hint("merge"), "_g").where(F.contains(text, F.col(name))).drop("_g")
    return df.join(held.hint("merge"), df[column] == text).drop("_t")


def nearest_number(df: DataFrame, row_id: str, street: str, number: str, area: str) -> DataFrame:
    """``area`` of rows without one, from the row of the same street whose number is nearest; ties to the first row (C17).

    A street's rows are first brought down to its numbers: whether rows with it lack an area, and the first one that has one.
    Only these are put in order; the nearest that has an area is the last before or the first after. Rows find the
    answer by street and number, a join that adaptive execution can split.
    """
    first = F.min(F.when(F.col(area).isNotNull(), F.struct(F.col(row_id).alias("id"), F.col(area).alias("area"))))
    numbers = df.where(F.col(number).isNotNull()).groupBy(street, number).agg(first.alias("_own"))
    order = Window.partitionBy(street).orderBy(number)
    held = F.when(F.col("_own").isNotNull(), F.struct(F.col(number).alias("n"), F.col("_own.id").alias("id"), F.col("_own.area").alias("area")))
    sides = [F.last(held, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(held, True).over(order.rowsBetween(0, Window.unboundedFollowing))]
    d = numbers.withColumns(dict(zip(("_b", "_a"), sides, strict=True)))
    side = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(number) - F.col(f"{s}.n")).alias("g"), F.col(f"{s}.id").alias("id"), F.col(f"{s}.area").alias("area")))
    near = d.select(street, number, F.least(side("_b"), side("_a"))["area"].alias("_near"))
    return df.join(near, [street, number], "left").withColumn(area, F.coalesce(area, "_near")).select(*df.columns)


def verified(candidates: DataFrame, reverse: DataFrame, keys: Sequence[str], number: str, street: str) -> DataFrame:
    """Candidates that their place confirms (C19): the reverse lookup gives the same street and number. ``distance`` is the
    numbers' difference, null if they are on different sides of the street."""
    back = reverse.select(*keys, F.col(number).alias("_number"), F.col(street).alias("_street"))
    d = candidates.join(back, list(keys), "left")
    distance = F.when(F.col(number) % 2 == F.col("_number") % 2, F.abs(F.col(number) - F.col("_number")))
    d = d.withColumn("distance", distance).withColumn("accepted", F.coalesce((F.col(street) == F.col("_street")) & (distance == 0), F.lit(False)))
    return d.drop("_number", "_street")


def snapped(df: DataFrame, known: DataFrame, row_id: str) -> DataFrame:
    """``known_street`` and ``known_suburb``: by folded street and suburb, else the first by street (C20). Both tables have
    ``street_key`` and ``suburb_key``; ``known`` also ``known_street``, ``known_suburb`` and ``known_id``."""
    tiers = [(known, ["street_key", "suburb_key"]), (known, ["street_key"])]
    return tiered(df, row_id, tiers, ["known_street", "known_suburb"], ["known_id"])
