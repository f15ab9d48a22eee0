"""Rows and their places: coordinates verified or filled, conflicting suburbs settled, addresses that are new.

Everything is looked up in a gazetteer of ``number``, ``street``, ``suburb``, ``lat``, ``lon``, ``postcode``; what a row may be found under is
a list of keys in order, exploded and joined by equality, and the first that is found counts. Rows have a unique ``_row_id``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import rank
from waymark.functions import numbers, text
from waymark.functions.geo import Box, flat_m, unswapped

_KEYS = ["_ks", "_kb", "_kn"]


def keyed(gazetteer: DataFrame, box: Box) -> DataFrame:
    """One entry for each street, suburb and number (canonical), swapped coordinates put right, inside the region only."""
    p = gazetteer.withColumn("_p", unswapped(F.col("lat"), F.col("lon"), box))
    g = p.select(text.canon_text("street").alias("_ks"), text.canon_text("suburb").alias("_kb"), text.canon_number(numbers.without_unit("number")).alias("_kn"), F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"), "postcode")
    return rank.first_by(g.where(box.holds(F.col("lat"), F.col("lon"))), _KEYS, ["lat", "lon", "postcode"])


def _probes(number: str, reach: int, order: Sequence[int]) -> Column:
    """The row's number, without its unit, then the numbers near it (the digits that the number ends with), positive ones."""
    base = F.regexp_extract(F.trim(number), r"(\d+)$", 1).try_cast("long")
    steps = [F.when(base + s > 0, (base + s).cast("string")) for s in order if abs(s) <= reach]
    return F.array(text.canon_number(F.col(number)), text.canon_number(numbers.without_unit(number)), *steps)


def _found(asked: DataFrame, probes: Column, table: DataFrame, keys: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """``_row_id`` and the entry of the first probe that the table has."""
    each = asked.select("_row_id", *[k for k in keys if k != "_kn"], *keep, F.posexplode(probes).alias("_nth", "_kn")).where("_kn <> '' and _ks <> ''")
    hits = each.join(table, list(keys))
    return hits if keep else hits.groupBy("_row_id").agg(F.min_by(F.struct("lat", "lon", "postcode"), "_nth").alias("_hit"))


def verified_or_filled(d: DataFrame, gazetteer: DataFrame, box: Box, verify: bool = False, reach: int = 5) -> DataFrame:
    """``_lat``, ``_lon`` and ``PostalCode`` from the gazetteer where a row has no coordinates, or for all rows if ``verify``.

    A row is looked up under its full number, without its unit, then under the numbers from ``reach`` below to ``reach`` above, in
    that order; what is found replaces all three. ``_source`` tells where the coordinates are from.
    """
    lacks = F.lit(verify) | F.col("_lat").isNull() | F.col("_lon").isNull() | (F.col("_lat") == 0) | (F.col("_lon") == 0)
    d = d.withColumns({"_ks": text.canon_text("Street"), "_kb": text.canon_text("Suburb")})
    order = [s for s in range(-reach, reach + 1) if s]
    hit = _found(d.where(lacks), _probes("Number", reach, order), keyed(gazetteer, box), _KEYS)
    return _filled(d.join(hit, "_row_id", "left"), "gazetteer").drop("_ks", "_kb")


def _filled(d: DataFrame, source: str) -> DataFrame:
    there = F.col("_hit").isNotNull()
    own = F.when(F.col("_lat").isNotNull(), "input").otherwise("") if "_source" not in d.columns else F.col("_source")
    code = F.coalesce(F.col("_hit.postcode"), F.lit(""))
    return d.withColumns({"_source": F.when(there, source).otherwise(own), "PostalCode": F.when(there & (code != ""), code).otherwise(F.col("PostalCode")), "_lat": F.when(there, F.col("_hit.lat")).otherwise(F.col("_lat")), "_lon": F.when(there, F.col("_hit.lon")).otherwise(F.col("_lon"))}).drop("_hit")


def retried(d: DataFrame, gazetteer: DataFrame, box: Box, failed: Column, outcome: str, promoted: str = "Pass") -> DataFrame:
    """A second pass over failed rows without coordinates (N5): looked up by street and number alone, and promoted if they are found."""
    again = F.coalesce(failed, F.lit(False)) & F.col("_lat").isNull()
    table = rank.first_by(keyed(gazetteer, box), ["_ks", "_kn"], ["_kb", "lat", "lon"]).drop("_kb")
    d = d.withColumn("_ks", text.canon_text("Street"))
    hit = _found(d.where(again), _probes("Number", 0, ()), table, ["_ks", "_kn"])
    d = d.join(hit, "_row_id", "left").withColumn(outcome, F.when(F.col("_hit").isNotNull(), promoted).otherwise(F.col(outcome)))
    return _filled(d, "retry").drop("_ks")


def suburbs_settled(d: DataFrame, gazetteer: DataFrame, box: Box, postcodes: Mapping[str, str] | None = None, city: str = "", k: int = 3, radius_m: float = 300, reach: int = 5) -> DataFrame:
    """One suburb for each street whose rows have several, by where they lie (O5); rows gain ``settled`` (how, null: not).

    Of the rows with coordinates inside the region (a blank suburb counts as ``city``): the only suburb (``only``); else one that three rows
    at least and 70 % have (``plurality``); else the one that most of the ``k`` rows nearest to their centre have (``nearest``); if two
    are even there, the one whose rows are nearest on average (``mean``). Postcodes follow the suburb. Rows without
    coordinates are then filled from the gazetteer within ``radius_m`` of the centre: own number, then the ones nearest to it.
    """
    street = text.title(F.trim("Street"))
    d = d.withColumn("_street", street)
    points = d.where((F.col("_street") != "") & box.holds(F.col("_lat"), F.col("_lon")))
    points = points.select("_row_id", "_street", F.when(F.trim("Suburb") == "", F.lit(city)).otherwise(text.title(F.trim("Suburb"))).alias("_label"), "_lat", "_lon")
    centre = points.groupBy("_street").agg(F.avg("_lat").alias("c_lat"), F.avg("_lon").alias("c_lon"))
    lead = rank.mode_first_seen(points, ["_street"], "_label", "_row_id")
    early = F.when(F.col("n") == F.col("total"), "only").when(F.col("n") >= F.greatest(F.lit(3), F.floor(F.lit(0.7) * F.col("total"))), "plurality")
    lead = lead.select("_street", F.col("_label").alias("_lead"), early.alias("_early"))
    open_ = points.join(lead.where("_early is null").select("_street"), "_street", "left_semi").join(centre, "_street")
    open_ = open_.withColumn("_m", flat_m(F.col("_lat"), F.col("_lon"), F.col("c_lat"), F.col("c_lon")))
    near = open_.withColumn("_nth", F.row_number().over(Window.partitionBy("_street").orderBy("_m", "_row_id"))).where(F.col("_nth") <= k)
    votes = near.groupBy("_street", "_label").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("_street").agg(F.max("votes").alias("most"), F.max_by("_label", "votes").alias("_top"), F.sort_array(F.collect_list("votes"), asc=False).alias("all"))
    means = open_.groupBy("_street", "_label").agg(F.avg("_m").alias("mean"))
    mean = means.groupBy("_street").agg(F.min(F.struct("mean", "_label")).alias("least"))
    alone = F.coalesce(F.get("all", F.lit(1)) < F.col("most"), F.lit(True))
    voted = most.join(mean, "_street").select("_street", F.when(alone, F.col("_top")).otherwise(F.col("least._label")).alias("_vote"), F.when(alone, "nearest").otherwise("mean").alias("_how"))
    chosen = lead.join(voted, "_street", "left").join(centre, "_street")
    chosen = chosen.select("_street", F.when(F.col("_early").isNotNull(), F.col("_lead")).otherwise(F.col("_vote")).alias("_chosen"), F.coalesce("_early", "_how").alias("settled"), "c_lat", "c_lon")
    d = d.join(chosen, "_street", "left").withColumn("Suburb", F.coalesce("_chosen", "Suburb"))
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in postcodes.items() for x in kv]), F.col("_chosen")), F.lit("")) if postcodes else F.lit("")
    d = d.withColumn("PostalCode", F.when(code != "", code).otherwise(F.col("PostalCode")))
    d = d.withColumns({"_ks": text.canon_text("Street"), "_kb": text.canon_text("Suburb")})
    order = [s * n for n in range(1, reach + 1) for s in (-1, 1)]
    hits = _found(d.where(F.col("_chosen").isNotNull() & F.col("_lat").isNull()), _probes("Number", reach, order), keyed(gazetteer, box), _KEYS, [F.col("c_lat"), F.col("c_lon")])
    near_enough = flat_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) <= radius_m
    hit = hits.where(near_enough).groupBy("_row_id").agg(F.min_by(F.struct("lat", "lon", "postcode"), "_nth").alias("_hit"))
    d = _filled(d.join(hit, "_row_id", "left").withColumn("_hit", F.when(F.col("_hit").isNotNull(), F.struct("_hit.lat", "_hit.lon", F.when(text.blank("PostalCode"), F.col("_hit.postcode")).otherwise("").alias("postcode")))), "street")
    return d.drop("_street", "_chosen", "c_lat", "c_lon", "_ks", "_kb")


def new_addresses(known: DataFrame, now: DataFrame, gazetteer: DataFrame, box: Box, numbers_to: int = 10) -> DataFrame:
    """A row for each street and suburb that ``known`` has and ``now`` lacks (O13), to be cleaned as input: ``Number``, ``Street``, ``Suburb``,
    ``Latitude``, ``Longitude``, ``several_suburbs``.

    The number is the first from 1 to ``numbers_to`` that the gazetteer has inside the region, with its coordinates; else 1, without.
    Streets that are in several suburbs keep a row for each and are marked.
    """
    pair = lambda d: d.select(text.title(F.trim("street")).alias("Street"), text.title(F.trim("suburb")).alias("Suburb")).where("Street <> ''").distinct()
    all_, there = pair(known), pair(now)
    lacking = all_.join(there, ["Street", "Suburb"], "left_anti")
    several = all_.groupBy("Street").agg((F.count(F.lit(1)) > 1).alias("several_suburbs"))
    first = F.explode(F.transform(F.sequence(F.lit(1), F.lit(numbers_to)), lambda n: n.cast("string")))
    asked = lacking.withColumns({"_ks": text.canon_text("Street"), "_kb": text.canon_text("Suburb")}).withColumn("_kn", first)
    hit = asked.join(keyed(gazetteer, box), _KEYS).groupBy("Street", "Suburb").agg(F.min(F.struct(F.col("_kn").cast("int").alias("n"), "lat", "lon")).alias("h"))
    fixed = lambda c: F.coalesce(F.format_string("%.8f", F.col(c)), F.lit(""))
    d = lacking.join(hit, ["Street", "Suburb"], "left").join(several, "Street")
    return d.select(F.coalesce(F.col("h.n"), F.lit(1)).cast("string").alias("Number"), "Street", "Suburb", F.when(F.col("h").isNotNull(), fixed("h.lat")).otherwise("").alias("Latitude"), F.when(F.col("h").isNotNull(), fixed("h.lon")).otherwise("").alias("Longitude"), "several_suburbs")
