"""The two cleaning flows as one plan each: a row in, the same row out with an outcome, nothing lost on the way."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import numbers, text
from waymark.functions.geo import Box, unswapped
from waymark.operators import aggregates, entity, joins, routing, tables
from waymark.operators.routing import Vocabulary, first_set
from waymark.plans import places
from waymark.stage import cut


@dataclass(frozen=True)
class Config:
    """All that is the caller's: region, vocabularies, names. Flags switch stages off (Q3)."""

    box: Box
    words: Vocabulary = Vocabulary()
    suburbs: Sequence[str] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    noise: Sequence[str] = ()
    postcodes: Mapping[str, str] = field(default_factory=dict)
    protected: Sequence[str] = ()
    note_phrases: Sequence[str] = ()
    unify: bool = True
    dominance: bool = True
    settle: bool = True
    verify: bool = False
    retry: bool = True
    keep_status: bool = False


def prepared(rows: DataFrame, config: Config) -> DataFrame:
    """Text types, suburbs lifted, suffixes written out, numbers in one form, coordinates put right (stages 1-4, 9)."""
    d = rows
    for c in ("Number", "Street", "Suburb", "Status", "Type", "Latitude", "Longitude", "PostalCode", "Notes"):
        d = d.withColumn(c, text.text(c) if c in d.columns else F.lit(""))
    d = d.withColumns({"_orig_street": F.col("Street"), "_orig_status": F.col("Status")})
    lifted = text.lift_suburb("Street", "Suburb", config.suburbs)
    d = d.withColumn("_l", lifted).withColumns({"Street": F.col("_l.street"), "Suburb": F.col("_l.suburb")}).drop("_l")
    # One step each: an expression over a column that is itself long would be copied into every place that reads it.
    d = d.withColumn("Number", F.when(text.blank("Number"), "").otherwise(numbers.normal_number("Number")))
    d = d.withColumn("_digits", numbers.house_digits("Number"))
    d = d.withColumn("Street", numbers.without_leading_number("_digits", "Street")).drop("_digits")
    d = d.withColumn("Street", text.expand_suffix("Street"))
    d = d.withColumn("Street", text.title("Street"))
    d = d.withColumn("Suburb", text.canon_suburb("Suburb", config.aliases, config.noise))
    d = d.withColumn("Street", routing.protected("Street", "_orig_street", config.protected))
    point = unswapped(text.number("Latitude"), text.number("Longitude"), config.box)
    d = d.withColumn("_p", point).withColumns({"_lat": F.col("_p.lat"), "_lon": F.col("_p.lon")}).drop("_p")
    inside = config.box.holds(F.col("_lat"), F.col("_lon"))
    return d.withColumns({"_lat": F.when(inside, F.col("_lat")), "_lon": F.when(inside, F.col("_lon"))})


def unified(d: DataFrame, config: Config) -> DataFrame:
    """One spelling for each street, and its dominant suburb where the own one is blank (stages 6-8, 15, 18)."""
    if config.unify:
        d = entity.unified_streets(d, "Street", "_row_id", 88, config.protected, respect_suffix=True)
    if config.dominance:
        lead = aggregates.dominant(d.where("Suburb <> '' and Street <> ''"), ["Street"], "Suburb", "_row_id", 0.6).select("Street", F.col("Suburb").alias("_lead"))
        d = d.join(lead, "Street", "left").withColumn("Suburb", first_set("Suburb", "_lead")).drop("_lead")
    return d


def with_points(d: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates and postcodes from the gazetteer where a row has none (stages 10-12): by number, street and suburb, then
    without the suburb, then the street alone. The gazetteer has ``number``, ``street``, ``suburb``, ``lat``, ``lon``, ``postcode``."""
    g = gazetteer.select(text.canon_text("street").alias("_ks"), text.canon_text("suburb").alias("_kb"), text.canon_number(numbers.without_unit("number")).alias("_kn"), "lat", "lon", "postcode")
    d = d.withColumns({"_ks": text.canon_text("Street"), "_kb": text.canon_text("Suburb"), "_kn": text.canon_number(numbers.without_unit("Number"))})
    tiers = [(g, ["_ks", "_kb", "_kn"]), (g, ["_ks", "_kn"])]
    d = joins.tiered(d, "_row_id", tiers, ["lat", "lon", "postcode"], ["_kb", "_kn", "lat", "lon"])
    d = d.withColumns({"_source": F.when(F.col("_lat").isNotNull(), "input").when(F.col("lat").isNotNull(), "gazetteer").otherwise(""), "_lat": F.coalesce("_lat", "lat"), "_lon": F.coalesce("_lon", "lon"), "PostalCode": first_set("PostalCode", "postcode")})
    return d.drop("_ks", "_kb", "_kn", "lat", "lon", "postcode", "tier")


def scheduler(rows: DataFrame, gazetteer: DataFrame, config: Config) -> DataFrame:
    """The scheduler's flow (O10): every row once, with ``Final Status`` and ``route``. ``rows`` have a unique ``_row_id``.

    Text and numbers are put right, streets and suburbs unified, conflicting suburbs settled by where rows lie (O5), coordinates
    verified or filled (N6), rows classified, failed ones retried (N5) and reclassified, duplicates found, and the rest written
    out; areas are assigned by :func:`waymark.operators.spatial.settled` on the result.
    """
    d = cut(unified(cut(prepared(rows, config)), config))
    if config.settle:
        d = cut(places.suburbs_settled(d, gazetteer, config.box, config.postcodes).drop("settled"))
    d = cut(places.verified_or_filled(d, gazetteer, config.box, config.verify))
    d = routing.classified(d, config.words, F.col("_lat").isNotNull())
    if config.retry:
        failed = routing.is_retryable("Final Status", "Status", config.words) & ~text.blank("Number") & ~text.blank("Street")
        d = cut(places.retried(d, gazetteer, config.box, failed, "Final Status"))
    d = routing.reclassified(d, "Final Status", "Status", config.words)
    d = routing.routed(d, "Final Status", words=config.words)
    d = d.withColumn("_key", F.when(F.col("route") == "clean", numbers.address_key(F.lit(""), "Number", "Street", "Suburb")).otherwise(""))
    d = tables.keep_best(d, "_key", F.col("_lat").isNotNull(), "_row_id")
    d = d.withColumns({"Final Status": F.when(F.col("kept"), F.col("Final Status")).otherwise("Duplicate"), "route": F.when(F.col("kept"), F.col("route")).otherwise("fail")})
    d = _written(d, config).withColumn("Number", numbers.house_first("Number"))
    return routing.restored(d, "Status", "_orig_status") if config.keep_status else d


def _written(d: DataFrame, config: Config) -> DataFrame:
    """Postcodes by suburb, cleaned notes, coordinates as text (stage 19)."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in config.postcodes.items() for x in kv]), F.col("Suburb")) if config.postcodes else F.lit(None).cast("string")
    fixed = lambda c: F.coalesce(F.format_string("%.8f", F.col(c)), F.lit(""))
    d = d.withColumns({"PostalCode": first_set(code, "PostalCode"), "Notes": text.clean_note("Notes", config.note_phrases)})
    return d.withColumns({"Latitude": F.when(F.col("_lat").isNotNull(), fixed("_lat")).otherwise(""), "Longitude": F.when(F.col("_lon").isNotNull(), fixed("_lon")).otherwise("")}).drop("kept", "_key")


def sheets(rows: DataFrame, master: DataFrame, gazetteer: DataFrame, config: Config) -> DataFrame:
    """The sheets' flow (O11): ``street, suburb`` split, unit and number merged, reasons and the master's gate in one step.

    ``rows`` have ``Type``, ``Unit``, ``Number``, ``Street``, ``Notes`` and a unique ``_row_id``; ``master`` has ``ApartmentNumber``, ``Number``,
    ``Street``. ``Missing Fields`` lists why a row fails.
    """
    d = rows.withColumns({"Old Unit": text.text("Unit"), "Old Number": text.text("Number"), "Old Street": text.text("Street")})
    whole = text.squeeze("Street")
    d = d.withColumns({"Suburb": F.trim(F.split_part(whole, F.lit(","), F.lit(2))), "Street": F.trim(F.split_part(whole, F.lit(","), F.lit(1))), "Number": numbers.merge_unit("Unit", "Number")})
    d = routing.defaulted(d, {"Type": "House", "Status": "At Home"})
    d = cut(with_points(cut(prepared(d, config)), gazetteer))
    is_new = routing.says_new_street("Notes")
    reasons = routing.address_reasons("Number", "Street", "Suburb", "Old Unit", "Old Number", "Old Street", is_new)
    # Spelling out a suffix is no change of street: only a missing part fails here.
    d = d.withColumn("Missing Fields", F.filter(reasons, lambda r: r.startswith("missing")))
    gate = lambda unit, house, street: F.to_json(numbers.gate_key(unit, house, street))
    complete = F.size("Missing Fields") == 0
    d = cut(d.withColumn("_gate", F.when(complete, gate(F.lit(""), "Number", "Street")).otherwise("")))
    known = master.select(gate("ApartmentNumber", "Number", text.expand_suffix("Street")).alias("_gate"))
    d = joins.gated(d, known, "_gate", "_known").withColumn("Final Status", routing.cascade([(~complete, "Fail"), (F.col("_known"), "Duplicate"), (F.col("_lat").isNull() & (F.trim(F.coalesce("Latitude", F.lit(""))) != ""), "Bad Geocode")], "Pass"))
    d = routing.routed(d, "Final Status", words=config.words)
    d = d.withColumns({"Number": numbers.unit_first("Number"), "Missing Fields": F.array_join("Missing Fields", "; ")})
    return _written(d.withColumns({"kept": F.lit(True), "_key": F.lit("")}), config).drop("_gate", "_known")


def verified(clean: DataFrame, parts: DataFrame) -> DataFrame:
    """What the area tables lack or have beside the clean table, by address key (C12): no rows if they are the same."""
    key: Column = numbers.address_key(F.lit(""), "Number", "Street", "Suburb").alias("key")
    return joins.coverage(clean.select(key), parts.select(key), ["key"]).where("state <> 'same'")


def backfilled(d: DataFrame, areas_of: DataFrame) -> DataFrame:
    """``Suburb`` from the street's comma, else from the area that holds the point (``_row_id``, ``area``), with the reason."""
    from_comma = F.trim(F.split_part("Street", F.lit(","), F.lit(2)))
    j = d.join(areas_of.select("_row_id", F.col("area").alias("_area")), "_row_id", "left")
    reason = F.when(~text.blank("Suburb"), "kept").when(from_comma != "", "comma").when(F.col("_area").isNotNull(), "area").otherwise("unresolved")
    return j.withColumns({"reason": reason, "Suburb": first_set("Suburb", from_comma, "_area")}).drop("_area")
