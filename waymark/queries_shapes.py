"""Queries of places, areas, sources, streams and whole flows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalog import Tables, query
from waymark.functions import geo
from waymark.operators import shapes, spatial
from waymark.operators.routing import cascade
from waymark.plans import cleaning
from waymark.sources import files, geocoders, geodata
from waymark.stage import folder
from waymark.streaming import submissions

#: Areas that overlap, touch and leave gaps: name, suburb, points.
AREAS = [
    ("west", "west", [(-0.3, -0.3), (0.0, -0.3), (0.0, 0.3), (-0.3, 0.3)]),
    ("east", "east", [(0.0, -0.3), (0.3, -0.3), (0.3, 0.3), (0.0, 0.3)]),
    ("centre", "east", [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]),
    ("wedge", "west", [(-0.2, 0.05), (0.05, 0.25), (-0.25, 0.2)]),
]
BOX = geo.Box(-0.2, 0.2, -0.25, 0.25)


def _areas(t: Tables) -> DataFrame:
    rows = [(n, s, [{"x": x, "y": y} for x, y in p]) for n, s, p in AREAS]
    return t.spark.createDataFrame(rows, "name string, suburb string, ring array<struct<x:double,y:double>>")


def _points(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


_SIDES = ", ".join(
    f"('{n}', '{s}', CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))"
    for n, s, p in AREAS
    for (x1, y1), (x2, y2) in zip(p, [*p[1:], p[0]], strict=True)
)
_INSIDE = f"""
WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES}),
p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
s AS (
  SELECT p.*, name, suburb, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (CASE WHEN y2 = y1 THEN NULL ELSE y2 - y1 END) + x1 AS hit,
         greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS f, x1, y1, x2, y2
  FROM p, a),
d AS (
  SELECT vec_id, name, suburb, count(*) FILTER (WHERE hit) % 2 = 1 AS inside, min(sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2))) AS edge
  FROM s GROUP BY ALL)
"""


@query(_INSIDE + "SELECT vec_id, name AS area, round(edge, 9) AS edge FROM d WHERE inside")
def point_in_ring(t: Tables) -> DataFrame:
    """C15, K1, K2, K3."""
    return spatial.containing(_points(t), _areas(t), "x", "y").select("vec_id", "area", F.round("edge", 9).alias("edge"))


@query(_INSIDE + "SELECT vec_id, arg_max(name, edge) FILTER (WHERE inside) AS area FROM d GROUP BY 1")
def assign_deepest(t: Tables) -> DataFrame:
    """K4, T7."""
    return spatial.deepest(_points(t), _areas(t), "vec_id", "x", "y").select("vec_id", "area")


@query(
    _INSIDE
    + """
SELECT vec_id, CASE count(*) FILTER (WHERE inside) WHEN 0 THEN 'NEAREST' WHEN 1 THEN 'IN' ELSE 'BORDER' END AS kind,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE inside), arg_min(name, (edge, name))) AS areas FROM d GROUP BY 1
"""
)
def assign_in_border_nearest(t: Tables) -> DataFrame:
    """C16, K5, T7."""
    return spatial.assigned(_points(t), _areas(t), "vec_id", "x", "y").select("vec_id", "kind", F.array_join("areas", ",").alias("areas"))


@query(
    _INSIDE
    + """
, q AS (SELECT vec_id, vec_id % 25 AS street, vec_id % 60 AS num, CASE WHEN vec_id % 2 = 0 THEN 'west' ELSE 'north' END AS own, vec_id % 9 <> 0 AS placed FROM embeddings),
i AS (
  SELECT vec_id, name, CASE WHEN own = suburb THEN 1 WHEN own = 'west' AND suburb = 'east' THEN 2 ELSE 3 END AS pass FROM d JOIN q USING (vec_id) WHERE inside AND placed),
f AS (SELECT vec_id, list(name ORDER BY name) AS areas FROM i WHERE (vec_id, pass) IN (SELECT vec_id, min(pass) FROM i GROUP BY 1) GROUP BY 1),
e AS (SELECT vec_id, arg_min(name, (edge, name)) AS near FROM d GROUP BY 1),
u AS (
  SELECT q.*, areas, CASE WHEN len(areas) = 1 THEN areas[1] WHEN areas IS NULL AND placed THEN near END AS area,
         CASE WHEN len(areas) = 1 THEN 'IN' WHEN len(areas) > 1 THEN 'BORDER' WHEN placed THEN 'NEAREST' END AS kind
  FROM q LEFT JOIN f USING (vec_id) LEFT JOIN e USING (vec_id)),
k AS (SELECT u.vec_id, arg_min(b.area, (abs(u.num - b.num), b.vec_id)) AS by_number FROM u JOIN u b ON u.street = b.street AND b.area IS NOT NULL WHERE u.area IS NULL GROUP BY 1),
n AS (SELECT u.* EXCLUDE (area, kind), coalesce(area, by_number) AS area, CASE WHEN area IS NULL AND by_number IS NOT NULL THEN 'NUMBER' ELSE kind END AS kind FROM u LEFT JOIN k USING (vec_id)),
c AS (SELECT street, area, count(*) AS n, min(vec_id) AS first, sum(count(*)) OVER (PARTITION BY street) AS total FROM n WHERE kind = 'IN' GROUP BY 1, 2),
l AS (SELECT street, area AS lead FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, first) AS nth FROM c) WHERE nth = 1 AND n >= 3 AND n >= 0.6 * total)
SELECT vec_id, kind, coalesce(CASE WHEN kind = 'IN' THEN area ELSE coalesce(lead, area) END, array_to_string(areas, '_')) AS area FROM n LEFT JOIN l USING (street)
"""
)
def settled_areas(t: Tables) -> DataFrame:
    """K6."""
    beside = t.spark.createDataFrame([("west", "east")], "suburb string, beside string")
    p = _points(t).withColumns({"street": F.col("vec_id") % 25, "number": (F.col("vec_id") % 60).cast("int"), "own": F.when(F.col("vec_id") % 2 == 0, "west").otherwise("north")})
    p = p.withColumn("x", F.when(F.col("vec_id") % 9 != 0, F.col("x")))
    return spatial.settled(p, _areas(t), beside, "vec_id", "x", "y", "street", "number", "own").select("vec_id", "kind", "area")


@query(
    """
WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
s AS (SELECT *, coalesce(a BETWEEN -0.25 AND 0.25 AND b BETWEEN -0.2 AND 0.2, false) AND NOT coalesce(a BETWEEN -0.2 AND 0.2 AND b BETWEEN -0.25 AND 0.25, false) AS swap FROM p),
u AS (SELECT vec_id, CASE WHEN swap THEN b ELSE a END AS lat, CASE WHEN swap THEN a ELSE b END AS lon FROM s)
SELECT vec_id, round(lat, 9) AS lat, round(lon, 9) AS lon, lat BETWEEN -0.2 AND 0.2 AND lon BETWEEN -0.25 AND 0.25 AS inside,
       round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres
FROM (SELECT *, pow(sin(radians(0.1 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(0.1)) * pow(sin(radians(0.1 - lon) / 2), 2) AS h FROM u)
"""
)
def swap_bbox_haversine(t: Tables) -> DataFrame:
    """J1, J3, J4, J5."""
    p = _points(t).select("vec_id", geo.unswapped(F.col("x"), F.col("y"), BOX).alias("p"))
    lat, lon = F.col("p.lat"), F.col("p.lon")
    return p.select("vec_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), BOX.holds(lat, lon).alias("inside"), F.round(geo.haversine_m(lat, lon, F.lit(0.1), F.lit(0.1)), 3).alias("metres"))


@query(
    f"""
WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES}),
m AS (SELECT name, sum(x1 * y2 - x2 * y1) / 2 AS s, avg(y1) AS lat, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS my, min(x1) AS west, max(y1) AS north FROM a GROUP BY 1)
SELECT name, round(abs(s), 9) AS area, round(abs(s) * pow(radians(1.0) * 6371000.0, 2) * cos(radians(lat)), 0) AS area_m2, round(mx / s, 9) AS cx, round(my / s, 9) AS cy, west, north FROM m
"""
)
def ring_area(t: Tables) -> DataFrame:
    """J6, J7, K18."""
    r = F.col("ring")
    c, b = geo.centroid(F.array(r)), geo.bounds(r)
    return _areas(t).select("name", F.round(F.abs(geo.signed_area(r)), 9).alias("area"), F.round(geo.area_m2(r), 0).alias("area_m2"), F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), b["west"].alias("west"), b["north"].alias("north"))


@query(
    f"""
WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES})
SELECT name, string_agg(printf('%.3f,%.3f', x1, y1), ' ' ORDER BY i) AS open_text, CAST(count(*) AS INTEGER) AS points FROM (SELECT *, row_number() OVER () AS i FROM a) GROUP BY 1
"""
)
def kml_round_trip(t: Tables) -> DataFrame:
    """Areas as coordinates and GeoJSON, and read back."""
    d = _areas(t).withColumn("text", geodata.coordinates_text(F.col("ring"), 3)).withColumn("back", geo.ring_of(F.col("text")))
    d = d.withColumn("json", geodata.from_geojson(geodata.geojson(F.col("name"), F.col("back"))))
    opened = F.slice("json.ring", 1, F.size("json.ring") - 1)
    return d.select("json.name", F.array_join(F.transform(opened, lambda p: F.format_string("%.3f,%.3f", p["x"], p["y"])), " ").alias("open_text"), F.size(opened).alias("points"))


@query(
    """
WITH b AS (SELECT vec_id, vec_id % 2 AS side, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, abs(CAST(embedding[3] AS DOUBLE)) / 2 AS r FROM embeddings)
SELECT l.vec_id AS a, m.vec_id AS b FROM b l JOIN b m ON l.side = 0 AND m.side = 1 WHERE l.x - l.r <= m.x + m.r AND m.x - m.r <= l.x + l.r AND l.y - l.r <= m.y + m.r AND m.y - m.r <= l.y + l.r
"""
)
def bounds_join(t: Tables) -> DataFrame:
    """Pairs of boxes that overlap."""
    r = F.abs(F.element_at("embedding", 3).cast("double")) / 2
    b = t.embeddings.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), r.alias("r"))
    b = b.select("vec_id", (F.col("x") - F.col("r")).alias("west"), (F.col("x") + F.col("r")).alias("east"), (F.col("y") - F.col("r")).alias("south"), (F.col("y") + F.col("r")).alias("north"))
    return spatial.by_cells(b.where("vec_id % 2 = 0"), b.where("vec_id % 2 = 1"), [], 0.1).select(F.col("vec_id").alias("a"), F.col("r_vec_id").alias("b"))


_HULL = """
WITH p AS (SELECT DISTINCT CAST(label AS VARCHAR) AS key, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
-- a point is a corner if all others lie within less than half a turn, seen from it
g AS (SELECT a.key, a.x, a.y, atan2(b.y - a.y, b.x - a.x) AS t FROM p a JOIN p b ON a.key = b.key AND (a.x, a.y) <> (b.x, b.y)),
s AS (SELECT *, coalesce(lead(t) OVER w, first(t) OVER (PARTITION BY key, x, y ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 2 * pi()) - t AS gap FROM g WINDOW w AS (PARTITION BY key, x, y ORDER BY t)),
c AS (SELECT key, x, y FROM s GROUP BY ALL HAVING max(gap) > pi()),
m AS (SELECT key, avg(x) AS mx, avg(y) AS my, min(x) AS x0 FROM c GROUP BY 1),
o AS (SELECT key, x, y, atan2(y - my, x - mx) AS t, first(atan2(y - my, x - mx)) OVER (PARTITION BY key ORDER BY x, y) AS t0 FROM c JOIN m USING (key)),
h AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN t >= t0 THEN t - t0 ELSE t - t0 + 2 * pi() END) - 1 AS place, x, y FROM o),
z AS (SELECT a.key, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM h a JOIN h b ON a.key = b.key AND b.place = (a.place + 1) % (SELECT count(*) FROM h c WHERE c.key = a.key) GROUP BY 1)
"""


@query(_HULL + "SELECT key, place, round(x, 9) AS x, round(y, 9) AS y FROM h")
def hulls(t: Tables) -> DataFrame:
    """K7."""
    return shapes.hulls(t.embeddings.select("label", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y")), "label", "x", "y").select("key", "place", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _by_label(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").alias("key"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


@query(_HULL + "SELECT key, band, round(area / 3, 6) AS area FROM z, (VALUES (0), (1), (2)) b(band)")
def area_bands(t: Tables) -> DataFrame:
    """K8, K9: each label's hull in three bands along its axis; their areas are even."""
    bands = shapes.banded(_by_label(t), "key", "x", "y", 3)
    return bands.select("key", F.col("band").cast("int").alias("band"), F.round(F.abs(geo.signed_area(F.col("ring"))), 6).alias("area"))


@query(_HULL + "SELECT key, CAST(4 AS BIGINT) AS parts, round(area, 6) AS area, true AS even FROM z")
def density_parts(t: Tables) -> DataFrame:
    """Each label's hull cut into four where points are sparse, which lose no ground; put in two groups whose difference no
    single part exceeds."""

    def work(group):
        import numpy as np
        import pandas as pd

        points = group[["x", "y"]].to_numpy()
        parts = [p for p in shapes.density_split(shapes.hull(points), points, 4) if len(p) > 2]
        sizes = [shapes.area(p) for p in parts]
        sums = np.bincount(shapes.balanced(sizes, 2), weights=sizes, minlength=2)
        return pd.DataFrame([(str(group["key"].iloc[0]), len(parts), round(sum(sizes), 6), bool(abs(sums[0] - sums[1]) <= max(sizes) + 1e-9))], columns=["key", "parts", "area", "even"])

    return _by_label(t).groupBy("key").applyInPandas(work, "key string, parts long, area double, even boolean")


@query(
    """
SELECT event_id, json_extract_string(props, '$.page') AS page, TRY_CAST(json_extract_string(props, '$.ref') AS VARCHAR) AS ref FROM events
"""
)
def props_json(t: Tables) -> DataFrame:
    """L1, A8's parsing of maps."""
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(m, "page").alias("page"), F.element_at(m, "ref").alias("ref"))


@query(
    """
SELECT o_orderkey AS address, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a' || o_orderkey END AS label, CAST(o_orderkey AS DOUBLE) AS lat,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS lon, CASE WHEN o_orderkey % 3 = 2 THEN '0610' ELSE '' END AS postcode, o_orderkey % 5 <> 0 AS found
FROM orders
"""
)
def cache_json_parse(t: Tables) -> DataFrame:
    """A8, L4, T22."""
    k = F.col("o_orderkey")
    lon = F.when(k % 5 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    parts = F.when(k % 3 == 0, F.array(k.cast("string"), lon)).when(k % 3 == 1, F.array(F.concat(F.lit("a"), k.cast("string")), k.cast("string"), lon)).otherwise(F.array(F.concat(F.lit("a"), k.cast("string")), k.cast("string"), lon, F.lit("0610")))
    d = t.orders.select(k.alias("address"), files.hit_of(F.from_json(F.to_json(parts), "array<string>")).alias("h"))
    return d.select("address", "h.*", files.is_hit(F.col("h")).alias("found"))


@query(
    """
WITH g AS (SELECT CAST(s_suppkey % 40 AS VARCHAR) AS address, s_name AS label, CASE WHEN s_suppkey % 7 = 0 THEN 9.0 ELSE (s_suppkey % 17) / 100.0 END AS lat, 0.2 AS lon FROM supplier),
o AS (SELECT address, arg_min(struct_pack(label := label, lat := lat), (label, lat)) AS h FROM g WHERE lat BETWEEN -0.2 AND 0.2 GROUP BY 1),
q AS (SELECT c_custkey, unnest([CAST(c_custkey % 200 AS VARCHAR), CAST(c_custkey % 60 AS VARCHAR)]) AS address, unnest([0, 1]) AS nth FROM customer)
SELECT c.c_custkey, arg_min(o.h.label, nth) AS label, round(CAST(arg_min(o.h.lat, nth) AS DOUBLE), 6) AS lat FROM customer c LEFT JOIN (q JOIN o USING (address)) USING (c_custkey) GROUP BY 1
"""
)
def provider_cascade(t: Tables) -> DataFrame:
    """A13, N1-N8 without a network: queries in order, answers inside the region only."""
    k = F.col("s_suppkey")
    g = t.supplier.select((k % 40).cast("string").alias("address"), F.col("s_name").alias("label"), F.when(k % 7 == 0, 9.0).otherwise((k % 17) / 100.0).alias("lat"), F.lit(0.2).alias("lon"), F.lit("").alias("postcode"))
    c = F.col("c_custkey")
    found = geocoders.by_tables(t.customer.select("c_custkey"), "c_custkey", [(c % 200).cast("string"), (c % 60).cast("string")], [("gazetteer", g)], BOX)
    return found.select("c_custkey", "label", F.round("lat", 6).alias("lat"))


@query(
    """
WITH r AS (
  SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey % 90 + 1 AS VARCHAR) END AS number, o_orderkey % 50 = 0 AS other,
         ['Kauri Road', 'Kauri Road', 'Rimu Crescent', 'Rimu Crescent', 'Totara Street', ''][o_orderkey % 6 + 1] AS street FROM orders),
-- a third has coordinates; the gazetteer knows Kauri Road 1 to 60, and numbers up to 65 are near enough
p AS (SELECT *, k % 3 = 0 AS own, k % 3 = 0 OR (street = 'Kauri Road' AND number <> '' AND CAST(nullif(number, '') AS INTEGER) <= 65) AS point FROM r),
s AS (SELECT *, CASE WHEN other THEN 'Pass' WHEN number = '' OR street = '' OR NOT point THEN 'Fail' ELSE 'Pass' END AS status FROM p),
n AS (SELECT *, status = 'Pass' AND number <> '' AND street <> '' AND row_number() OVER (PARTITION BY status = 'Pass' AND number <> '' AND street <> '', number, street ORDER BY point DESC, k) > 1 AS again FROM s)
SELECT k AS o_orderkey, number, street, 'Eastfield' AS suburb, CASE WHEN again THEN 'Duplicate' ELSE status END AS final_status, CASE WHEN again OR status = 'Fail' THEN 'fail' ELSE 'clean' END AS route FROM n
"""
)
def scheduler_clean(t: Tables) -> DataFrame:
    """O5, N5, N6, O10 over orders as address rows: an outcome for every one."""
    k = F.col("o_orderkey")
    streets = F.array(*map(F.lit, ["Kauri rd", "Kauri Road", "Rimu Cresent", "Rimu Crescent, Eastfield", "Totara St", ""]))
    rows = t.orders.select(
        k.alias("_row_id"),
        F.when(k % 13 == 0, "").otherwise((F.col("o_custkey") % 90 + 1).cast("string")).alias("Number"),
        F.get(streets, (k % 6).cast("int")).alias("Street"),
        F.when(k % 4 == 0, "").otherwise("Eastfield").alias("Suburb"),
        F.col("o_orderpriority").alias("Status"),
        F.when(k % 50 == 0, "other").otherwise("House").alias("Type"),
        F.when(k % 3 == 0, "0.1").otherwise("").alias("Latitude"),
        F.when(k % 3 == 0, "0.1").otherwise("").alias("Longitude"),
    )
    gazetteer = t.spark.range(1, 61).select(F.col("id").cast("string").alias("number"), F.lit("Kauri Road").alias("street"), F.lit("Eastfield").alias("suburb"), (F.col("id") / 1000).alias("lat"), F.lit(0.05).alias("lon"), F.lit("0610").alias("postcode"))
    config = cleaning.Config(box=BOX, suburbs=["Eastfield"], unify=True)
    done = cleaning.scheduler(rows, gazetteer, config)
    return done.select(F.col("_row_id").alias("o_orderkey"), F.col("Number").alias("number"), F.col("Street").alias("street"), F.col("Suburb").alias("suburb"), F.col("Final Status").alias("final_status"), "route")


@query(
    """
WITH r AS (
  SELECT c_custkey AS k, c_custkey % 120 + 1 AS n, c_custkey % 5 = 0 AS unit, c_custkey % 17 = 0 AS bare, c_custkey % 34 = 0 AS is_new, c_custkey % 19 = 0 AS far, c_custkey % 2 = 0 AS kauri FROM customer),
s AS (
  SELECT *, bare AND NOT unit AND NOT is_new AS lacks, CASE WHEN bare THEN (CASE WHEN unit THEN 'A' ELSE '' END) ELSE (CASE WHEN unit THEN 'UnitA/' ELSE '' END) || n END AS number,
         kauri AND NOT bare AND n <= 30 AS known FROM r)
SELECT k AS c_custkey, number, CASE WHEN kauri THEN 'Kauri Road' ELSE 'Rimu Crescent' END AS street, CASE WHEN kauri THEN 'Eastfield' ELSE 'West Bay' END AS suburb,
       CASE WHEN lacks THEN 'Fail' WHEN known THEN 'Duplicate' WHEN far THEN 'Bad Geocode' ELSE 'Pass' END AS final_status, CASE WHEN lacks THEN 'missing number' ELSE '' END AS missing,
       CASE WHEN lacks OR known OR far THEN 'fail' ELSE 'clean' END AS route FROM s
"""
)
def sheets_clean(t: Tables) -> DataFrame:
    """O11, O12 over customers as sheet rows."""
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("_row_id"),
        F.lit("").alias("Type"),
        F.when(k % 5 == 0, "A").otherwise("").alias("Unit"),
        F.when(k % 17 == 0, "").otherwise((k % 120 + 1).cast("string")).alias("Number"),
        F.when(k % 2 == 0, "Kauri rd, Eastfield").otherwise("Rimu Cres, West Bay").alias("Street"),
        F.when(k % 34 == 0, "a new street").otherwise("").alias("Notes"),
        F.when(k % 19 == 0, "88").otherwise("0.1").alias("Latitude"),
        F.when(k % 19 == 0, "99").otherwise("0.1").alias("Longitude"),
    )
    master = t.spark.range(1, 31).select(F.when(F.col("id") % 5 == 1, "A").otherwise("").alias("ApartmentNumber"), F.col("id").cast("string").alias("Number"), F.lit("Kauri Road").alias("Street"))
    gazetteer = t.spark.createDataFrame([], "number string, street string, suburb string, lat double, lon double, postcode string")
    done = cleaning.sheets(rows, master, gazetteer, cleaning.Config(box=BOX))
    return done.select(F.col("_row_id").alias("c_custkey"), F.col("Number").alias("number"), F.col("Street").alias("street"), F.col("Suburb").alias("suburb"), F.col("Final Status").alias("final_status"), F.col("Missing Fields").alias("missing"), "route")


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderstatus = 'P' THEN 'rejected' ELSE 'new' END AS route FROM orders
"""
)
def stream_append_route(t: Tables) -> DataFrame:
    """The same rows as a batch, through a stream."""
    spark = t.spark
    work = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    d = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("4").alias("Number"), F.lit("Kauri Road").alias("Street"), F.col("o_orderstatus").alias("Type"), F.lit("").alias("Notes"), F.lit("").alias("Map"))
    d.repartition(3).write.parquet(f"{work}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(f"{work}/in")
    submissions.append(stream, ["F", "O"], f"{work}/out", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/out").select("o_orderkey", cascade([(F.col("route").isNotNull(), F.col("route"))], "").alias("route"))
