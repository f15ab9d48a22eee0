"""Queries of sources written and read again, of places, polygons, facts and functions by name."""

from __future__ import annotations

import sqlite3
import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalog import Tables, query
from waymark.functions import geo, numbers, registry, text
from waymark.operators import facts, polygons, shapes, tables
from waymark.plans import cleaning, places
from waymark.queries_joins import _CANON
from waymark.queries_shapes import _SIDES, AREAS, BOX, _areas
from waymark.sources import files, geocoders, geodata, shapefiles, workbooks
from waymark.stage import folder


def _place(t: Tables, name: str) -> str:
    return f"{folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, coalesce(props, '') AS props FROM events")
def csv_scan(t: Tables) -> DataFrame:
    """A1: quotes and commas inside, all columns texts."""
    path = _place(t, "csv")
    t.events.select("event_id", "event_type", "props").write.options(header=True, quote='"', escape='"').csv(path)
    return files.read_csv(t.spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'caf' || chr(233) || ' ' || chr(8220) || source || chr(8221) AS name FROM documents")
def csv_encodings(t: Tables) -> DataFrame:
    """A2: a western encoding is found, and its own quotation marks are read."""
    path = _place(t, "western")
    name = F.concat(F.lit("café \u0093"), "source", F.lit("\u0094"))  # as Latin-1, these are the bytes of the marks
    t.documents.select("doc_id", name.alias("name")).write.options(header=True, encoding="ISO-8859-1").csv(path)
    return files.read_csv(t.spark, path, None)


@query("SELECT CAST(p_partkey AS VARCHAR) AS part, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, p_name AS colour, '' AS nothing, true AS whole, false AS wider FROM part")
def header_rules(t: Tables) -> DataFrame:
    """Columns by their names' beginnings, by alias, or blank."""
    raw = t.part.select(F.col("p_partkey").alias("Part Key"), F.col("p_brand").alias(" BRAND"), F.col("p_size").alias("size (cm)"), F.col("p_name").alias("hue"))
    d = files.conformed(raw, ["part", "brand", "size", "colour", "nothing"], {"colour": ["shade", "HUE"]})
    return d.withColumns({"whole": F.lit(files.has_header(raw, ["Brand", "HUE "])), "wider": F.lit(files.has_header(raw, ["brand", "colour"]))})


@query("SELECT 'region-' || r_regionkey || '-new' AS value FROM region")
def newest_file(t: Tables) -> DataFrame:
    """A4: of a folder's files, the one written last."""
    path, spark = _place(t, "newest"), t.spark
    for state in ("old", "new"):
        t.region.select(F.format_string(f"region-%d-{state}", "r_regionkey").alias("value")).coalesce(1).write.mode("append").text(path)
    return spark.read.text(files.newest(spark, path, "*.txt"))


@query(f"SELECT c_custkey, {_CANON.format('c_mktsegment || c_nationkey')} AS key, c_acctbal AS lat, CAST(c_nationkey AS DOUBLE) AS lon, false AS stale, true AS absent FROM customer")
def indexed_store(t: Tables) -> DataFrame:
    """A text table with keys and split points, written for lookups by key; whether it is older than its source."""
    spark, source, target = t.spark, _place(t, "master"), _place(t, "index")
    t.customer.select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("street"), F.concat_ws(", ", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string")).alias("point")).write.options(header=True).csv(source)
    d = files.read_csv(spark, source).withColumn("p", files.split_point(F.col("point")))
    d = files.indexed(d.select(F.col("c_custkey").cast("long").alias("c_custkey"), "street", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")), target, {"key": text.canon_text("street")}, "key", 8)
    return d.select("c_custkey", "key", "lat", "lon", F.lit(files.is_stale(spark, source, target)).alias("stale"), F.lit(files.is_stale(spark, source, target + "-none")).alias("absent"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS number, n_name AS street, '' AS suburb, 1 AS left_out FROM nation UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), 1 FROM supplier")
def folder_union(t: Tables) -> DataFrame:
    """Files with the required columns under one header; one that lacks them is named."""
    a, b, c = (_place(t, n) for n in ("nations", "suppliers", "regions"))
    t.nation.select(F.col("n_nationkey").alias("Number"), F.col("n_name").alias("STREET")).write.options(header=True).csv(a)
    t.supplier.select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("Street"), F.col("s_nationkey").alias("Suburb")).write.options(header=True).csv(b)
    t.region.select(F.col("r_name").alias("Street")).write.options(header=True).csv(c)
    found, left = files.read_folder(t.spark, [a, b, c], ["number", "street"])
    return found.select("number", "street", "suburb", F.lit(len(left)).alias("left_out"))


@query("SELECT 's' || s_suppkey AS address, s_name AS label, s_acctbal AS lat, CAST(s_nationkey AS DOUBLE) AS lon, '0' || s_nationkey AS postcode FROM supplier")
def cache_round_trip(t: Tables) -> DataFrame:
    """Lookups as sorted JSON in chunks, and read again."""
    path = _place(t, "cache")
    k = F.col("s_nationkey").cast("string")
    files.write_cache(t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("address"), F.col("s_name").alias("label"), F.col("s_acctbal").alias("lat"), F.col("s_nationkey").cast("double").alias("lon"), F.concat(F.lit("0"), k).alias("postcode")), path, 7)
    return files.read_cache(t.spark, path)


@query(
    """
WITH s AS (SELECT s_name AS address, (row_number() OVER (ORDER BY s_name) - 1) // 7 AS chunk FROM supplier)
SELECT chunk, count(*) AS n, min(address) AS first, max(address) AS last, sha256('{' || string_agg('"' || address || '":["' || address || '","","",""]', ',' ORDER BY address) || '}') AS sha256 FROM s GROUP BY 1
"""
)
def cache_manifest(t: Tables) -> DataFrame:
    """What the chunks hold; the same entries give the same digests."""
    none = F.lit("")
    return files.write_cache(t.supplier.repartition(5).select(F.col("s_name").alias("address"), F.col("s_name").alias("label"), none.alias("lat"), none.alias("lon"), none.alias("postcode")), _place(t, "chunks"), 7)


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 7 <> 3 OR c_mktsegment <> 'BUILDING'")
def cache_without_keys(t: Tables) -> DataFrame:
    """A cache less the entries of some streets in some suburbs."""
    gone = t.nation.where("n_nationkey % 7 = 3").select(F.format_string(" Street %d", "n_nationkey").alias("street"), F.lit("building ").alias("suburb"))
    d = t.customer.select("c_custkey", "c_mktsegment", F.format_string("street %d", "c_nationkey").alias("street"))
    return files.without_keys(d, gone, F.col("street"), F.col("c_mktsegment")).select("c_custkey")


@query(f"WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES}) SELECT name, named_by, CAST(count(*) + 1 AS INTEGER) AS points, round(sum(x1), 6) AS xs FROM a, (VALUES ('file'), ('placemark')) b(named_by) GROUP BY 1, 2")
def kml_scan(t: Tables) -> DataFrame:
    """Areas as KML documents, read by file and by placemark; the ring comes back closed."""
    docs = geodata.kml_documents(_areas(t)).select(F.concat("name", F.lit(".kml")).alias("path"), F.encode("value", "UTF-8").alias("content"))
    found = [geodata.kml_areas(docs, by).withColumn("named_by", F.lit(by)) for by in ("file", "placemark")]
    ring = F.slice("ring", 1, F.size("ring") - 1)
    return found[0].unionByName(found[1]).select("name", "named_by", F.size("ring").alias("points"), F.round(F.aggregate(F.transform(ring, lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x), 6).alias("xs"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, '' AS absent, (SELECT count(*) FROM region) AS regions FROM nation")
def workbook_scan(t: Tables) -> DataFrame:
    """A workbook of three sheets written, one read by name and one as the first for want of the name."""
    path = _place(t, "book") + ".xlsx"
    workbooks.write_workbook(t.spark, {"Regions": t.region, "Streets": t.nation, "Empty": t.nation.where("false")}, path)
    book = t.spark.read.format("binaryFile").load(path)
    regions = workbooks.read_workbooks(book, ["r_name"], "No such sheet").agg(F.count(F.lit(1)).alias("regions"))
    return workbooks.read_workbooks(book, ["N_NATIONKEY", "n_name", "absent"], "Streets").crossJoin(F.broadcast(regions)).select(F.col("N_NATIONKEY").alias("n_nationkey"), "n_name", "absent", "regions")


_AREA_FILES = f"WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES}), m AS (SELECT name, suburb, round(abs(sum(x1 * y2 - x2 * y1) / 2), 9) AS area FROM a GROUP BY 1, 2) "


@query(_AREA_FILES + "SELECT name, suburb, area FROM m")
def shapefile_scan(t: Tables) -> DataFrame:
    """Polygons and their attributes out of a shapefile's parts."""
    shp, dbf = shapefiles.shapefile([p for _, _, p in AREAS], [{"NAME": n, "SUBURB": s} for n, s, _ in AREAS])
    found = shapefiles.read_shapefiles(t.spark.createDataFrame([("x/areas.shp", shp), ("x/areas.dbf", dbf), ("x/areas.prj", b"")], "path string, content binary"))
    return found.select(F.col("attributes")["NAME"].alias("name"), F.col("attributes")["SUBURB"].alias("suburb"), F.round(F.abs(geo.signed_area(F.col("ring"))), 9).alias("area"))


def _geopackage() -> bytes:
    db = sqlite3.connect(":memory:")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('areas', 'geom')")
    db.execute("create table areas (fid integer primary key, geom blob, name text, suburb text)")
    for i, (name, suburb, points) in enumerate(AREAS):
        ring = [*points, points[0]]
        wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
        db.execute("insert into areas values (?, ?, ?, ?)", (i, b"GP\x00\x01" + struct.pack("<i", 4326) + wkb, name, suburb))
    db.commit()
    return db.serialize()


@query(_AREA_FILES + "SELECT name, suburb, area FROM m WHERE suburb LIKE 'w%'")
def geopackage_scan(t: Tables) -> DataFrame:
    """Polygons out of a GeoPackage, with an attribute filter."""
    found = shapefiles.read_geopackages(t.spark.createDataFrame([("x/areas.gpkg", _geopackage())], "path string, content binary"), "areas")
    return found.where("attributes['suburb'] ilike 'W%'").select(F.col("attributes")["name"].alias("name"), F.col("attributes")["suburb"].alias("suburb"), F.round(F.abs(geo.signed_area(F.col("ring"))), 9).alias("area"))


@query("SELECT 'a_' || r.r_regionkey AS area_stem, CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'clean' END AS outcome, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation JOIN region r ON n_regionkey = r_regionkey GROUP BY ALL")
def area_files(t: Tables) -> DataFrame:
    """A folder for each area and outcome, read again."""
    path = _place(t, "areas")
    d = t.nation.select("n_nationkey", F.concat(F.lit("a/"), F.col("n_regionkey").cast("string")).alias("area"), F.lit("x").alias("_internal"))
    files.write_areas(d, path, "area", F.col("n_nationkey") % 4 == 0)
    return t.spark.read.option("header", True).csv(path).groupBy("area_stem", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_nationkey").cast("long")).alias("keys"))


def _answers(start: int):
    async def ask(address: str):
        k = int(address[1:])
        if start == 2:
            return (address, 80.0, 80.0, "9")  # outside: never accepted
        if start == 3:
            raise OSError("no answer")
        return (address, k / 1000, 0.1, "1") if k % 2 == start else None

    return ask


def _providers():
    return [(f"p{i}", _answers(i), 0.0) for i in range(4)]


@query("SELECT DISTINCT 'c' || c_custkey % 150 AS address, 'p' || c_custkey % 150 % 2 AS provider, c_custkey % 150 / 1000 AS lat, '1' AS postcode FROM customer")
def provider_race(t: Tables) -> DataFrame:
    """Providers asked at once, the first answer inside the region wins; one fails, one is always outside."""
    asked = t.customer.select(F.concat(F.lit("c"), (F.col("c_custkey") % 150).cast("string")).alias("a"))
    return geocoders.geocoded(asked, "a", _providers, BOX).select("address", "provider", "lat", "postcode")


@query(
    """
WITH g AS (SELECT CAST(s_suppkey % 40 AS VARCHAR) AS address, s_nationkey % 5 AS l, (s_suppkey % 17) / 100.0 AS lat FROM supplier),
h AS (SELECT DISTINCT 'n' || n_nationkey % 5 AS label, CAST(n_nationkey AS VARCHAR) AS address, n_nationkey / 100.0 AS lat FROM nation WHERE n_nationkey <= 20),
b AS (SELECT address, 'n' || l AS label, round(CAST(lat AS DOUBLE), 6) AS lat, 0 AS i FROM g UNION ALL SELECT address, label, round(CAST(lat AS DOUBLE), 6), 1 FROM h)
SELECT c_custkey, 'n' || right(label, 1) AS label, lat, CASE min(i) WHEN 0 THEN 'first' ELSE 'second' END AS provider FROM customer JOIN b ON address = CAST(c_custkey % 40 AS VARCHAR) GROUP BY ALL
"""
)
def probe_all(t: Tables) -> DataFrame:
    """All answers of all tables, each place once."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    a = t.supplier.select((k % 40).cast("string").alias("address"), F.format_string("n%d", F.col("s_nationkey") % 5).alias("label"), ((k % 17) / 100).alias("lat"), F.lit(0.1).alias("lon"), F.lit("").alias("postcode"))
    b = t.nation.select(n.cast("string").alias("address"), F.format_string("n%d", n % 5).alias("label"), F.when(n <= 20, n / 100).otherwise(9.0).alias("lat"), F.lit(0.1).alias("lon"), F.lit("").alias("postcode"))
    asked = t.customer.select("c_custkey", (F.col("c_custkey") % 40).cast("string").alias("a"))
    return geocoders.probed_all(asked, "c_custkey", "a", [("first", a), ("second", b)], BOX).select("c_custkey", "label", "lat", "provider")


@query(
    """
WITH s AS (SELECT c_custkey AS k, c_custkey % 30 + 1 AS n, c_custkey % 4 AS kind FROM customer)
SELECT k AS c_custkey, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'English' WHEN 2 THEN 'tbc' ELSE '' END AS language, CASE WHEN kind = 3 THEN 'Rimu Road' ELSE n || 'x Kauri Road' END AS street,
       'caf' || chr(233) || ' - bar' AS repaired, 'a b c' AS plain, kind = 1 AS unit, CAST(n AS VARCHAR) AS number, printf('%.8f', n / 7.0::DOUBLE) AS fixed FROM s
"""
)
def small_repairs(t: Tables) -> DataFrame:
    """Labels blanked, corruptions put right, a street's own number and a unit taken off, fixed digits."""
    kind, n = F.col("c_custkey") % 4, F.col("c_custkey") % 30 + 1
    number = F.when(kind == 1, F.concat(F.lit("UnitA/"), n.cast("string"))).otherwise(n.cast("string"))
    street = F.when(kind == 3, F.concat(n.cast("string"), F.lit("x Rimu Road"))).otherwise(F.concat(n.cast("string"), F.lit("x Kauri Road")))
    asked = F.when(kind == 3, number).otherwise(F.lit("999"))
    label = F.get(F.array(*map(F.lit, (" N/A ", "English", "tbc", "none"))), kind.cast("int"))
    return t.customer.select(
        "c_custkey",
        text.clean_label(label, ["n/a", "None"]).alias("language"),
        numbers.without_leading_number(asked, street).alias("street"),
        text.repair(F.lit("cafÃ© â€“ bar"), {"Ã©": "é", " â€“ ": " - "}).alias("repaired"),
        text.strip_punctuation(F.lit(" a,b;  c! ")).alias("plain"),
        numbers.has_unit(number).alias("unit"),
        numbers.without_unit(number).alias("number"),
        geo.fixed8(n / 7.0).alias("fixed"),
    )


@query("SELECT c_nationkey, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def first_row_probe(t: Tables) -> DataFrame:
    """the first matching row, in a total order."""
    from waymark import rank

    return rank.first_by(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)")
def report_examples(t: Tables) -> DataFrame:
    """the number of rows, and fifty of them as a report shows them."""
    n, some = tables.examples(t.orders, [F.desc("o_totalprice"), "o_orderkey"])
    return some.crossJoin(F.broadcast(n)).select("o_orderkey", "n")


@query(f"WITH a(name, suburb, x1, y1, x2, y2) AS (VALUES {_SIDES}) SELECT name, CAST(count(*) AS INTEGER) AS points, round(sum(x1), 9) AS xs FROM a GROUP BY 1")
def collinear_prune(t: Tables) -> DataFrame:
    """Points put in the middle of each side go again."""
    ring = F.col("ring")
    n = F.size(ring)
    double = F.flatten(F.transform(ring, lambda p, i: F.array(p, F.struct(((p["x"] + F.get(ring, (i + 1) % n)["x"]) / 2).alias("x"), ((p["y"] + F.get(ring, (i + 1) % n)["y"]) / 2).alias("y")))))
    d = _areas(t).withColumn("ring", double).withColumn("ring", geo.without_collinear(F.col("ring")))
    return d.select("name", F.size("ring").alias("points"), F.round(F.aggregate(F.transform("ring", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x), 9).alias("xs"))


@query(
    """
WITH p AS (SELECT vec_id, radians(CAST(embedding[1] AS DOUBLE) * 4) AS lam, radians(-40 + CAST(embedding[2] AS DOUBLE) * 10) AS phi FROM embeddings),
-- the ellipsoid's meridian arc and the classic series in the longitude, to the seventh order
c AS (SELECT 6378137.0::DOUBLE AS a, (2 - 1 / 298.257222101) / 298.257222101 AS e2),
s AS (SELECT vec_id, a, e2, lam * cos(phi) AS q, pow(tan(phi), 2) AS u, e2 / (1 - e2) * pow(cos(phi), 2) AS w, a / sqrt(1 - e2 * pow(sin(phi), 2)) AS v, tan(phi) AS tn,
  a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256 - 175 * pow(e2, 4) / 16384) * phi - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024 + 105 * pow(e2, 4) / 4096) * sin(2 * phi)
       + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024 + 525 * pow(e2, 4) / 16384) * sin(4 * phi) - (35 * pow(e2, 3) / 3072 + 175 * pow(e2, 4) / 12288) * sin(6 * phi) + 315 * pow(e2, 4) / 131072 * sin(8 * phi)) AS m
  FROM p, c)
SELECT vec_id, round(1600000 + 0.9996 * v * (q + (1 - u + w) * pow(q, 3) / 6 + (5 - 18 * u + u * u + 72 * w - 58 * e2 / (1 - e2)) * pow(q, 5) / 120), 1) AS east,
       round(10000000 + 0.9996 * (m + v * tn * (q * q / 2 + (5 - u + 9 * w + 4 * w * w) * pow(q, 4) / 24 + (61 - 58 * u + u * u + 600 * w - 330 * e2 / (1 - e2)) * pow(q, 6) / 720)), 1) AS north
FROM s
"""
)
def grid_places(t: Tables) -> DataFrame:
    """Longitudes and latitudes as metres of the grid, against another series for the same projection."""
    from collections.abc import Iterator

    import pandas as pd

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xy = shapes.to_grid(b[["lon", "lat"]].to_numpy())
            yield pd.DataFrame({"vec_id": b["vec_id"], "east": xy[:, 0], "north": xy[:, 1]})

    p = t.embeddings.select("vec_id", (F.lit(173.0) + F.element_at("embedding", 1).cast("double") * 4).alias("lon"), (F.lit(-40.0) + F.element_at("embedding", 2).cast("double") * 10).alias("lat"))
    return p.mapInPandas(work, "vec_id long, east double, north double").select("vec_id", F.round("east", 1).alias("east"), F.round("north", 1).alias("north"))


# Boxes of embeddings: a lower left corner and a size.
_BOXES = "WITH b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 0.01 + abs(CAST(embedding[3] AS DOUBLE)) AS w, 0.01 + abs(CAST(embedding[4] AS DOUBLE)) AS h FROM embeddings)"


def _boxes(t: Tables, low: bool = False) -> DataFrame:
    """As rings; ``low``: all from 0 to 1 upwards."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    b = t.embeddings.select("vec_id", "label", at(1).alias("x"), (F.lit(0.0) if low else at(2)).alias("y"), (F.lit(0.01) + F.abs(at(3))).alias("w"), (F.lit(1.0) if low else F.lit(0.01) + F.abs(at(4))).alias("h"))
    corner = lambda i, j: F.struct((F.col("x") + i * F.col("w")).alias("x"), (F.col("y") + j * F.col("h")).alias("y"))
    return b.select("vec_id", "label", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query(
    _BOXES
    + """
, o AS (SELECT label, x, x + w AS e, max(x + w) OVER (PARTITION BY label ORDER BY x, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT CAST(label AS VARCHAR) AS name, CAST(count(*) FILTER (WHERE before IS NULL OR before < x) AS BIGINT) AS rings, round(sum(greatest(0, e - greatest(x, coalesce(before, x)))), 6) AS area FROM o GROUP BY 1
"""
)
def dissolved_boxes(t: Tables) -> DataFrame:
    """Each label's boxes, all of one height, joined; against the union of their sides."""
    d = polygons.dissolved(_boxes(t, True), "label")
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("rings"), F.round(F.sum(geo.signed_area(F.col("ring"))), 6).alias("area"))


_LAND = [("north", [(-0.15, 0.0), (0.15, 0.0), (0.15, 0.3), (-0.15, 0.3)]), ("south", [(-0.05, -0.3), (0.2, -0.3), (0.2, -0.05), (-0.05, -0.05)])]


@query(
    _BOXES
    + """
, m(w1, s1, e1, n1) AS (VALUES (-0.15, 0.0, 0.15, 0.3), (-0.05, -0.3, 0.2, -0.05)),
c AS (SELECT vec_id, greatest(0, least(x + w, e1) - greatest(x, w1)) * greatest(0, least(y + h, n1) - greatest(y, s1)) AS area FROM b, m)
SELECT vec_id, round(sum(area), 6) AS area FROM c GROUP BY 1 HAVING sum(area) > 1e-5
"""
)
def clipped_boxes(t: Tables) -> DataFrame:
    """Boxes where they lie on land."""
    land = t.spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in p]) for n, p in _LAND], "name string, ring array<struct<x:double,y:double>>")
    d = polygons.clipped(_boxes(t).select(F.col("vec_id").cast("string").alias("name"), "ring"), land)
    return d.groupBy(F.col("name").cast("long").alias("vec_id")).agg(F.sum(geo.signed_area(F.col("ring"))).alias("area")).where("area > 1e-5").select("vec_id", F.round("area", 6).alias("area"))


@query(
    _BOXES
    + """
, p AS (SELECT vec_id, unnest([w * h * 0.25, w * h * 0.75 * 0.5, w * h * 0.75 * 0.5]) AS area FROM b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY area DESC) - 1 AS INTEGER) AS place, round(area, 7) AS area FROM p
"""
)
def box_sections(t: Tables) -> DataFrame:
    """Each box cut by a line across it and one from that to its side; a third line ends inside and cuts nothing off."""
    b = _boxes(t).select(F.col("vec_id").cast("string").alias("name"), "ring")
    low, high = F.col("ring")[0], F.col("ring")[2]
    at = lambda i, j: F.struct((low["x"] + i * (high["x"] - low["x"])).alias("x"), (low["y"] + j * (high["y"] - low["y"])).alias("y"))
    lines = b.select("name", F.explode(F.array(F.array(at(0.25, -0.5), at(0.25, 1.5)), F.array(at(0.25, 0.5), at(1.5, 0.5)), F.array(at(0.5, 0.6), at(0.7, 0.8)))).alias("line"))
    d = polygons.sections(b, lines)
    return d.select(F.col("name").cast("long").alias("vec_id"), "place", F.round(geo.signed_area(F.col("ring")), 7).alias("area"))


@query("SELECT vec_id, true AS near, true AS whole FROM embeddings")
def road_corridors(t: Tables) -> DataFrame:
    """The ground within 0.02 of a road, inside a box: no corner of it is farther from the road, and where the box is as wide as the
    corridor it has the area of the road's strip."""
    import pandas as pd

    at = lambda i: F.element_at("embedding", i).cast("double")
    roads = t.embeddings.select("vec_id", at(1).alias("x"), at(2).alias("y"), (F.lit(0.05) + F.abs(at(3))).alias("w"))

    def work(batches):
        for b in batches:
            rows = []
            for k, x, y, w in zip(b["vec_id"], b["x"], b["y"], b["w"], strict=True):
                line = np.array([(x, y), (x + w, y), (x + w, y + w)])
                ring = np.array([(x, y - 1), (x + w / 2, y - 1), (x + w / 2, y + 1), (x, y + 1)])  # the first half of the first stretch
                found = polygons.common(polygons.corridor(line, 0.02), [ring])
                far = max(shapes.to_segment(r, line[0], line[1]).max() for r in found)
                rows.append((k, bool(far < 0.0200001), bool(abs(sum(map(shapes.signed_area, found)) - 0.04 * w / 2) < 1e-5)))
            yield pd.DataFrame(rows, columns=["vec_id", "near", "whole"])

    return roads.mapInPandas(work, "vec_id long, near boolean, whole boolean")


@query("SELECT CAST(vec_id AS VARCHAR) AS name, true AS fits, true AS near, true AS fewer FROM embeddings")
def reduced_rings(t: Tables) -> DataFrame:
    """Rings of 400 points brought down to the bytes of a KML document, five metres off at most."""
    r = F.lit(40.0) + 20 * F.abs(F.element_at("embedding", 1).cast("double"))
    turn = lambda i: i * (2 * np.pi / 400)
    ring = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.struct((r * F.cos(turn(i))).alias("x"), (r * F.sin(turn(i))).alias("y")))
    d = shapes.reduced(t.embeddings.select(F.col("vec_id").cast("string").alias("name"), ring.alias("ring")), lambda p: geodata.kml_size(p.tolist()), 3000)
    return d.select("name", (F.col("bytes") <= 3000).alias("fits"), (F.col("distance") <= 5).alias("near"), (F.size("ring") < 200).alias("fewer"))


def _gazetteer(t: Tables) -> DataFrame:
    return t.spark.range(1, 61).select(F.col("id").cast("string").alias("number"), F.lit("Kauri Road").alias("street"), F.when(F.col("id") <= 40, "Eastfield").otherwise("West Bay").alias("suburb"), (F.col("id") / 1000).alias("lat"), F.lit(0.05).alias("lon"), F.concat(F.lit("06"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("postcode"))


@query(
    """
WITH r AS (SELECT o_orderkey AS k, o_custkey % 70 + 1 AS n, o_orderkey % 4 = 0 AS own, o_orderkey % 7 = 0 AS unit FROM orders),
-- Eastfield has 1 to 40: the number itself, or the first from five below that is there
h AS (SELECT *, CASE WHEN n <= 40 THEN n WHEN n - 5 <= 40 THEN n - 5 END AS hit FROM r)
SELECT k AS o_orderkey, CASE WHEN own THEN 0.1 ELSE round(hit / 1000, 6) END AS lat, CASE WHEN own OR hit IS NULL THEN '' ELSE '06' || lpad(CAST(hit AS VARCHAR), 2, '0') END AS postcode,
       CASE WHEN own THEN 'input' WHEN hit IS NOT NULL THEN 'gazetteer' ELSE '' END AS source FROM h
"""
)
def filled_places(t: Tables) -> DataFrame:
    """Coordinates of rows without any, by number, without the unit, then by numbers near it."""
    k = F.col("o_orderkey")
    n = (F.col("o_custkey") % 70 + 1).cast("string")
    d = t.orders.select(k.alias("_row_id"), F.when(k % 7 == 0, F.concat(F.lit("UnitB/"), n)).otherwise(n).alias("Number"), F.lit("Kauri Road").alias("Street"), F.lit("Eastfield").alias("Suburb"), F.lit("").alias("PostalCode"), F.when(k % 4 == 0, 0.1).alias("_lat"), F.when(k % 4 == 0, 0.1).alias("_lon"))
    d = places.verified_or_filled(d, _gazetteer(t), BOX)
    return d.select(F.col("_row_id").alias("o_orderkey"), F.round("_lat", 6).alias("lat"), F.col("PostalCode").alias("postcode"), F.col("_source").alias("source"))


@query(
    """
WITH r AS (SELECT o_orderkey AS k, o_custkey % 70 + 1 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'Pass' ELSE 'Fail' END AS outcome FROM orders)
SELECT k AS o_orderkey, CASE WHEN outcome = 'Fail' AND n <= 60 THEN 'Pass' ELSE outcome END AS outcome, CASE WHEN outcome = 'Fail' AND n <= 60 THEN 'retry' ELSE '' END AS source FROM r
"""
)
def retried_rows(t: Tables) -> DataFrame:
    """Failed rows looked up again by street and number, and promoted."""
    d = t.orders.select(F.col("o_orderkey").alias("_row_id"), (F.col("o_custkey") % 70 + 1).cast("string").alias("Number"), F.lit("Kauri Road").alias("Street"), F.lit("Nowhere").alias("Suburb"), F.lit("").alias("PostalCode"), F.lit(None).cast("double").alias("_lat"), F.lit(None).cast("double").alias("_lon"), F.when(F.col("o_orderkey") % 3 == 0, "Pass").otherwise("Fail").alias("outcome"))
    d = places.retried(d, _gazetteer(t), BOX, F.col("outcome") == "Fail", "outcome")
    return d.select(F.col("_row_id").alias("o_orderkey"), "outcome", F.col("_source").alias("source"))


@query(
    """
WITH r AS (SELECT vec_id, 'Street ' || vec_id % 37 AS street, 'S' || label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
p AS (SELECT * FROM r WHERE lat BETWEEN -0.2 AND 0.2 AND lon BETWEEN -0.25 AND 0.25),
c AS (SELECT street, avg(lat) AS cy, avg(lon) AS cx FROM p GROUP BY 1),
m AS (SELECT p.*, 6371000.0 * sqrt(pow(radians(cx - lon) * cos(radians((lat + cy) / 2)), 2) + pow(radians(cy - lat), 2)) AS d FROM p JOIN c USING (street)),
a AS (SELECT street, label, count(*) AS n, min(vec_id) AS first, sum(count(*)) OVER (PARTITION BY street) AS total, avg(d) AS mean FROM m GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, first, label) AS nth FROM a),
e AS (SELECT street, label, CASE WHEN n = total THEN 'only' WHEN n >= greatest(3, floor(0.7 * total)) THEN 'plurality' END AS how FROM l WHERE nth = 1),
k AS (SELECT street, label, count(*) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY d, vec_id) AS nth FROM m) WHERE nth <= 3 GROUP BY 1, 2),
v AS (SELECT street, arg_max(label, votes) AS top, count(*) FILTER (WHERE votes = most) = 1 AS alone FROM (SELECT *, max(votes) OVER (PARTITION BY street) AS most FROM k) GROUP BY 1),
w AS (SELECT street, arg_min(label, (mean, label)) AS nearest FROM a GROUP BY 1)
SELECT r.vec_id, coalesce(CASE WHEN how IS NOT NULL THEN e.label WHEN alone THEN top ELSE nearest END, r.label) AS suburb,
       CASE WHEN e.street IS NULL THEN NULL WHEN how IS NOT NULL THEN how WHEN alone THEN 'nearest' ELSE 'mean' END AS settled
FROM r LEFT JOIN e USING (street) LEFT JOIN v USING (street) LEFT JOIN w USING (street)
"""
)
def settled_suburbs(t: Tables) -> DataFrame:
    """One suburb for each street, by where its rows lie."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    d = t.embeddings.select(F.col("vec_id").alias("_row_id"), F.lit("").alias("Number"), F.format_string("street %d", F.col("vec_id") % 37).alias("Street"), F.format_string("s%d", F.col("label") % 3).alias("Suburb"), F.lit("").alias("PostalCode"), at(1).alias("_lat"), at(2).alias("_lon"))
    d = places.suburbs_settled(d, _gazetteer(t), BOX)
    return d.select(F.col("_row_id").alias("vec_id"), F.initcap("Suburb").alias("suburb"), "settled")


@query(
    """
WITH k AS (SELECT DISTINCT 'Street ' || n_nationkey % 9 AS street, 'Suburb ' || n_regionkey AS suburb FROM nation UNION SELECT 'Kauri Road', 'Eastfield' UNION SELECT 'Kauri Road', 'West Bay'),
w AS (SELECT DISTINCT 'Street ' || n_nationkey % 9 AS street, 'Suburb ' || n_regionkey AS suburb FROM nation WHERE n_nationkey % 2 = 0)
SELECT '1' AS number, street, suburb, CASE WHEN suburb = 'Eastfield' THEN '0.00100000' ELSE '' END AS latitude, (SELECT count(*) > 1 FROM k x WHERE x.street = k.street) AS several
FROM k WHERE (street, suburb) NOT IN (SELECT street, suburb FROM w)
"""
)
def missing_addresses(t: Tables) -> DataFrame:
    """Streets that are known but not there, as rows to clean, with the first number that the gazetteer has."""
    pairs = lambda d: d.select(F.format_string("street %d", F.col("n_nationkey") % 9).alias("street"), F.format_string("SUBURB %d ", "n_regionkey").alias("suburb"))
    known = pairs(t.nation).union(t.spark.createDataFrame([("Kauri road", "Eastfield"), ("KAURI ROAD", "West bay")], "street string, suburb string"))
    d = places.new_addresses(known, pairs(t.nation.where("n_nationkey % 2 = 0")), _gazetteer(t), BOX)
    return d.select(F.col("Number").alias("number"), F.col("Street").alias("street"), F.col("Suburb").alias("suburb"), F.col("Latitude").alias("latitude"), F.col("several_suburbs").alias("several"))


@query(
    """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Own' WHEN 1 THEN 'Eastfield' ELSE CASE WHEN c_custkey % 8 = 2 THEN 'west' ELSE '' END END AS suburb,
       CASE c_custkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'comma' ELSE CASE WHEN c_custkey % 8 = 2 THEN 'area' ELSE 'unresolved' END END AS reason FROM customer
"""
)
def backfilled_suburbs(t: Tables) -> DataFrame:
    """A suburb from the street's comma, else from the area that holds the point, with the reason."""
    k = F.col("c_custkey")
    d = t.customer.select(k.alias("_row_id"), F.when(k % 4 == 0, "Own").otherwise("").alias("Suburb"), F.when(k % 4 == 1, "Kauri Road, Eastfield").otherwise("Kauri Road").alias("Street"))
    areas_of = t.customer.where("c_custkey % 8 in (1, 2)").select(k.alias("_row_id"), F.lit("west").alias("area"))
    return cleaning.backfilled(d, areas_of).select(F.col("_row_id").alias("c_custkey"), F.col("Suburb").alias("suburb"), "reason")


@query(f"SELECT c_custkey, {_CANON.format('c_mktsegment || c_nationkey')} AS key, c_custkey % 3 <> 2 AS valid, round(6371000.0 * sqrt(pow(radians(0.1) * cos(radians(c_nationkey / 2)), 2) + pow(radians(CAST(c_nationkey AS DOUBLE)), 2)), 3) AS metres FROM customer")
def functions_by_name(t: Tables) -> DataFrame:
    """Q1: rules called by name in SQL."""
    registry.register(t.spark, "wm_")
    t.customer.createOrReplaceTempView("wm_customers")
    return t.spark.sql("""
        SELECT c_custkey, wm_canon_text(c_mktsegment || c_nationkey) AS key, wm_is_house_number(element_at(array('12A', 'UnitB/3-5', 'x'), cast(c_custkey % 3 + 1 as int))) AS valid,
               round(wm_flat_metres(0, 0, c_nationkey, 0.1), 3) AS metres FROM wm_customers""")


@query(
    """
WITH f AS (SELECT 'n' || n_nationkey || '.py' AS path, n_nationkey AS k FROM nation)
SELECT path, kind, name, CAST(line AS BIGINT) AS line FROM f, LATERAL (VALUES ('import', 'os.path', 1), ('function', 'f' || k, 2), ('call', 'open', 3), ('writes', 'out' || k || '.csv', 3), ('call', 'g.read_csv', 4), ('reads', 'in.csv', 4), ('host', 'example.org', 5)) v(kind, name, line)
"""
)
def source_facts(t: Tables) -> DataFrame:
    """What Python files define, import, call, read and write."""
    k = F.col("n_nationkey").cast("string")
    code = F.concat(F.lit("from os import path\ndef f"), k, F.lit("():\n    open('out"), k, F.lit(".csv', 'w')\n    return g.read_csv('in.csv')\n# https://example.org/x\n"))
    return facts.facts(t.nation.select(F.concat(F.lit("n"), k, F.lit(".py")).alias("path"), code.alias("content")))


@query("SELECT n_nationkey, n_name FROM nation")
def fresh_table(t: Tables) -> DataFrame:
    """A table that is built once and read again while it is fresh."""
    target = _place(t, "fresh")
    files.kept_fresh(t.spark, target, 3600, lambda: t.nation.select("n_nationkey", "n_name"))
    return files.kept_fresh(t.spark, target, 3600, lambda: t.nation.where("false").select("n_nationkey", "n_name"))
