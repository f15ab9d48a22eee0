"""What must hold whatever the rows and their order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import rank
from waymark.functions.geo import Box
from waymark.functions.text import split_suffix
from waymark.operators import entity, graph, joins, routing, shapes, spatial, tables
from waymark.plans import cleaning
from waymark.sources import files, geocoders, geodata


def test_row_ids_do_not_depend_on_partitions(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("k"))
    want = {r.id: i for i, r in enumerate(sorted(d.collect(), key=lambda r: (r.k, r.id)), 1)}
    for n in (1, 4, 32):
        got = {r.id: r._row_id for r in rank.with_row_id(d.repartition(n), ["k", "id"]).collect()}
        assert got == want


def test_mode_takes_the_first_seen(spark):
    d = spark.createDataFrame([("a", "y", 2), ("a", "x", 3), ("a", "x", 5), ("a", "y", 4), ("b", "z", 9)], "k string, v string, i long")
    for n in (1, 4, 32):
        assert {r.k: r.v for r in rank.mode_first_seen(d.repartition(n), ["k"], "v", "i").collect()} == {"a": "y", "b": "z"}


def test_keep_best(spark):
    d = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True), (4, "", False), (5, "", False), (6, None, True)], "i long, key string, good boolean")
    assert {r.i for r in tables.keep_best(d, "key", F.col("good"), "i").where("kept").collect()} == {2, 4, 5, 6}


def test_routing_is_a_partition_and_repeats_nothing(spark):
    d = spark.createDataFrame([(1, " PASS "), (2, "ok"), (3, ""), (4, None), (5, "Fail")], "i long, s string")
    once = routing.routed(d, "s")
    assert {r.i for r in once.where("route = 'clean'").collect()} == {1, 2}
    assert once.collect() == routing.routed(once.drop("route"), "s").collect()
    assert once.count() == 5


def test_missing_keeps_blank_keys(spark):
    d = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "b")], "i long, k string")
    there = spark.createDataFrame([("a",), ("",), (None,)], "k string")
    assert sorted(r.i for r in joins.missing(d, there, ["k"]).collect()) == [2, 3, 4]


def test_union_by_name(spark):
    a, b = spark.createDataFrame([("1", "x")], "id string, only_a string"), spark.createDataFrame([("2", "y", "t")], "id string, only_b string, _t string")
    got = tables.union_by_name([a, b])
    assert got.columns == ["id", "only_a", "only_b"]
    assert {tuple(r) for r in got.collect()} == {("1", "x", ""), ("2", "", "y")}


def test_mirrored_and_overridden(spark):
    d = spark.createDataFrame([("", "7", "q"), ("5", "", "q")], "a string, b string, c string")
    assert [tuple(r) for r in routing.mirrored(d, "a", "b").collect()] == [("7", "7", "q"), ("5", "5", "q")]
    assert routing.mirrored(d.drop("b"), "a", "b").columns == ["a", "b", "c"]


def test_scores():
    assert entity.ratio("abc", "abc") == 100 and entity.ratio("", "") == 100
    assert entity.partial_ratio("road", "kauri road west") == 100
    assert entity.token_set_ratio("a b", "b a c") == 100
    assert 0 <= entity.score("kauri", "tomo") < 60


def test_clusters(spark):
    """Names are clustered without their suffix, as the flow does; with it, ends that differ by "Road" keep them apart."""
    names = ["Kauri Road"] * 3 + ["Kaurri Road", "Totara", "Totara Vale"]
    d = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "s string, i long").withColumn("base", split_suffix("s")["base"])
    alias = {r.name: r.alias for r in entity.clustered(d, "base").collect()}
    assert alias == {"Kauri": "Kauri", "Kaurri": "Kauri", "Totara": "Totara", "Totara Vale": "Totara Vale"}
    streets = {r.i: r.s for r in entity.unified_streets(d, "s", "i").collect()}
    assert streets[3] == "Kauri Road" and streets[4] == "Totara"


def test_graph_chain(spark):
    n = 300
    edges = spark.range(n).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001), (5, 5)], "a long, b long"))
    got = {r.node: (r.component, r.size) for r in graph.components(edges, spark.createDataFrame([(7777,)], "node long")).collect()}
    assert all(got[i] == (0, n + 1) for i in range(n + 1)) and got[1001] == (1000, 2) and got[7777] == (7777, 1)
    assert graph.components(edges.where("false")).count() == 0
    names = edges.selectExpr("concat('n', a) as a", "concat('n', b) as b").union(spark.createDataFrame([(None, "x"), ("é", "z")], "a string, b string"))
    graph.PER_TASK, most = 20, graph.PER_TASK  # several tasks, none of which sees the whole chain
    try:
        got = {r.node: (r.component, r.size) for r in graph.components(names.repartition(6)).collect()}
    finally:
        graph.PER_TASK = most
    assert all(got[f"n{i}"] == ("n0", n + 1) for i in range(n + 1)) and got["é"] == ("z", 2) and None not in got and len(got) == n + 5


def test_hull_and_cuts():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400, 2)) * [3, 1]
    h = shapes.hull(p)
    edge = np.roll(h, -1, axis=0) - h
    for q in p:
        assert ((edge[:, 0] * (q[1] - h[:, 1]) - edge[:, 1] * (q[0] - h[:, 0])) > -1e-9).all()
    parts = shapes.bands(h, 4, shapes.axis_of(p))
    assert np.allclose([shapes.area(x) for x in parts], shapes.area(h) / 4)
    assert np.isclose(sum(shapes.area(x) for x in shapes.density_split(h, p, 3)), shapes.area(h))
    assert len(shapes.hull(np.array([[0, 0], [0, 0], [1, 1]]))) == 2
    assert len(shapes.hull(np.array([[0, 0], [1, 1], [2, 2], [3, 3]]))) == 2


def test_balanced_and_simplified():
    group = shapes.balanced([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, g in zip([8, 7, 6, 5, 4], group, strict=True) if g == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) <= 2
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    ring = np.stack([np.cos(t), np.sin(t)], axis=1) * 100
    s = shapes.simplified(ring, 1.0)
    assert len(s) < 60 and shapes.hausdorff(ring, s) <= 1.0 + 1e-9
    small = shapes.within_budget(ring, lambda r: 20 * len(r), 800, farthest=5)
    assert 20 * len(small) <= 800 and shapes.hausdorff(ring, small) <= 5
    assert shapes.hausdorff(ring, np.zeros((0, 2))) == np.inf


def test_grid():
    got = shapes.to_grid(np.array([[173.0, 0.0], [174.7645, -36.8509], [173.0, -41.0]]))
    assert np.allclose(got[0], [1_600_000, 10_000_000])
    assert np.allclose(got[1], [1_757_307, 5_920_050], atol=200)
    assert np.isclose(got[2][0], 1_600_000)


def test_settled_areas_cover_all_rows(spark):
    from waymark import queries_shapes
    from waymark.catalog import Tables

    rows = queries_shapes.settled_areas(Tables(spark, "/root/testdata/sf0.001")).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == Tables(spark, "/root/testdata/sf0.001").embeddings.count()
    assert all(r.area for r in rows if r.vec_id % 9)
    assert spatial is not None


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    path = tmp_path / "x.gpkg"
    db = sqlite3.connect(path)
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    db.execute("insert into gpkg_geometry_columns values ('areas', 'geom')")
    db.execute("create table areas (fid integer primary key, geom blob, name text)")
    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    db.executemany("insert into areas values (?, ?, ?)", [(i, b"GP\0\1" + struct.pack("<i", 4326) + wkb, f"n{i}") for i in range(1, 26)])
    db.commit()
    spark.dataSource.register(geodata.GeoPackage)
    rows = spark.read.format("geopackage").option("rows", "10").load(str(path)).collect()
    assert len(rows) == 25 and {r.attributes["name"] for r in rows} == {f"n{i}" for i in range(1, 26)}
    assert geodata.wkb_rings(bytes(rows[0].wkb)) == [[tuple(map(float, p)) for p in ring]]


def test_kml(spark, tmp_path):
    import zipfile

    kml = "<kml xmlns='x'><Document><Placemark><name>Höhe &amp; Tal</name><Polygon><outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"
    (tmp_path / "North Side.kml").write_text(kml.format("0,0,0 1,0,0 1,1,0 0,0,0"))
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub" / "b.kmz", "w") as z:
        z.writestr("doc.kml", kml.format("0,0 2,0 2,2"))
    (tmp_path / "bad.kml").write_text("<kml><Placemark><name>p</name><coordinates>1,1 2,2</coordinates></Placemark></kml>")
    by_file = {r.name: len(r.ring) for r in geodata.read_kml(spark, str(tmp_path)).collect()}
    assert by_file == {"North Side": 4, "b": 3}
    assert {r.name for r in geodata.read_kml(spark, str(tmp_path), by="placemark").collect()} == {"Höhe &amp; Tal"}


def test_csv(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿Number,Street\n0610,Kāuri Road\n1-3,\n".encode())
    (tmp_path / "old.csv").write_bytes("number,street\n1,Café\n".encode("cp1252"))
    d = files.read_csv(spark, str(tmp_path / "bom.csv"), None)
    assert d.columns == ["Number", "Street"] and [tuple(r) for r in d.collect()] == [("0610", "Kāuri Road"), ("1-3", "")]
    assert files.encoding_of(spark, str(tmp_path / "old.csv")) == "windows-1252"
    assert files.read_csv(spark, str(tmp_path / "old.csv"), None).first().street == "Café"
    both, left = files.read_folder(spark, [str(tmp_path / "bom.csv"), str(tmp_path / "old.csv")], ["number", "street"])
    assert both.count() == 3 and not left
    assert files.read_folder(spark, [str(tmp_path / "old.csv")], ["postcode"])[0] is None
    assert files.newest(spark, str(tmp_path), skip=["old"]).endswith("bom.csv")
    assert files.resolve_column(["Street Name", "No"], "street") == "Street Name" and files.resolve_column(["No"], "number", {"number": ["no"]}) == "No"


def test_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"1 kauri road": ["k", -36.9, 174.8, "0610"], "x": [1.5, 2.5], "gone": ["", "", "", ""]}')
    got = {r.address: (r.label, r.lat, r.lon, r.postcode) for r in files.read_cache(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"1 kauri road": ("k", -36.9, 174.8, "0610"), "x": ("", 1.5, 2.5, ""), "gone": ("", None, None, "")}


def test_race_takes_the_first_accepted(spark):
    def make():
        import asyncio

        async def wrong(address):
            return ("far", 80.0, 0.0, "")

        async def broken(address):
            raise OSError

        async def right(address):
            await asyncio.sleep(0.01)
            return None if address == "none" else ("here", 175.0, -37.0, "1")  # the wrong way round

        return [("wrong", wrong, 0.0), ("broken", broken, 0.0), ("right", right, 0.0)]

    d = spark.createDataFrame([("a",), ("a",), ("none",), ("",)], "q string")
    got = {r.address: r for r in geocoders.geocoded(d, "q", make, Box(-38, -36, 174, 176)).collect()}
    assert set(got) == {"a", "none"} and (got["a"].lat, got["a"].lon, got["a"].provider) == (-37.0, 175.0, "right") and got["none"].lat is None


@pytest.mark.parametrize("parts", [1, 7])
def test_flows_lose_nothing(spark, parts):
    rows = spark.createDataFrame(
        [(i, n, s, "", st, "House", la, lo) for i, (n, s, st, la, lo) in enumerate([("12", "Kauri rd", "", "0.1", "0.1"), ("12", "Kauri Road", "", "", ""), ("", "Kauri Road", "", "0.1", "0.1"), ("UnitA/3", "Kauri Road, Eastfield", "", "0.1", "0.2"), ("3/UnitA", "Kauri Rd", "", "0.1", "0.2"), ("", "", "", "", ""), ("", "", "", "", "")])],
        "_row_id long, Number string, Street string, Suburb string, Status string, Type string, Latitude string, Longitude string",
    ).repartition(parts)
    gazetteer = spark.createDataFrame([("12", "Kauri Road", "Eastfield", 0.1, 0.1, "0610")], "number string, street string, suburb string, lat double, lon double, postcode string")
    done = cleaning.scheduler(rows, gazetteer, cleaning.Config(box=Box(-1, 1, -1, 1), suburbs=["Eastfield"]))
    got = {r._row_id: (r["Final Status"], r.route) for r in done.collect()}
    assert len(got) == 7
    assert got[0] == ("Pass", "clean") and got[1] == ("Duplicate", "fail") and got[2][1] == "fail" and got[5] == got[6] == ("Fail", "fail")
