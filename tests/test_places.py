"""Polygons, files and places against brute force, and their odd cases."""

import math
import random
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.geo import Box
from waymark.operators import facts, polygons, shapes, spatial
from waymark.plans import places
from waymark.sources import files, shapefiles, workbooks
from waymark.stage import cancel, cancellable, progress


def box(x, y, w=1.0, h=1.0):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])


def ground(rings):
    return sum(shapes.signed_area(r) for r in rings)


def test_joined_clipped_and_cut_by_sampling():
    rng = np.random.default_rng(0)
    points = rng.uniform(-1.5, 4.5, (100_000, 2))
    for _ in range(8):
        rings = []
        for _ in range(6):
            turn, far = (np.arange(7) + rng.uniform(-0.4, 0.4, 7)) * (2 * math.pi / 7), rng.uniform(0.4, 1.3, 7)
            rings.append(rng.uniform(0, 3, 2) + np.stack([np.cos(turn) * far, np.sin(turn) * far], axis=1))
        assert abs(polygons.within(rings)(points).mean() * 36 - ground(polygons.joined(rings))) < 0.2
        both = polygons.within(rings[:3])(points) & polygons.within(rings[3:])(points)
        assert abs(both.mean() * 36 - ground(polygons.common(rings[:3], rings[3:]))) < 0.15
        parts = polygons.divided(rings[0], [rng.uniform(-1, 4, (2, 2)) for _ in range(3)])
        assert abs(ground(parts) - shapes.area(rings[0])) < 1e-6


def test_borders_that_touch():
    assert [len(r) for r in polygons.joined([box(0, 0), box(1, 0)])] == [4]
    frame = polygons.joined([box(0, 0, 3, 1), box(0, 2, 3, 1), box(0, 0, 1, 3), box(2, 0, 1, 3)])
    assert len(frame) == 2 and abs(ground(frame) - 8) < 1e-6 and shapes.signed_area(frame[1]) < 0  # a hole
    assert polygons.joined([]) == [] and polygons.common([box(0, 0)], [box(5, 5)]) == [] and polygons.joined([box(0, 0), box(0, 0)])[0].shape == (4, 2)
    assert [round(shapes.area(p), 6) for p in polygons.divided(box(0, 0), [])] == [1]
    assert len(polygons.divided(box(0, 0), [np.array([(0.5, 0.0), (0.5, 1.0)])], least=0.6)) == 0
    strip = polygons.corridor(np.array([(0.0, 0.0), (5.0, 0.0)]), 0.5, 64)
    assert abs(ground(strip) - (5 + math.pi / 4)) < 0.01


def test_nearest_border_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(120)] + [(900, 250.0, -80.0), (901, None, 1.0)]
    areas = [("a", box(0, 0, 0.3, 0.2)), ("b", box(1, 1, 0.1, 0.4)), ("c", box(-2, -2, 0.5, 0.5)), ("d", box(0.1, 0.05, 0.1, 0.1))]
    table = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in areas], "name string, ring array<struct<x:double,y:double>>")
    got = {r.i: (r.area, r.edge) for r in spatial.nearest(spark.createDataFrame(rows, "i int, x double, y double"), table, "i", "x", "y").collect()}
    for i, x, y in rows:
        if x is None:
            assert got[i] == (None, None)
            continue
        best = min((min(float(shapes.to_segment(np.array([[x, y]]), r[j], r[(j + 1) % 4])[0]) for j in range(4)), n) for n, r in areas)
        assert got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-9


def test_workbooks_keep_what_is_in_cells():
    rows = [["a", "B ", "ü <&>"], ["1", "", "x\ny"], [], ["", "", " z "], ["\x01"]]
    book = workbooks.workbook({"One": rows, 'Two "&"': [["q"]]})
    assert list(workbooks.sheet_rows(book, "One")) == [["a", "B ", "ü <&>"], ["1", "", "x\ny"], [], ["", "", " z "], [" "]]
    assert list(workbooks.sheet_rows(book, 'Two "&"')) == [["q"]] and next(workbooks.sheet_rows(book, "none")) == ["a", "B ", "ü <&>"]
    assert workbooks._column(28) == "AB" and workbooks._number("AB7") == 28


def test_shapes_of_all_kinds():
    point = struct.pack(">ii", 1, 10) + struct.pack("<i2d", 1, 3.0, 4.0)
    none = struct.pack(">ii", 2, 2) + struct.pack("<i", 0)
    line = struct.pack("<i4d2i2i", 3, 0, 0, 1, 1, 2, 5, 0, 2) + b"".join(struct.pack("<2d", i, i) for i in range(5))
    line = struct.pack(">ii", 3, len(line) // 2) + line
    found = list(shapefiles.shapes_of(bytes(100) + point + none + line))
    assert found == [(1, [[(3.0, 4.0)]]), (2, []), (3, [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)]])]
    shp, dbf = shapefiles.shapefile([[(0, 0), (1, 0), (1, 1)]], [{"NAME": "Tāwa"}])
    assert list(shapefiles.records_of(dbf)) == [{"NAME": "Tāwa"}] and len(next(shapefiles.shapes_of(shp))[1][0]) == 4


def test_facts_of_odd_files():
    assert facts.python_facts("def f(:\n")[0][0] == "error" and facts.facts_of("x.txt", "") == []
    assert ("reads", "a.txt", 1) in facts.python_facts("open('a.txt')") and ("writes", "b", 1) in facts.python_facts("open('b', mode='ab')")
    assert facts.facts_of("run.bat", "@call tools\\go.cmd x\nrem\n\"my app.exe\" -q") == [("call", "tools\\go.cmd", 1), ("call", "my app.exe", 3)]
    assert facts.facts_of("c.yaml", "# k: 1\nname: x\n  inner: y\non :\n") == [("key", "name", 2), ("key", "on", 4)]
    assert ("call", "a.b.c", 1) in facts.python_facts("a.b.c(1)")


def test_cached_tables_expire(spark, tmp_path):
    target, n = f"file://{tmp_path}/t", []
    for seconds in (100, 100, -1):
        n.append(files.kept_fresh(spark, target, seconds, lambda: spark.range(3 + len(n))).count())
    assert n == [3, 3, 5]


def test_cache_is_stable_and_read_again(spark, tmp_path):
    rows = [(f"a{i} \"q\" é", f"l{i}" if i % 2 else None, float(i), None if i % 3 == 0 else -1.5, "06") for i in range(25)] + [("a3 \"q\" é", "l3", 3.0, None, "06")]
    d = spark.createDataFrame(rows, "address string, label string, lat double, lon double, postcode string")
    one = files.write_cache(d.repartition(4), f"{tmp_path}/a", 10).orderBy("chunk").collect()
    two = files.write_cache(d.repartition(1), f"{tmp_path}/b", 10).orderBy("chunk").collect()
    assert one == two and [r.n for r in one] == [10, 10, 5]
    got = {r.address: (r.label, r.lat, r.lon, r.postcode) for r in files.read_cache(spark, f"{tmp_path}/a").collect()}
    assert got == {a: (b or "", c, e, p) for a, b, c, e, p in rows}
    files.write_cache(d.where("false"), f"{tmp_path}/c")
    assert files.read_cache(spark, f"{tmp_path}/c").count() == 0


def test_jobs_are_followed_and_stopped(spark):
    seen, failed = [], []

    def work():
        with cancellable(spark, "slow"):
            try:
                spark.range(0, 1000, 1, 4).select(F.udf(lambda x: time.sleep(0.05) or x, "long")("id").alias("x")).agg(F.sum("x")).collect()
            except Exception as e:
                failed.append(type(e).__name__)

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        time.sleep(0.1)
        if seen := progress(spark):
            break
    cancel(spark, "slow")
    thread.join(60)
    assert seen and seen[0][2] >= 1 and failed and not thread.is_alive()
    assert spark.range(5).count() == 5


BOX = Box(-1, 1, -1, 1)
GAZETTEER = [("5", "Kauri Road", "East", 0.1, 0.1, "1"), ("7", "Kauri Road", "East", 0.2, 0.1, "2"), ("9", "Kauri Road", "West", 0.3, 0.1, ""), ("2", "Far Street", "East", 50.0, 0.1, "3"), ("4", "Swap Lane", "East", 0.5, 0.2, "4")]


def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "number string, street string, suburb string, lat double, lon double, postcode string")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row_id int, Number string, Street string, Suburb string, PostalCode string, _lat double, _lon double")


def test_coordinates_are_filled_in_order(spark):
    d = rows_of(spark, [
        ("5", "kauri road", "East", "", None, None), ("UnitA/7", "Kauri Road", "East", "", None, None), ("11", "Kauri Road", "East", "", None, None), ("13", "Kauri Road", "East", "x", None, None),
        ("2", "Far Street", "East", "", None, None), ("5", "Kauri Road", "East", "own", 0.9, 0.9), ("", "Kauri Road", "East", "", None, None), ("5", "", "East", "", None, None), ("9", "Kauri Road", "West", "own", 0.0, 0.0),
    ])
    for verify, own in ((False, 0.9), (True, 0.1)):
        got = {r._row_id: (r._lat, r.PostalCode, r._source) for r in places.verified_or_filled(d, gazetteer(spark), BOX, verify).collect()}
        assert got[0] == (0.1, "1", "gazetteer") and got[1] == (0.2, "2", "gazetteer") and got[2] == (0.2, "2", "gazetteer")  # 6 isn't there, 7 is
        assert got[3] == (None, "x", "") and got[4] == (None, "", "") and got[6][0] is None and got[7][0] is None
        assert got[5][0] == own and got[8] == (0.3, "own", "gazetteer")
    assert places.verified_or_filled(d.where("false"), gazetteer(spark), BOX).count() == 0


def test_conflicting_suburbs(spark):
    d = rows_of(spark, [
        ("1", "One Road", "East", "", 0.1, 0.1), ("2", "one road", "", "", None, None),  # the only suburb
        *[("1", "Two Road", "East", "", 0.1, 0.1)] * 3, ("3", "Two Road", "West", "", 0.1, 0.1),  # three of four
        ("1", "Three Road", "East", "", 0.1, 0.1), ("2", "Three Road", "East", "", 0.19, 0.1), ("3", "Three Road", "West", "", 0.21, 0.1), ("4", "Three Road", "West", "", 0.22, 0.1),  # two of the three nearest
        ("1", "Four Road", "East", "", 0.1, 0.1), ("2", "Four Road", "West", "", -0.1, 0.1),  # even: the nearer on average, by name on ties
        ("1", "Five Road", "East", "", 7.0, 0.1), ("2", "Five Road", "West", "", None, None),  # nothing inside the region
        ("5", "Kauri Road", "East", "", 0.1, 0.1), ("6", "Kauri Road", "", "", None, None),  # 5 lies at the centre
    ])
    got = [(r.Suburb, r.settled, r._lat, r.PostalCode) for r in places.suburbs_settled(d, gazetteer(spark), BOX, {"East": "77"}).orderBy("_row_id").collect()]
    assert got[0][:2] == got[1][:2] == ("East", "only") and got[1][2] is None and got[1][3] == "77"
    assert {g[:2] for g in got[2:6]} == {("East", "plurality")}
    assert {g[:2] for g in got[6:10]} == {("West", "nearest")}
    assert {g[:2] for g in got[10:12]} == {("East", "mean")}
    assert [g[:2] for g in got[12:14]] == [("East", None), ("West", None)]
    assert got[15] == ("East", "only", 0.1, "77")


def test_new_addresses_of_nothing(spark):
    pairs = spark.createDataFrame([("kauri road", "east"), ("Kauri Road", "West"), ("", "x"), (None, "y"), ("Lost Lane", "")], "street string, suburb string")
    got = {(r.Street, r.Suburb): (r.Number, r.Latitude, r.several_suburbs) for r in places.new_addresses(pairs, pairs.where("false"), gazetteer(spark), BOX).collect()}
    assert got == {("Kauri Road", "East"): ("5", "0.10000000", True), ("Kauri Road", "West"): ("9", "0.30000000", True), ("Lost Lane", ""): ("1", "", False)}
    assert places.new_addresses(pairs, pairs, gazetteer(spark), BOX).count() == 0


def test_sheets_beyond_the_format_are_refused(spark, tmp_path):
    workbooks.MOST_ROWS, most = 3, workbooks.MOST_ROWS
    try:
        with pytest.raises(ValueError):
            workbooks.write_workbook(spark, {"a": spark.range(9)}, f"file://{tmp_path}/b.xlsx")
    finally:
        workbooks.MOST_ROWS = most


def test_boxes_that_nearly_touch(spark):
    """Sides a millionth apart, in one group and in a group without a name, in one strip and in many, against sums of intervals."""
    rng = np.random.default_rng(0)
    x, w = rng.uniform(-0.5, 0.5, 400).astype(np.float32).astype(float), 0.01 + rng.uniform(0, 0.002, 400)
    x[200:] = x[:200] + w[:200] + rng.choice([1e-6, -1e-6, 1e-7, 0], 200)
    n, length, end = 0, 0.0, -9.0
    for a, b in sorted(zip(x, x + w, strict=True)):
        n, length, end = n + (end < a), length + max(0, b - max(a, end)), max(end, b)
    found = polygons.joined([box(a, 0, b) for a, b in zip(x, w, strict=True)])
    assert len(found) == n and abs(ground(found) - length) < 1e-12
    rows = [(g, [{"x": float(p), "y": float(q)} for p, q in box(a, 0, b)]) for g in ("g", None) for a, b in zip(x, w, strict=True)]
    areas = spark.createDataFrame(rows, "g string, ring array<struct<x:double,y:double>>")
    for size in (10, 1000):
        got = polygons.dissolved(areas, "g", size).toPandas()
        assert {k if k == k and k else None for k in got["name"]} == {"g", None} and len(got) == 2 * n
        assert abs(ground(polygons._rings(got["ring"])) - 2 * length) < 1e-12
    hole = polygons.united([polygons.joined([box(0, 0, 3, 1), box(0, 2, 3, 1), box(0, 0, 1, 3), box(2, 0, 1, 3)]), [box(1.5, 1.5, 0.25, 0.25)]])
    assert len(hole) == 3 and abs(ground(hole) - 8.0625) < 1e-9


def test_clip_is_dealt_over_all_partitions(spark):
    """Areas of a small table are clipped in as many tasks as the session has partitions, each area once, on one mask or several."""
    rng = np.random.default_rng(1)
    rows = [(str(i), [{"x": float(p), "y": float(q)} for p, q in box(*rng.uniform(-1, 1, 2), *rng.uniform(0.01, 1, 2))]) for i in range(60)]
    masks = [box(-0.5, -0.5), box(0, 0, 0.7, 0.9)]
    schema = "name string, ring array<struct<x:double,y:double>>"
    land = spark.createDataFrame([(str(i), [{"x": float(p), "y": float(q)} for p, q in m]) for i, m in enumerate(masks)], schema)
    d = polygons.clipped(spark.createDataFrame(rows, schema), land, 0.5)
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {k: ground(polygons._rings(g["ring"])) for k, g in d.toPandas().groupby("name")}
    for name, ring in rows:
        b = [ring[0]["x"], ring[0]["y"], ring[2]["x"], ring[2]["y"]]
        meet = lambda m, b=b: max(0, min(b[2], m[2]) - max(b[0], m[0])) * max(0, min(b[3], m[3]) - max(b[1], m[1]))
        assert abs(got.get(name, 0) - meet((-0.5, -0.5, 0.5, 0.5)) - meet((0, 0, 0.7, 0.9)) + meet((0, 0, 0.5, 0.5))) < 1e-9
