"""Queries cover whole tables, not a subset of fixed size."""

import os
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from waymark import catalog
from waymark.functions.geo import Box
from waymark.functions.text import canon_text
from waymark.operators import entity, joins, shapes
from waymark.sources import geocoders

catalog.load()
DATA = "/root/testdata/sf0.01"  # more customers than the old limits let in
SMALL = "/root/testdata/sf0.001"


def test_fuzzy_best_match_asks_for_every_customer(spark):
    got = [r.c_custkey for r in catalog.QUERIES["fuzzy_best_match"](spark, DATA).select("c_custkey").collect()]
    assert sorted(got) == sorted(r.c_custkey for r in spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").collect())


def _random_names(rng, n, words):
    out = []
    for _ in range(n):
        x = " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        if rng.random() < 0.7:
            i = rng.randrange(len(x) + 1)
            x = rng.choice((x[:i] + rng.choice("abx ") + x[i:], x[:i] + x[i + 1 :], x[: max(0, i - 1)] + rng.choice("eio") + x[i:]))
        out.append(x.strip())
    return out


def test_best_matches_are_those_of_all_choices(spark):
    """No choice is passed over, whatever letters it begins with; ties go to the first."""
    rng = random.Random(0)
    words = ["kauri", "rimu", "saint", "christopher", "east", "west", "road", "rd", "Te", "x", "a a"]
    asked, choices = _random_names(rng, 150, words) + ["", "zzz"], sorted(set(_random_names(rng, 90, words)))
    q = spark.createDataFrame([(i, x) for i, x in enumerate(asked)] + [(999, None)], "i long, text string")
    c = spark.createDataFrame([(x, (k * 7) % len(choices)) for k, x in enumerate(choices)], "choice string, o long")
    order = {x: (k * 7) % len(choices) for k, x in enumerate(choices)}
    for block in (2000, 17):
        got = {r.i: (r.match, r.score) for r in entity.matched(q, c, "text", "choice", "o", 60, block).collect()}
        for i, x in enumerate(asked):
            best = min((-entity.score(x.lower(), y.lower()), order[y], y) for y in choices)
            assert got[i] == ((best[2], -best[0]) if best[0] <= -60 else (None, None))
        assert got[999] == (None, None)


def test_close_pairs_are_all_pairs(spark):
    rng = random.Random(1)
    names = sorted(set(_random_names(rng, 160, ["kauri", "rimu", "tawa", "a", "st"])) | {"", "a", "ab", "b"})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    d = spark.createDataFrame([(x,) for x in [*names, *names[:9], None]], "n string")
    for most in (1, 2, 3):
        want = {(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= most}
        assert {tuple(r) for r in entity.close_pairs(d, "n", most).collect()} == want


def test_names_that_end_apart_stay_apart(spark):
    d = spark.createDataFrame([(x,) for x in ["Saint Christopher East"] * 3 + ["Saint Christopher West", "Kauri Road", "Kauri Roat", "Eaglen", "Eaglemont"]], "n string")
    alias = {r.name: r.alias for r in entity.clustered(d, "n", 80).collect()}
    assert alias["Saint Christopher West"] == "Saint Christopher West" and alias["Eaglen"] == "Eaglen"
    assert alias["Kauri Roat"] == alias["Kauri Road"]


def _clustered(counts, threshold):
    """Aliases, by a plain loop over all names."""
    blocks, alias = {}, {}
    for x in counts:
        blocks.setdefault(re.sub("[^a-z]", "", x.lower())[:4], []).append(x)
    for names in blocks.values():
        names.sort(key=lambda x: (-counts[x], -len(x), x))
        for i, a in enumerate(names):
            if alias.setdefault(a, a) != a:
                continue
            for b in names[i + 1 :]:
                x, y = (re.sub("[^a-z]", "", n.lower()) for n in (a, b))
                both = len(os.path.commonprefix([x, y]))
                if b not in alias and abs(len(x) - len(y)) <= 2 and not (both >= 4 and max(len(x), len(y)) >= both + 3) and entity.ratio(a.lower(), b.lower()) >= threshold:
                    alias[b] = a
    for x, a in alias.items():
        if x != a and min(counts[x], counts[a]) >= 2 and not (entity.ratio(x.lower(), a.lower()) > 92 and abs(len(x) - len(a)) < 2):
            alias[x] = x
    return alias


def test_aliases_and_streets_by_plain_loops(spark):
    parts = sorted((r.p_partkey, r.p_name.title()) for r in spark.read.parquet(f"{DATA}/part.parquet").collect())
    streets = []
    for k, x in parts:
        at = 1 + k % len(x)
        streets.append((k, x[:at] + x[at - 1 :] if k % 5 == 0 else x, ("Road", "Street", "Drive")[k % 3]))
    spelt = {k: f"{x} {s}" for k, x, s in streets}
    streets = [(k, " ".join(y.capitalize() for y in x.split()), s) for k, x, s in streets]
    counts = Counter(x for _, x, _ in streets)
    got = catalog.QUERIES["alias_cluster"](spark, DATA).collect()
    assert len(counts) > 250 and {r.name: r.alias for r in got} == _clustered(counts, 86) and len(got) == len(counts)
    alias, groups = _clustered(counts, 80), {}
    for k, x, s in streets:
        groups.setdefault(alias[x], []).append((k, spelt[k]))
    lead = {}
    for a, rows in groups.items():
        n = Counter(x for _, x in rows)
        lead[a] = min(n, key=lambda x: (-n[x], min(k for k, y in rows if y == x)))
    got = {r.p_partkey: r.street for r in catalog.QUERIES["unified_streets"](spark, DATA).collect()}
    assert got == {k: lead[alias[x]] for k, x, _ in streets}


def test_contained_names_of_any_length(spark):
    texts, names = ["kauri road", "ab", "", "a", None, "xkaurix"], ["a", "ab", "kauri", "kauri road west", "", None, "k", "uri "]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r.i, r.name) for r in joins.containing(d, n, "text", "name").collect()}
    assert got == {(i, x) for i, t in enumerate(texts) for x in names if t is not None and x and x in t}
    assert joins.containing(d, n.where("false"), "text", "name").count() == 0


def test_nearest_numbers_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(3)}" if rng.random() < 0.95 else None, rng.randrange(40) if rng.random() < 0.9 else None, f"a{rng.randrange(5)}" if rng.random() < 0.3 else None) for i in range(300)]
    d = spark.createDataFrame(rows, "i long, street string, n int, area string")
    got = {r.i: r.area for r in joins.nearest_number(d, "i", "street", "n", "area").collect()}
    for i, s, n, area in rows:
        known = [(abs(m - n), j, b) for j, t, m, b in rows if b and s is not None and t == s and m is not None] if n is not None else []
        want = area or (min(known)[2] if known else None)
        assert got[i] == want


def test_components_of_all_edges(spark):
    edges = [(f"p{r.l_partkey}", f"s{r.l_suppkey}") for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.node: r.component for r in catalog.QUERIES["components"](spark, SMALL).collect()} == {x: find(x) for x in parent}


def test_shortest_paths_of_all_customers(spark):
    rows = spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    n, to = max(r.c_custkey for r in rows) + 1, {}
    for r in rows:
        to[r.c_custkey] = {(r.c_custkey * 7 + r.c_nationkey) % n, (r.c_custkey * 3 + 1) % n}
    there, want = {r.c_custkey for r in rows}, {}
    for s in range(3):
        seen, front = {s: 0}, [s]
        for d in range(1, 7):
            front = sorted({y for x in front for y in to.get(x, ()) if y not in seen})
            seen |= dict.fromkeys(front, d)
        want |= {(str(s), str(x)): d for x, d in seen.items() if d and x % 10 == 9 and x in there}
    assert {(r.source, r.target): r.length for r in catalog.QUERIES["shortest_path"](spark, DATA).collect()} == want


def test_benchmark_semi_gate_reads_whole_texts(spark):
    key = lambda t: t.select(canon_text("text")).collect()
    docs = {r[0] for r in key(spark.read.parquet(f"{SMALL}/documents.parquet"))}
    want = {r[0]: bool(r[1]) and r[1] in docs for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", canon_text("text")).collect()}
    assert {r.item_id: r.duplicate for r in catalog.QUERIES["benchmark_semi_gate"](spark, SMALL).collect()} == want


def test_containment_broadcasts_no_stretches(spark, tmp_path):
    """Rows of a file that looks small go neither as stretches nor as rows to the driver; repeated and null texts keep their rows."""
    rows = [(i, None if i % 10 == 9 else "kauri road rimu lane"[i % 7 :]) for i in range(300)]
    spark.createDataFrame(rows, "i long, text string").write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    n = spark.createDataFrame([("road",), ("ri",), ("kauri road",), ("",), ("absent",)], "name string")
    got = joins.containing(d, n, "text", "name")
    assert got.columns == ["i", "text", "name"] and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, t, m) for i, t in rows for m in ("road", "ri", "kauri road", "absent") if t and m in t)
    assert sorted(map(tuple, got.collect())) == want


def test_probes_of_a_common_address(spark):
    """An address that thousands ask for and thousands of rows answer costs in proportion to its places; a row that asks twice gets a place once."""
    box = Box(-1.0, 1.0, -1.0, 1.0)
    schema = "address string, label string, lat double, lon double, postcode string"
    k = F.col("id")
    many = spark.range(20_000).select(F.lit("a").alias("address"), F.lit("x").alias("label"), (k % 2 / 10).alias("lat"), F.lit(0.5).alias("lon"), (k + 10_000).cast("string").alias("postcode"))
    few = spark.createDataFrame([("a", "x", 0.0, 0.5, "1"), ("b", "x", 0.0, 0.5, "1"), ("b", "y", 0.2, 0.5, "2"), ("b", "z", 9.0, 9.0, "3"), (None, "n", 0.0, 0.0, "4")], schema)
    asked = spark.range(20_000).select("id", F.lit("a").alias("q")).union(spark.createDataFrame([(7, "b"), (7, "a"), (-1, "b"), (-2, None), (-3, "c")], "id long, q string"))
    got = geocoders.probed_all(asked, "id", "q", [("many", many), ("few", few)], box)
    assert got.columns == ["id", "provider", "label", "lat", "lon", "postcode"]
    rows = {i: sorted((r.label, r.lat, r.provider, r.postcode) for r in got.where(F.col("id") == i).collect()) for i in (3, 7, -1)}
    at = [("x", 0.0, "many", "10000"), ("x", 0.1, "many", "10001")]
    assert rows == {3: at, 7: [*at, ("y", 0.2, "few", "2")], -1: [("x", 0.0, "few", "1"), ("y", 0.2, "few", "2")]}
    assert got.count() == 40_000 + 1 + 2


def test_rings_are_reduced_over_all_partitions(spark):
    """Weights drop what a plain search drops, and a small table's rings are dealt over all partitions."""
    rng = np.random.default_rng(0)
    turn = np.arange(200) * (2 * np.pi / 200)
    ring = np.stack([50 * np.cos(turn), 50 * np.sin(turn)], axis=1) + rng.normal(0, 1, (200, 2))
    until = shapes.lasting(ring)
    for t in (0.1, 0.5, 1, 2, 5, 200):
        assert np.array_equal(ring[until > t], shapes.simplified(ring, t))
    small = shapes.within_budget(ring, lambda r: 20 * len(r), 800)
    apart = np.min([shapes.to_segment(ring, small[i], small[(i + 1) % len(small)]) for i in range(len(small))], axis=0).max()
    assert abs(shapes.hausdorff(ring, small) - apart) < 1e-9
    d = spark.createDataFrame([("a", [{"x": float(x), "y": float(y)} for x, y in ring])], "name string, ring array<struct<x:double,y:double>>").coalesce(1)
    got = shapes.reduced(d, lambda r: 20 * len(r), 800)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r.name, r.bytes, round(r.distance, 9)) for r in got.collect()] == [("a", 20 * len(small), round(float(apart), 9))]
