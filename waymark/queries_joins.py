"""Queries of gates, lookups, graphs and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalog import Tables, query
from waymark.functions.numbers import neighbours
from waymark.functions.text import canon_text, split_suffix
from waymark.operators import entity, graph, joins, routing

_CANON = "regexp_replace(strip_accents(regexp_replace(lower(trim({})), '\\b\\d{{4}}\\s*$', '')), '[^a-z0-9]+', '', 'g')"


def _keyed_customers(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "").otherwise(canon_text(F.concat("c_mktsegment", (F.col("c_custkey") % 300).cast("string")))).alias("key"))


def _keyed_parts(t: Tables) -> DataFrame:
    return t.part.where("p_partkey % 3 = 0").select(canon_text(F.concat(F.lit("Building"), (F.col("p_partkey") % 300).cast("string"))).alias("key"))


_GATE = (
    "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE "
    + _CANON.format("c_mktsegment || (c_custkey % 300)")
    + " END AS key FROM customer), p AS (SELECT DISTINCT "
    + _CANON.format("'Building' || (p_partkey % 300)")
    + " AS key FROM part WHERE p_partkey % 3 = 0) "
)


@query(_GATE + "SELECT c_custkey, c.key <> '' AND EXISTS (SELECT 1 FROM p WHERE p.key = c.key) AS duplicate FROM c")
def semi_gate(t: Tables) -> DataFrame:
    """C5, C11."""
    return joins.gated(_keyed_customers(t), _keyed_parts(t), "key").select("c_custkey", "duplicate")


@query(
    _GATE
    + """
, f AS (SELECT c_custkey, key, CASE WHEN c_custkey % 2 = 0 THEN 'Duplicate' ELSE 'Fail' END AS outcome FROM c)
SELECT c_custkey, CASE WHEN outcome = 'Duplicate' AND NOT (key <> '' AND EXISTS (SELECT 1 FROM p WHERE p.key = f.key)) THEN 'Pass' ELSE outcome END AS outcome FROM f
"""
)
def anti_gate(t: Tables) -> DataFrame:
    """C6, C7."""
    fail = _keyed_customers(t).withColumn("outcome", F.when(F.col("c_custkey") % 2 == 0, "Duplicate").otherwise("Fail"))
    clean = _keyed_parts(t).select(F.lit(None).cast("long").alias("c_custkey"), "key", F.lit("Pass").alias("outcome"))
    a, b = joins.real_duplicates(clean, fail, "key", "outcome")
    return a.unionByName(b).where("c_custkey is not null").select("c_custkey", "outcome")


@query("SELECT o_orderkey FROM orders o WHERE o_orderkey % 10 = 0 OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30 AND l.l_orderkey % 10 <> 0)")
def missing_orders_report(t: Tables) -> DataFrame:
    """C1, T16."""
    key = lambda c: F.when(F.col(c) % 10 == 0, "").otherwise(F.col(c).cast("string")).alias("key")
    return joins.missing(t.orders.select("o_orderkey", key("o_orderkey")), t.lineitem.where("l_quantity > 30").select(key("l_orderkey")), ["key"]).select("o_orderkey")


@query(
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity <= 25 AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_quantity > 25 AND m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey)"
)
def missing_two_key_report(t: Tables) -> DataFrame:
    """C2."""
    return joins.missing(t.lineitem.where("l_quantity <= 25"), t.lineitem.where("l_quantity > 25"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey AS _row_id FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def completed_by_row_id(t: Tables) -> DataFrame:
    """C3."""
    d = t.orders.select(F.col("o_orderkey").alias("_row_id"), "o_orderstatus")
    return joins.completed(d, d.where("o_orderstatus = 'F'"), d.where("o_orderstatus = 'O'")).select("_row_id")


@query("SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)")
def missing_pairs(t: Tables) -> DataFrame:
    """C4, O13."""
    return joins.missing(t.part.select("p_brand", "p_type").distinct(), t.part.where("p_size > 48"), ["p_brand"])


@query(
    """
WITH a AS (SELECT o_custkey, count(*) AS n_a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n_b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN n_b IS NULL THEN 'missing' WHEN n_a IS NULL THEN 'extra' WHEN n_a <> n_b THEN 'count' ELSE 'same' END AS state FROM a FULL JOIN b USING (o_custkey)
"""
)
def coverage_full_outer(t: Tables) -> DataFrame:
    """C12, G3, G4."""
    return joins.coverage(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1")
def multiset_difference(t: Tables) -> DataFrame:
    """G4, A19."""
    d = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return d.where("o_orderkey % 2 = 0").drop("o_orderkey").exceptAll(d.where("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def bulk_lookup(t: Tables) -> DataFrame:
    """C8."""
    table = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.looked_up(t.customer.select("c_custkey"), table, ["c_custkey"], ["o_orderkey"])


@query(
    """
WITH r AS (SELECT * FROM part WHERE p_partkey % 4 = 0),
q AS (SELECT p_partkey AS id, p_brand, p_type, p_size FROM part WHERE p_partkey % 4 <> 0),
m AS (
  SELECT id, 1 AS tier, min(r.p_partkey) AS hit FROM q JOIN r USING (p_brand, p_type, p_size) GROUP BY 1
  UNION ALL SELECT id, 2, min(r.p_partkey) FROM q JOIN r USING (p_brand, p_type) GROUP BY 1
  UNION ALL SELECT id, 3, min(r.p_partkey) FROM q JOIN r USING (p_brand) GROUP BY 1)
SELECT q.id, arg_min(tier, tier) AS tier, arg_min(hit, tier) AS hit FROM q LEFT JOIN m ON q.id = m.id GROUP BY q.id
"""
)
def tiered_lookup(t: Tables) -> DataFrame:
    """A quarter of the parts is the reference, all others ask."""
    r = t.part.where("p_partkey % 4 = 0").withColumn("hit", F.col("p_partkey"))
    q = t.part.where("p_partkey % 4 <> 0").withColumnRenamed("p_partkey", "id")
    keys = (["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand"])
    return joins.tiered(q, "id", [(r, k) for k in keys], ["hit"], ["p_partkey"]).select("id", "tier", "hit")


@query(
    """
WITH f AS (SELECT o_custkey AS key, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1),
q AS (SELECT c_custkey, unnest([c_custkey * 10, c_custkey * 3, c_custkey + 1]) AS key, unnest([0, 1, 2]) AS nth FROM customer)
SELECT c.c_custkey, arg_min(price, nth) AS price FROM customer c LEFT JOIN (SELECT c_custkey, nth, price FROM q JOIN f USING (key)) h USING (c_custkey) GROUP BY 1
"""
)
def multi_key_restore(t: Tables) -> DataFrame:
    """C10."""
    k = F.col("c_custkey")
    source = t.orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").alias("price"), "o_orderkey")
    wanted = [(k * 10).cast("string"), (k * 3).cast("string"), (k + 1).cast("string")]
    return joins.restored(t.customer.select("c_custkey"), "c_custkey", wanted, source, "key", "price", "o_orderkey")


@query(
    """
WITH n AS (SELECT DISTINCT substr(p_type, 1 + p_size % 3, 1 + p_size % 6) AS name FROM part)
SELECT p_partkey, name FROM part JOIN n ON contains(p_type, name) WHERE name <> ''
"""
)
def containment_join(t: Tables) -> DataFrame:
    """C14."""
    names = t.part.select(F.expr("substr(p_type, 1 + p_size % 3, 1 + p_size % 6)").alias("name")).distinct()
    return joins.containing(t.part.select("p_partkey", "p_type"), names, "p_type", "name").select("p_partkey", "name")


@query(
    """
WITH d AS (SELECT o_orderkey AS id, o_custkey % 300 AS street, CAST(o_orderkey * 7 % 40 AS INTEGER) AS num, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS area FROM orders),
p AS (SELECT d.id, k.area, row_number() OVER (PARTITION BY d.id ORDER BY abs(d.num - k.num), k.id) AS nth FROM d JOIN d k ON d.street = k.street AND k.area IS NOT NULL WHERE d.area IS NULL)
SELECT d.id, coalesce(d.area, p.area) AS area FROM d LEFT JOIN p ON d.id = p.id AND p.nth = 1
"""
)
def nearest_number_pick(t: Tables) -> DataFrame:
    """C17."""
    k = F.col("o_orderkey")
    d = t.orders.select(k.alias("id"), (F.col("o_custkey") % 300).alias("street"), (k * 7 % 40).cast("int").alias("num"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("area"))
    return joins.nearest_number(d, "id", "street", "num", "area").select("id", "area")


@query(
    """
SELECT o_orderkey, CASE WHEN o_custkey % 2 = (o_custkey + o_orderkey % 3) % 2 THEN o_orderkey % 3 ELSE -1 END AS distance, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AS accepted FROM orders
"""
)
def reverse_verification(t: Tables) -> DataFrame:
    """C19."""
    k = F.col("o_orderkey")
    d = t.orders.select("o_orderkey", F.col("o_custkey").alias("num"), F.lit("kauri").alias("street"))
    back = t.orders.select("o_orderkey", (F.col("o_custkey") + k % 3).alias("num"), F.when(k % 5 == 0, "rimu").otherwise("kauri").alias("street"))
    return joins.verified(d, back, ["o_orderkey"], "num", "street").select("o_orderkey", F.coalesce("distance", F.lit(-1)).alias("distance"), "accepted")


@query(
    """
WITH k AS (SELECT s_suppkey AS id, s_nationkey % 7 AS st, s_nationkey AS sb, s_name FROM supplier),
q AS (SELECT c_custkey, c_nationkey % 9 AS st, c_nationkey AS sb FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(s_name, id) FROM k WHERE k.st = q.st AND k.sb = q.sb), (SELECT arg_min(s_name, id) FROM k WHERE k.st = q.st)) AS known_street FROM q
"""
)
def known_street_snap(t: Tables) -> DataFrame:
    """C20."""
    n = F.col("s_nationkey")
    known = t.supplier.select(F.col("s_suppkey").alias("known_id"), (n % 7).cast("string").alias("street_key"), n.cast("string").alias("suburb_key"), F.col("s_name").alias("known_street"), n.alias("known_suburb"))
    m = F.col("c_nationkey")
    asked = t.customer.select("c_custkey", (m % 9).cast("string").alias("street_key"), m.cast("string").alias("suburb_key"))
    return joins.snapped(asked, known, "c_custkey").select("c_custkey", "known_street")


@query(
    """
SELECT p_partkey, CAST(x.nth AS INTEGER) AS nth, CAST(p_size + x.d AS INTEGER) AS probe
FROM part, (SELECT d, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS nth FROM range(-5, 6) r(d)) x WHERE p_size + x.d > 0
"""
)
def neighbour_probes(t: Tables) -> DataFrame:
    """I9; the place in the sequence is shown as the pair of distance and side."""
    d = t.part.select("p_partkey", F.col("p_size").alias("num"), F.explode(neighbours("p_size")).alias("probe"))
    away = F.col("probe") - F.col("num")
    return d.select("p_partkey", F.when(away < 0, -2 * away - 1).otherwise(2 * away).cast("int").alias("nth"), "probe")


@query(
    """
WITH n AS (SELECT DISTINCT lower(p_type) || ' ' || lower(p_brand) AS a FROM part)
SELECT x.a, y.a AS b, CAST(levenshtein(x.a, y.a) AS INTEGER) AS distance FROM n x JOIN n y ON x.a < y.a WHERE levenshtein(x.a, y.a) <= 2
"""
)
def blocking_fuzzy_levenshtein(t: Tables) -> DataFrame:
    """C13."""
    return entity.close_pairs(t.part.select(F.lower(F.concat("p_type", F.lit(" "), "p_brand")).alias("name")), "name", 2)


@query()
def fuzzy_best_match(t: Tables) -> DataFrame:
    """C13, H15; a test holds it against brute force."""
    q = t.customer.select("c_custkey", F.concat(F.translate("c_mktsegment", "IO", "10"), F.lit(" Rd")).alias("text"))
    choices = t.customer.select(F.initcap("c_mktsegment").alias("choice"), "c_custkey").groupBy("choice").agg(F.min("c_custkey").alias("o"))
    return entity.matched(q, choices, "text", "choice", "o", 60).select("c_custkey", "text", "match", F.round("score", 6).alias("score"))


def _misspelt(t: Tables) -> DataFrame:
    """Streets after the parts' names, a letter doubled in every fifth."""
    name, at = F.initcap("p_name"), F.lit(1) + (F.col("p_partkey") % F.length("p_name")).cast("int")
    spelt = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring(name, F.lit(1), at), F.substring(name, at, F.length(name)))).otherwise(name)
    suffix = F.get(F.array(*map(F.lit, ("Road", "Street", "Drive"))), (F.col("p_partkey") % 3).cast("int"))
    return t.part.select("p_partkey", F.concat(spelt, F.lit(" "), suffix).alias("street"))


@query()
def alias_cluster(t: Tables) -> DataFrame:
    """O2, O3: of names without their suffix; a test holds it against a plain loop."""
    d = _misspelt(t).select(split_suffix("street")["base"].alias("base"))
    return entity.hardened(entity.clustered(d, "base"), d, "base")


@query()
def unified_streets(t: Tables) -> DataFrame:
    """O1, O4, O6, O7, T8; a test holds it against a plain loop."""
    return entity.unified_streets(_misspelt(t), "street", "p_partkey", 80)


def _part_suppliers(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, label) USING KEY (node) AS (
  SELECT a, min(a) FROM u GROUP BY a
  UNION
  SELECT u.b, min(r.label) FROM r JOIN u ON r.node = u.a JOIN recurring.r AS x ON x.node = u.b WHERE r.label < x.label GROUP BY u.b)
SELECT node, label AS component, count(*) OVER (PARTITION BY label) AS size FROM r
"""
)
def components(t: Tables) -> DataFrame:
    """P2 over all edges."""
    return graph.components(_part_suppliers(t))


@query(
    """
WITH RECURSIVE c AS (SELECT *, (SELECT max(c_custkey) + 1 FROM customer) AS n FROM customer),
e AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS a, CAST(unnest([(c_custkey * 7 + c_nationkey) % n, (c_custkey * 3 + 1) % n]) AS VARCHAR) AS b FROM c),
r(source, at_node, n, path) USING KEY (source, at_node) AS (
  SELECT CAST(s AS VARCHAR), CAST(s AS VARCHAR), 0, [CAST(s AS VARCHAR)] FROM range(3) x(s)
  UNION
  SELECT r.source, e.b, min(r.n) + 1, min(list_append(r.path, e.b)) FROM r JOIN e ON r.at_node = e.a
  LEFT JOIN recurring.r AS x ON x.source = r.source AND x.at_node = e.b WHERE x.source IS NULL AND r.n < 6 GROUP BY r.source, e.b)
SELECT source, at_node AS target, CAST(n AS INTEGER) AS length, array_to_string(path, '>') AS path FROM r WHERE CAST(at_node AS BIGINT) % 10 = 9 AND source <> at_node
"""
)
def shortest_path(t: Tables) -> DataFrame:
    """P3 over all customers' edges, from three sources to every tenth customer, to the default depth."""
    k, n = F.col("c_custkey"), t.customer.agg((F.max("c_custkey") + 1).alias("n"))
    c = t.customer.crossJoin(F.broadcast(n))  # one row
    edges = c.select(k.cast("string").alias("a"), ((k * 7 + F.col("c_nationkey")) % F.col("n")).cast("string").alias("b")).union(c.select(k.cast("string"), ((k * 3 + 1) % F.col("n")).cast("string")))
    sources = t.spark.range(3).select(F.col("id").cast("string").alias("node"))
    targets = t.customer.where("c_custkey % 10 = 9").select(k.cast("string").alias("node"))
    return graph.shortest_paths(edges, sources, targets).withColumn("path", F.array_join("path", ">"))


@query("SELECT 's' || l_suppkey AS node, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def in_degrees(t: Tables) -> DataFrame:
    """P4."""
    return graph.in_degrees(t.lineitem.select(F.col("l_partkey").cast("string").alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")))


@query(
    """
SELECT CAST(c_nationkey AS VARCHAR) AS from_bucket, CAST(o_orderkey % 25 AS VARCHAR) AS to_bucket, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey <> o_orderkey % 25 GROUP BY 1, 2 ORDER BY n DESC, from_bucket, to_bucket LIMIT 12
"""
)
def bucket_edges(t: Tables) -> DataFrame:
    """P4."""
    e = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("a"), (F.col("o_orderkey") % 25).alias("b"))
    return graph.bucket_edges(e, F.col("a").cast("string"), F.col("b").cast("string"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1")
def shared_contracts(t: Tables) -> DataFrame:
    """P6."""
    return graph.shared(t.lineitem, "l_suppkey", "l_partkey")


@query(
    """
WITH w AS (SELECT DISTINCT 'f' || (l_suppkey % 50) AS file, l_returnflag || l_linenumber AS producer FROM lineitem WHERE l_quantity < 10),
r AS (SELECT DISTINCT 'f' || (l_suppkey % 60) AS file, l_linestatus || l_linenumber AS consumer FROM lineitem WHERE l_quantity > 45),
a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY producer) AS i FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY consumer) AS i FROM r)
SELECT a.file, producer, consumer FROM a JOIN b ON a.file = b.file WHERE a.i <= 6 AND b.i <= 6 AND producer <> consumer
"""
)
def producer_consumer(t: Tables) -> DataFrame:
    """P5."""
    at = lambda n: F.concat(F.lit("data/f"), (F.col("l_suppkey") % n).cast("string"))
    who = lambda c: F.concat(c, F.col("l_linenumber").cast("string"))
    w = t.lineitem.where("l_quantity < 10").select(at(50).alias("file"), who("l_returnflag").alias("producer"))
    r = t.lineitem.where("l_quantity > 45").select(at(60).alias("file"), who("l_linestatus").alias("consumer"))
    return graph.produced_for(w, r)


@query(
    """
WITH n AS (SELECT 'dir' || (c_custkey % 7) || '/m' || c_custkey || '.py' AS node, c_custkey AS k FROM customer),
q AS (SELECT node AS a, CASE WHEN k % 2 = 0 THEN 'dir' || ((k + 1) % 7) || '/M' || (k + 1) || '.py' ELSE 'm' || (k * 2) || '.py' END AS ref FROM n)
SELECT DISTINCT q.a, n.node AS b FROM q JOIN n ON lower(regexp_extract(q.ref, '([^/]+)$', 1)) = lower(regexp_extract(n.node, '([^/]+)$', 1)) WHERE q.a <> n.node
"""
)
def resolved_references(t: Tables) -> DataFrame:
    """P1 for all customers."""
    k = F.col("k")
    name = lambda x, m="m": F.concat(F.lit("dir"), (x % 7).cast("string"), F.lit(f"/{m}"), x.cast("string"), F.lit(".py"))
    n = t.customer.select(name(F.col("c_custkey")).alias("node"), F.col("c_custkey").alias("k"))
    ref = F.when(k % 2 == 0, name(k + 1, "M")).otherwise(F.concat(F.lit("m"), (k * 2).cast("string"), F.lit(".py")))
    return graph.resolved(n.select(F.col("node").alias("a"), ref.alias("ref")), n.select("node"))


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, 'click|view') THEN 'look' WHEN regexp_matches(event_type, '^p') THEN 'pay' ELSE 'other' END AS role FROM events")
def rule_labels(t: Tables) -> DataFrame:
    """P8."""
    return t.events.select("event_id", graph.labelled(F.col("event_type"), [("click|view", "look"), ("^p", "pay")], "other").alias("role"))


@query("SELECT doc_id FROM documents d WHERE lower(lang) IN ('en', 'fr') AND lower(source) = 'src1'")
def allow_list(t: Tables) -> DataFrame:
    """B17."""
    return routing.allowed(routing.allowed(t.documents, "lang", ["EN", "fr"]), "source", ["SRC1"]).select("doc_id")


@query(f"SELECT item_id, {_CANON.format('b.text')} <> '' AND EXISTS (SELECT 1 FROM documents d WHERE {_CANON.format('d.text')} = {_CANON.format('b.text')}) AS duplicate FROM benchmark b")
def benchmark_semi_gate(t: Tables) -> DataFrame:
    """C5 on the canonical key of the whole text."""
    return joins.gated(t.benchmark.select("item_id", canon_text("text").alias("key")), t.documents.select(canon_text("text").alias("key")), "key").select("item_id", "duplicate")


@query(
    f"""
WITH l AS (SELECT text FROM documents UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents),
k AS (SELECT DISTINCT {_CANON.format('l.text')} AS key FROM l)
SELECT conv_id, turn, EXISTS (SELECT 1 FROM k WHERE key = {_CANON.format('c.text')} AND key <> '') AS duplicate FROM conversations c
"""
)
def turns_gate(t: Tables) -> DataFrame:
    """Turns of conversations that a document, or a line of one, says as well."""
    lines = t.documents.select("text").unionByName(t.documents.select(F.explode(F.split("text", "\n")).alias("text")))
    return joins.gated(t.conversations.select("conv_id", "turn", canon_text("text").alias("key")), lines.select(canon_text("text").alias("key")), "key").select("conv_id", "turn", "duplicate")
