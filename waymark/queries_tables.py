"""Queries of dedupe, votes, aggregates, orders and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark import rank
from waymark.catalog import Tables, query
from waymark.functions import geo
from waymark.functions.text import canon_text
from waymark.operators import aggregates, routing, tables

@query(
    """
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, regexp_replace(strip_accents(lower(trim(c_mktsegment || ' ' || (o_custkey % 40) || ' ' || o_orderpriority))), '[^a-z0-9]+', '', 'g') AS key, o_totalprice > 100000 AS better
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2),
d AS (SELECT o_custkey, o_orderpriority AS lead FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS nth FROM c) WHERE nth = 1 AND n >= 0.4 * total),
k AS (SELECT o.*, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN better THEN 0 ELSE 1 END, o_orderkey) = 1 AS kept FROM o),
s AS (SELECT CASE WHEN NOT kept THEN 'Duplicate' WHEN lead IS NOT NULL AND lead <> o_orderpriority THEN 'Fail' ELSE 'Pass' END AS status FROM k LEFT JOIN d USING (o_custkey))
SELECT coalesce(status, 'Total') AS status, count(*) AS n, CAST(CASE WHEN grouping(status) = 1 THEN 4 WHEN status = 'Pass' THEN 0 WHEN status = 'Fail' THEN 1 ELSE 2 END AS INTEGER) AS position FROM s GROUP BY ROLLUP (status)
"""
)
def order_outcomes(t: Tables) -> DataFrame:
    """Which rows are clean, duplicate or failed, and how many."""
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", canon_text(F.concat_ws(" ", "c_mktsegment", (F.col("o_custkey") % 40).cast("string"), "o_orderpriority")).alias("key"), (F.col("o_totalprice") > 100000).alias("better"))
    lead = aggregates.dominant(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey", 0.4).select("o_custkey", F.col("o_orderpriority").alias("lead"))
    kept = tables.keep_best(o, "key", F.col("better"), "o_orderkey").join(lead, "o_custkey", "left")
    status = routing.cascade([(~F.col("kept"), "Duplicate"), (F.col("lead") != F.col("o_orderpriority"), "Fail")], "Pass")
    return routing.status_summary(kept.withColumn("status", status), "status")


@query("SELECT doc_id, md5(text) AS key FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def dedupe_keep_first_documents(t: Tables) -> DataFrame:
    """E1."""
    return tables.keep_first(t.documents.select("doc_id", F.md5("text").alias("key")), ["key"], ["doc_id"])


@query(
    """
SELECT d.doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END, d.doc_id) = 1 AS kept
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
"""
)
def dedupe_keep_best_documents(t: Tables) -> DataFrame:
    """E2."""
    labelled = t.labels.select("doc_id").distinct().withColumn("has", F.lit(True))
    d = t.documents.select("doc_id", F.md5("text").alias("key")).join(labelled, "doc_id", "left")
    return tables.keep_best(d, "key", F.coalesce("has", F.lit(False)), "doc_id").select("doc_id", "kept")


@query(
    """
SELECT doc_id, copies, lo = hi AS exact FROM (
  SELECT doc_id, count(*) OVER p AS copies, min(source) OVER p AS lo, max(source) OVER p AS hi FROM documents WINDOW p AS (PARTITION BY md5(text))) WHERE copies > 1
"""
)
def duplicate_audit_documents(t: Tables) -> DataFrame:
    """D12."""
    return aggregates.repeated(t.documents.select("doc_id", "source", F.md5("text").alias("key")), ["key"], "source").select("doc_id", "copies", "exact")


@query(
    """
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_id, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_id) AS nth FROM c)
SELECT o_custkey, o_orderpriority, n, CAST(total AS BIGINT) AS total FROM r WHERE nth = 1 AND n >= 3 AND n >= 0.6 * total
"""
)
def dominant_priority_per_customer(t: Tables) -> DataFrame:
    """D1, D4, D5."""
    return aggregates.dominant(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey", 0.6, 3).select("o_custkey", "o_orderpriority", "n", "total")


@query(
    """
WITH d AS (SELECT o_orderkey, o_custkey, o_orderpriority AS p, o_orderstatus <> 'P' AS settled FROM orders),
c AS (SELECT o_custkey, p, count(*) AS n, min(o_orderkey) AS f, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM d WHERE settled GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS nth FROM c),
w AS (SELECT o_custkey, p FROM r WHERE nth = 1 AND n >= 2 AND n >= 0.4 * total)
SELECT o_orderkey, CASE WHEN settled THEN d.p ELSE coalesce(w.p, d.p) END AS priority FROM d LEFT JOIN w USING (o_custkey)
"""
)
def dominance_pull(t: Tables) -> DataFrame:
    """D5, E5."""
    d = aggregates.pulled(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey", F.col("o_orderstatus") != "P", 0.4, 2)
    return d.select("o_orderkey", F.col("o_orderpriority").alias("priority"))


@query(
    """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, first_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id) AS nth FROM c) WHERE nth = 1
"""
)
def mode_first_seen(t: Tables) -> DataFrame:
    """D2."""
    return rank.mode_first_seen(t.events, ["user_id"], "event_type", "event_id").select("user_id", "event_type", "n", "first_id")


@query(
    """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END, c_mktsegment) AS nth FROM c)
WHERE nth = 1
"""
)
def mode_policy_tiebreak(t: Tables) -> DataFrame:
    """D3."""
    seg = F.col("c_mktsegment")
    return aggregates.policy_mode(t.customer, ["c_nationkey"], "c_mktsegment", seg == "BUILDING", seg == "MACHINERY")


@query(
    """
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderkey) AS f, sum(count(*)) OVER (PARTITION BY o_custkey) AS total FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS nth FROM c)
SELECT o_custkey, o_orderstatus, n FROM r WHERE nth = 1 AND (n = total OR n >= greatest(3, floor(0.7 * total)))
"""
)
def plurality_early_exit(t: Tables) -> DataFrame:
    """D6."""
    return aggregates.plurality(t.orders, ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderstatus", "n")


def _points(t: Tables) -> DataFrame:
    x = lambda i: (F.element_at("embedding", i).cast("double"))
    return t.embeddings.select("vec_id", (F.col("vec_id") % 10).alias("street"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"), (x(1) - 36.9).alias("lat"), (x(2) + 174.8).alias("lon"))


_POINTS = """
WITH p AS (SELECT vec_id, vec_id % 10 AS street, 'L' || label AS label, CAST(embedding[1] AS DOUBLE) - 36.9 AS lat, CAST(embedding[2] AS DOUBLE) + 174.8 AS lon FROM embeddings),
c AS (SELECT street, avg(lat) AS c_lat, avg(lon) AS c_lon FROM p GROUP BY 1),
d AS (
  SELECT p.*, 6371000.0 * sqrt(pow(radians(c_lon - lon) * cos(radians((lat + c_lat) / 2)), 2) + pow(radians(c_lat - lat), 2)) AS m FROM p JOIN c USING (street))
"""


@query(
    _POINTS
    + """
, k AS (SELECT *, row_number() OVER (PARTITION BY street ORDER BY m, vec_id) AS nth FROM d),
v AS (SELECT street, label, count(*) AS votes, avg(m) AS mean_m FROM k WHERE nth <= 7 GROUP BY 1, 2)
SELECT street, label, votes, round(mean_m, 2) AS mean_m FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY votes DESC, mean_m, label) AS r FROM v) WHERE r = 1
"""
)
def centroid_knn_vote(t: Tables) -> DataFrame:
    """D7, D8, F4, J2."""
    v = aggregates.nearest_vote(_points(t), ["street"], "label", "lat", "lon", "vec_id", 7)
    return v.select("street", "label", "votes", F.round("mean_m", 2).alias("mean_m"))


@query(
    _POINTS
    + """
, v AS (SELECT street, label, count(*) AS n, avg(m) AS mean_m FROM d GROUP BY 1, 2),
w AS (SELECT *, min(mean_m) OVER (PARTITION BY street) AS least FROM v)
SELECT street, label, n, round(mean_m, 2) AS mean_m FROM (SELECT *, row_number() OVER (PARTITION BY street ORDER BY n DESC, label DESC) AS r FROM w WHERE mean_m <= least + 1e-6) WHERE r = 1
"""
)
def min_avg_distance_label(t: Tables) -> DataFrame:
    """D9."""
    v = aggregates.nearest_mean(_points(t), ["street"], "label", "lat", "lon")
    return v.select("street", "label", "n", F.round("mean_m", 2).alias("mean_m"))


@query(
    _POINTS
    + """
SELECT vec_id, bool_or(NOT (lat BETWEEN -37.15 AND -36.65 AND lon BETWEEN 174.5 AND 175.1)) OVER (PARTITION BY street) AS demoted FROM p
"""
)
def any_out_of_region_demotion(t: Tables) -> DataFrame:
    """D15, J3."""
    box = geo.Box(-37.15, -36.65, 174.5, 175.1)
    return aggregates.any_in_group(_points(t), ["street"], ~box.holds(F.col("lat"), F.col("lon")), "demoted").select("vec_id", "demoted")


@query(
    """
SELECT o_custkey, bool_and(o_orderstatus = 'O') AS all_blank, bool_or(o_totalprice > 200000) AS any_out, count(*) AS total FROM orders GROUP BY 1
"""
)
def group_stats(t: Tables) -> DataFrame:
    """D15."""
    return aggregates.group_stats(t.orders, ["o_custkey"], F.col("o_orderstatus") == "O", F.col("o_totalprice") > 200000)


@query(
    """
SELECT user_id, CASE WHEN count(*) > 20 THEN string_agg(item, '; ' ORDER BY event_id) FILTER (WHERE nth <= 20) || '; ...' ELSE string_agg(item, '; ' ORDER BY event_id) END AS items, count(*) AS n
FROM (SELECT user_id, event_id, event_type || ':' || event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) GROUP BY user_id
"""
)
def grouped_concat_cap20(t: Tables) -> DataFrame:
    """D14."""
    d = t.events.withColumn("item", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")))
    return aggregates.listed(d, ["user_id"], "item", "event_id")


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def spanning_segments(t: Tables) -> DataFrame:
    """D11."""
    return aggregates.spanning(t.customer, ["c_nationkey"], "c_mktsegment").select("c_nationkey", F.array_join("values", ",").alias("segments"), "n")


@query(
    """
SELECT arg_min(word, doc_id) AS word FROM (SELECT doc_id, split_part(text, ' ', 1) AS word FROM documents) GROUP BY regexp_replace(strip_accents(lower(trim(word))), '[^a-z0-9]+', '', 'g')
"""
)
def distinct_folded_words(t: Tables) -> DataFrame:
    """D10."""
    d = t.documents.select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("word"))
    return aggregates.distinct_folded(d, "word", canon_text("word"), "doc_id")


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def sum_per_segment(t: Tables) -> DataFrame:
    """D13."""
    return aggregates.summed(t.customer, "c_mktsegment", "c_acctbal").withColumn("total", F.round("total", 2))


@query(
    r"""
WITH v AS (
  SELECT field, value, count(*) AS n FROM (
    SELECT 'p_size' AS field, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'p_brand', trim(p_brand) FROM part UNION ALL SELECT 'p_type', trim(p_type) FROM part) GROUP BY 1, 2)
SELECT field, value, n, CAST(row_number() OVER (PARTITION BY field ORDER BY CASE WHEN field = 'p_size' AND value = '7' THEN 0 END NULLS LAST, n DESC,
  CASE WHEN regexp_matches(value, '^\d+$') THEN 0 ELSE 1 END, TRY_CAST(value AS BIGINT) NULLS FIRST, lower(value), value) AS INTEGER) AS position FROM v
"""
)
def freq_then_alpha(t: Tables) -> DataFrame:
    """D17, F3."""
    return aggregates.lookup_lists(t.part, ["p_size", "p_brand", "p_type"], {"p_size": ["7"]})


@query(
    """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p_brand, p_type, n, count(*) OVER (PARTITION BY p_brand) = 1 AS only FROM c
"""
)
def suffix_counts(t: Tables) -> DataFrame:
    """D18."""
    return aggregates.suffix_counts(t.part, "p_brand", "p_type")


_HIST = """
WITH h AS (SELECT CAST(least(greatest(floor((l_extendedprice - 900.0) / (100000.0 - 900.0) * 64), 0), 63) AS INTEGER) AS bin, count(*) AS c FROM lineitem GROUP BY 1),
b AS (SELECT CAST(r AS INTEGER) AS bin, coalesce(c, 0) AS n FROM range(64) x(r) LEFT JOIN h ON h.bin = x.r),
s AS (SELECT bin, n, avg(n) OVER (ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smoothed, CAST(sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM b)
"""


@query(_HIST + "SELECT bin, n, round(smoothed, 6) AS smoothed, running FROM s")
def histogram_smooth(t: Tables) -> DataFrame:
    """D19, E6, E7."""
    return aggregates.histogram(t.lineitem, "l_extendedprice", 900.0, 100000.0).withColumn("smoothed", F.round("smoothed", 6))


@query(
    _HIST
    + """
, a AS (SELECT CAST(k AS INTEGER) AS cut, min(bin) AS at_bin FROM s, range(1, 4) x(k) WHERE running * 4 >= (SELECT max(running) FROM s) * k GROUP BY 1),
n AS (SELECT cut, at_bin, bin, row_number() OVER (PARTITION BY cut ORDER BY smoothed, abs(bin - at_bin), bin) AS nth FROM s JOIN a ON abs(bin - at_bin) <= 3)
SELECT cut, at_bin, bin FROM n WHERE nth = 1
"""
)
def histogram_valleys(t: Tables) -> DataFrame:
    """D19."""
    return aggregates.valleys(aggregates.histogram(t.lineitem, "l_extendedprice", 900.0, 100000.0), 4).withColumnRenamed("at", "at_bin")


@query(
    """
WITH c AS (SELECT var_pop(CAST(embedding[1] AS DOUBLE)) AS sxx, var_pop(CAST(embedding[2] AS DOUBLE)) AS syy, covar_pop(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)) AS sxy FROM embeddings)
SELECT round(sxx, 9) AS sxx, round(syy, 9) AS syy, round(sxy, 9) AS sxy, round(0.5 * atan2(2 * sxy, sxx - syy), 6) AS angle FROM c
"""
)
def principal_axis(t: Tables) -> DataFrame:
    """D20."""
    p = t.embeddings.select(F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return aggregates.principal_axis(p, "x", "y").select(*[F.round(c, 9).alias(c) for c in ("sxx", "syy", "sxy")], F.round("angle", 6).alias("angle"))


@query(
    """
WITH p AS (SELECT event_type AS function, count(*) AS calls, round(sum(value), 4) AS own_s, round(sum(value * 2), 4) AS total_s FROM events GROUP BY 1)
SELECT * FROM (SELECT * FROM p ORDER BY own_s DESC, function LIMIT 2) UNION SELECT * FROM (SELECT * FROM p ORDER BY total_s DESC, function LIMIT 2)
"""
)
def time_profile(t: Tables) -> DataFrame:
    """D21."""
    calls = t.events.select(F.col("event_type").alias("function"), F.col("value").alias("own_s"), (F.col("value") * 2).alias("total_s"))
    return aggregates.profile(calls, 2).withColumns({"own_s": F.round("own_s", 4), "total_s": F.round("total_s", 4)})


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders")
def row_ids(t: Tables) -> DataFrame:
    """E3, T13."""
    return rank.with_row_id(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 300) AS BIGINT) + 1 AS chunk FROM orders")
def chunk_by_300(t: Tables) -> DataFrame:
    """A16."""
    return tables.chunked(t.orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "chunk")


@query(
    """
SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1 END, lower(c_mktsegment), lower(CAST(c_nationkey AS VARCHAR)), c_custkey % 50, lower(CAST(c_custkey % 50 AS VARCHAR)), c_custkey) AS place FROM customer
"""
)
def address_order(t: Tables) -> DataFrame:
    """F1, E4."""
    d = t.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("Street"), F.col("c_nationkey").cast("string").alias("Suburb"), (F.col("c_custkey") % 50).cast("string").alias("Number"))
    return rank.with_row_id(d, tables.address_order("c_custkey", [F.col("c_nationkey") % 2]), "place").select("c_custkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 100, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE '' END, p_partkey) AS place FROM part")
def dotted_key_sort(t: Tables) -> DataFrame:
    """F2."""
    key = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 100).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "A").otherwise(""))
    d = t.part.select("p_partkey", tables.dotted_key(key).alias("k"))
    return rank.with_row_id(d, ["k", "p_partkey"], "place").select("p_partkey", "place")


@query(
    """
WITH n AS (SELECT c_custkey, 'File' || (c_custkey % 120) || CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE '' END AS f FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey % 120, c_custkey % 2 = 0, c_custkey) AS place FROM n
"""
)
def natural_sort(t: Tables) -> DataFrame:
    """F2."""
    name = F.concat(F.lit("File"), (F.col("c_custkey") % 120).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "b").otherwise(""))
    d = t.customer.select("c_custkey", tables.natural_key(name).alias("k"))
    return rank.with_row_id(d, ["k", "c_custkey"], "place").select("c_custkey", "place")


@query(
    """
WITH r AS (SELECT p_partkey, p_name, lower(p_name) AS n FROM part),
c AS (SELECT max(k) AS k FROM r, (VALUES (1), (2), (3), (4)) v(k) WHERE starts_with(n, substr('ring', 1, k)))
SELECT p_partkey, p_name, CAST(CASE WHEN starts_with(n, substr('ring', 1, k)) THEN 1 WHEN contains(' ' || n, ' ring') THEN 2 ELSE 3 END AS INTEGER) AS tier FROM r, c
WHERE starts_with(n, substr('ring', 1, k)) OR contains(n, 'ring') ORDER BY tier, p_partkey LIMIT 300
"""
)
def prefix_search_rank(t: Tables) -> DataFrame:
    """F9, F7."""
    return tables.searched(t.part.select("p_partkey", "p_name"), "p_name", "Ring", "p_partkey", 300)


@query(
    """
WITH l AS (SELECT DISTINCT upper(n_name[1]) AS letter, n_name FROM nation), p AS (SELECT *, row_number() OVER (PARTITION BY letter ORDER BY n_name) AS place FROM l)
SELECT CAST(place AS INTEGER) AS place, min(n_name) FILTER (WHERE letter = 'N') AS "N", min(n_name) FILTER (WHERE letter = 'A') AS "A", min(n_name) FILTER (WHERE letter = 'I') AS "I"
FROM p GROUP BY place
"""
)
def letter_pivot(t: Tables) -> DataFrame:
    """F8."""
    return tables.letter_columns(t.nation, "n_name", ["N", "A", "I"])


@query("SELECT user_id, least(count(*), 20) AS n FROM events GROUP BY 1")
def sample_cap_per_group(t: Tables) -> DataFrame:
    """F6; which rows are drawn is tested by repetition."""
    return tables.sampled(t.events, ["user_id"], "event_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT CAST(id AS BIGINT) AS id, coalesce(name, '') AS name, coalesce(seg, '') AS seg, coalesce(phone, '') AS phone FROM (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS phone FROM supplier)
"""
)
def union_by_name_superset(t: Tables) -> DataFrame:
    """G1, G2."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.lit(1).alias("_x"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("phone"))
    return tables.union_by_name([a, b])


@query(
    """
WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice
"""
)
def index_diff(t: Tables) -> DataFrame:
    """G5."""
    k = F.col("o_orderkey")
    a = t.orders.where(k % 5 != 0).select("o_orderkey", "o_totalprice")
    b = t.orders.where(k % 3 != 0).select("o_orderkey", F.when(k % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return tables.index_diff(a, b, "o_orderkey", ["o_totalprice"])


@query("SELECT DISTINCT round(CAST(embedding[1] AS DOUBLE), 1) AS lat, round(CAST(embedding[2] AS DOUBLE), 1) AS lon FROM embeddings")
def probe_dedupe(t: Tables) -> DataFrame:
    """N4."""
    return t.embeddings.select(F.round(F.element_at("embedding", 1).cast("double"), 1).alias("lat"), F.round(F.element_at("embedding", 2).cast("double"), 1).alias("lon")).distinct()
