"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import line_windows, mixing, packing, pii, quality_net, quality_rules, repeats, simhash, token_counts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removed(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(0, octet_length(b) - 199)) AS i, unnest(list_transform(range(0, octet_length(b) - 199), lambda i: hash(b[i + 1 : i + 200]))) AS k FROM d),
k AS (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS new FROM w SEMI JOIN k USING (k)),
n AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
g AS (SELECT r, run, min(i) AS lo, max(i) + 200 AS hi FROM n GROUP BY 1, 2),
x AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM g),
y AS (SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS ends FROM x GROUP BY 1),
q AS (SELECT r, string_agg(hex(b[before + 1 : lo]), '' ORDER BY lo) AS h FROM x JOIN d USING (r) GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(h, '') || hex(b[coalesce(ends, 0) + 1 : octet_length(b)]))) AS kept_sha256
FROM d LEFT JOIN y USING (r) LEFT JOIN q USING (r)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    return mixing.mixed(docs)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0:' || coalesce(text, '')) AS spot
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, row_number() OVER o AS k, 2.0 * source_size / w AS ratio,
         1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
r AS (SELECT arg_min(rest / weights, k) FILTER (WHERE rest / weights <= ratio) AS rate FROM f),
t AS (
  SELECT source, source_size, CAST(least(2.0 * source_size, w * (SELECT rate FROM r)) AS DOUBLE) AS target FROM f),
c AS (
  SELECT d.*, source_size, target, floor(target + 0.5) AS gives,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 + size AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(size * (CASE WHEN gives > 0 AND middle <= 2 * least(gives, source_size) THEN 1 ELSE 0 END
                  + CASE WHEN gives > source_size AND middle <= 2 * (gives - source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("double"))
    held = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))  # floor would hide them
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.when(~held, whole).alias("x"))
    return topk.top(vectors, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_windows.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS t
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d)),
f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, i) AS nth
  FROM w WHERE regexp_matches(t, '[^ 	-
]')),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM f, (VALUES (0), (1), (2)) v(o) WHERE nth > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (
  SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept,
         CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.i) AS BIGINT) AS n_removed
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS win FROM d),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM t),
c AS (SELECT r, count(DISTINCT i + o) AS covered FROM f, (VALUES (0), (1), (2)) v(o) WHERE twice GROUP BY 1),
m AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '[.,;:?]')) AS n_stops, len(regexp_extract_all(text, '!')) AS n_shouts
  FROM d LEFT JOIN c USING (r)),
s AS (
  SELECT *, n_symbols / greatest(n_words, 1) AS symbols, n_symbols / greatest(word_chars, 1) AS dense, n_repeat_words / greatest(n_words, 1) AS repeats, n_dup_lines / greatest(n_lines, 1) AS dups, word_chars / greatest(n_words, 1) AS size,
         n_capitals / greatest(word_chars, 1) AS capitals, n_stops / greatest(n_words, 1) AS stops, n_shouts / greatest(n_words, 1) AS shouts FROM m),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    CASE WHEN symbols > 0.1 THEN -1 WHEN symbols <= 0.01 THEN 1 ELSE 0 END,
    CASE WHEN dense > 0.04 THEN -1 WHEN dense <= 0.005 THEN 1 ELSE 0 END,
    CASE WHEN repeats > 0.3 THEN -1 WHEN repeats < 0.15 THEN 1 ELSE 0 END,
    CASE WHEN n_dup_lines >= 3 AND dups > 0.3 THEN -1 WHEN n_lines > 2 AND dups <= 0.1 THEN 1 ELSE 0 END,
    CASE WHEN n_words >= 20 AND NOT size BETWEEN 4.2 AND 7 THEN -1 WHEN n_words >= 20 AND size BETWEEN 4.4 AND 6.6 THEN 1 ELSE 0 END,
    CASE WHEN capitals > 0.4 THEN -1 WHEN capitals < 0.15 THEN 1 ELSE 0 END,
    CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END,
    CASE WHEN stops < 0.004 THEN -1 WHEN stops BETWEEN 0.02 AND 0.35 THEN 1 ELSE 0 END,
    CASE WHEN shouts > 0.2 THEN -1 WHEN shouts <= 0.02 THEN 1 ELSE 0 END] AS votes FROM s),
p AS (SELECT votes, count(*)::DOUBLE AS n, sum(count(*)) OVER () AS total FROM v GROUP BY 1),
e(round, prior, good, bad) AS (
  SELECT 0, 0.85::DOUBLE, list_transform(range(9), lambda k: 0.01::DOUBLE), list_transform(range(9), lambda k: 0.15::DOUBLE)
  UNION ALL
  SELECT round + 1, any_value(mass / all_mass), list(ag ORDER BY k), list(ab ORDER BY k) FROM (
    SELECT round, k, sum(n * g) + 0.85 * any_value(weight) AS mass, sum(n) + any_value(weight) AS all_mass,
           (coalesce(sum(n * g) FILTER (votes[k] = -1), 0) + 0.01 * any_value(weight)) / (coalesce(sum(n * g) FILTER (votes[k] <> 0), 0) + any_value(weight)) AS ag,
           (coalesce(sum(n * (1 - g)) FILTER (votes[k] = -1), 0) + 0.15 * 0.15 * any_value(weight)) / (coalesce(sum(n * (1 - g)) FILTER (votes[k] <> 0), 0) + 0.15 * any_value(weight)) AS ab
    FROM (
      SELECT round, votes, n, total * 0.05 + 1 AS weight,
             1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 10), lambda k: CASE votes[k] WHEN -1 THEN ln(good[k] / bad[k]) WHEN 1 THEN ln((1 - good[k]) / (1 - bad[k])) ELSE 0 END))))) AS g
      FROM e, p WHERE round < 25), range(1, 10) x(k)
    GROUP BY round, k)
  GROUP BY round)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS p_good
FROM (SELECT v.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 10), lambda k: CASE votes[k] WHEN -1 THEN ln(good[k] / bad[k]) WHEN 1 THEN ln((1 - good[k]) / (1 - bad[k])) ELSE 0 END))))) AS q
      FROM v, e WHERE round = 25)
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_net.fitted(docs, _table(spark, sf_dir, "labels"))
    scored = quality_net.scored(docs, net).withColumn("held_out", F.coalesce(quality_net.held_out(), F.lit(False)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_source_mixing": op3_source_mixing,
        "op4_packing": op4_packing,
        "op5_pii": op5_pii,
        "op6_topk": op6_topk,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": OP1_SQL, "op3_source_mixing": OP3_SQL, "op6_topk": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL}
