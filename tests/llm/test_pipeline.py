"""The pipeline's stages take effect, one after the other."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import scratch, shingles, simhash


def test_stages(spark, sf_dir):
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.kept(stage(spark, docs, sf_dir), name)
        assert docs.columns == first.columns
        n[name] = docs.count()
    assert n["quality"] < first.count() and n["lines"] == n["quality"] and 0 < n["near_duplicates"] < n["lines"]
    assert docs.select("doc_id").distinct().count() <= n["near_duplicates"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert pieces.columns == whole.columns
    assert pieces.agg({"length": "sum"}).first() == whole.agg({"length": "sum"}).first()
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_odd_tables(spark, sf_dir):
    """Clashing columns come through unchanged; nulls, repeats and empty tables are no trouble."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs.withColumns({"n_words": F.lit("w"), "at": F.lit(7), "kept": F.lit(None).cast("boolean"), "n_lines": F.lit(-1), "_k": F.lit("k"), "limit_1": F.lit("z"), "fp": F.lit(0.5), "component": F.lit("c")})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    for table in (odd, odd.where("false")):
        d = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = scratch.kept(stage(spark, d, sf_dir), name)
            assert d.columns == odd.columns
            assert d.where("at <> 7 or n_words <> 'w' or n_lines <> -1 or kept is not null or _k <> 'k' or limit_1 <> 'z' or fp <> 0.5 or component <> 'c'").count() == 0
        assert (corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).count() > 0) == (d.count() > 0)


def test_stages_on_very_long_texts(spark, sf_dir):
    """Texts of a megabyte, of words, of one word and of one line repeated, go through all stages."""
    rng = random.Random(0)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 6))) for _ in range(9)) + "."
    words = " ".join(sentence() for _ in range(18_000))
    line = "the same line of some words again\n" * 30_000
    long = "\n".join(sentence() for _ in range(18_000))
    rows = [(1, words, "en", "a", 0), (2, "x" * 1_000_000, "en", "a", 0), (3, line, "en", "b", 0), (4, long, "en", "b", 0), (5, long + "\nend", "en", "c", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = scratch.kept(stage(spark, d, sf_dir), name)
        kept[name] = {r.doc_id for r in d.select("doc_id").collect()}
    assert kept["quality"] >= {1, 4, 5} and 2 not in kept["quality"] and 3 not in kept["quality"]
    assert 4 in kept["near_duplicates"]
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).agg({"length": "sum"}).first()[0] > 100_000


def test_near_duplicates_go_through_fingerprints(spark):
    """Near copies are found by the index of fingerprints; what only lists of shingles see is linked as well, and nothing else."""
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(12):
        w = words(400)
        texts += [w, [*w[:-1], "other"], [*w[:200], "mid", "dle", *w[208:]], words(400)]
    rows = [(i, " ".join(w), "en", "a", 0) for i, w in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in simhash.representatives(d).collect()} == {i for i in range(48) if i % 4 in (0, 3)}
    marked = shingles.marked(d.select("doc_id", "text"), 5, simhash.summed).cache()
    name = {r.id: r.doc_id for r in marked.collect()}
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in simhash.near_sets(marked).collect()}
    assert {(i, i + 1) for i in range(0, 48, 4)} <= found and all(a // 4 == b // 4 for a, b in found)
