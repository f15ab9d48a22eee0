"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes the documents that the one before kept and returns a DataFrame; it is written and read again before
the next one, so what a stage has put aside in the shared folder goes when the next one begins. Tables of other
queries in the same session stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import line_windows, mixing, packing, quality_rules, scratch, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that operators read; all others go through in one of their own, so that no name clashes.
READ = ("doc_id", "text", "source")
_before: list[str] = []  # tables of the stage before


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, _before)
        there = set(scratch.written())
        rest = [c for c in docs.columns if c not in READ]
        bare = docs.select(*[c for c in docs.columns if c in READ], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))
        out = f(spark, bare, sf_dir)
        if "text" in out.columns:
            out = out.select(*[F.col(c) if c in READ else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
            if "n_chars" in rest:
                out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
        # The last stage's result isn't written here, so what it reads from stays.
        _before[:] = [p for p in scratch.written() if p not in there] if "text" in out.columns else []
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs, with_text=True).where("kept").select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the later occurrences of repeated three-line windows; ``n_chars`` follows the text."""
    return line_windows.deduplicated(docs).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.representatives(docs)


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.sampled(docs)


@_stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]
#: SQL can't express the estimation, the fingerprints and the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
