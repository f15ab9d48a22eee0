"""Boundaries between steps of a long plan, their shared folder, and jobs that can be followed and stopped."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``; a local one only under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/waymark"


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared checkpoint folder.

    Use it where a computed column is read by several later joins and filters: they would each compute it again, and a
    filter that is pushed through many projections copies every expression on its way.
    """
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str, **wanted: Column) -> tuple[DataFrame, dict]:
    """``df``, written to the shared folder and read again, with aggregates taken as it is written."""
    spark, seen = df.sparkSession, Observation()
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}-{name}"
    df.observe(seen, *[c.alias(k) for k, c in wanted.items()]).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all of the session's shuffle partitions, for work that is large beside its rows' bytes, by which adaptive execution
    would put them into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs within carry ``tag``, so that another thread can stop them, and only them, by :func:`cancel`."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the running jobs of a tag; the thread that waits for them gets an error."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> list[tuple[int, str, int, int, int]]:
    """Stage, name, tasks, tasks done and tasks failed of every stage that runs now."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(s.stageId, s.name, s.numTasks, s.numCompletedTasks, s.numFailedTasks) for s in found if s]
