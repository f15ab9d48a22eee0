"""Spark sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "waymark", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` adds settings, with ``__`` for dots.

    Nothing else is set: partitions, memory and the checkpoint folder belong to the cluster.
    """
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**fixed, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
