"""Tables that a job writes between its steps, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only where spark.checkpoint.dir is unset and Spark runs in one process.
LOCAL_FOLDER = "file:///tmp/checkpoints/waymark"

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only under a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_FOLDER


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **wanted: Column) -> tuple[DataFrame, dict]:
    """As :func:`stored`, with aggregates of the table that are taken as it is written, not by another pass."""
    seen = Observation()
    table = stored(df.observe(seen, *[c.alias(k) for k, c in wanted.items()]), name)
    return table, seen.get


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables, all that were written so far or those of ``paths``; call it once the results made from them are written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in list(_written if paths is None else paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _written:
            _written.remove(name)


def written() -> list[str]:
    """The tables that are there now."""
    return list(_written)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stored`, but the table outlives the next :func:`release`, for results that a later step reads."""
    found = stored(df, name)
    _written.pop()
    return found
