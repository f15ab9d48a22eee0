"""Submitted records as a stream: checked, routed and appended, once each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.routing import submission_check


def checked(records: DataFrame, types: Sequence[str]) -> DataFrame:
    """Records with ``ok``, ``message`` and ``destination``; for batches and streams alike."""
    return records.withColumn("_check", submission_check(types)).select(*records.columns, "_check.*")


def append(stream: DataFrame, types: Sequence[str], target: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write accepted records to a folder for each destination, and rejected ones to ``rejected``.

    Every micro-batch goes to a folder of its own number, overwritten if the batch is run again, so a restart neither loses
    nor repeats a record. ``trigger`` is that of the writer (for example ``{"processingTime": "3 hours"}``).
    """

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        route = F.when(F.col("ok"), F.col("destination")).otherwise("rejected")
        batch.withColumn("route", route).write.mode("overwrite").partitionBy("route").parquet(f"{target}/batch={number}")

    return checked(stream, types).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
