"""Streaming forms: deduplicated deliveries and a watcher of changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.history import compare_with_latest
from docketry.operators.scoring import score_records


def distinct_deliveries(stream: DataFrame, time: str = "received_at", delay: str = "7 days") -> DataFrame:
    """Each (source, application number) once per watermark; the state is dropped behind it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "applicationNumber"])


def watch_changes(stream: DataFrame, log_path: str, out_path: str, checkpoint: str):
    """Append to ``out_path`` every arriving record that differs from its latest decision.

    Each micro-batch reads the log anew, so later decisions count. ``stream`` has record columns.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        log = batch.sparkSession.read.parquet(log_path)
        hits = compare_with_latest(batch, log).filter(F.size("differences") > 0)
        hits.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out_path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def score_stream(stream: DataFrame, technology: str) -> DataFrame:
    """Scoring is row-wise, so it runs on a stream unchanged."""
    return score_records(stream, technology)
