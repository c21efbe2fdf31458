"""Streaming queries: ``events`` read as a file stream to the end of the input
(``availableNow``); results equal their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.plans.q_io import scratch
from pricelens.plans.q_ledger import _LWW, _ROWS_SQL, NOW_EPOCH, _ledger_rows
from pricelens.plans.registry import register
from pricelens.sources.tables import SHAPES, read_table, shape_cte
from pricelens.streaming.state import stream_ledger, stream_unseen


def _event_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    # the table folder as a file stream, restricted to the events file(s)
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*.parquet")
        .parquet(sf.rstrip("/"))
    )


def _to_ledger(spark):
    def fn(batch):
        shaped = batch.sparkSession.sql(SHAPES["ledger"], events=batch)
        return _ledger_rows(shaped)

    return fn


@register(
    "stream_ledger",
    shape_cte("ledger") + ", " + _ROWS_SQL + ", " + _LWW + " SELECT pk, sk, source, dt, url, status, reason, attempt, ttl, seq FROM lww",
)
def q_stream_ledger(spark, sf):
    root = scratch(spark, "ledger-stream")
    out = stream_ledger(spark, _event_stream(spark, sf), _to_ledger(spark), f"{root}/state", f"{root}/_checkpoint", NOW_EPOCH)
    return out.select("pk", "sk", "source", "dt", "url", "status", "reason", "attempt", "ttl", "seq")


@register("stream_unseen", "SELECT DISTINCT user_id FROM events")
def q_stream_unseen(spark, sf):
    root = scratch(spark, "unseen-stream")
    out = stream_unseen(spark, _event_stream(spark, sf).select("user_id", "event_id", "ts"), "user_id", f"{root}/out", f"{root}/_checkpoint")
    return out.select("user_id")


@register("stream_unseen_watermarked")
def q_stream_unseen_watermarked(spark, sf):
    """The bounded-state variant: duplicates are dropped within a 30-day event-time watermark."""
    root = scratch(spark, "unseen-wm")
    out = stream_unseen(
        spark, _event_stream(spark, sf).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")), "user_id",
        f"{root}/out", f"{root}/_checkpoint", watermark=("ts", "30 days"),
    )
    return out.select("user_id", F.col("ts").cast("string").alias("ts"))
