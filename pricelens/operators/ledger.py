"""Crawl bookkeeping: fetch-status ledger, retry sets, skip reasons, crawl summary.

The ledger is a table keyed by (source#dt, sha1(url)) where the last write wins; every
operation here is a filter, an aggregate or a keyed merge - nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.operators.load import last_write_wins

# Fixed values
FAILED, SUCCESS = "FAILED", "SUCCESS"
UNKNOWN_REASON = "unknown"
LEDGER_TTL_DAYS = 30
DEFAULT_MAX_ATTEMPTS = 2
RETRY_SUFFIX = "-retry"


def ledger_keys(source: Column, url: Column, extracted_at: Column) -> tuple[Column, Column, Column]:
    """(pk, sk, dt): dt = first 10 chars of the extraction time, pk = 'source#dt=dt',
    sk = sha1(url)."""
    dt = F.substring(extracted_at, 1, 10)
    return F.concat(source, F.lit("#dt="), dt), F.sha1(url), dt


def ledger_ttl(now_epoch: Column, days: int = LEDGER_TTL_DAYS) -> Column:
    return now_epoch + F.lit(days * 86400)


def ledger_upsert(ledger: DataFrame, events: DataFrame, order: str = "seq") -> DataFrame:
    """Merge outcome events into the ledger; per (pk, sk) the latest write wins."""
    cols = ledger.columns
    merged = ledger.select(*cols).unionByName(events.select(*cols))
    return last_write_wins(merged, ["pk", "sk"], order).select(*cols)


def expire(ledger: DataFrame, now_epoch: int) -> DataFrame:
    """Rows whose ttl passed are gone (T1's retention)."""
    return ledger.where(F.col("ttl").isNull() | (F.col("ttl") > F.lit(now_epoch)))


def retryable_failures(ledger: DataFrame, max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """FAILED rows with attempt < max (or no attempt recorded) and a non-empty url."""
    return ledger.where(
        (F.col("status") == FAILED)
        & (F.col("attempt").isNull() | (F.col("attempt") < max_attempts))
        & F.col("url").isNotNull()
        & (F.length("url") > 0)
    )


def retry_set(ledger: DataFrame, run_id: str, retry_attempt: int, max_attempts: int = DEFAULT_MAX_ATTEMPTS) -> DataFrame:
    """Failed urls per (source, dt) under a new run id ``<run>-retry<n>``; one row per url.

    The manifest is written per (source, dt) partition by a distributed writer
    (:func:`pricelens.sources.io.write_url_manifest`), never gathered on the driver.
    """
    return retryable_failures(ledger, max_attempts).select(
        "source", "dt", F.lit(f"{run_id}{RETRY_SUFFIX}{retry_attempt}").alias("retry_run_id"), "url"
    )


def reason_or_unknown(reason: Column) -> Column:
    return F.coalesce(F.when(F.length(reason) > 0, reason), F.lit(UNKNOWN_REASON))


def skip_reasons(skips: DataFrame) -> DataFrame:
    """A4: skip records per (source, reason); blank/missing reason -> 'unknown'; sorted."""
    return (
        skips.groupBy("source", reason_or_unknown(F.col("reason")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("source", "reason")
    )


def crawl_summary(parts_rows: DataFrame, skips: DataFrame) -> DataFrame:
    """A3: per source: success rows, failed (skip records), total."""
    s = parts_rows.groupBy("source").agg(F.count(F.lit(1)).alias("success"))
    f = skips.groupBy("source").agg(F.count(F.lit(1)).alias("failed"))
    return (
        s.join(f, "source", "full_outer")
        .select(
            "source",
            F.coalesce("success", F.lit(0)).alias("success"),
            F.coalesce("failed", F.lit(0)).alias("failed"),
        )
        .withColumn("total", F.col("success") + F.col("failed"))
    )
