"""Ledger queries: keys, last write wins per key, retryable failures, retry set, skips, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.operators import ledger as LG
from pricelens.plans.registry import register
from pricelens.sources.tables import shape, shape_cte

CTE = shape_cte("ledger")
NOW_EPOCH = 1_767_225_600  # 2026-01-01T00:00:00Z, fixed so the ttl is reproducible


def _ledger(spark, sf):
    return shape(spark, sf, "ledger")


def _ledger_rows(df):
    """Ledger shape -> ledger records (pk, sk, ..., ttl) with event_id as the write order."""
    pk, sk, dt = LG.ledger_keys(F.col("source"), F.col("url"), F.col("dt").cast("string"))
    return df.select(
        pk.alias("pk"), sk.alias("sk"), "source", dt.alias("dt"), "url", "status",
        F.coalesce("reason", F.lit("")).alias("reason"), "attempt",
        LG.ledger_ttl(F.lit(NOW_EPOCH)).alias("ttl"), F.col("event_id").alias("seq"),
    )


_ROWS_SQL = (
    "lrows AS (SELECT concat(source, '#dt=', substr(CAST(dt AS VARCHAR), 1, 10)) AS pk, sha1(url) AS sk, source, "
    "substr(CAST(dt AS VARCHAR), 1, 10) AS dt, url, status, coalesce(reason, '') AS reason, attempt, "
    f"{NOW_EPOCH} + 30 * 86400 AS ttl, event_id AS seq FROM ledger)"
)


@register("url_key", CTE + ", " + _ROWS_SQL + " SELECT pk, sk, dt, ttl, seq FROM lrows")
def q_url_key(spark, sf):
    return _ledger_rows(_ledger(spark, sf)).select("pk", "sk", "dt", "ttl", "seq")


_LWW = (
    "lww AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk ORDER BY seq DESC) AS rn FROM lrows) WHERE rn = 1)"
)


@register(
    "ledger_upsert",
    CTE + ", " + _ROWS_SQL + ", " + _LWW + " SELECT pk, sk, source, dt, url, status, reason, attempt, ttl, seq FROM lww",
)
def q_ledger_upsert(spark, sf):
    rows = _ledger_rows(_ledger(spark, sf))
    # the first half of the events is the stored ledger, the rest arrives as new writes
    empty = rows.limit(0)
    return LG.ledger_upsert(LG.ledger_upsert(empty, rows.where(F.col("seq") % 2 == 0)), rows.where(F.col("seq") % 2 == 1))


@register(
    "retryable_failures",
    CTE + ", " + _ROWS_SQL + ", " + _LWW + " SELECT pk, sk, url, attempt FROM lww WHERE status = 'FAILED' "
    "AND (attempt IS NULL OR attempt < 2) AND url IS NOT NULL AND length(url) > 0",
)
def q_retryable_failures(spark, sf):
    rows = LG.ledger_upsert(_ledger_rows(_ledger(spark, sf)).limit(0), _ledger_rows(_ledger(spark, sf)))
    return LG.retryable_failures(rows).select("pk", "sk", "url", "attempt")


@register(
    "retry_set",
    CTE + ", " + _ROWS_SQL + ", " + _LWW + " SELECT source, dt, '20260316_000000-retry2' AS retry_run_id, url FROM lww "
    "WHERE status = 'FAILED' AND (attempt IS NULL OR attempt < 2) AND url IS NOT NULL AND length(url) > 0",
)
def q_retry_set(spark, sf):
    rows = LG.ledger_upsert(_ledger_rows(_ledger(spark, sf)).limit(0), _ledger_rows(_ledger(spark, sf)))
    return LG.retry_set(rows, "20260316_000000", 2)


_SKIPS = "skips AS (SELECT source, reason FROM ledger WHERE status = 'FAILED')"


@register(
    "skip_reasons",
    CTE + ", " + _SKIPS + " SELECT source, coalesce(CASE WHEN length(reason) > 0 THEN reason END, 'unknown') AS reason, count(*) AS n "
    "FROM skips GROUP BY 1, 2",
)
def q_skip_reasons(spark, sf):
    return LG.skip_reasons(_ledger(spark, sf).where(F.col("status") == LG.FAILED).select("source", "reason"))


@register(
    "sorted_reasons",
    CTE + ", " + _SKIPS + " SELECT source, string_agg(concat(r, '=', CAST(n AS VARCHAR)), ', ' ORDER BY r) AS reasons FROM ("
    "SELECT source, coalesce(CASE WHEN length(reason) > 0 THEN reason END, 'unknown') AS r, count(*) AS n FROM skips GROUP BY 1, 2) GROUP BY source",
)
def q_sorted_reasons(spark, sf):
    counts = LG.skip_reasons(_ledger(spark, sf).where(F.col("status") == LG.FAILED).select("source", "reason"))
    return counts.groupBy("source").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))),
            ", ",
        ).alias("reasons")
    )


@register(
    "crawl_summary",
    CTE + " SELECT source, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'FAILED') AS failed, "
    "count(*) AS total FROM ledger GROUP BY source",
)
def q_crawl_summary(spark, sf):
    led = _ledger(spark, sf)
    return LG.crawl_summary(led.where(F.col("status") == LG.SUCCESS), led.where(F.col("status") == LG.FAILED))
