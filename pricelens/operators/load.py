"""Loading the price mart: last-write-wins dedupe, one-month retention, upsert by key.

The database transaction of a row store becomes a table rewrite:
``result = (retained existing rows that no staged row replaces) UNION staged rows``.
Running the same date twice gives the same table (idempotent), and the result is
written to a *new* location - a job never overwrites the path it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The mart key and the retention window.
MART_KEY = ["part_official_name", "car_type", "extracted_at"]
RETENTION_MONTHS = 1


def last_write_wins(df: DataFrame, key: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    """One row per key - the one with the greatest ``order`` (explicit sequence column[s]).

    An aggregate (``max_by`` over a struct of all columns), so it combines map-side and a
    hot key never lands whole in one task.
    """
    order_cols = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in key]
    ordering = F.struct(*[F.col(c) for c in order_cols])
    return (
        df.groupBy(*key)
        .agg(F.max_by(F.struct(*[F.col(c) for c in others]), ordering).alias("_last"))
        .select(*key, *[F.col(f"_last.{c}").alias(c) for c in others])
    )


def retention_cutoff(ds: str):
    return F.add_months(F.to_date(F.lit(ds)), -RETENTION_MONTHS)


def retention(df: DataFrame, ds: str, date_col: str = "extracted_at") -> DataFrame:
    """keep rows with date >= run date - 1 month (older rows are dropped)."""
    return df.where(F.col(date_col).cast("date") >= retention_cutoff(ds))


def expired(df: DataFrame, ds: str, date_col: str = "extracted_at") -> DataFrame:
    """The rows that :func:`retention` deletes - older ones and those without a date."""
    return df.where(~F.coalesce(F.col(date_col).cast("date") >= retention_cutoff(ds), F.lit(False)))


def upsert_mart(existing: DataFrame, staged: DataFrame, ds: str, order: str | Sequence[str], key: Sequence[str] = MART_KEY) -> DataFrame:
    """D1 + D2: retention on the existing table, then staged rows replace rows with the same
    key; of several staged rows with a key the last by ``order`` (column or columns) wins."""
    cols = existing.columns
    order_cols = [order] if isinstance(order, str) else list(order)
    ordered = staged.select(*cols, *[c for c in order_cols if c not in cols])
    staged_one = last_write_wins(ordered, key, order_cols).select(*cols)
    kept = retention(existing, ds).join(staged_one.select(*key), list(key), "left_anti").select(*cols)
    return kept.unionByName(staged_one)


def write_new_version(df: DataFrame, path: str, partition_by: Sequence[str] = ("extracted_at",)) -> None:
    """D3: write the upserted table to a fresh path (callers swap a pointer afterwards)."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def unique_docs(docs: DataFrame, key: Sequence[str] = ("vehicle_model", "symptom_text", "repair_parts", "evidence_text")) -> DataFrame:
    """One document per unique (model, symptom, parts, evidence); keeps the smallest id."""
    order = [c for c in docs.columns if c not in key]
    return (
        docs.groupBy(*key)
        .agg(F.min_by(F.struct(*[F.col(c) for c in order]), F.col("id")).alias("_d"))
        .select(*key, *[F.col(f"_d.{c}").alias(c) for c in order])
        .select(*docs.columns)
    )
