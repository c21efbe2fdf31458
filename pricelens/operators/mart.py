"""Representative part names and the daily price-range mart.

Plan shape (three hash aggregates, one scan, no window, no join):

1. ``(part_no, car_type, source, name)``: count of non-blank names plus min/max price
   of *all* rows (blank and null names keep their prices) - partial aggregation on the
   map side, so a hot key collapses to one row per task before the shuffle.
2. ``(part_no, car_type)``: the canonical name is ``min_by(name, (priority, -count,
   name))`` over non-blank names - the same row the two ``row_number`` windows of a
   per-source-then-per-part ranking would keep - together with min/max price.
   Groups with no usable name disappear, like an inner join with the name map.
3. ``(canonical_name, car_type)``: min/max price.

Every step is an aggregate with a partial (map-side) phase, so key skew never lands
whole in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.text import price_to_int

# Fixed value: rank given to a source missing from the priority table.
UNLISTED_SOURCE_PRIORITY = 99


def priority_expr(source: Column, priority: Mapping[str, int]) -> Column:
    """Source -> priority as a CASE expression (constant-folded, no join)."""
    expr = None
    for name, rank in priority.items():
        expr = F.when(source == F.lit(name), F.lit(rank)) if expr is None else expr.when(source == F.lit(name), F.lit(rank))
    if expr is None:
        return F.lit(UNLISTED_SOURCE_PRIORITY)
    return expr.otherwise(F.lit(UNLISTED_SOURCE_PRIORITY))


def _usable_name(name: Column) -> Column:
    return name.isNotNull() & (F.length(name) > 0)


def with_int_price(df: DataFrame) -> DataFrame:
    """Price column as int; strings go through ``try_cast`` (over-long or junk -> null)."""
    if dict(df.dtypes).get("price") == "int":
        return df
    return df.withColumn("price", price_to_int(F.col("price").cast("string"), digits_only=False))


def name_frequency(df: DataFrame) -> DataFrame:
    """A1: rows per (part_no, car_type, source, name), blank names dropped."""
    return (
        df.groupBy("part_no", "car_type", "source", "name")
        .agg(F.count(F.lit(1)).alias("count"))
        .where(_usable_name(F.col("name")))
    )


def top_name_per_source(df: DataFrame) -> DataFrame:
    """Most frequent name per (part_no, car_type, source); ties -> smallest name."""
    counts = name_frequency(df)
    best = F.min_by(F.struct("name", "count"), F.struct((-F.col("count")).alias("k"), F.col("name")))
    return (
        counts.groupBy("part_no", "car_type", "source")
        .agg(best.alias("b"))
        .select("part_no", "car_type", "source", "b.name", "b.count")
    )


def _name_stats(df: DataFrame) -> DataFrame:
    """Step 1 of the plan: counts of usable names plus price range of every row."""
    usable = _usable_name(F.col("name"))
    return df.groupBy("part_no", "car_type", "source", "name").agg(
        F.count(F.when(usable, F.lit(1))).alias("count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def _per_part(stats: DataFrame, priority: Mapping[str, int]) -> DataFrame:
    """Step 2: canonical name and price range per (part_no, car_type)."""
    usable = _usable_name(F.col("name")) & (F.col("count") > 0)
    order = F.when(
        usable,
        F.struct(
            priority_expr(F.col("source"), priority).alias("p"),
            (-F.col("count")).alias("c"),
            F.col("name").alias("n"),
        ),
    )
    return (
        stats.where(F.col("part_no").isNotNull() & F.col("car_type").isNotNull())
        .groupBy("part_no", "car_type")
        .agg(
            F.min_by(F.col("name"), order).alias("canonical_name"),
            F.min("min_price").alias("min_price"),
            F.max("max_price").alias("max_price"),
            F.max(F.when(usable, F.lit(True))).alias("has_name"),
        )
        .where(F.col("has_name"))
        .drop("has_name")
    )


def canonical_name_map(df: DataFrame, priority: Mapping[str, int], dt: str | None = None) -> DataFrame:
    """W2 / canonical map: (part_no, car_type, canonical_name[, dt])."""
    out = _per_part(_name_stats(with_int_price(df)), priority).select("part_no", "car_type", "canonical_name")
    return out.withColumn("dt", F.lit(dt)) if dt is not None else out


def attach_canonical_name(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows joined with the name map on (part_no, car_type), inner."""
    return df.join(canonical.select("part_no", "car_type", "canonical_name"), ["part_no", "car_type"], "inner")


def price_mart(df: DataFrame, priority: Mapping[str, int], dt: str) -> tuple[DataFrame, DataFrame]:
    """Mart job: returns (summary, canonical map).

    ``df`` needs part_no, name, price, car_type, source.  ``car_type`` must be present
    (the normalized value); a missing column is an input error.
    """
    if "car_type" not in df.columns:
        raise ValueError("input must include car_type (normalized value)")
    per_part = _per_part(_name_stats(with_int_price(df)), priority)
    summary = (
        per_part.groupBy("canonical_name", "car_type")
        .agg(F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"))
        .select(
            F.col("canonical_name").alias("part_official_name"),
            F.lit(dt).alias("extracted_at"),
            "min_price",
            "max_price",
            "car_type",
        )
    )
    canonical = per_part.select("part_no", "car_type", "canonical_name", F.lit(dt).alias("dt"))
    return summary, canonical


def price_range(df: DataFrame, priority: Mapping[str, int], dt: str) -> DataFrame:
    """A2: the summary half of :func:`price_mart`."""
    return price_mart(df, priority, dt)[0]
