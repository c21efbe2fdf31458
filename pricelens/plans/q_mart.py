"""Mart queries: name frequency, representative names, price range."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.operators import mart
from pricelens.plans.registry import register
from pricelens.sources.tables import shape, shape_cte

# Test priority table: src_a first, then src_b, then src_c; anything else ranks 99.
TEST_PRIORITY = {"src_a": 1, "src_b": 2, "src_c": 3}
TEST_DT = "2026-03-16"

_PRIO_SQL = "CASE source WHEN 'src_a' THEN 1 WHEN 'src_b' THEN 2 WHEN 'src_c' THEN 3 ELSE 99 END"

_COUNTS_SQL = (
    "counts AS (SELECT part_no, car_type, source, name, count(*) AS count FROM clean_rows "
    "GROUP BY part_no, car_type, source, name HAVING name IS NOT NULL AND length(name) > 0), "
    "top1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part_no, car_type, source "
    "ORDER BY count DESC, name ASC) AS rn FROM counts) WHERE rn = 1), "
    f"canon AS (SELECT part_no, car_type, name AS canonical_name FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY part_no, car_type ORDER BY {_PRIO_SQL} ASC, count DESC, name ASC) AS rn2 FROM top1) WHERE rn2 = 1) "
)


def _rows(spark, sf):
    return shape(spark, sf, "clean_rows")


@register(
    "name_frequency",
    shape_cte("clean_rows")
    + ", " + _COUNTS_SQL
    + "SELECT part_no, car_type, source, name, count FROM counts",
)
def q_name_frequency(spark, sf):
    return mart.name_frequency(_rows(spark, sf))


@register(
    "top_name_per_source",
    shape_cte("clean_rows") + ", " + _COUNTS_SQL + "SELECT part_no, car_type, source, name, count FROM top1",
)
def q_top_name_per_source(spark, sf):
    return mart.top_name_per_source(_rows(spark, sf))


@register(
    "top_name_by_priority",
    shape_cte("clean_rows") + ", " + _COUNTS_SQL + "SELECT part_no, car_type, canonical_name FROM canon",
)
def q_top_name_by_priority(spark, sf):
    return mart.canonical_name_map(_rows(spark, sf), TEST_PRIORITY)


@register(
    "attach_canonical_name",
    shape_cte("clean_rows") + ", " + _COUNTS_SQL
    + "SELECT r.part_no, r.car_type, r.name, r.price, r.source, c.canonical_name "
    "FROM clean_rows r JOIN canon c ON r.part_no = c.part_no AND r.car_type = c.car_type",
)
def q_attach_canonical_name(spark, sf):
    rows = _rows(spark, sf)
    return mart.attach_canonical_name(rows, mart.canonical_name_map(rows, TEST_PRIORITY)).select(
        "part_no", "car_type", "name", "price", "source", "canonical_name"
    )


PRICE_RANGE_SQL = (
    shape_cte("clean_rows") + ", " + _COUNTS_SQL
    + f"SELECT c.canonical_name AS part_official_name, '{TEST_DT}' AS extracted_at, "
    "min(r.price) AS min_price, max(r.price) AS max_price, r.car_type "
    "FROM clean_rows r JOIN canon c ON r.part_no = c.part_no AND r.car_type = c.car_type "
    "GROUP BY c.canonical_name, r.car_type"
)


@register("price_range", PRICE_RANGE_SQL)
def q_price_range(spark, sf):
    return mart.price_range(_rows(spark, sf), TEST_PRIORITY, TEST_DT)


@register(
    "distinct_vehicles",
    shape_cte("clean_rows") + "SELECT DISTINCT car_type FROM clean_rows",
)
def q_distinct_vehicles(spark, sf):
    return _rows(spark, sf).select("car_type").distinct()


@register(
    "union_sources",
    shape_cte("clean_rows")
    + "SELECT source, count(*) AS n_rows, CAST(sum(price) AS BIGINT) AS sum_price FROM ("
    "SELECT * FROM clean_rows WHERE source = 'src_a' UNION ALL SELECT * FROM clean_rows WHERE source = 'src_b' "
    "UNION ALL SELECT * FROM clean_rows WHERE source NOT IN ('src_a', 'src_b')) GROUP BY source",
)
def q_union_sources(spark, sf):
    rows = _rows(spark, sf)
    a = rows.where(F.col("source") == "src_a")
    b = rows.where(F.col("source") == "src_b")
    c = rows.where(~F.col("source").isin("src_a", "src_b"))
    from pricelens.sources.io import union_all

    return (
        union_all([a, b, c])
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("price").cast("bigint").alias("sum_price"))
    )
