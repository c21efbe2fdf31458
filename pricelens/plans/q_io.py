"""Source/sink queries: each writes a shape derived from the driver tables into a scratch
folder under the session's checkpoint directory (the shared folder of the cluster) and
reads it back through the library readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricelens.operators import ledger as LG
from pricelens.operators import mart
from pricelens.plans.q_mart import PRICE_RANGE_SQL, TEST_DT, TEST_PRIORITY
from pricelens.plans.registry import register
from pricelens.session import ensure_checkpoint_dir
from pricelens.sources import io as IO
from pricelens.sources.tables import shape, shape_cte


def scratch(spark, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pricelens-io/{name}-{uuid.uuid4().hex}"


def _raw_listing(spark, sf):
    return shape(spark, sf, "listing").select(
        F.lit(TEST_DT).alias("extracted_at"), F.col("source").alias("category"), F.col("official_name").alias("name"),
        "price", "official_name", "part_no", "applicable", "l_linenumber", "source",
    )


RAW_SQL = (
    shape_cte("listing") + "SELECT '2026-03-16' AS extracted_at, source AS category, official_name AS name, price, official_name, "
    "part_no, applicable FROM listing"
)


@register("scan_raw_csv", RAW_SQL)
def q_scan_raw_csv(spark, sf):
    """Headered CSV under two roots (one nested), read as a comma-separated path list."""
    root = scratch(spark, "raw")
    raw = _raw_listing(spark, sf)
    cols = IO.RAW_STORE_COLUMNS
    raw.where(F.col("source") == "src_a").select(*cols).write.option("header", "true").option("escape", '"').csv(f"{root}/a")
    raw.where(F.col("source") != "src_a").select(*cols).write.option("header", "true").option("escape", '"').csv(f"{root}/b/nested")
    return IO.read_raw_csv(spark, f"{root}/a, {root}/b")


@register(
    "compact_parts",
    RAW_SQL,
)
def q_compact_parts(spark, sf):
    """Headerless parts (plus a non-CSV file that must be ignored) -> one headered file."""
    root = scratch(spark, "parts")
    cols = IO.RAW_STORE_COLUMNS
    _raw_listing(spark, sf).select(*cols).write.option("header", "false").option("escape", '"').csv(f"{root}/parts")
    spark.range(3).write.json(f"{root}/parts/meta")
    return IO.compact_parts(spark, f"{root}/parts", f"{root}/final", cols)


@register(
    "union_runs",
    shape_cte("listing") + "SELECT source, count(*) AS n_rows FROM (SELECT source FROM listing UNION ALL "
    "SELECT source FROM listing WHERE l_linenumber = 1) GROUP BY source",
)
def q_union_runs(spark, sf):
    """Base run + retry run of the same date, a plain union (no dedupe)."""
    root = scratch(spark, "runs")
    raw = _raw_listing(spark, sf)
    cols = IO.RAW_STORE_COLUMNS
    raw.select(*cols).write.option("header", "true").option("escape", '"').csv(f"{root}/dt={TEST_DT}/run_base")
    raw.where(F.col("l_linenumber") == 1).select(*cols).write.option("header", "true").option("escape", '"').csv(
        f"{root}/dt={TEST_DT}/run_base-retry2"
    )
    paths = IO.resolve_run_paths(f"{root}/dt={TEST_DT}", "run_base", "run_base-retry2")
    return IO.read_raw_csv(spark, paths).groupBy(F.col("category").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "resolve_run_paths",
    shape_cte("listing") + "SELECT count(*) AS n_rows FROM listing",
)
def q_resolve_run_paths(spark, sf):
    """A retry id equal to the base id adds no second path."""
    root = scratch(spark, "runs1")
    _raw_listing(spark, sf).select(*IO.RAW_STORE_COLUMNS).write.option("header", "true").option("escape", '"').csv(f"{root}/run_base")
    paths = IO.resolve_run_paths(root, "run_base", "run_base")
    return IO.read_raw_csv(spark, paths).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "scan_clean_union",
    shape_cte("clean_rows") + "SELECT source, count(*) AS n_rows, CAST(sum(price) AS BIGINT) AS sum_price, count(name) AS n_named "
    "FROM clean_rows GROUP BY source",
)
def q_scan_clean_union(spark, sf):
    """Two clean sets (Parquet, one without the ``name`` column) read as one set."""
    root = scratch(spark, "clean")
    rows = shape(spark, sf, "clean_rows")
    rows.where(F.col("source").isin("src_a", "src_b")).write.parquet(f"{root}/one")
    rows.where(~F.col("source").isin("src_a", "src_b")).write.parquet(f"{root}/two")
    df = IO.read_clean(spark, [f"{root}/one", f"{root}/two"])
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("price").cast("bigint").alias("sum_price"), F.count("name").alias("n_named")
    )


@register(
    "sink_clean",
    shape_cte("clean_rows") + "SELECT dt, count(*) AS n_rows, CAST(sum(price) AS BIGINT) AS sum_price FROM ("
    "SELECT '2026-03-15' AS dt, price FROM clean_rows WHERE source = 'src_a' UNION ALL "
    "SELECT '2026-03-16' AS dt, price FROM clean_rows WHERE source <> 'src_a' AND price % 2 = 0) GROUP BY dt",
)
def q_sink_clean(spark, sf):
    """S3: partitioned overwrite; rewriting one date leaves the other date untouched."""
    root = scratch(spark, "sink")
    rows = shape(spark, sf, "clean_rows").withColumn(
        "dt", F.when(F.col("source") == "src_a", F.lit("2026-03-15")).otherwise(F.lit("2026-03-16"))
    )
    IO.write_set(rows, root, "parquet", ["dt"])
    again = rows.where((F.col("dt") == "2026-03-16") & (F.col("price") % 2 == 0))
    IO.write_set(again, root, "parquet", ["dt"])
    back = spark.read.parquet(root)
    return back.groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("price").cast("bigint").alias("sum_price")
    )


@register(
    "sink_mart_single_csv",
    PRICE_RANGE_SQL.replace("SELECT c.canonical_name AS part_official_name", "SELECT 1 AS n_files, c.canonical_name AS part_official_name"),
)
def q_sink_mart_single_csv(spark, sf):
    """The mart as one CSV file (repartition(1) after the aggregate), read back."""
    root = scratch(spark, "mart")
    summary = mart.price_range(shape(spark, sf, "clean_rows"), TEST_PRIORITY, TEST_DT)
    IO.write_mart(summary, root, "csv", n_files=1)
    back = spark.read.option("header", "true").option("escape", '"').csv(root)
    n_files = back.select(F.input_file_name()).distinct().count()  # a scalar, not data
    return back.select(
        F.lit(n_files).cast("int").alias("n_files"),
        "part_official_name", "extracted_at", F.col("min_price").try_cast("int").alias("min_price"),
        F.col("max_price").try_cast("int").alias("max_price"), "car_type",
    )


_MART_LOAD = (
    "SELECT part_official_name AS name, CASE WHEN min_price % 5 = 0 THEN '' ELSE CAST(extracted_at AS STRING) END AS extracted_at, "
    "CASE WHEN min_price % 7 = 0 THEN '' ELSE CAST(min_price AS STRING) END AS min_price, CAST(max_price AS STRING) AS max_price, "
    "CASE WHEN car_type = 'unknown' THEN '' ELSE car_type END AS car_type FROM parts_master"
)


@register(
    "scan_mart_for_load",
    shape_cte("parts_master") + "SELECT coalesce(NULLIF(name, ''), '') AS part_official_name, coalesce(NULLIF(extracted_at, ''), '2026-03-16') AS extracted_at, "
    "TRY_CAST(NULLIF(min_price, '') AS INTEGER) AS min_price, TRY_CAST(NULLIF(max_price, '') AS INTEGER) AS max_price, "
    "coalesce(NULLIF(car_type, ''), '') AS car_type FROM (" + _MART_LOAD.replace("AS STRING", "AS VARCHAR") + ")",
)
def q_scan_mart_for_load(spark, sf):
    """Mart CSV with a ``name`` column and blanks; fallbacks applied on read."""
    root = scratch(spark, "load")
    spark.sql(_MART_LOAD.replace("FROM parts_master", "FROM {pm}"), pm=shape(spark, sf, "parts_master")).write.option(
        "header", "true"
    ).option("escape", '"').csv(root)
    spark.range(2).selectExpr("CAST(id AS STRING) AS value").write.text(f"{root}/notes")  # non-CSV files are ignored
    return IO.read_mart_for_load(spark, root, "2026-03-16")


@register(
    "scan_skip_json",
    shape_cte("ledger") + "SELECT coalesce(CASE WHEN length(reason) > 0 THEN reason END, 'unknown') AS reason, count(*) AS n "
    "FROM ledger WHERE status = 'FAILED' GROUP BY 1",
)
def q_scan_skip_json(spark, sf):
    """Skip files holding a JSON array (with a non-object element) or a single object."""
    root = scratch(spark, "skips")
    led = shape(spark, sf, "ledger").where(F.col("status") == LG.FAILED)
    rec = F.to_json(F.struct("url", F.lit(404).alias("status_code"), "reason", F.lit("2026-03-16T00:00:00").alias("skipped_at")))
    # batches of at most 100 ids; a batch with one record is a file with a single object
    one = F.count(F.lit(1)) == 1
    files = led.groupBy((F.col("event_id") / 100).cast("long").alias("batch")).agg(
        F.when(one, F.first(rec)).otherwise(F.concat(F.lit("["), F.array_join(F.collect_list(rec), ","), F.lit(",7]"))).alias("value")
    )
    files.write.partitionBy("batch").text(root)
    skips = IO.read_skip_json(spark, root)
    return skips.groupBy(LG.reason_or_unknown(F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "gate_empty_output",
    f"SELECT CAST(1 AS BIGINT) AS files_with_data, CAST(1 AS BIGINT) AS files_deleted, true AS has_data FROM ({PRICE_RANGE_SQL}) HAVING count(*) > 0",
)
def q_gate_empty_output(spark, sf):
    """Files with data rows are kept, empty output files are deleted; has_data gate."""
    root = scratch(spark, "gate")
    summary = mart.price_range(shape(spark, sf, "clean_rows"), TEST_PRIORITY, TEST_DT)
    IO.write_mart(summary, f"{root}/summary", "csv", n_files=1)
    IO.write_mart(summary.limit(0), f"{root}/canonical", "csv", n_files=1)
    report = IO.gate_empty_output(spark, root)
    return spark.createDataFrame([report], "files_with_data long, files_deleted long, has_data boolean")


@register(
    "load_report",
    f"SELECT count(*) AS rows_read, CAST(1 AS BIGINT) AS files_deleted, count(*) > 0 AS has_data FROM ({PRICE_RANGE_SQL})",
)
def q_load_report(spark, sf):
    """Rows read, empty files deleted, has_data - for one load of the mart."""
    root = scratch(spark, "loadrep")
    summary = mart.price_range(shape(spark, sf, "clean_rows"), TEST_PRIORITY, TEST_DT)
    IO.write_mart(summary, f"{root}/summary", "csv", n_files=1)
    IO.write_mart(summary.limit(0), f"{root}/empty", "csv", n_files=1)
    gate = IO.gate_empty_output(spark, root)
    rows = IO.read_mart_for_load(spark, root, TEST_DT)
    return rows.agg(F.count(F.lit(1)).alias("rows_read")).select(
        "rows_read", F.lit(gate[1]).cast("long").alias("files_deleted"), F.lit(gate[2]).alias("has_data")
    )
