"""Readers and writers: raw crawl CSV, clean sets, skip JSON, marts.

All reads declare their schema (only a CSV header is read, never types inferred);
writes are idempotent overwrites with dynamic partition overwrite, so a rerun of
one ``dt`` replaces only that date.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw crawl column orders.
RAW_STORE_COLUMNS = ["extracted_at", "category", "name", "price", "official_name", "part_no", "applicable"]
RAW_MARKET_COLUMNS = ["extracted_at", "name", "part_no", "price", "car_type"]
MART_COLUMNS = ["part_official_name", "extracted_at", "min_price", "max_price", "car_type"]

SKIP_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("skipped_at", T.StringType()),
    ]
)


def parse_input_paths(raw: str | Sequence[str]) -> list[str]:
    """Comma-separated list (or sequence) of paths; an empty list is an error."""
    items = raw.split(",") if isinstance(raw, str) else list(raw)
    paths = [p.strip() for p in items if p and p.strip()]
    if not paths:
        raise ValueError("at least one input path is required")
    return paths


def all_string_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Headered UTF-8 CSV, recursive dirs, doubled-quote escaping; every column a string."""
    reader = (
        spark.read.option("header", "true")
        .option("encoding", "utf-8")
        .option("recursiveFileLookup", "true")
        .option("escape", '"')
        .option("multiLine", "false")
    )
    if columns is not None:
        reader = reader.schema(all_string_schema(columns))
    else:
        reader = reader.option("inferSchema", "false")
    return reader.csv(parse_input_paths(paths))


def read_headerless_parts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Headerless crawl parts of one run (fixed column order)."""
    return (
        spark.read.schema(all_string_schema(columns))
        .option("header", "false")
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns filled with null; no dedupe."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_clean(spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """N clean dirs as one set."""
    ps = parse_input_paths(paths)
    if fmt == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(*ps)
    return union_all([spark.read.option("header", "true").option("escape", '"').csv(p) for p in ps])


def write_set(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """S3: overwrite as Parquet or headered CSV; with ``partition_by`` only the dates present are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("header", "true").option("escape", '"').csv(path)


def write_mart(df: DataFrame, path: str, fmt: str = "csv", n_files: int | None = None) -> None:
    """The mart under ``path``.  Every task writes its own file unless the caller asks for
    a number of files (1: one file, for marts known to be small); no row count decides."""
    write_set(df if n_files is None else df.repartition(n_files), path, fmt)


def read_skip_json(spark: SparkSession, path: str) -> DataFrame:
    """Skip files, each a JSON array of records or one record; non-objects and empty files ignored."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    body = F.trim(F.col("value"))
    as_array = F.from_json(body, T.ArrayType(T.StringType()))
    items = F.when(body.startswith("["), as_array).when(body.startswith("{"), F.array(body))
    return (
        text.select(F.explode(items).alias("item"))
        .where(F.trim(F.col("item")).startswith("{"))
        .select(F.from_json("item", SKIP_SCHEMA).alias("r"))
        .select("r.*")
    )


def read_mart_for_load(spark: SparkSession, path: str, run_date: str) -> DataFrame:
    """Mart CSV rows with fallbacks (name <- `name` <- '', date <- run date, '' price -> null)."""
    raw = spark.read.option("header", "true").option("escape", '"').option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.csv"
    ).csv(path)
    return coerce_mart_rows(raw, run_date)


def coerce_mart_rows(raw: DataFrame, run_date: str) -> DataFrame:
    cols = set(raw.columns)

    def col(c: str):
        return F.nullif(F.col(c), F.lit("")) if c in cols else F.lit(None).cast("string")

    return raw.select(
        F.coalesce(col("part_official_name"), col("name"), F.lit("")).alias("part_official_name"),
        F.coalesce(col("extracted_at"), F.lit(run_date)).alias("extracted_at"),
        col("min_price").try_cast("int").alias("min_price"),
        col("max_price").try_cast("int").alias("max_price"),
        F.coalesce(col("car_type"), F.lit("")).alias("car_type"),
    )


# --- manifests and batches ---------------------------------------------------------------------

BATCH_SIZE = 100


def explode_manifest(df: DataFrame, col: str) -> DataFrame:
    """A JSON string array per row -> one (pos, url) row per element (pos from 0)."""
    arr = F.from_json(F.col(col), T.ArrayType(T.StringType()))
    return df.select("*", F.posexplode(arr).alias("pos", "url"))


def assign_batches(items: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Batches of ``size`` consecutive items; the batch id is the index of its first item."""
    return items.withColumn("batch_id", (F.floor(F.col("pos") / size) * size).cast("int"))


def flatten_batch_items(df: DataFrame, col: str) -> DataFrame:
    """Batch payloads whose items carry ``urls`` (list or string) or ``url`` ->
    trimmed non-empty URL rows.  ``urls`` wins when truthy (a non-empty list or string)."""
    # key lookups are case-sensitive here ("Items" before "items"), as in a dict lookup
    arr_of = lambda key: F.from_json(F.get_json_object(F.col(col), f"$.{key}"), T.ArrayType(T.StringType()))
    top_items = F.coalesce(
        F.when(F.size(arr_of("Items")) > 0, arr_of("Items")), F.when(F.size(arr_of("items")) > 0, arr_of("items"))
    )
    items = F.coalesce(top_items, F.array(F.col(col)))

    def urls_of(item):
        j = F.from_json(item, "urls string, url string")
        raw = j["urls"]
        is_arr = F.ltrim(raw).startswith("[")
        arr = F.from_json(raw, T.ArrayType(T.StringType()))
        truthy = raw.isNotNull() & F.when(is_arr, F.size(arr) > 0).otherwise(F.length(raw) > 0)
        listed = F.when(is_arr, arr).otherwise(F.array(raw))
        chosen = F.when(truthy, listed).when(j["url"].isNotNull(), F.array(j["url"])).otherwise(F.array().cast("array<string>"))
        return F.when(F.ltrim(item).startswith("{"), chosen).otherwise(F.array().cast("array<string>"))

    urls = F.flatten(F.transform(items, urls_of))
    cleaned = F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: F.length(u) > 0)
    return df.select("*", F.explode(cleaned).alias("url"))


def write_url_manifest(urls: DataFrame, path: str, partition_by=("source", "dt")) -> None:
    """Manifest of retry URLs as JSON lines, one folder per (source, dt) - written by the
    executors, never assembled on the driver."""
    urls.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).json(path)


# --- file-level gates --------------------------------------------------------------------------------


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows per input file (S9's data check)."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def compact_parts(spark: SparkSession, parts_dir: str, out_dir: str, columns: Sequence[str], n_files: int | None = None) -> DataFrame:
    """Headerless CSV parts of one run (``.csv`` only) -> fewer headered files: as many as
    the advisory partition size asks for, or ``n_files``.  No part at all is an error."""
    df = read_headerless_parts(spark, parts_dir, columns)
    if df.isEmpty():
        raise FileNotFoundError(f"no .csv parts under {parts_dir}")
    packed = df.hint("rebalance") if n_files is None else df.repartition(n_files)
    packed.write.mode("overwrite").option("header", "true").option("escape", '"').csv(out_dir)
    return spark.read.option("header", "true").option("escape", '"').schema(all_string_schema(columns)).csv(out_dir)


def resolve_run_paths(base_dir: str, base_run: str, retry_run: str | None = None) -> list[str]:
    """The inputs of one date: the base run, plus the retry run when its id differs."""
    paths = [f"{base_dir.rstrip('/')}/{base_run}"]
    if retry_run and retry_run != base_run:
        paths.append(f"{base_dir.rstrip('/')}/{retry_run}")
    return paths


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, root: str, suffix: str = ".csv") -> list[str]:
    """Data files under ``root`` (recursive), by path - a metadata listing, no data read."""
    p, fs = _hadoop_fs(spark, root)
    out = []
    it = fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().lower().endswith(suffix):
            out.append(f.toUri().getPath())
    return out


def gate_empty_output(spark: SparkSession, root: str) -> tuple[int, int, bool]:
    """Files with no data row (a header alone counts as empty) are deleted; returns
    (files_with_data, files_deleted, has_data).  Row counts per file come from one
    distributed aggregate; only file names reach the driver."""
    from urllib.parse import urlparse

    files = list_files(spark, root)
    if not files:
        return 0, 0, False
    df = spark.read.option("header", "true").option("escape", '"').csv(files)
    with_data = {urlparse(r["file"]).path for r in rows_per_file(df).where(F.col("n_rows") > 0).select("file").collect()}
    deleted = 0
    for f in files:
        if f not in with_data:
            p, fs = _hadoop_fs(spark, f)
            fs.delete(p, False)
            deleted += 1
    return len(with_data), deleted, len(with_data) > 0
