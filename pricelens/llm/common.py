"""Helpers shared by the operators: reading a table, Arrow column plumbing, digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable by Python workers and name the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    """The text column as a string; a null text counts as the empty one."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def sha256_hex(parts: str | bytes) -> str:
    return hashlib.sha256(parts.encode() if isinstance(parts, str) else parts).hexdigest()


def joined_spans(spans: Iterable[tuple[str, int, int]]) -> str:
    """``kind:start:end`` of each span, comma-joined in the given order."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def struct_array(fields: dict[str, tuple[pa.DataType, list]]) -> pa.StructArray:
    """A struct column out of named, typed Python lists."""
    names = list(fields)
    return pa.StructArray.from_arrays([pa.array(values, kind) for kind, values in fields.values()], names)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: computed once, safe from
    lost executors, and read with fresh lineage."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_sample(texts: DataFrame, column: str, rows: int, chars: int) -> list[str]:
    """At most ``rows`` distinct texts, the smallest by a hash, up to ``chars`` of each.  Only
    hashes compete for a place; texts reach the driver once the places are known."""
    hashed = texts.select(F.xxhash64(column).alias("h"), F.substring(column, 1, chars).alias("t"))
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return []
    found = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.min("t").alias("t")).collect()
    return [r["t"] for r in sorted(found, key=lambda r: r["h"])]
