"""The price mart on shared storage, in versions.

A load rewrites the days that its staged rows name, into a folder of its own, and publishes
them with one small file: ``log/<number>.json`` says which folder holds each day of that
version.  The file appears by a rename that fails if it is there already, so

* readers see the version before or the version after, never a load half done;
* a load that is killed leaves the version before it in force, and a folder that nothing
  names; running it again starts from the same rows;
* of two loads at once one is published, the other one raises and changes nothing.

Days that a load doesn't name stay where they are: a load reads and writes by the staged days,
not by the table.  Days past retention are left out of the new version, without reading them.
What reaches the driver is one row per calendar day.  A rerun of a load with equal rows writes
equal files: rows are dealt by the key and sorted by all columns.

Defined cases: a table without a version is empty; staged rows without a day make a day of
their own, which the next load's retention leaves out; an empty load publishes retention alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.operators.load import MART_KEY, last_write_wins, retention_cutoff, upsert_mart
from pricelens.session import stored
from pricelens.sources.io import _hadoop_fs

DAY = "extracted_at"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name of a null partition value


@dataclass(frozen=True)
class Version:
    """``days``: each day of this version -> the folder under ``data`` that holds its files."""

    number: int
    days: dict[str, str]


def _names(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _hadoop_fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _log_file(root: str, number: int) -> str:
    return f"{root}/log/{number:012d}.json"


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    """The published versions that :func:`vacuum` has left, ascending."""
    return [int(name.removesuffix(".json")) for name in _names(spark, f"{root}/log") if name.endswith(".json") and name[0] != "."]


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A published version, the latest unless a number is given; number 0 is the empty table."""
    if number is None:
        number = max(version_numbers(spark, root), default=0)
    if number == 0:
        return Version(0, {})
    return Version(number, json.loads(spark.read.text(_log_file(root, number), wholetext=True).first()[0]))


def read_days(spark: SparkSession, root: str, version: Version, schema: T.StructType, days: Sequence[str] | None = None) -> DataFrame:
    """The rows of a version, of some days or of all."""
    chosen = version.days if days is None else {d: version.days[d] for d in days if d in version.days}
    if not chosen:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/folder={folder}/{DAY}={day}" for day, folder in sorted(chosen.items())]
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).select(*schema.names)


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    hidden, fs = _hadoop_fs(spark, f"{root}/log/.{uuid.uuid4().hex}")
    fs.mkdirs(hidden.getParent())
    out = fs.create(hidden, True)
    out.write(bytearray(json.dumps(version.days, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    never_over = gateway.new_array(rename, 1)
    never_over[0] = rename.NONE
    try:
        context.rename(hidden, _hadoop_fs(spark, _log_file(root, version.number))[0], never_over)
    finally:
        fs.delete(hidden, False)


def write_days(rows: DataFrame, root: str, number: int, key: Sequence[str] = MART_KEY, n_files: int | None = None) -> str:
    """Rows in a new folder, by day; dealt by the key, so a day that holds all rows is written
    by many tasks.  Returns the folder's name; nothing names it yet."""
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    dealt = rows.repartition(*key) if n_files is None else rows.repartition(n_files, *key)
    ordered = dealt.sortWithinPartitions(DAY, *[c for c in rows.columns if c != DAY])
    ordered.write.mode("errorifexists").partitionBy(DAY).parquet(f"{root}/data/folder={folder}")
    return folder


def load_version(
    spark: SparkSession,
    root: str,
    staged: DataFrame,
    ds: str,
    order: str | Sequence[str],
    schema: T.StructType,
    key: Sequence[str] = MART_KEY,
    n_files: int | None = None,
) -> Version:
    """D1 to D3 on storage: retention, last write wins, staged rows replace rows with their
    key; the result is published as the next version.  The key holds the day.  Staged rows are
    read once: their days, the rows that they replace and the new rows come from the last write
    of each key, stored."""
    if DAY not in key:
        raise ValueError(f"the key must hold {DAY}: a load rewrites the staged days only")
    before = read_version(spark, root)
    cutoff = spark.range(1).select(retention_cutoff(ds).cast("string")).first()[0]
    kept = {day: folder for day, folder in before.days.items() if day != NO_DAY and day >= cutoff}
    order = [order] if isinstance(order, str) else list(order)
    columns = [*schema.names, *[c for c in order if c not in schema.names]]
    staged = stored(last_write_wins(staged.select(*columns), key, order))
    staged_days = [r[0] or NO_DAY for r in staged.select(F.col(DAY).cast("date").cast("string")).distinct().collect()]
    days = dict(kept)
    if staged_days:
        touched = read_days(spark, root, before, schema, [d for d in staged_days if d in kept])
        folder = write_days(upsert_mart(touched, staged, ds, order, key), root, before.number + 1, key, n_files)
        days |= dict.fromkeys(staged_days, folder)
    after = Version(before.number + 1, days)
    _publish(spark, root, after)
    return after


def import_version(spark: SparkSession, root: str, rows: DataFrame, n_files: int | None = None) -> Version:
    """A whole table as the next version, as it is: no retention, repeated keys stay."""
    number = read_version(spark, root).number + 1
    folder = write_days(rows, root, number, n_files=n_files)
    days = [name.removeprefix(f"{DAY}=") for name in _names(spark, f"{root}/data/folder={folder}") if name.startswith(f"{DAY}=")]
    after = Version(number, dict.fromkeys(days, folder))
    _publish(spark, root, after)
    return after


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Forget all versions but the latest ``keep`` and delete the folders that these don't name,
    those of killed loads included; a load that still runs writes above the latest number and
    is spared.  Returns the names of the deleted folders (one per load, not per file)."""
    if keep < 1:
        raise ValueError("the latest version always stays")
    numbers = version_numbers(spark, root)
    live = {folder for n in numbers[-keep:] for folder in read_version(spark, root, n).days.values()}
    gone = []
    for n in numbers[:-keep]:
        p, fs = _hadoop_fs(spark, _log_file(root, n))
        fs.delete(p, False)
    for name in _names(spark, f"{root}/data"):
        folder = name.removeprefix("folder=")
        if folder not in live and int(folder.split("-")[0]) <= max(numbers, default=0):
            p, fs = _hadoop_fs(spark, f"{root}/data/{name}")
            fs.delete(p, True)
            gone.append(folder)
    return gone
