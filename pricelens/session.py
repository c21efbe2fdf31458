"""Session helpers: building a session for tests/bench and cutting lineage safely.

On a cluster the session is handed to us; we only read its settings.  The
checkpoint directory must be a shared folder named by the cluster in
``spark.checkpoint.dir``; a local scratch folder is set only when that is unset
(tests, bench on one machine).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "pricelens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers (Arrow UDFs, ``applyInPandas``)
    whatever the driver's working directory: the package's sources are zipped once per
    content and added with ``addPyFile``, Spark's own way of shipping Python code to every
    executor."""
    sc = spark.sparkContext
    if getattr(sc, "_pricelens_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = sorted(
        os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py")
    )
    h = hashlib.sha1()
    for f in files:
        h.update(os.path.relpath(f, root).encode())
        with open(f, "rb") as fh:
            h.update(fh.read())
    out = os.path.join(tempfile.gettempdir(), f"pricelens-py-{h.hexdigest()[:16]}")
    zpath = os.path.join(out, "pricelens.zip")
    if not os.path.exists(zpath):
        os.makedirs(out, exist_ok=True)
        part = f"{zpath}.{os.getpid()}.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, root))
        os.replace(part, zpath)
    sc.addPyFile(zpath)
    sc._pricelens_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir (``spark.checkpoint.dir``).

    A scratch folder is created only for a local master (tests, single-machine bench); on a
    cluster an unset checkpoint dir is an error, never a machine-local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at the cluster's shared folder")
    path = tempfile.mkdtemp(prefix="pricelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver
#: happens to collect its garbage
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, rounds: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint dir, read with fresh lineage: like
    :func:`cut_lineage`, and readers fetch only the columns they need.  With ``rounds`` the rows
    are computed in so many rounds, dealt by a hash of the columns ``by``, and the shuffles of
    each round leave the disk as soon as it is written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not rounds:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    given = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        for i in range(rounds):
            dealt = df if rounds == 1 else df.where(F.pmod(F.xxhash64(*by), F.lit(rounds)) == i)
            dealt.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if given is None else spark.conf.set(FREE_SHUFFLES, given)
    return spark.read.schema(df.schema).parquet(path)
