"""Structured Streaming operators for the two stateful behaviours of the crawl.

T1 ``stream_ledger``: outcome events -> keyed ledger, last write wins, rows expire by ttl.
   Each micro-batch writes a *new* version directory named by the epoch id, which holds the
   last writes of a range of epochs only: version n (from 1) covers the epochs after
   n - lowbit(n), lowbit being n's lowest set bit.  It is merged from its batch and the
   versions inside its range, so a row is written again at most once per doubling of the
   number of epochs, and a reader merges at most log2(n) + 1 versions.  Whole ledgers are
   written at powers of two only.  A replayed epoch rewrites its own version from the same
   input and from versions before it, so ``foreachBatch``'s at-least-once delivery stays
   idempotent, and a job never overwrites the path it reads.
T2 ``stream_unseen``: items whose id was seen in any earlier run are dropped.  Ids are kept
   forever, as the original does, but in the output table, not in the state store: a batch is
   compared with the ids of the versions before it, and of these only the ones that the batch
   holds are shuffled on.  The ``watermark`` variant forgets ids with
   ``dropDuplicatesWithinWatermark``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators.ledger import expire, ledger_upsert

VERSION_PREFIX = "v="


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(VERSION_PREFIX) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[len(VERSION_PREFIX):]))
    return sorted(out)


def _path(root: str, version: int) -> str:
    return f"{root}/{VERSION_PREFIX}{version}"


def covering(existing: list[int], last: int, first: int = 1) -> list[int]:
    """The versions that together hold the epochs ``first`` to ``last``: from the last one back,
    each with all that its range covers; a version that is absent is stepped over."""
    have, out, n = set(existing), [], last
    while n >= first:
        if n in have:
            out.append(n)
            n -= n & -n
        else:
            n -= 1
    return out


def _read(spark: SparkSession, root: str, versions: list[int]) -> DataFrame:
    return spark.read.parquet(*[_path(root, v) for v in versions])


def read_ledger(spark: SparkSession, root: str, now_epoch: int) -> DataFrame | None:
    """The ledger as of its last version, without expired rows; None if there is no version."""
    versions = _versions(spark, root)
    if not versions:
        return None
    writes = _read(spark, root, covering(versions, versions[-1]))
    return expire(ledger_upsert(writes, writes.limit(0)), now_epoch)


def prune_versions(spark: SparkSession, root: str, last: int) -> list[int]:
    """Delete the versions that no reader of version ``last`` or a later one needs."""
    versions = [v for v in _versions(spark, root) if v <= last]
    gone = sorted(set(versions) - set(covering(versions, last)))
    for v in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_path(root, v))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def stream_ledger(
    spark: SparkSession,
    events: DataFrame,
    to_ledger: Callable[[DataFrame], DataFrame],
    state_root: str,
    checkpoint: str,
    now_epoch: int,
) -> DataFrame:
    """Run the stream to the end of the available input and return the ledger table.

    An expired row is forgotten when a version from the first epoch on is written (at powers of
    two); until then it hides older writes of its key.  Versions that an epoch made superfluous
    are deleted after the next one, when it can't be replayed any more."""

    def merge(batch: DataFrame, epoch_id: int) -> None:
        session, n = batch.sparkSession, epoch_id + 1
        from_start = n & (n - 1) == 0
        inside = covering([v for v in _versions(session, state_root) if v < n], n - 1, n - (n & -n) + 1)
        rows = to_ledger(batch)
        merged = ledger_upsert(_read(session, state_root, inside) if inside else rows.limit(0), rows)
        (expire(merged, now_epoch) if from_start else merged).write.mode("overwrite").parquet(_path(state_root, n))
        prune_versions(session, state_root, n - 1)

    q = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    out = read_ledger(spark, state_root, now_epoch)
    if out is None:
        raise RuntimeError("the stream produced no ledger version")
    return out


def stream_unseen(
    spark: SparkSession,
    items: DataFrame,
    key: str,
    sink: str,
    checkpoint: str,
    watermark: tuple[str, str] | None = None,
) -> DataFrame:
    """First occurrence of every key across all micro-batches (and runs sharing the
    checkpoint); returns the written unseen items.  A null key counts as one key."""
    if watermark is None:

        def keep(batch: DataFrame, epoch_id: int) -> None:
            session, n = batch.sparkSession, epoch_id + 1
            first = batch.dropDuplicates([key])
            before = [v for v in _versions(session, sink) if v < n]
            if before:
                ids = batch.select(F.col(key).alias("_seen")).distinct()
                seen = _read(session, sink, before).select(F.col(key).alias("_id"))
                hits = seen.join(ids, F.col("_id").eqNullSafe(F.col("_seen")), "left_semi")
                first = first.join(hits, F.col(key).eqNullSafe(F.col("_id")), "left_anti")
            first.write.mode("overwrite").parquet(_path(sink, n))

        q = items.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        written = _versions(spark, sink)
        return _read(spark, sink, written) if written else spark.createDataFrame([], items.schema)
    col, delay = watermark
    q = (
        items.withWatermark(col, delay).dropDuplicatesWithinWatermark([key])
        .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink)


def ttl_column(now_epoch: int, days: int) -> F.Column:
    return F.lit(now_epoch + days * 86400)
