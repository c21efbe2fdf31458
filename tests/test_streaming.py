"""Ledger and unseen streams: rows against a plain fold, bytes by epoch, replays, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from pricelens.streaming import state

LEDGER = "pk string, sk string, status string, ttl long, seq long"
NOW = 1000


def _epochs(n, r):
    out, seq = [], 0
    for _ in range(n):
        rows = []
        for _ in range(r.randint(1, 12)):
            seq += 1
            rows.append((f"p{r.randint(0, 2)}", f"s{r.randint(0, 9)}", r.choice(["SUCCESS", "FAILED"]), r.choice([None, 2000, 2000, 500]), seq))
        out.append(rows)
    return out


def _feed(spark, folder, rows, schema):
    # the file source takes one new file per trigger, the oldest first
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_covering_versions_hold_every_epoch_once():
    for last in range(1, 70):
        kept = state.covering(list(range(1, last + 1)), last)
        held = sorted(e for n in kept for e in range(n - (n & -n) + 1, n + 1))
        assert held == list(range(1, last + 1)) and len(kept) <= last.bit_length()
    assert state.covering([1, 2, 3, 5, 6], 6) == [6, 3, 2]  # 4 is absent: its epochs come from 3 and 2
    assert state.covering([], 5) == []


def test_ledger_equals_a_fold_and_writes_by_the_batch(spark, tmp_path):
    r = random.Random(21)
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "state", "check"))
    epochs, last, written = _epochs(7, r), {}, {}
    for k, rows in enumerate(epochs):
        _feed(spark, source, rows, LEDGER)
        stream = spark.readStream.schema(LEDGER).parquet(source)
        got = state.stream_ledger(spark, stream, lambda batch: batch, root, checkpoint, NOW)
        last.update({(pk, sk): (pk, sk, status, ttl, seq) for pk, sk, status, ttl, seq in rows})
        want = sorted((x for x in last.values() if x[3] is None or x[3] > NOW), key=str)
        assert sorted((tuple(x) for x in got.collect()), key=str) == want
        written[k + 1] = spark.read.parquet(f"{root}/v={k + 1}").count()
    for n, rows in written.items():  # a version holds keys of its own range of epochs, no others
        keys = {(x[0], x[1]) for e in range(n - (n & -n), n) for x in epochs[e]}
        assert rows <= len(keys) and (n & (n - 1) == 0 or rows == len(keys))
    # versions below 4 went when 4 could not be replayed any more; 5 is inside 6
    assert state._versions(spark, root) == [4, 6, 7]
    assert state.prune_versions(spark, root, 7) == []


def test_ledger_replay_of_an_epoch_gives_equal_rows(spark, tmp_path):
    r = random.Random(22)
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "state", "check"))
    for rows in _epochs(3, r):
        _feed(spark, source, rows, LEDGER)
        stream = spark.readStream.schema(LEDGER).parquet(source)
        want = sorted((tuple(x) for x in state.stream_ledger(spark, stream, lambda b: b, root, checkpoint, NOW).collect()), key=str)
    # the driver is lost after the table was written but before the epoch was committed
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    got = state.stream_ledger(spark, spark.readStream.schema(LEDGER).parquet(source), lambda b: b, root, checkpoint, NOW)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert state._versions(spark, root) == [2, 3]


@pytest.mark.parametrize("replay", [False, True])
def test_unseen_ids_across_restarts(spark, tmp_path, replay):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, place string"
    batches = [[(1, "a"), (1, "b"), (None, "a")], [(2, "a"), (1, "c"), (None, "b")], [(3, "a"), (2, "b"), (4, "a")]]
    for rows in batches:
        _feed(spark, source, rows, schema)
        got = state.stream_unseen(spark, spark.readStream.schema(schema).parquet(source), "id", sink, checkpoint)
    if replay:
        (tmp_path / "check" / "commits" / "2").unlink()
        (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
        got = state.stream_unseen(spark, spark.readStream.schema(schema).parquet(source), "id", sink, checkpoint)
    assert sorted((x["id"] for x in got.collect()), key=str) == [1, 2, 3, 4, None]
    assert {x["id"] for x in spark.read.parquet(f"{sink}/v=3").select(F.col("id")).collect()} == {3, 4}
    assert not (tmp_path / "check" / "state").exists()  # nothing is kept in the state store
