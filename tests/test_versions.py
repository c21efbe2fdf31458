"""The mart in versions: a load against the DataFrame upsert, reruns, killed loads, races."""

import datetime as dt
import hashlib
import uuid
from pathlib import Path

import pytest

from pricelens.operators import load as LD
from pricelens.session import ensure_checkpoint_dir
from pricelens.sources import versions as V

DS = "2026-03-16"
ROW = "part_official_name string, car_type string, extracted_at date, min_price int, max_price int"


def _day(month, day):
    return dt.date(2026, month, day)


def _existing(spark):
    days = [_day(2, 15), _day(2, 16), _day(3, 10), _day(3, 16), None]
    return spark.createDataFrame([(f"n{k}", "v", d, k, k + 1) for k in range(40) for d in days], ROW)


def _staged(spark):
    rows = [(f"n{k}", "v", _day(3, 16), k + s, 900, s) for k in range(20) for s in (1, 2)]
    rows += [("new", "v", _day(3, 10), 5, 6, 1), ("old", "v", _day(1, 1), 7, 8, 1), ("none", "v", None, 9, 9, 1)]
    return spark.createDataFrame(rows, ROW + ", seq int")


@pytest.fixture
def root(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-versions-{uuid.uuid4().hex}"


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def _files(root, version):
    folder = lambda day: Path(root.removeprefix("file:")) / "data" / f"folder={version.days[day]}" / f"{V.DAY}={day}"
    return {day: sorted(hashlib.sha256(f.read_bytes()).hexdigest() for f in folder(day).glob("*.parquet")) for day in version.days}


def test_load_equals_the_upsert_and_rereads_are_equal_files(spark, root):
    existing, staged = _existing(spark), _staged(spark)
    V.import_version(spark, root, existing)
    assert _rows(V.read_days(spark, root, V.read_version(spark, root), existing.schema)) == _rows(existing)
    first = V.load_version(spark, root, staged, DS, "seq", existing.schema)
    want = _rows(LD.upsert_mart(existing, staged, DS, "seq"))
    assert _rows(V.read_days(spark, root, first, existing.schema)) == want
    second = V.load_version(spark, root, staged, DS, "seq", existing.schema)
    assert second.number == 3 and _rows(V.read_days(spark, root, second, existing.schema)) == want
    assert _files(root, first) == _files(root, second)
    # the day that no staged row names was not written again, the expired one is not named
    imported = V.read_version(spark, root, 1)
    assert second.days["2026-02-16"] == imported.days["2026-02-16"] and "2026-02-15" in imported.days
    assert set(second.days) == {"2026-02-16", "2026-03-10", "2026-03-16", "2026-01-01", V.NO_DAY}


def test_a_killed_load_leaves_the_version_before(spark, root, monkeypatch):
    existing, staged = _existing(spark), _staged(spark)
    V.import_version(spark, root, existing)
    with monkeypatch.context() as m:
        m.setattr(V, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            V.load_version(spark, root, staged, DS, "seq", existing.schema)
    now = V.read_version(spark, root)
    assert now.number == 1 and _rows(V.read_days(spark, root, now, existing.schema)) == _rows(existing)
    again = V.load_version(spark, root, staged, DS, "seq", existing.schema)
    assert _rows(V.read_days(spark, root, again, existing.schema)) == _rows(LD.upsert_mart(existing, staged, DS, "seq"))
    assert len(V.vacuum(spark, root, keep=1)) == 1  # the killed load's; the import still holds a day
    assert V.version_numbers(spark, root) == [2]
    assert _rows(V.read_days(spark, root, V.read_version(spark, root), existing.schema)) == _rows(LD.upsert_mart(existing, staged, DS, "seq"))


def test_of_two_loads_at_once_one_is_published(spark, root, monkeypatch):
    existing, staged = _existing(spark), _staged(spark)
    before = V.import_version(spark, root, existing)
    won = V.load_version(spark, root, staged, DS, "seq", existing.schema)
    monkeypatch.setattr(V, "read_version", lambda *_: before)  # the second one began at the same version
    with pytest.raises(Exception, match="exists"):
        V.load_version(spark, root, staged.limit(0), DS, "seq", existing.schema)
    monkeypatch.undo()
    assert V.read_version(spark, root) == won


def test_empty_table_and_empty_load(spark, root):
    schema = _existing(spark).schema
    assert V.read_version(spark, root) == V.Version(0, {}) and V.vacuum(spark, root) == []
    assert V.read_days(spark, root, V.read_version(spark, root), schema).collect() == []
    assert V.load_version(spark, root, _staged(spark).limit(0), DS, "seq", schema) == V.Version(1, {})
    with pytest.raises(ValueError, match="key"):
        V.load_version(spark, root, _staged(spark), DS, "seq", schema, key=["car_type"])
