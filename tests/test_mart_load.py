"""Goldens for the mart (FIXTURES 6), load/state (FIXTURES 8) and properties."""

import datetime as dt

from pyspark.sql import functions as F

from pricelens.operators import ledger as LG
from pricelens.operators import load as LD
from pricelens.operators import mart

PRIO = {"partsro": 1, "shop_b": 2, "shop_c": 3}


def _rows(spark):
    data = [("p1", "v", "partsro", "A", 10), ("p1", "v", "partsro", "B", 20), ("p1", "v", "partsro", "B", 30)]
    data += [("p1", "v", "shop_b", "C", 5)] * 3 + [("p2", "v", "shop_b", "B", 40)]
    return spark.createDataFrame(data, "part_no string, car_type string, source string, name string, price int")


def test_canonical_and_range(spark):
    rows = _rows(spark)
    canon = {r["part_no"]: r["canonical_name"] for r in mart.canonical_name_map(rows, PRIO).collect()}
    assert canon == {"p1": "B", "p2": "B"}
    summary = mart.price_range(rows, PRIO, "2026-03-16").collect()
    assert [(r["part_official_name"], r["car_type"], r["min_price"], r["max_price"]) for r in summary] == [("B", "v", 5, 40)]


def test_blank_names_keep_prices_and_nameless_parts_drop(spark):
    data = [("p1", "v", "x", "", 1), ("p1", "v", "x", None, 99), ("p1", "v", "x", "N", 50), ("p3", "v", "x", "", 7)]
    rows = spark.createDataFrame(data, "part_no string, car_type string, source string, name string, price int")
    out = {r["part_official_name"]: (r["min_price"], r["max_price"]) for r in mart.price_range(rows, {}, "d").collect()}
    assert out == {"N": (1, 99)}


def test_partition_count_does_not_change_result(spark):
    rows = _rows(spark)
    a = sorted(map(tuple, mart.price_range(rows.repartition(1), PRIO, "d").collect()))
    b = sorted(map(tuple, mart.price_range(rows.repartition(7), PRIO, "d").collect()))
    assert a == b


def _mart(spark, rows):
    return spark.createDataFrame(rows, "part_official_name string, car_type string, extracted_at date, min_price int, max_price int")


def test_last_write_and_retention(spark):
    d = dt.date
    staged = spark.createDataFrame(
        [("n", "v", d(2026, 3, 16), 1, 2, 1), ("n", "v", d(2026, 3, 16), 3, 4, 2)],
        "part_official_name string, car_type string, extracted_at date, min_price int, max_price int, seq int",
    )
    one = LD.last_write_wins(staged, LD.MART_KEY, "seq").collect()
    assert len(one) == 1 and one[0]["min_price"] == 3
    existing = _mart(spark, [("a", "v", d(2026, 2, 16), 1, 1), ("b", "v", d(2026, 2, 15), 1, 1), ("n", "v", d(2026, 3, 16), 9, 9)])
    kept = {r["part_official_name"] for r in LD.retention(existing, "2026-03-16").collect()}
    assert kept == {"a", "n"}
    up = LD.upsert_mart(existing, staged, "2026-03-16", order="seq")
    got = {(r["part_official_name"], r["min_price"]) for r in up.collect()}
    assert got == {("a", 1), ("n", 3)}
    twice = LD.upsert_mart(up, staged, "2026-03-16", order="seq")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, up.collect()))


def test_retry_and_skip_counts(spark):
    led = spark.createDataFrame(
        [("FAILED", 1, "u1"), ("FAILED", 2, "u2"), ("FAILED", None, "u3"), ("SUCCESS", 1, "u4"), ("FAILED", 1, "")],
        "status string, attempt int, url string",
    )
    assert {r["url"] for r in LG.retryable_failures(led, 2).collect()} == {"u1", "u3"}
    skips = spark.createDataFrame([("s", "timeout"), ("s", "timeout"), ("s", "not_found"), ("s", "")], "source string, reason string")
    got = {r["reason"]: r["n"] for r in LG.skip_reasons(skips).collect()}
    assert got == {"timeout": 2, "not_found": 1, "unknown": 1}


def test_min_not_above_max(spark):
    rows = _rows(spark)
    out = mart.price_range(rows, PRIO, "d")
    assert out.where(F.col("min_price") > F.col("max_price")).count() == 0


def test_mart_layout_is_the_callers_choice(spark):
    """Every task writes a file unless a number of files is asked for; nothing is lost."""
    import uuid

    from pricelens.session import ensure_checkpoint_dir
    from pricelens.sources import io as IO

    base = ensure_checkpoint_dir(spark).rstrip("/") + "/test-mart-" + uuid.uuid4().hex
    df = spark.range(0, 1000, numPartitions=4).selectExpr("id", "concat('n', id) AS name")

    def files_and_rows(path):
        back = spark.read.option("header", "true").csv(path)
        return back.select(F.input_file_name()).distinct().count(), back.count()

    IO.write_mart(df, f"{base}/small", "csv", n_files=1)
    assert files_and_rows(f"{base}/small") == (1, 1000)
    IO.write_mart(df, f"{base}/big", "csv")
    n_files, n_rows = files_and_rows(f"{base}/big")
    assert n_files > 1 and n_rows == 1000
