"""The checks of all estimates read one table of loaded line items; its rows, and what is shuffled."""

import datetime as dt
import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from pricelens import session
from pricelens.operators import estimates as E
from pricelens.plans import q_estimates as Q

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
PARTS = "p_partkey long, p_name string, p_type string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders, line items and parts with null and repeated keys, names, types, dates and vehicles."""
    rnd = random.Random(7)
    pick = lambda values: rnd.choice([*values, *values, None])
    dates = [dt.datetime(y, m, 3) for y in (1994, 1995, 1996) for m in (1, 6)]
    orders = [(k, pick(range(5)), rnd.choice([5e5, 9e5, 9e6, None]), pick(dates), pick(["1-URGENT", "all", "5-LOW"])) for k in range(120)]
    lines = [(rnd.randrange(125), pick(range(12)), 1, rnd.randint(1, 7), rnd.choice([1.0, 2.0, None]), rnd.randrange(100, 90000) + 0.5) for _ in range(500)]
    parts = [(k, pick(["bolt", "ring", "nut", "plate"]), pick(["SMALL", "LARGE"])) for k in range(12)]
    # whole rows that come twice; an order's key comes again only with its own customer, date and mileage
    orders, lines, parts = orders + orders[:6], lines + lines[:20], parts + parts[:2]
    at = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("orders", orders, ORDERS), ("lineitem", lines, LINES), ("part", parts, PARTS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def _rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("per_round, broadcast_rows", [(10**6, 200_000), (50, 200_000), (50, 0)])
def test_loaded_checks_have_the_rows_of_the_single_checks(spark, tables, monkeypatch, per_round, broadcast_rows):
    monkeypatch.setattr(Q, "ESTIMATES_PER_ROUND", per_round)
    monkeypatch.setattr(Q, "MAX_BROADCAST_ROWS", broadcast_rows)
    est, priced, checked = Q._loaded_checks(spark, tables)
    assert est.count() == 126
    assert _rows(priced) == _rows(Q._priced(spark, tables))
    assert _rows(checked) == _rows(Q._checked(spark, tables))
    assert sum(_rows(checked).values()) > 500


@pytest.mark.parametrize("shape, loaded", [("price_mart", "loaded_price_mart"), ("labor_master", "loaded_labor_master")])
def test_loaded_dimensions_have_the_rows_of_the_shapes(spark, tables, shape, loaded):
    assert _rows(Q.shape(spark, tables, shape)) == _rows(Q.shape(spark, tables, loaded))


def test_previous_service_is_the_latest_other_visit(spark):
    rnd = random.Random(3)
    est = [(k, rnd.choice(["a", "b", None]), "V", rnd.choice([k * 10, None]), rnd.choice([dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(2022, 1, 1), None])) for k in range(60)]
    labor = [(rnd.randrange(62), n, rnd.choice(["oil", "pad", None]), 5) for n in range(150)]
    got = E.previous_service(
        spark.createDataFrame(labor, "estimate_id long, no int, repair_content string, tech_fee int"),
        spark.createDataFrame(est, "id long, customer_id string, car_type string, car_mileage int, service_finish_at date"),
    ).select("no", "prev_mileage").collect()
    head = {e[0]: e for e in est}
    rows = [(n, c, head[k]) for k, n, c, _ in labor if k in head]
    want = {}
    for n, c, e in rows:
        others = [o for _, oc, o in rows if c is not None and e[1] is not None and (oc, o[1]) == (c, e[1]) and o[0] != e[0]]
        latest = max(others, key=lambda o: (o[4] is None, o[4] or dt.date.min, o[0]), default=None)
        want[n] = latest and latest[3]
    assert dict(tuple(r) for r in got) == want and any(v is not None for v in want.values())


def test_a_repeated_estimate_is_not_its_own_previous_visit(spark):
    est = [(1, "c", "V", 10, dt.date(2020, 1, 1)), (1, "c", "V", 20, dt.date(2021, 1, 1)), (2, "c", "V", 5, dt.date(2019, 1, 1))]
    got = E.previous_service(
        spark.createDataFrame([(1, 1, "oil", 5), (2, 1, "oil", 5)], "estimate_id long, no int, repair_content string, tech_fee int"),
        spark.createDataFrame(est, "id long, customer_id string, car_type string, car_mileage int, service_finish_at date"),
    )
    assert {(r["estimate_id"], r["prev_mileage"]) for r in got.collect()} == {(1, 5), (2, 20)}


def test_labor_checks_shuffle_loaded_rows_once(spark, tables):
    _, _, checked = Q._loaded_checks(spark, tables)
    loaded = checked.drop("prev_mileage", "standard_repair_time", "hour_labor_rate", "change_cycle")
    lm = session.stored(Q.shape(spark, tables, "labor_master"))
    plan = E.labor_checks(loaded, None, lm, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, fs in os.walk(d.getPath()) for f in fs if f.startswith("shuffle_")}


def test_rounds_keep_all_rows_and_leave_no_shuffles(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id % 10 <> 0 THEN id END AS id", "id % 7 AS k").repartition(5, "k")
    spark.conf.set(session.FREE_SHUFFLES, "false")
    before = _shuffle_files(spark)
    found = session.stored(df, 3, ["id"])
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"
    assert _rows(found) == _rows(df) == _rows(session.stored(df))
    spark.conf.unset(session.FREE_SHUFFLES)


@pytest.mark.parametrize("query", ["inquiry_text", "estimate_verdict", "effective_verdict"])
def test_line_items_are_joined_once(spark, tables, query):
    plan = entry.queries()[query](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan, query
    assert "Window" not in plan, query  # of inquiry_text: no question is shuffled to its closing question
