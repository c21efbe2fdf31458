"""Golden: the sample estimate (FIXTURES section 2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelens.operators import estimates as E

D = dt.date


@pytest.fixture(scope="module")
def sample(spark):
    est = spark.createDataFrame(
        [("EST_001", "c1", "엑센트(RB)", 85000, D(2026, 2, 16)), ("EST_002", "c1", "엑센트(RB)", 50000, D(2026, 1, 1))],
        "id string, customer_id string, car_type string, car_mileage int, service_finish_at date",
    )
    parts = spark.createDataFrame(
        [("EST_001", 1, "필터 에어 클리너", 6000), ("EST_001", 2, "서비스 키트-오일 필터", 10000)],
        "estimate_id string, no int, part_official_name string, unit_price int",
    )
    labor = spark.createDataFrame(
        [("EST_001", 1, "계기판 교환", 150000), ("EST_002", 1, "계기판 교환", 120000)],
        "estimate_id string, no int, repair_content string, tech_fee int",
    )
    pm = spark.createDataFrame(
        [("필터 에어 클리너", "엑센트(RB)", D(2026, 2, 16), 5810, 7000), ("서비스 키트-오일 필터", "엑센트(RB)", D(2026, 2, 16), 6820, 8750)],
        "part_official_name string, car_type string, extracted_at date, min_price int, max_price int",
    )
    lm = spark.createDataFrame(
        [("계기판 교환", "엑센트(RB)", D(2026, 1, 1), D(9999, 12, 31), 0.9, 132000, 40000)],
        "repair_content string, car_type string, start_date date, end_date date, standard_repair_time double, hour_labor_rate int, change_cycle int",
    )
    return est, parts, labor, pm, lm


def test_part_checks(sample):
    est, parts, _, pm, _ = sample
    priced = E.price_at_service(parts, est, pm)
    st, pos = E.classify_part_price(F.col("unit_price"), F.col("min_price"), F.col("max_price"))
    rows = {r["no"]: r for r in priced.select("no", st.alias("status"), "unit_price", "max_price").collect()}
    assert rows[1]["status"] == "ok" and rows[2]["status"] == "over"
    rep = {r["row_kind"]: r for r in E.overcharge_report(priced).collect()}
    assert rep["line"]["diff"] == 1250 and round(rep["line"]["pct"], 1) == 14.3
    assert (rep["total"]["charged"], rep["total"]["max_price"], rep["total"]["diff"], rep["total"]["ok_count"]) == (10000, 8750, 1250, 1)


def test_labor_cycle_and_verdict(sample):
    est, parts, labor, pm, lm = sample
    checked = E.labor_checks(labor, est, lm)
    exp, diff, pct = E.labor_deviation(F.col("tech_fee"), F.col("standard_repair_time"), F.col("hour_labor_rate"))
    r = checked.where("estimate_id = 'EST_001'").select(exp.alias("e"), diff.alias("d"), pct.alias("p")).first()
    assert abs(r["e"] - 118800) < 1e-6 and abs(r["d"] - 31200) < 1e-6 and round(r["p"], 1) == 26.3
    cyc = {x["estimate_id"]: x for x in E.cycle_issues(checked).collect()}
    assert cyc["EST_001"]["usage"] == 35000 and cyc["EST_001"]["verdict"] == E.CYCLE_SOON
    # the other visit is later than the subject: usage is negative -> early (quirk kept)
    assert cyc["EST_002"]["prev_mileage"] == 85000 and cyc["EST_002"]["verdict"] == E.CYCLE_EARLY
    v = {x["estimate_id"]: x for x in E.estimate_verdict(est, E.price_at_service(parts, est, pm), checked).collect()}
    assert (v["EST_001"]["p_issue"], v["EST_001"]["l_issue"], v["EST_001"]["c_issue"]) == (True, True, False)
    assert v["EST_001"]["issue_count"] == 2 and v["EST_001"]["is_over"]
    assert v["EST_002"]["c_issue"] is True


def test_price_fallback_order(spark):
    est = spark.createDataFrame([("e", "c", "V", 1, D(2026, 1, 1))], "id string, customer_id string, car_type string, car_mileage int, service_finish_at date")
    parts = spark.createDataFrame([("e", 1, "n", 5), ("e", 2, "m", 5)], "estimate_id string, no int, part_official_name string, unit_price int")
    pm = spark.createDataFrame(
        [("n", "all", D(2026, 1, 1), 1, 10), ("n", "unknown", D(2026, 1, 1), 2, 20), ("m", "all", D(2026, 1, 1), 3, 30),
         ("m", "V", D(2026, 2, 1), 9, 90)],
        "part_official_name string, car_type string, extracted_at date, min_price int, max_price int",
    )
    got = {r["no"]: r["max_price"] for r in E.price_at_service(parts, est, pm).collect()}
    # 'unknown' ranks before 'all'; a different date never matches
    assert got == {1: 20, 2: 30}


def test_estimate_json(spark):
    js = '{"car_type":"A","car_mileage":85000,"service_finish_at":"2026-02-16","parts":[{"name":"x","unit_price":"12,000"},{"name":"y"}],"labor":[]}'
    df = spark.createDataFrame([("E1", js)], "id string, j string")
    h, p, l = E.estimate_rows(df, "id", "j")
    assert h.first()["car_mileage"] == 85000
    assert [(r["no"], r["unit_price"]) for r in p.orderBy("no").collect()] == [(1, 12000), (2, 0)]
    assert l.count() == 0


def test_zero_prices_give_null_percentages(spark):
    parts = spark.createDataFrame([(1, 1, "a", 10, 0), (1, 2, "b", 10, 5)], "estimate_id int, no int, part_official_name string, unit_price int, max_price int")
    got = {r["no"]: (r["diff"], r["pct"]) for r in E.overcharge_report(parts).where("row_kind = 'line'").collect()}
    assert got == {1: (10, None), 2: (5, 100.0)}
    labor = spark.createDataFrame([(1, 1, "x", 10, 0.0, 20000)], "estimate_id int, no int, repair_content string, tech_fee int, standard_repair_time double, hour_labor_rate int")
    assert [r["pct"] for r in E.labor_overcharge_report(labor).where("row_kind = 'line'").collect()] == [None]
