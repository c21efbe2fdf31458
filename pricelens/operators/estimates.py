"""Repair-estimate checks over *all* estimates at once.

``estimates``: id, customer_id, car_type, car_mileage, service_finish_at
``parts``:     estimate_id, no, part_official_name, unit_price
``labor``:     estimate_id, no, repair_content, tech_fee
``price_mart``: part_official_name, car_type, extracted_at, min_price, max_price
``labor_master``: repair_content, car_type, start_date, end_date, standard_repair_time,
                  hour_labor_rate, change_cycle

Plan notes (scale):
* price lookup (J3) is two left equi-joins: (name, date, vehicle) for the own vehicle's
  row and (name, date) for the fallback row, each side one aggregated row per key.  A hot
  part name is split by AQE's skew join.
* labor standards (J4) are an equi-join on (content, vehicle) with the date range as a
  residual filter - never a cartesian product.
* the previous visit (J5) comes from the top-2 visits per (customer, content), found by one
  window over the rows; no pairs of visits are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.text import fill_template
from pricelens.operators.broadcast import checked_broadcast

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
FALLBACK_ALL = "all"
FALLBACK_UNKNOWN = "unknown"
# price-lookup rank of a mart row: own vehicle 1, literal 'ALL' 2, 'unknown' 3, else 4
RANK_OWN, RANK_ALL_UPPER, RANK_UNKNOWN, RANK_OTHER = 1, 2, 3, 4
PRICE_NO_DATA, PRICE_OVER, PRICE_LOW, PRICE_OK = "no_data", "over", "low", "ok"
BAR_START, BAR_END, BAR_WIDTH, BAR_MIN, BAR_MAX = 20.0, 80.0, 60.0, 5.0, 95.0
CYCLE_SOON_RATIO = 0.8
CYCLE_FIRST = "첫 교체"
CYCLE_OK = "교체 적절"
CYCLE_SOON = "권장 시기"
CYCLE_EARLY = "조기 교체"
ISSUES_FOR_OVER = 2


# --- joins --------------------------------------------------------------------------

def load_estimate(items: DataFrame, estimates: DataFrame | None) -> DataFrame:
    """Item rows with their estimate header (inner join); without ``estimates`` the rows
    carry it already (loaded before, so that several checks share one join)."""
    if estimates is None:
        return items
    head = estimates.select(
        F.col("id").alias("estimate_id"), "customer_id", "car_type", "car_mileage", "service_finish_at"
    )
    return items.join(head, "estimate_id", "inner")


def _dimension(df: DataFrame, broadcast_rows: int) -> DataFrame:
    return checked_broadcast(df, broadcast_rows) if broadcast_rows else df


def price_at_service(parts: DataFrame, estimates: DataFrame | None, price_mart: DataFrame, broadcast_rows: int = 0) -> DataFrame:
    """Each part row with min/max price of the best mart row on the service date.

    Candidates: same name, ``extracted_at = service date``, vehicle in (own, 'all',
    'unknown'); ranked own < 'unknown' < 'all' (the literal 'ALL' rank never matches a
    lower-case 'all' row).  Left join: a part without a candidate keeps null prices.
    Prices of at most ``broadcast_rows`` keys are broadcast once their size is checked, so
    the parts aren't shuffled; more are joined by a shuffle.
    """
    mart = price_mart.where(F.col("part_official_name").isNotNull() & F.col("extracted_at").isNotNull()).select(
        "part_official_name", F.col("extracted_at").alias("service_finish_at"), "car_type", F.struct("min_price", "max_price").alias("price")
    )
    own = mart.groupBy("part_official_name", "service_finish_at", "car_type").agg(F.min("price").alias("own"))
    fallback = (
        mart.where(F.col("car_type").isin(FALLBACK_UNKNOWN, FALLBACK_ALL))
        .groupBy("part_official_name", "service_finish_at")
        .agg(
            F.min(F.when(F.col("car_type") == FALLBACK_UNKNOWN, F.col("price"))).alias("unknown"),
            F.min(F.when(F.col("car_type") == FALLBACK_ALL, F.col("price"))).alias("every"),
        )
    )
    best = F.coalesce("own", "unknown", "every")
    return (
        load_estimate(parts, estimates)
        .join(_dimension(own, broadcast_rows), ["part_official_name", "service_finish_at", "car_type"], "left")
        .join(_dimension(fallback, broadcast_rows), ["part_official_name", "service_finish_at"], "left")
        .select(
            "estimate_id", "no", "part_official_name", "unit_price", "customer_id", "car_type",
            "car_mileage", "service_finish_at",
            best["min_price"].alias("min_price"), best["max_price"].alias("max_price"),
        )
    )


def labor_at_service(labor: DataFrame, estimates: DataFrame | None, labor_master: DataFrame, broadcast_rows: int = 0) -> DataFrame:
    """Labor rows with every standard in force on the service date (left; several multiply);
    ``broadcast_rows`` as in :func:`price_at_service`."""
    lm = _dimension(labor_master, broadcast_rows).select(
        F.col("repair_content").alias("lm_content"), F.col("car_type").alias("lm_car_type"),
        "start_date", "end_date", "standard_repair_time", "hour_labor_rate", "change_cycle",
    )
    rows = load_estimate(labor, estimates)
    cond = (
        (rows["repair_content"] == lm["lm_content"])
        & (rows["car_type"] == lm["lm_car_type"])
        & rows["service_finish_at"].between(lm["start_date"], lm["end_date"])
    )
    return rows.join(lm, cond, "left").drop("lm_content", "lm_car_type", "start_date", "end_date")


def latest_two_visits(rows: DataFrame) -> DataFrame:
    """Add per (customer, content) of the rows: the latest visit ``t1`` and the latest visit of
    another estimate ``t2`` (both struct(estimate_id, car_mileage)), null without a customer or
    a content.  One shuffle and one sort of the rows; no pairs of visits are ever formed."""
    keyed = F.col("customer_id").isNotNull() & F.col("repair_content").isNotNull()
    # rows without a key belong to no group: each estimate's are dealt out by themselves
    rows = rows.withColumn("alone", F.when(~keyed, F.col("estimate_id")))
    visits = Window.partitionBy("customer_id", "repair_content", "alone").orderBy(
        # latest first with PostgreSQL DESC semantics: null dates rank above every date
        F.col("service_finish_at").desc_nulls_first(), F.col("estimate_id").desc(), F.col("car_mileage").desc()
    )
    visit = F.struct("estimate_id", "car_mileage")
    latest = rows.withColumn("t1", F.first(F.when(keyed, visit)).over(visits.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    other = F.when(F.col("estimate_id") != F.col("t1.estimate_id"), visit)
    return latest.withColumn("t2", F.first(other, ignorenulls=True).over(visits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def attach_previous(rows: DataFrame) -> DataFrame:
    """Add ``prev_mileage`` to rows carrying their estimate's header and repair_content."""
    return latest_two_visits(rows).select(
        *rows.columns,
        F.when(F.col("t1.estimate_id") != F.col("estimate_id"), F.col("t1.car_mileage"))
        .otherwise(F.col("t2.car_mileage"))
        .alias("prev_mileage"),
    )


def previous_service(labor: DataFrame, estimates: DataFrame | None) -> DataFrame:
    """Per labor row, mileage of the latest *other* visit of the same customer with
    the same repair content (even if later than this one); ties -> highest estimate id.
    """
    return attach_previous(load_estimate(labor, estimates))


# --- per-row verdicts ------------------------------------------------------------------

def classify_part_price(unit_price: Column, min_price: Column, max_price: Column) -> tuple[Column, Column]:
    """(status, bar position clamped to 5..95)."""
    a, lo, hi = unit_price.cast("double"), min_price.cast("double"), max_price.cast("double")
    no_data = min_price.isNull() | max_price.isNull() | (min_price == 0) | (max_price == 0)
    status = (
        F.when(no_data, F.lit(PRICE_NO_DATA))
        .when(a > hi, F.lit(PRICE_OVER))
        .when(a < lo, F.lit(PRICE_LOW))
        .otherwise(F.lit(PRICE_OK))
    )
    inner = F.when(hi != lo, (a - lo) / (hi - lo)).otherwise(F.lit(0.5))
    raw = (
        F.when(a < lo, BAR_START - ((lo - a) / lo) * 50)
        .when(a > hi, BAR_END + ((a - hi) / hi) * 50)
        .otherwise(BAR_START + inner * BAR_WIDTH)
    )
    pos = F.when(~no_data, F.greatest(F.lit(BAR_MIN), F.least(F.lit(BAR_MAX), raw)))
    return status, pos


def labor_deviation(fee: Column, std_time: Column, rate: Column) -> tuple[Column, Column, Column]:
    """(expected, diff, pct); pct 0 when expected <= 0; null without a standard."""
    expected = std_time * rate
    diff = fee - expected
    pct = F.when(expected > 0, diff / expected * 100).otherwise(F.lit(0.0))
    has = std_time.isNotNull() & rate.isNotNull()
    return F.when(has, expected), F.when(has, diff), F.when(has, pct)


def cycle_verdict(usage: Column, cycle: Column) -> Column:
    """First / ok (>= cycle) / soon (>= 0.8 cycle) / early."""
    return (
        F.when(usage.isNull(), F.lit(CYCLE_FIRST))
        .when(usage >= cycle, F.lit(CYCLE_OK))
        .when(usage >= cycle * CYCLE_SOON_RATIO, F.lit(CYCLE_SOON))
        .otherwise(F.lit(CYCLE_EARLY))
    )


def labor_checks(labor: DataFrame, estimates: DataFrame | None, labor_master: DataFrame, broadcast_rows: int = 0) -> DataFrame:
    """Labor rows with standards (J4) and the previous visit (J5) side by side.  The previous
    visit comes first: its shuffle then carries no standards."""
    rows = labor_at_service(previous_service(labor, estimates), None, labor_master, broadcast_rows)
    return rows.select(*[c for c in rows.columns if c != "prev_mileage"], "prev_mileage")


def cycle_issues(labor_checked: DataFrame) -> DataFrame:
    """Cycle rows (change_cycle present) with usage (0 shown for a first replacement) and verdict."""
    usage = F.col("car_mileage") - F.col("prev_mileage")
    return labor_checked.where(F.col("change_cycle").isNotNull()).select(
        "estimate_id", "no", "repair_content", F.col("car_mileage").alias("current_mileage"), "prev_mileage",
        F.coalesce(usage, F.lit(0)).alias("usage"), F.col("change_cycle").alias("cycle"),
        cycle_verdict(usage, F.col("change_cycle")).alias("verdict"),
    )


# --- per-estimate aggregates -------------------------------------------------------------

def estimate_verdict(estimates: DataFrame, priced_parts: DataFrame, labor_checked: DataFrame) -> DataFrame:
    """A5: p/l/c issue flags, issue count, over when >= 2 issues."""
    p = priced_parts.groupBy("estimate_id").agg(
        F.coalesce(F.bool_or(F.col("unit_price") > F.col("max_price")), F.lit(False)).alias("p_issue")
    )
    fee_over = F.col("tech_fee") > F.col("standard_repair_time") * F.col("hour_labor_rate")
    early = (
        F.col("change_cycle").isNotNull()
        & F.col("prev_mileage").isNotNull()
        & ((F.col("car_mileage") - F.col("prev_mileage")) < F.col("change_cycle") * CYCLE_SOON_RATIO)
    )
    lab = labor_checked.groupBy("estimate_id").agg(
        F.coalesce(F.bool_or(fee_over), F.lit(False)).alias("l_issue"),
        F.coalesce(F.bool_or(early), F.lit(False)).alias("c_issue"),
    )
    out = (
        estimates.select(F.col("id").alias("estimate_id"))
        .join(p, "estimate_id", "left")
        .join(lab, "estimate_id", "left")
        .select(
            "estimate_id",
            F.coalesce("p_issue", F.lit(False)).alias("p_issue"),
            F.coalesce("l_issue", F.lit(False)).alias("l_issue"),
            F.coalesce("c_issue", F.lit(False)).alias("c_issue"),
        )
    )
    count = sum(F.col(c).cast("int") for c in ("p_issue", "l_issue", "c_issue"))
    return out.withColumn("issue_count", count).withColumn("is_over", F.col("issue_count") >= ISSUES_FOR_OVER)


def effective_verdict(verdict: DataFrame, symptom_flags: DataFrame, report_issue_count: DataFrame | None = None) -> DataFrame:
    """Add the symptom flag: page rule (count + flag, over = is_over or flag) and
    report rule (any of four issues)."""
    flags = symptom_flags.select("estimate_id", F.col("symptom_flag").cast("boolean").alias("symptom_flag"))
    v = verdict.join(flags, "estimate_id", "left").withColumn("symptom_flag", F.coalesce("symptom_flag", F.lit(False)))
    v = v.withColumn("page_issue_count", F.col("issue_count") + F.col("symptom_flag").cast("int")).withColumn(
        "page_is_over", F.col("is_over") | F.col("symptom_flag")
    )
    if report_issue_count is not None:
        v = v.join(report_issue_count, "estimate_id", "left").withColumn(
            "report_is_over", F.coalesce(F.col("report_issue_count"), F.lit(0)) > 0
        )
    return v


def overcharge_report(priced_parts: DataFrame) -> DataFrame:
    """Over-priced part lines with diff and pct (null if the highest price is zero), plus
    one total row per estimate (charged, max, over) carrying ok_count = parts - over parts."""
    over = F.col("max_price").isNotNull() & (F.col("unit_price") > F.col("max_price"))
    lines = priced_parts.where(over).select(
        "estimate_id", F.lit("line").alias("row_kind"), "no", "part_official_name",
        F.col("unit_price").cast("long").alias("charged"), F.col("max_price").cast("long").alias("max_price"),
        (F.col("unit_price") - F.col("max_price")).cast("long").alias("diff"),
        (F.try_divide(F.col("unit_price") - F.col("max_price"), F.col("max_price")) * 100).alias("pct"),
        F.lit(None).cast("long").alias("ok_count"),
    )
    totals = (
        priced_parts.groupBy("estimate_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(over, 1)).alias("n_over"),
            F.sum(F.when(over, F.col("unit_price"))).cast("long").alias("charged"),
            F.sum(F.when(over, F.col("max_price"))).cast("long").alias("max_price"),
            F.sum(F.when(over, F.col("unit_price") - F.col("max_price"))).cast("long").alias("diff"),
        )
        .where(F.col("n_over") > 0)
        .select(
            "estimate_id", F.lit("total").alias("row_kind"), F.lit(None).cast("int").alias("no"),
            F.lit(None).cast("string").alias("part_official_name"), "charged", "max_price", "diff",
            F.lit(None).cast("double").alias("pct"), (F.col("n_rows") - F.col("n_over")).alias("ok_count"),
        )
    )
    return lines.unionByName(totals)


def labor_overcharge_report(labor_checked: DataFrame) -> DataFrame:
    """Labor lines over the standard with expected, diff, pct (null if the standard is
    zero); one total row (excess, ok_count)."""
    expected = F.col("standard_repair_time") * F.col("hour_labor_rate")
    over = F.col("standard_repair_time").isNotNull() & F.col("hour_labor_rate").isNotNull() & (F.col("tech_fee") > expected)
    lines = labor_checked.where(over).select(
        "estimate_id", F.lit("line").alias("row_kind"), "no", "repair_content",
        F.col("tech_fee").cast("double").alias("charged"), expected.alias("expected"),
        (F.col("tech_fee") - expected).alias("diff"), (F.try_divide(F.col("tech_fee") - expected, expected) * 100).alias("pct"),
        F.lit(None).cast("long").alias("ok_count"),
    )
    totals = (
        labor_checked.groupBy("estimate_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(over, 1)).alias("n_over"),
            F.sum(F.when(over, F.col("tech_fee") - expected)).alias("diff"),
        )
        .where(F.col("n_over") > 0)
        .select(
            "estimate_id", F.lit("total").alias("row_kind"), F.lit(None).cast("int").alias("no"),
            F.lit(None).cast("string").alias("repair_content"), F.lit(None).cast("double").alias("charged"),
            F.lit(None).cast("double").alias("expected"), "diff", F.lit(None).cast("double").alias("pct"),
            (F.col("n_rows") - F.col("n_over")).alias("ok_count"),
        )
    )
    return lines.unionByName(totals)


def early_cycle_report(cycles: DataFrame) -> DataFrame:
    """Early replacements with achieved pct = trunc(usage / cycle * 100); ok_count per estimate."""
    early = F.col("verdict") == CYCLE_EARLY
    pct = F.when(F.col("cycle") != 0, (F.col("usage") / F.col("cycle") * 100).cast("int")).otherwise(F.lit(0))
    counts = cycles.groupBy("estimate_id").agg(
        (F.count(F.lit(1)) - F.count(F.when(early, 1))).alias("ok_count")
    )
    return (
        cycles.where(early)
        .select("estimate_id", "no", "repair_content", "cycle", "usage", pct.alias("achieved_pct"), "prev_mileage")
        .join(counts, "estimate_id", "left")
    )


# --- inquiry sentences (P42) ---------------------------------------------------------------

# Question templates and closing questions of the report.
PART_QUESTION = '"{name}" 부품이 시장 최고 기준가 ({max}원) 대비 {diff}원 초과 청구된 근거를 제시해 주십시오.'
PART_CLOSING = "사용된 부품의 등급(정품 / OEM / 재제조)과 구매 단가 영수증을 확인할 수 있습니까?"
LABOR_QUESTION = (
    '"{content}" 작업의 표준 작업시간 {hours}h 기준 공임은 {expected}원이나, {fee}원이 청구되었습니다. '
    "초과 청구 ({diff}원)의 사유를 제시해 주십시오."
)
SYMPTOM_QUESTIONS = [
    "이번 정비에서 교체된 부품이 고객이 호소한 증상과 어떤 직접적 연관이 있습니까?",
    "증상 해결을 위해 해당 부품 교체가 반드시 필요하다는 기술적 근거를 제시해 주십시오.",
    "사전에 고객 동의 없이 증상과 무관한 예방적 정비가 진행된 경우 그 사유를 설명해 주십시오.",
]
LABOR_CLOSING = "실제 작업시간 기록(작업지시서)을 확인할 수 있습니까?"
CYCLE_QUESTION = (
    '"{content}"은 권장 주기 {cycle}km 대비 {gap}km 조기인 {usage}km 시점에 교체되었습니다. '
    "조기 교체가 필요했던 기술적 사유와 소모품 상태 점검 기록을 제시해 주십시오."
)
CYCLE_CLOSING = "소모품 상태 점검 기록(사진 또는 측정값 포함)을 제공해 주실 수 있습니까?"


def _thousands(c: Column) -> Column:
    return F.format_number(c.cast("double"), 0)


def inquiry_text(priced_parts: DataFrame, labor_checked: DataFrame, cycles: DataFrame, symptom_over: DataFrame | None = None) -> DataFrame:
    """One question per over-charged part, labor item and early replacement, plus
    each section's closing question when the section has rows; with ``symptom_over``
    (estimate_id) the symptom section's questions as section 0."""
    p_over = priced_parts.where(F.col("max_price").isNotNull() & (F.col("unit_price") > F.col("max_price")))
    p_q = p_over.select(
        "estimate_id", F.lit(1).alias("section"), F.col("no").alias("item_no"),
        fill_template(PART_QUESTION, name=F.col("part_official_name"), max=_thousands(F.col("max_price")),
             diff=_thousands(F.col("unit_price") - F.col("max_price"))).alias("question"),
    )
    expected = F.col("standard_repair_time") * F.col("hour_labor_rate")
    l_over = labor_checked.where(
        F.col("standard_repair_time").isNotNull() & F.col("hour_labor_rate").isNotNull() & (F.col("tech_fee") > expected)
    )
    l_q = l_over.select(
        "estimate_id", F.lit(2).alias("section"), F.col("no").alias("item_no"),
        fill_template(LABOR_QUESTION, content=F.col("repair_content"), hours=F.col("standard_repair_time").cast("string"),
             expected=_thousands(expected), fee=_thousands(F.col("tech_fee")),
             diff=_thousands(F.col("tech_fee") - expected)).alias("question"),
    )
    early = cycles.where(F.col("verdict") == CYCLE_EARLY)
    c_q = early.select(
        "estimate_id", F.lit(3).alias("section"), F.col("no").alias("item_no"),
        fill_template(CYCLE_QUESTION, content=F.col("repair_content"), cycle=_thousands(F.col("cycle")),
             gap=_thousands(F.col("cycle") - F.col("usage")), usage=_thousands(F.col("usage"))).alias("question"),
    )
    lines = p_q.unionByName(l_q).unionByName(c_q)
    # only which sections an estimate has is shuffled, never a question
    closing = F.when(F.col("section") == 1, PART_CLOSING).when(F.col("section") == 2, LABOR_CLOSING).otherwise(CYCLE_CLOSING)
    closings = lines.select("estimate_id", "section").distinct().select(
        "estimate_id", "section", F.lit(None).cast("int").alias("item_no"), closing.alias("question")
    )
    out = lines.unionByName(closings)
    return out if symptom_over is None else symptom_inquiry(symptom_over).unionByName(out)


def symptom_inquiry(symptom_over: DataFrame) -> DataFrame:
    """The symptom section's fixed questions for each estimate that has the section."""
    questions = F.array(*[F.struct(F.lit(n).alias("item_no"), F.lit(q).alias("question")) for n, q in enumerate(SYMPTOM_QUESTIONS, 1)])
    return symptom_over.select("estimate_id").distinct().select("estimate_id", F.lit(0).alias("section"), F.inline(questions))


# --- estimate JSON (P39, G4) -------------------------------------------------------------------

ESTIMATE_JSON_SCHEMA = (
    "car_type string, car_mileage string, service_finish_at string, "
    "parts array<struct<name: string, unit_price: string>>, labor array<struct<repair_content: string, tech_fee: string>>"
)


def _amount(c: Column) -> Column:
    """'12,000' -> 12000; missing -> 0; not a number -> null."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.replace(c, F.lit(","), F.lit("")).try_cast("int"))


def estimate_rows(payloads: DataFrame, id_col: str, json_col: str, customer_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed estimate JSON -> (header rows, part rows, labor rows); items numbered from 1.

    Rejecting ids that already exist is a ``left_anti`` join of ``payloads`` with the stored
    estimates before this call (J7)."""
    j = payloads.select(F.col(id_col).alias("estimate_id"), F.from_json(F.col(json_col), ESTIMATE_JSON_SCHEMA).alias("j"))
    header = j.select(
        F.col("estimate_id").alias("id"),
        (customer_id if customer_id is not None else F.lit(None).cast("string")).alias("customer_id"),
        F.col("j.car_type").alias("car_type"),
        F.when(F.col("j.car_mileage").isNull(), F.lit(0)).otherwise(F.col("j.car_mileage").try_cast("int")).alias("car_mileage"),
        F.col("j.service_finish_at").alias("service_finish_at"),
    )
    parts = j.select("estimate_id", F.posexplode(F.coalesce(F.col("j.parts"), F.array())).alias("pos", "p")).select(
        "estimate_id", (F.col("pos") + 1).alias("no"), F.col("p.name").alias("part_official_name"), _amount(F.col("p.unit_price")).alias("unit_price")
    )
    labor = j.select("estimate_id", F.posexplode(F.coalesce(F.col("j.labor"), F.array())).alias("pos", "l")).select(
        "estimate_id", (F.col("pos") + 1).alias("no"), F.col("l.repair_content").alias("repair_content"), _amount(F.col("l.tech_fee")).alias("tech_fee")
    )
    return header, parts, labor
