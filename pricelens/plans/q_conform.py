"""Conform-job queries: vehicle keys, token measures, keyword derivation, fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions.similarity import containment, sequence_ratio, token_jaccard
from pricelens.functions.text import base_name, default_vehicle, match_key, norm_text, token_set
from pricelens.operators import conform as C
from pricelens.plans.registry import register
from pricelens.sources.tables import shape, shape_cte

V = shape_cte("vehicle_cells")
CV = shape_cte("canonical_vehicles")

NORM_SQL = "regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
TOKENS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0))"


def _cells(spark, sf):
    return shape(spark, sf, "vehicle_cells")


def _joined_sorted(c):
    return F.array_join(F.array_sort(c), " ")


@register(
    "default_vehicle",
    V + "SELECT l_orderkey, l_linenumber, CASE WHEN car_type IS NULL OR length(trim(car_type)) = 0 THEN 'all' ELSE trim(car_type) END AS vehicle "
    "FROM vehicle_cells",
)
def q_default_vehicle(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", default_vehicle(F.col("car_type")).alias("vehicle"))


@register(
    "match_key",
    V + "SELECT l_orderkey, l_linenumber, regexp_replace(lower(trim(car_type)), '[^0-9a-z가-힣]', '', 'g') AS vkey FROM vehicle_cells",
)
def q_match_key(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", match_key(F.col("car_type")).alias("vkey"))


@register(
    "norm_text",
    V + f"SELECT l_orderkey, l_linenumber, {NORM_SQL.format(x='car_type')} AS norm FROM vehicle_cells",
)
def q_norm_text(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", norm_text(F.col("car_type")).alias("norm"))


@register(
    "token_set",
    V + f"SELECT l_orderkey, l_linenumber, array_to_string(list_sort({TOKENS_SQL.format(x='car_type')}), ' ') AS tokens FROM vehicle_cells",
)
def q_token_set(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", _joined_sorted(token_set(F.col("car_type"))).alias("tokens"))


@register(
    "base_name",
    CV + "SELECT canonical_name, trim(regexp_replace(canonical_name, '\\s*\\([^)]*\\)\\s*$', '')) AS base FROM canonical_vehicles",
)
def q_base_name(spark, sf):
    return shape(spark, sf, "canonical_vehicles").select("canonical_name", base_name(F.col("canonical_name")).alias("base"))


_KW_SQL = (
    "b AS (SELECT canonical_name, trim(regexp_replace(canonical_name, '\\s*\\([^)]*\\)\\s*$', '')) AS base FROM canonical_vehicles), "
    "t AS (SELECT canonical_name, base, list_filter(string_split_regex(base, '\\s+'), lambda x: length(x) > 0) AS toks, "
    "(contains(base, '하이브리드') OR contains(base, '일렉트릭') OR contains(base, '플러그인') OR contains(lower(base), 'electrified') "
    "OR contains(lower(base), 'hybrid') OR contains(lower(base), 'electric') OR contains(base, '택시') OR contains(base, '쿠페') "
    "OR ends_with(lower(base), ' n')) AS marker FROM b), "
    "k AS (SELECT canonical_name, unnest([base, replace(base, ' ', '')] || list_filter(toks, lambda x: regexp_full_match(x, '[A-Za-z]{1,4}[0-9]{1,4}[A-Za-z]?')) "
    "|| CASE WHEN NOT marker AND len(toks) >= 2 THEN [toks[1]] ELSE [] END) AS kw FROM t) "
)


@register(
    "derive_keywords",
    CV + ", " + _KW_SQL + f"SELECT DISTINCT canonical_name, {NORM_SQL.format(x='kw')} AS keyword FROM k "
    f"WHERE length(kw) > 0 AND length({NORM_SQL.format(x='kw')}) > 0",
)
def q_derive_keywords(spark, sf):
    feats = C.canonical_features(shape(spark, sf, "canonical_vehicles"))
    return feats.select("canonical_name", F.explode("c_keywords").alias("keyword")).distinct()


@register(
    "token_jaccard",
    V + f", x AS (SELECT l_orderkey, l_linenumber, {TOKENS_SQL.format(x='trim(car_type)')} AS a, {TOKENS_SQL.format(x='intended')} AS b FROM vehicle_cells) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN len(list_distinct(a || b)) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) ELSE 0 END AS jaccard FROM x",
)
def q_token_jaccard(spark, sf):
    j = token_jaccard(token_set(F.col("car_type")), token_set(F.col("intended")))
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", F.round(j, 6).alias("jaccard"))


@register(
    "token_setops",
    V + f", x AS (SELECT l_orderkey, l_linenumber, {TOKENS_SQL.format(x='car_type')} AS a, {TOKENS_SQL.format(x='intended')} AS b FROM vehicle_cells) "
    "SELECT l_orderkey, l_linenumber, CAST(len(list_intersect(a, b)) AS INTEGER) AS n_inter, CAST(len(list_distinct(a || b)) AS INTEGER) AS n_union FROM x",
)
def q_token_setops(spark, sf):
    a, b = token_set(F.col("car_type")), token_set(F.col("intended"))
    return _cells(spark, sf).select(
        "l_orderkey", "l_linenumber", F.size(F.array_intersect(a, b)).alias("n_inter"), F.size(F.array_union(a, b)).alias("n_union")
    )


@register(
    "containment",
    V + f", x AS (SELECT l_orderkey, l_linenumber, {NORM_SQL.format(x='car_type')} AS a, {NORM_SQL.format(x='intended')} AS b FROM vehicle_cells) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN contains(b, a) OR contains(a, b) THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS contains FROM x",
)
def q_containment(spark, sf):
    c = containment(norm_text(F.col("car_type")), norm_text(F.col("intended")))
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", c.alias("contains"))


@register(
    "special_values",
    V + "SELECT l_orderkey, l_linenumber, CASE WHEN length(trim(coalesce(car_type, ''))) = 0 THEN 'all' "
    "WHEN lower(trim(car_type)) = 'all' THEN 'all' "
    f"WHEN length({NORM_SQL.format(x='car_type')}) = 0 THEN 'unknown' END AS special FROM vehicle_cells",
)
def q_special_values(spark, sf):
    return _cells(spark, sf).select("l_orderkey", "l_linenumber", C.special_value(F.col("car_type")).alias("special"))


@register(
    "conform_vehicle",
    shape_cte("vehicle_map") + "SELECT v.l_orderkey, v.l_linenumber, v.intended, coalesce(m.canonical, 'unknown') AS car_type "
    "FROM vehicle_cells v LEFT JOIN vehicle_map m ON m.raw = CASE WHEN length(trim(v.car_type)) = 0 THEN 'all' ELSE trim(v.car_type) END",
)
def q_conform_vehicle(spark, sf):
    cache: dict = {}
    cells = shape(spark, sf, "vehicle_cells", cache)
    mapping = shape(spark, sf, "vehicle_map", cache)
    rows = cells.select("l_orderkey", "l_linenumber", "intended", default_vehicle(F.col("car_type")).alias("car_type"))
    return C.apply_vehicle_map(rows, mapping).select("l_orderkey", "l_linenumber", "intended", "car_type")


# --- fuzzy matching (no SQL oracle: the ratio has no SQL builtin; checked against difflib in tests)

def _mapping(spark, sf):
    cache: dict = {}
    cells = shape(spark, sf, "vehicle_cells", cache)
    canon = shape(spark, sf, "canonical_vehicles", cache)
    return C.match_vehicles(cells.select(default_vehicle(F.col("car_type")).alias("raw")), canon.select("canonical_name", "idx"))


@register("fuzzy_vehicle_match")
def q_fuzzy_vehicle_match(spark, sf):
    cache: dict = {}
    cells = shape(spark, sf, "vehicle_cells", cache)
    canon = shape(spark, sf, "canonical_vehicles", cache)
    return C.conform_vehicles(cells.select("l_orderkey", "l_linenumber", "car_type"), canon.select("canonical_name", "idx"))


@register("weighted_argmax")
def q_weighted_argmax(spark, sf):
    return _mapping(spark, sf).where(F.col("method") == "score").select("raw", "canonical", F.round("score", 6).alias("score"))


@register("keyword_fallback")
def q_keyword_fallback(spark, sf):
    return _mapping(spark, sf).where(F.col("method").isin("keyword", "none")).select("raw", "canonical", "method")


@register("sequence_ratio")
def q_sequence_ratio(spark, sf):
    cells = _cells(spark, sf).select(norm_text(F.col("car_type")).alias("a"), norm_text(F.col("intended")).alias("b")).distinct()
    return cells.select("a", "b", F.round(sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))
