"""Clean-job queries: scalar part-number/price rules, vehicle-cell parsing, whole clean jobs.

Oracles take a different route from the Spark plan: vehicle cells are parsed
relationally in DuckDB (``unnest`` pieces and sub-pieces with positions, join the
first sub-piece's prefix back, ``DISTINCT`` per row) instead of array lambdas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.functions.vehicles import valid_vehicle_token
from pricelens.operators.clean import clean_listings, tag_lineage, vehicle_rows
from pricelens.plans.registry import register
from pricelens.sources.tables import shape, shape_cte

L = shape_cte("listing")
DIGITS = "regexp_replace(price, '[^0-9]', '', 'g')"
PRICE_SQL = f"CASE WHEN length({DIGITS}) > 0 THEN TRY_CAST({DIGITS} AS INTEGER) END"
PART_WORDS_SQL = "(?i)(ASSY|BRACKET|BOLT|NUT|SCREW|GASKET|SEAL|HOSE|DUCT|COVER|REINF|CHECKER|CLIP|GROMMET|LATCH|GUARD)"
VALID_SQL = "(length({t}) > 1 AND NOT contains({t}, '_') AND NOT regexp_matches({t}, '" + PART_WORDS_SQL + "'))"


def _listing(spark, sf):
    return shape(spark, sf, "listing")


# --- scalar rules -----------------------------------------------------------------

@register("price_digits", L + f"SELECT l_orderkey, l_linenumber, {PRICE_SQL} AS price_int FROM listing")
def q_price_digits(spark, sf):
    return _listing(spark, sf).select("l_orderkey", "l_linenumber", T.price_to_int(F.col("price")).alias("price_int"))


_PACK = "'^([A-Za-z0-9]+)[xX](\\d+)$'"
_QTY = f"TRY_CAST(NULLIF(regexp_extract(trim(part_no), {_PACK}, 2), '') AS INTEGER)"


@register(
    "unit_price_from_pack",
    L + f"SELECT l_orderkey, l_linenumber, CASE WHEN ({PRICE_SQL}) IS NOT NULL AND {_QTY} > 0 "
    f"THEN CAST(round(({PRICE_SQL}) / {_QTY}) AS INTEGER) ELSE {PRICE_SQL} END AS unit_price FROM listing",
)
def q_unit_price_from_pack(spark, sf):
    df = _listing(spark, sf)
    price = T.unit_price_from_pack(T.price_to_int(F.col("price")), T.pack_qty(F.trim(F.col("part_no"))))
    return df.select("l_orderkey", "l_linenumber", price.alias("unit_price"))


@register(
    "strip_trailing_paren",
    L + "SELECT l_orderkey, l_linenumber, regexp_replace(official_name, '\\s*\\([^()]*\\)\\s*$', '') AS name FROM listing",
)
def q_strip_trailing_paren(spark, sf):
    return _listing(spark, sf).select("l_orderkey", "l_linenumber", T.strip_trailing_paren(F.col("official_name")).alias("name"))


@register(
    "part_no_from_name",
    L + "SELECT l_orderkey, l_linenumber, CASE WHEN length(regexp_extract(trim(official_name), '\\(([^()]+)\\)\\s*$', 1)) > 0 "
    "THEN regexp_extract(trim(official_name), '\\(([^()]+)\\)\\s*$', 1) ELSE trim(part_no) END AS part_no_out, "
    "CASE WHEN length(regexp_extract(trim(official_name), '\\(([^()]+)\\)\\s*$', 1)) > 0 "
    "THEN regexp_replace(trim(official_name), '\\s*\\([^()]*\\)\\s*$', '') ELSE trim(official_name) END AS name FROM listing",
)
def q_part_no_from_name(spark, sf):
    return _listing(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        T.part_no_from_name(F.col("official_name"), F.col("part_no")).alias("part_no_out"),
        T.name_without_part_no(F.col("official_name")).alias("name"),
    )


# cascade input: mixes the pack pattern, paren codes, replacement notes and junk
_CASCADE_INPUT = (
    "CASE l_linenumber % 5 WHEN 0 THEN part_no WHEN 1 THEN concat('구형(', substr(part_no, 2), ')') "
    "WHEN 2 THEN concat('단종되어 ', part_no, ' 로 대체') WHEN 3 THEN concat('AB-', substr(part_no, 4), '-X') "
    "ELSE concat('#', part_no, '!!') END"
)


@register(
    "part_no_cascade",
    L + f"SELECT l_orderkey, l_linenumber, raw, coalesce("
    f"NULLIF(regexp_extract(trim(raw), {_PACK}, 1), ''), "
    "NULLIF(regexp_extract(trim(raw), '\\(([A-Za-z0-9]+)\\)', 1), ''), "
    "NULLIF(regexp_extract(trim(raw), '단종되어\\s*([A-Za-z0-9]+)\\s*로', 1), ''), "
    "CASE WHEN regexp_full_match(trim(raw), '[A-Za-z0-9]+') THEN trim(raw) END, "
    "NULLIF(regexp_extract(trim(raw), '([A-Za-z0-9]{5,})', 1), '')) AS part_no_out "
    f"FROM (SELECT *, {_CASCADE_INPUT} AS raw FROM listing)",
)
def q_part_no_cascade(spark, sf):
    df = _listing(spark, sf).withColumn("raw", F.expr(_CASCADE_INPUT))
    return df.select("l_orderkey", "l_linenumber", "raw", T.part_no_cascade(F.col("raw")).alias("part_no_out"))


@register(
    "non_empty_keys",
    L + "SELECT count(*) AS n_rows FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN '  ' ELSE official_name END AS on2, "
    "CASE WHEN l_linenumber = 4 THEN NULL ELSE part_no END AS pn2 FROM listing) "
    "WHERE on2 IS NOT NULL AND length(trim(on2)) > 0 AND pn2 IS NOT NULL AND length(trim(pn2)) > 0",
)
def q_non_empty_keys(spark, sf):
    df = _listing(spark, sf).select(
        F.when(F.col("l_linenumber") == 3, F.lit("  ")).otherwise(F.col("official_name")).alias("on2"),
        F.when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("part_no")).alias("pn2"),
    )
    keep = F.col("on2").isNotNull() & (F.length(F.trim("on2")) > 0) & F.col("pn2").isNotNull() & (F.length(F.trim("pn2")) > 0)
    return df.where(keep).agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "tag_lineage",
    L + "SELECT l_orderkey, l_linenumber, '2026-03-16' AS dt, 'src_x' AS source FROM listing",
)
def q_tag_lineage(spark, sf):
    return tag_lineage(_listing(spark, sf).select("l_orderkey", "l_linenumber"), "src_x", "2026-03-16")


# --- vehicle cells ----------------------------------------------------------------

_NORM = {
    "market": (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^차종\\s*[:：]?\\s*', ''), "
        "'\\s*\\((?:[^)]*~[^)]*|\\d{{4}}[^)]*)\\)\\s*', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-]+|[ \\-]+$', '', 'g'))"
    ),
    "store": "trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^[ \\-]+|[ \\-]+$', '', 'g'))",
    "partsro": (
        "trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "replace({x}, '&amp;', '&'), '\\s*\\([^)]*\\)\\s*', ' ', 'g'), "
        "'(?:\\b(?:19|20)\\d{{2}}(?:[./-]\\d{{1,2}})?\\b|(?:\\b\\d{{4}}\\s*년식\\b)|(?:~\\s*(?:19|20)\\d{{2}}))', ' ', 'g'), "
        "'(?i)\\b\\d{{2}}\\s*:\\s*-?[A-Z]{{3}}\\.?\\d{{4}}\\b', ' ', 'g'), '\\s+', ' ', 'g'), '^[ \\-]+|[ \\-]+$', '', 'g')), "
        "'^[.,:;~]+|[.,:;~]+$', '', 'g'))"
    ),
}

_PRE = {
    # returns the text to split on commas (market also handles the leading all-vehicles word)
    "market": "trim(regexp_replace(regexp_replace(replace(rest, '，', ','), '\\)\\s+([A-Za-z0-9가-힣])', '), \\1', 'g'), '\\s+', ' ', 'g'))",
    "store": "trim(regexp_replace(regexp_replace(replace(trim(coalesce(cell, '')), '，', ','), "
    "'(\\d{2,4})\\s*,\\s*(\\d{2,4}\\s*년식)', '\\1\x01\\2', 'g'), '\\s+', ' ', 'g'))",
    "partsro": "regexp_replace(trim(regexp_replace(replace(trim(coalesce(cell, '')), '，', ','), '\\s+', ' ', 'g')), '\\s+/\\s+', ',', 'g')",
}


def vehicle_oracle(rules: str, cells_sql: str) -> str:
    """DuckDB oracle for a rule set; ``cells_sql`` yields (k1, k2, cell)."""
    norm = _NORM[rules]
    if rules == "market":
        head = (
            "c0 AS (SELECT k1, k2, cell, trim(regexp_replace(trim(cell), '^\\[차종\\s*및\\s*연식\\]\\s*', '')) AS t1 FROM cells), "
            "c1 AS (SELECT *, (starts_with(t1, '전차종') OR starts_with(t1, '전 차종')) AS lead, "
            "CASE WHEN starts_with(t1, '전차종') THEN trim(substr(t1, 4)) WHEN starts_with(t1, '전 차종') THEN trim(substr(t1, 5)) ELSE t1 END AS rest FROM c0), "
            f"c2 AS (SELECT k1, k2, cell, t1, lead, {_PRE['market']} AS txt FROM c1), "
        )
        special = (
            "SELECT k1, k2, 'All' AS tok, 0 AS pi, 0 AS si FROM c2 WHERE lead UNION ALL "
        )
        all_rows = "cell IS NULL OR length(trim(cell)) = 0 OR length(t1) = 0 OR (NOT lead AND regexp_full_match(t1, '전\\s*차종'))"
        piece_all = "regexp_full_match(piece, '전\\s*차종')"
    else:
        head = f"c2 AS (SELECT k1, k2, cell, {_PRE[rules]} AS txt FROM cells), "
        special = ""
        all_rows = "length(trim(coalesce(cell, ''))) = 0"
        piece_all = "false"
    unprotect = "replace(trim(p), '\x01', ',')" if rules == "store" else "trim(p)"
    return (
        f"cells AS ({cells_sql}), " + head
        + f"pieces AS (SELECT k1, k2, {unprotect} AS piece, pi FROM (SELECT k1, k2, unnest(string_split(txt, ',')) AS p, "
        "generate_subscripts(string_split(txt, ','), 1) AS pi FROM c2) WHERE length(trim(p)) > 0), "
        "subs0 AS (SELECT k1, k2, pi, piece, trim(s) AS sub, si FROM (SELECT k1, k2, pi, piece, "
        "unnest(string_split_regex(piece, '\\s*/\\s*')) AS s, generate_subscripts(string_split_regex(piece, '\\s*/\\s*'), 1) AS si "
        f"FROM pieces WHERE contains(piece, '/') AND NOT {piece_all}) WHERE length(trim(s)) > 0), "
        "subs AS (SELECT *, row_number() OVER (PARTITION BY k1, k2, pi ORDER BY si) AS rn FROM subs0), "
        "pref AS (SELECT k1, k2, pi, trim(regexp_extract(sub, '^(.*\\D)\\s*(\\d+X\\d+)$', 1)) AS prefix FROM subs WHERE rn = 1), "
        "toks AS (" + special
        + f"SELECT k1, k2, 'All' AS tok, pi, 0 AS si FROM pieces WHERE {piece_all} UNION ALL "
        f"SELECT k1, k2, {norm.format(x='piece')} AS tok, pi, 0 AS si FROM pieces WHERE NOT contains(piece, '/') AND NOT {piece_all} UNION ALL "
        "SELECT s.k1, s.k2, " + norm.format(
            x="CASE WHEN s.rn > 1 AND length(p.prefix) > 0 AND regexp_full_match(s.sub, '\\d+X\\d+') THEN concat(p.prefix, ' ', s.sub) ELSE s.sub END"
        ) + " AS tok, s.pi, s.si FROM subs s JOIN pref p ON s.k1 = p.k1 AND s.k2 = p.k2 AND s.pi = p.pi), "
        f"valid AS (SELECT DISTINCT k1, k2, tok FROM toks WHERE {VALID_SQL.format(t='tok')}), "
        f"forced AS (SELECT k1, k2 FROM c2 WHERE {all_rows}), "
        "res AS (SELECT v.k1, v.k2, v.tok AS vehicle FROM valid v WHERE NOT EXISTS (SELECT 1 FROM forced f WHERE f.k1 = v.k1 AND f.k2 = v.k2) "
        "UNION ALL SELECT k1, k2, 'All' AS vehicle FROM c2 c WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.k1 = c.k1 AND v.k2 = c.k2) "
        "OR EXISTS (SELECT 1 FROM forced f WHERE f.k1 = c.k1 AND f.k2 = c.k2)) "
    )


# a cell per listing row: mostly the fixture cell, some blank/null/all-vehicle/part-word variants
_CELL = (
    "CASE l_linenumber WHEN 2 THEN NULL WHEN 3 THEN '  ' WHEN 4 THEN concat('전차종 ', applicable) "
    "WHEN 5 THEN concat(p_brand, ' BRACKET ASSY') WHEN 6 THEN concat('[차종 및 연식] ', applicable, ') ', p_type) "
    "ELSE applicable END"
)
_CELL_SQL = (
    "SELECT row_key AS k1, 0 AS k2, "
    + _CELL.replace("p_brand", "substr(official_name, 1, 4)").replace("p_type", "source")
    + " AS cell FROM listing"
)


def _cells(spark, sf):
    return _listing(spark, sf).select(
        F.col("row_key").alias("k1"),
        F.lit(0).alias("k2"),
        F.expr(_CELL.replace("p_brand", "substr(official_name, 1, 4)").replace("p_type", "source")).alias("cell"),
    )


def _vehicle_query(rules):
    def build(spark, sf):
        return vehicle_rows(_cells(spark, sf), "cell", rules, ["k1"]).select(F.col("k1").alias("row_key"), "vehicle")

    return build


for _rules in ("market", "store", "partsro"):
    register(
        f"vehicles_{_rules}",
        L + ", " + vehicle_oracle(_rules, _CELL_SQL) + "SELECT k1 AS row_key, vehicle FROM res",
    )(_vehicle_query(_rules))


@register(
    "valid_vehicle_token",
    "SELECT p_partkey, p_name, " + VALID_SQL.format(t="p_name") + " AS is_vehicle FROM part",
)
def q_valid_vehicle_token(spark, sf):
    from pricelens.sources.tables import read_table

    return read_table(spark, sf, "part").select("p_partkey", "p_name", valid_vehicle_token(F.col("p_name")).alias("is_vehicle"))


# --- whole clean jobs ---------------------------------------------------------------

def _clean_oracle(rules: str) -> str:
    if rules == "market":
        proj = (
            "SELECT row_key AS k1, 0 AS k2, trim(part_no) AS part_no, "
            "regexp_replace(official_name, '\\s*\\([^()]*\\)\\s*$', '') AS name, "
            f"{PRICE_SQL} AS price, applicable AS cell FROM listing"
        )
    elif rules == "store":
        ex = "regexp_extract(trim(official_name), '\\(([^()]+)\\)\\s*$', 1)"
        proj = (
            f"SELECT row_key AS k1, 0 AS k2, CASE WHEN length({ex}) > 0 THEN {ex} ELSE trim(part_no) END AS part_no, "
            f"CASE WHEN length({ex}) > 0 THEN regexp_replace(trim(official_name), '\\s*\\([^()]*\\)\\s*$', '') ELSE trim(official_name) END AS name, "
            f"{PRICE_SQL} AS price, applicable AS cell FROM listing WHERE length(trim(official_name)) > 0"
        )
    else:
        qty = _QTY
        proj = (
            "SELECT row_key AS k1, 0 AS k2, coalesce("
            f"NULLIF(regexp_extract(trim(part_no), {_PACK}, 1), ''), "
            "NULLIF(regexp_extract(trim(part_no), '\\(([A-Za-z0-9]+)\\)', 1), ''), "
            "NULLIF(regexp_extract(trim(part_no), '단종되어\\s*([A-Za-z0-9]+)\\s*로', 1), ''), "
            "CASE WHEN regexp_full_match(trim(part_no), '[A-Za-z0-9]+') THEN trim(part_no) END, "
            "NULLIF(regexp_extract(trim(part_no), '([A-Za-z0-9]{5,})', 1), '')) AS part_no, "
            "regexp_replace(trim(official_name), '\\s*\\([^()]*\\)\\s*$', '') AS name, "
            f"CASE WHEN ({PRICE_SQL}) IS NOT NULL AND {qty} > 0 THEN CAST(round(({PRICE_SQL}) / {qty}) AS INTEGER) ELSE {PRICE_SQL} END AS price, "
            "applicable AS cell FROM listing WHERE length(trim(official_name)) > 0"
        )
    cells = f"SELECT k1, k2, cell FROM proj WHERE length(name) > 0 AND length(part_no) > 0"
    return (
        L + f", proj AS ({proj}), " + vehicle_oracle(rules, cells)
        + f"SELECT p.part_no, p.name, p.price, r.vehicle AS car_type, '2026-03-16' AS dt, 'src_{rules}' AS source "
        "FROM res r JOIN proj p ON r.k1 = p.k1 AND r.k2 = p.k2"
    )


def _clean_query(rules):
    def build(spark, sf):
        df = _listing(spark, sf)
        if rules == "market":
            df = df.select("part_no", F.col("official_name").alias("name"), "price", F.col("applicable").alias("car_type"))
        return clean_listings(df, rules, dt="2026-03-16", source=f"src_{rules}")

    return build


for _rules in ("market", "store", "partsro"):
    register(f"clean_{_rules}", _clean_oracle(_rules))(_clean_query(_rules))
