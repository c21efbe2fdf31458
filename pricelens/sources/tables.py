"""Driver tables (one parquet file per table) and the domain-shaped views built from them.

Every shape is one SQL text with ``{table}`` placeholders.  Spark runs it with the
tables passed as DataFrame arguments (``spark.sql(text, lineitem=df, ...)``), so the
scan keeps projection pruning and filter pushdown; the DuckDB oracle runs the very
same text on its pre-registered views.  One text for both engines means the inputs
of every registered query are equal by construction.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- shape texts -----------------------------------------------------------------
# Fixed fixture texts (FIXTURES.md section 10) plus a few of our own.

_STANDARDS = (
    "SELECT repair_content, car_type, make_date(y, 1, 1) AS start_date, "
    "make_date(y, 12, 31) AS end_date, CAST(CASE WHEN y % 6 = 5 THEN 0.0 ELSE 1.0 + (y % 3) * 0.5 END AS DOUBLE) AS standard_repair_time, "
    "20000 AS hour_labor_rate, CASE WHEN y % 2 = 0 THEN 20000 END AS change_cycle "
)

SHAPES: dict[str, str] = {
    # scraped listing rows, store-style columns
    "listing": (
        "SELECT l_orderkey, l_linenumber, l_partkey, "
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), "
        "CAST(l_suppkey AS STRING), CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING), "
        "CAST(CAST(floor(l_quantity) AS INT) AS STRING)) AS row_key, "
        "CASE WHEN l_linenumber = 1 THEN concat('P', lpad(CAST(l_partkey AS STRING), 8, '0'), 'x', "
        "CAST(CAST(floor(l_quantity) AS INT) AS STRING)) ELSE concat('P', lpad(CAST(l_partkey AS STRING), 8, '0')) END AS part_no, "
        "concat(p_name, ' (', p_brand, ')') AS official_name, "
        "concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '원') AS price, "
        "concat(p_type, ' 4X2/4X4, ', p_name, ' (2014~2017)') AS applicable, "
        "CASE l_suppkey % 3 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' ELSE 'src_c' END AS source "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    # clean rows for the mart: several spellings per part, blank names, null prices
    "clean_rows": (
        "SELECT concat('P', lpad(CAST(l_partkey AS STRING), 8, '0')) AS part_no, "
        "CASE WHEN l_linenumber = 5 THEN '' WHEN l_linenumber = 6 THEN NULL "
        "WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN p_brand "
        "WHEN (l_orderkey + l_linenumber) % 3 = 1 THEN p_name "
        "ELSE concat(p_name, ' ', p_type) END AS name, "
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(floor(l_extendedprice) AS INT) END AS price, "
        "p_type AS car_type, "
        "CASE l_suppkey % 4 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' WHEN 2 THEN 'src_c' ELSE 'src_z' END AS source "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    "estimates": (
        "SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderpriority AS car_type, "
        "CAST(floor(o_totalprice / 10) AS INT) AS car_mileage, "
        "CAST(date_trunc('month', o_orderdate) AS DATE) AS service_finish_at FROM {orders}"
    ),
    "est_parts": (
        "SELECT l_orderkey AS estimate_id, l_linenumber AS no, p_name AS part_official_name, "
        "CAST(floor(l_extendedprice / l_quantity) AS INT) AS unit_price "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    "est_labor": (
        "SELECT l_orderkey AS estimate_id, l_linenumber AS no, p_type AS repair_content, "
        "CAST(floor(l_extendedprice) AS INT) AS tech_fee "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    # one row per line item, as part (est_parts) and as labor (est_labor) at once
    "est_items": (
        "SELECT l_orderkey AS estimate_id, l_linenumber AS no, p_name AS part_official_name, "
        "CAST(floor(l_extendedprice / l_quantity) AS INT) AS unit_price, p_type AS repair_content, "
        "CAST(floor(l_extendedprice) AS INT) AS tech_fee "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    # labor standards per (work type, vehicle, year) that occur in the line items: yearly
    # windows, some years without a change cycle (a join, not a cross product)
    "labor_master": (
        _STANDARDS + "FROM (SELECT DISTINCT p_type AS repair_content, o_orderpriority AS car_type, CAST(year(o_orderdate) AS INT) AS y "
        "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey) t"
    ),
    # line items that carry their estimate's header, and out of them the rows of labor_master
    # and of price_mart
    "loaded_items": (
        "SELECT i.*, e.customer_id, e.car_type, e.car_mileage, e.service_finish_at "
        "FROM {est_items} i JOIN {estimates} e ON i.estimate_id = e.id"
    ),
    "loaded_labor_master": (
        _STANDARDS + "FROM (SELECT DISTINCT repair_content, car_type, CAST(year(service_finish_at) AS INT) AS y FROM {loaded_items}) t"
    ),
    "loaded_price_mart": (
        "SELECT part_official_name, car_type, service_finish_at AS extracted_at, "
        "min(unit_price) AS min_price, max(unit_price) AS max_price "
        "FROM {loaded_items} GROUP BY part_official_name, car_type, service_finish_at"
    ),
    "ledger": (
        "SELECT concat('src', CAST(user_id % 3 AS STRING)) AS source, CAST(ts AS DATE) AS dt, "
        "sha1(concat('u', CAST(user_id AS STRING))) AS sk, concat('u', CAST(user_id AS STRING)) AS url, "
        "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status, "
        "CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'not_found' ELSE '' END END AS reason, "
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(1 + event_id % 3 AS INT) END AS attempt, "
        "event_id FROM {events}"
    ),
    "price_mart": (
        "SELECT ep.part_official_name, e.car_type, e.service_finish_at AS extracted_at, "
        "min(ep.unit_price) AS min_price, max(ep.unit_price) AS max_price "
        "FROM {est_parts} ep JOIN {estimates} e ON ep.estimate_id = e.id "
        "GROUP BY ep.part_official_name, e.car_type, e.service_finish_at"
    ),
    # price mart with vehicle-specific rows partly missing and 'all'/'unknown' fallbacks
    "parts_master": (
        "SELECT part_official_name, car_type, extracted_at, min_price, CASE WHEN min_price % 11 = 0 THEN 0 ELSE max_price - 25 END AS max_price FROM {price_mart} "
        "WHERE min_price % 3 <> 0 "
        "UNION ALL "
        "SELECT part_official_name, CASE length(part_official_name) % 4 WHEN 0 THEN 'all' ELSE 'unknown' END AS car_type, "
        "extracted_at, min(min_price) AS min_price, max(max_price) AS max_price FROM {price_mart} "
        "WHERE length(part_official_name) % 4 IN (0, 1) "
        "GROUP BY part_official_name, CASE length(part_official_name) % 4 WHEN 0 THEN 'all' ELSE 'unknown' END, extracted_at"
    ),
    # staged mart rows of one load: one row per priced part line, several per key
    "staged_mart": (
        "SELECT ep.part_official_name, e.car_type, e.service_finish_at AS extracted_at, "
        "ep.unit_price AS min_price, ep.unit_price + ep.no AS max_price, "
        "ep.estimate_id AS seq1, ep.no AS seq2 "
        "FROM {est_parts} ep JOIN {estimates} e ON ep.estimate_id = e.id"
    ),
    # repair documents: prose documents with a model, a system, expected parts and a vector.  The
    # symptom is the whole text in another spelling; the expected parts are the text's second to
    # fourth word, then the whole text's phrases between common words
    "repair_doc": (
        "SELECT d.doc_id AS id, CASE d.doc_id % 3 WHEN 0 THEN 'hyundai_model_pdf' WHEN 1 THEN 'common' ELSE 'common_guideline' END AS document_source, "
        "CASE WHEN d.doc_id % 4 = 0 THEN 'common' ELSE concat('M', CAST(d.doc_id % 5 AS STRING)) END AS vehicle_model, "
        "replace(replace(replace(d.text, 'th', 't'), 'ción', 'sion'), 'eau', 'o') AS symptom_text, "
        "CASE d.doc_id % 13 WHEN 0 THEN '엔진' WHEN 1 THEN '점화' WHEN 2 THEN '연료' WHEN 3 THEN '냉각' WHEN 4 THEN '배기' "
        "WHEN 5 THEN '제동' WHEN 6 THEN '공조' WHEN 7 THEN '변속기' WHEN 8 THEN '전기충전' WHEN 9 THEN '조향현가' "
        "WHEN 10 THEN '시동 시스템' WHEN 11 THEN '바디전장' ELSE '' END AS system_category, "
        "concat(split_part(d.text, ' ', 2), ', ', split_part(d.text, ' ', 3), '/', split_part(d.text, ' ', 4), ' | ', split_part(d.text, ' ', 2), ' | ', "
        "replace(replace(replace(replace(d.text, ' the ', ', '), ' of ', '/'), ' de ', ' | '), ' und ', ', ')) AS repair_parts, "
        "'' AS pre_replace_check_rule, d.text AS evidence_text, e.embedding AS symptom_embedding "
        "FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id"
    ),
    # symptom text per estimate (several symptoms split by newlines) and its vehicle model
    "symptom_inputs": (
        "SELECT item_id AS estimate_id, CASE WHEN item_id % 7 = 6 THEN 'M9' ELSE concat('M', CAST(item_id % 5 AS STRING)) END AS vehicle_model, "
        "concat(text, CASE item_id % 6 WHEN 0 THEN ' 엔진 소음' WHEN 1 THEN ' 브레이크 패드 마모' WHEN 2 THEN ' 배터리 방전' "
        "WHEN 3 THEN '' WHEN 4 THEN ' 시동모터 소음' ELSE ' 에어컨 송풍' END) AS symptom_text_raw FROM {benchmark}"
    ),
    # quoted parts of the estimates that carry symptoms (consumables and plain names)
    "quote_parts": (
        "SELECT l_orderkey AS estimate_id, l_linenumber AS no, CASE l_linenumber % 4 WHEN 0 THEN concat('엔진오일 ', p_name) "
        "WHEN 1 THEN concat(p_name, ' (', p_brand, ')') ELSE p_name END AS part_official_name "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    # free-text vehicle cells to conform: decorated part names, one per line item
    "vehicle_cells": (
        "SELECT l_orderkey, l_linenumber, p_name AS intended, "
        "CASE l_linenumber WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(p_name, ' (', p_brand, ')') "
        "WHEN 4 THEN replace(p_name, ' ', '') WHEN 5 THEN concat(' ', p_type, ' ') WHEN 6 THEN 'All' ELSE concat(p_name, ' ', p_size) END AS car_type "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
    ),
    # canonical vehicle dimension: one name per distinct part name, decorated with a
    # trailing paren code, a variant marker or a leading model code; idx = list order
    "canonical_vehicles": (
        "SELECT CASE m % 4 WHEN 0 THEN concat(p_name, ' (K', CAST(m % 9 + 1 AS STRING), ')') "
        "WHEN 1 THEN concat(p_name, ' hybrid') "
        "WHEN 2 THEN concat(upper(substr(p_name, 1, 1)), CAST(m % 80 AS STRING), ' ', p_name) "
        "ELSE p_name END AS canonical_name, m AS idx, p_name AS source_name "
        "FROM (SELECT p_name, CAST(min(p_partkey) AS BIGINT) AS m FROM {part} GROUP BY p_name) t"
    ),
    # detail pages of the three shop sites, one of each per part: names with a reference,
    # prices as text or as a script variable, quotes of both kinds, nested markup
    "shop_pages": (
        "SELECT p_partkey AS page_id, "
        "concat('<html><ul><li class=\"\"><a href=\"/category/c/', CAST(p_size AS STRING), '/\">', p_type, '</a></li> <li class=\"displaynone\"></li></ul>', "
        "'<li><span class=\"tit\"><span>상품명</span> </span> <span class=\"con\"><span style=\"x\">', p_name, ' &amp; <b>', p_brand, '</b> (PN-', CAST(p_partkey AS STRING), ')</span></span></li>', "
        "CASE WHEN p_partkey % 3 = 0 THEN concat('<script>var product_price = ', chr(39), CAST(p_partkey * 1000 + 500 AS STRING), chr(39), ';</script>') "
        "ELSE concat('<strong id=\"span_product_price_text\">', CAST(p_partkey AS STRING), '&nbsp;원 </strong>') END, "
        "'<span><span>부품번호</span></span><span class=\"con\"><span>PN-', CAST(p_partkey AS STRING), '</span></span>', "
        "'<span><b>[차종 및 연식] </b><br> [차종 및 연식] ', upper(p_name), ' <i>', CAST(p_size AS STRING), '</i></span></html>') AS store_html, "
        "concat('<table><tr><th><span>부품명</span></th><td><span class=\"v\">', p_name, ' &#38; ', p_brand, ' &eacute;&#x20AC;</span></td></tr>', "
        "'<tr><th><span>판매가</span></th><td><span><strong class=\"p\">', CAST(p_partkey AS STRING), '원</strong></span></td></tr>', "
        "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('<tr><th><span>부품번호</span></th><td><span>', lower(p_brand), '</span></td></tr>') END, "
        "'</table><div class=\"xans-element- xans-product xans-product-additional simple_desc_top\"> ', upper(p_name), '<br>', p_type, ' </div>') AS market_html, "
        "concat('<div class=\"xans-element- xans-product-detaildesign\"><table><tr><th>상품명</th><td>', p_name, '</td></tr><tr><th> 판매가 </th><td><b>', "
        "CAST(p_partkey AS STRING), '</b>원</td></tr><tr><th>정식 부품명</th><td>', p_name, ' &amp; ', p_brand, '</td></tr><tr><th>부품번호</th><td>PN-', CAST(p_partkey AS STRING), "
        "'</td></tr><tr><th>무게</th><td>1kg</td></tr>', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('<tr><th>적용차(생산연도)</th><td>', p_type, '<br/>', upper(p_name), '</td></tr>') END, "
        "'</table></div><script type=\"application/ld+json\">', chr(123), '\"description\": \"', lower(p_brand), ' ', p_type, '\"', chr(125), '</script>') AS partsro_html "
        "FROM {part}"
    ),
    # forum pages: a post with nested divisions and comments, and a list with paging; the
    # text of a document is the body of its post; attributes in either quote or none
    "forum_pages": (
        "SELECT doc_id AS page_id, concat('https://forum.example.com/b/list.php?page=', CAST(doc_id % 3 AS STRING)) AS url, "
        "concat('<html><title>t</title><div class=', chr(39), 'detail view', chr(39), '><div class=\"head pc-view\"><div class=subject>T', CAST(doc_id AS STRING), ' <b>', source, '</b></div></div>', "
        "'<div class=\"cont\">', replace(replace(text, '&', '&amp;'), '<', '&lt;'), '<div><div>n', CAST(doc_id AS STRING), '</div></div><script>x()</script>end</div></div>', "
        "'<div id=\"commentSkinBox\"><ul><li><div class=', chr(39), 'commentCont', chr(39), '>c <div>', lang, '</div></div></li><li><div class=\"commentCont\"> </div></li>', "
        "'<li><div class=commentCont>second ', CAST(doc_id AS STRING), '</div></li></ul></div></html>') AS post_html, "
        "concat('<table><tbody><tr class=', chr(39), 'notice_bg', chr(39), '><td class=subject><a href=\"view.php?seq=0\">n</a></td></tr><tr><td class=\"no\">1</td>', "
        "'<td class=\"subject left\"><a href=\"/else\">x</a><a href=', chr(39), 'view.php?a=1&amp;seq=', CAST(doc_id AS STRING), chr(39), '>', lang, '</a></td></tr></tbody></table>', "
        "'<div class=', chr(39), 'paging', chr(39), '><a href=\"?page=', CAST(doc_id % 7 AS STRING), '\">a</a><div><a href=\"list.php?x=1&amp;page=12\">b</a></div><a href=?page=5>c</a></div>') AS list_html "
        "FROM {documents}"
    ),
    # a supplied mapping: raw spellings equal (any case) to a source name
    "vehicle_map": (
        "SELECT DISTINCT v.raw, c.canonical_name AS canonical FROM "
        "(SELECT DISTINCT trim(car_type) AS raw FROM {vehicle_cells}) v "
        "JOIN {canonical_vehicles} c ON lower(v.raw) = lower(c.source_name)"
    ),
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def shape_deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(SHAPES[name])


def shape(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """Build a shape as a Spark DataFrame; dependencies resolve recursively."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    args = {}
    for dep in dict.fromkeys(shape_deps(name)):
        if dep in SHAPES:
            args[dep] = shape(spark, sf_dir, dep, cache)
        else:
            args[dep] = read_table(spark, sf_dir, dep)
    df = spark.sql(SHAPES[name], **args)
    cache[name] = df
    return df


@lru_cache(maxsize=None)
def shape_cte(*names: str) -> str:
    """``WITH`` prefix defining the given shapes (and their dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in shape_deps(n):
            if dep in SHAPES:
                visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), SHAPES[n])})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"
