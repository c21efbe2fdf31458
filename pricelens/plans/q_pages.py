"""Page-parsing queries over ``pages`` (url, html) and JSON payloads built from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.text import flat_text
from pricelens.operators import pages as P
from pricelens.plans.registry import register
from pricelens.sources.tables import read_table, shape

# --- DuckDB helpers ---------------------------------------------------------------------------------



def _unescape_sql(x: str) -> str:
    """The named references that the given pages hold, '&amp;' last: a single pass."""
    return f"regexp_replace(replace(replace(replace({x}, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;?', '&', 'g')"


def _clean_sql(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    t = f"replace({_unescape_sql(t)}, chr(160), ' ')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def _first_sql(h: str, patterns: list[str]) -> str:
    out = "''"
    for p in reversed(patterns):
        rx = "(?is)" + p.replace("'", "''")
        out = f"CASE WHEN regexp_matches({h}, '{rx}') THEN {_clean_sql(f'regexp_extract({h}, ' + repr_sql(rx) + ', 1)')} ELSE {out} END"
    return out


def repr_sql(s: str) -> str:
    return "'" + s + "'"


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


# --- queries ------------------------------------------------------------------------------------------


@register("html_clean_text", "SELECT page_id, " + _clean_sql("html") + " AS text FROM pages")
def q_html_clean_text(spark, sf):
    return _pages(spark, sf).select("page_id", P.html_clean_text(F.col("html")).alias("text"))


TITLE_PATTERNS = [r"<h1[^>]*>(.*?)</h1>", r"<title[^>]*>(.*?)</title>"]


@register("first_match", "SELECT page_id, " + _first_sql("html", TITLE_PATTERNS) + " AS title FROM pages")
def q_first_match(spark, sf):
    return _pages(spark, sf).select("page_id", P.first_match(F.col("html"), TITLE_PATTERNS).alias("title"))


@register(
    "extract_product_fields",
    "SELECT p_partkey AS page_id, concat(p_name, ' & ', p_brand, ' (PN-', CAST(p_partkey AS VARCHAR), ')') AS official_name, "
    "CASE WHEN p_partkey % 3 = 0 THEN concat(format('{:,}', CAST(p_partkey * 1000 + 500 AS BIGINT)), '원') ELSE concat(CAST(p_partkey AS VARCHAR), ' 원') END AS price, "
    "concat('PN-', CAST(p_partkey AS VARCHAR)) AS part_no, concat(upper(p_name), ' ', CAST(p_size AS VARCHAR)) AS applicable, p_type AS category, "
    "concat(p_name, ' & ', p_brand) AS name FROM part",
)
def q_extract_product_fields(spark, sf):
    out = P.extract_product_fields(shape(spark, sf, "shop_pages"), "store", "store_html")
    return out.select("page_id", *P.STORE_PATTERNS.keys(), "name")


@register(
    "extract_market_fields",
    "SELECT p_partkey AS page_id, concat(p_name, ' & ', p_brand, ' é€') AS name, concat(CAST(p_partkey AS VARCHAR), '원') AS price, "
    "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_brand) END AS part_no, concat(upper(p_name), ' ', p_type) AS car_type FROM part",
)
def q_extract_market_fields(spark, sf):
    out = P.extract_product_fields(shape(spark, sf, "shop_pages"), "market", "market_html")
    return out.select("page_id", *P.MARKET_PATTERNS.keys())


@register(
    "extract_partsro_fields",
    "SELECT p_partkey AS page_id, p_name AS name, concat(CAST(p_partkey AS VARCHAR), ' 원') AS price, concat(p_name, ' & ', p_brand) AS official_name, "
    "concat('PN-', CAST(p_partkey AS VARCHAR)) AS part_no, CASE WHEN p_partkey % 5 = 0 THEN concat(lower(p_brand), ' ', p_type) ELSE concat(p_type, ' / ', upper(p_name)) END AS applicable FROM part",
)
def q_extract_partsro_fields(spark, sf):
    out = P.extract_product_fields(shape(spark, sf, "shop_pages"), "partsro", "partsro_html")
    return out.select("page_id", *P.PARTSRO_COLUMNS.keys())


# URL variants per page: category path, cate_no query, both, neither
def _query_param_sql(u: str, key: str) -> str:
    """Value of ``key`` in the query part (between '?' and '#') of ``u``; '' if absent."""
    return f"regexp_extract('&' || regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&{key}=([^&]*)', 1)"


_URL = (
    "CASE page_id % 4 WHEN 0 THEN concat('https://shop.example.com/category/', CAST(175 + page_id % 8 AS STRING), '/p', CAST(page_id AS STRING)) "
    "WHEN 1 THEN concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'cate_no=', CAST(175 + page_id % 8 AS STRING)) "
    "WHEN 2 THEN concat('https://shop.example.com/category/parts/', CAST(170 + page_id % 20 AS STRING), '/?x=1 ') ELSE url END"
)


@register(
    "category_from_url",
    "SELECT page_id, CASE WHEN length(regexp_extract(u, '/category/(\\d+)/', 1)) > 0 THEN coalesce(CASE TRY_CAST(regexp_extract(u, '/category/(\\d+)/', 1) AS INTEGER) "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.CATEGORY_LABELS.items())
    + " END, '') ELSE coalesce(CASE TRY_CAST(" + _query_param_sql("u", "cate_no") + " AS INTEGER) "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.CATEGORY_LABELS.items())
    + f" END, '') END AS category FROM (SELECT page_id, {_URL} AS u FROM pages)",
)
def q_category_from_url(spark, sf):
    return _pages(spark, sf).select("page_id", F.expr(_URL).alias("u")).select("page_id", P.category_from_url(F.col("u")).alias("category"))


_CATE_SQL = (
    "coalesce(NULLIF(" + _query_param_sql("v", "cate_no") + ", ''), "
    "NULLIF(regexp_extract(regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/category/[^/]+/(\\d+)/', 1), ''))"
)


@register(
    "cate_no_required",
    f"SELECT page_id, {_CATE_SQL} AS cate_no FROM (SELECT page_id, regexp_replace({_URL}, '\\s+', '', 'g') AS v FROM pages)",
)
def q_cate_no_required(spark, sf):
    return _pages(spark, sf).select("page_id", P.cate_no_required(F.expr(_URL)).alias("cate_no"))


@register(
    "crawl_manifest",
    f"SELECT page_id, cate_no, CAST(page AS INTEGER) AS page, concat(regexp_extract(v, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1), '://', "
    "regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '/exec/front/Product/ApiProductNormal?cate_no=', cate_no, "
    "'&supplier_code=S0000000&page=', CAST(page AS VARCHAR), '&bInitMore=F&count=500') AS api_url "
    f"FROM (SELECT page_id, v, {_CATE_SQL} AS cate_no FROM (SELECT page_id, regexp_replace({_URL}, '\\s+', '', 'g') AS v FROM pages)) t, "
    "range(1, 4) r(page) WHERE cate_no IS NOT NULL",
)
def q_crawl_manifest(spark, sf):
    df = _pages(spark, sf).select("page_id", F.expr(_URL).alias("u"))
    return P.crawl_manifest(df, "u", 3, 500, "S0000000").select("page_id", "cate_no", "page", "api_url")


@register(
    "crawl_manifest_rejects",
    f"SELECT page_id, u, 'list_url must include cate_no or /category/.../<id>/ path' AS reject_reason FROM (SELECT page_id, {_URL} AS u, regexp_replace({_URL}, '\\s+', '', 'g') AS v FROM pages) "
    f"WHERE {_CATE_SQL} IS NULL",
)
def q_crawl_manifest_rejects(spark, sf):
    return P.crawl_manifest_rejects(_pages(spark, sf).select("page_id", F.expr(_URL).alias("u")), "u")


_PAYLOAD = (
    "CASE WHEN event_id % 7 = 0 THEN props WHEN event_id % 11 = 0 THEN 'not json' ELSE concat('{\"rtn_code\":\"1000\",\"rtn_data\":{\"data\":[', "
    "'{\"link_product_detail\":\"/product/detail.html?product_no=', CAST(event_id AS STRING), '\"},', "
    "'{\"link_product_detail\":\"https://m.example.com/p/', CAST(user_id AS STRING), '\"},', "
    "'{\"link_product_detail\":\"\"},{\"other\":1},', '{\"link_product_detail\":\"item', CAST(event_id % 5 AS STRING), '.html\"}', "
    "'],\"end\":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, '}}') END"
)
_BASE = "https://shop.example.com/list/cat.html?cate_no=177"


@register(
    "parse_list_payload",
    "WITH p AS (SELECT event_id, " + _PAYLOAD + " AS payload FROM events), "
    "j AS (SELECT event_id, TRY_CAST(payload AS JSON) AS js FROM p), "
    "ok AS (SELECT event_id, js FROM j WHERE js IS NOT NULL AND json_type(js, '$.rtn_data') = 'OBJECT') "
    "SELECT event_id, CASE WHEN starts_with(h, 'https://') THEN h WHEN starts_with(h, '/') THEN concat('https://shop.example.com', h) "
    f"ELSE concat('https://shop.example.com/list/', h) END AS url, coalesce(TRY_CAST(json_extract(js, '$.rtn_data.end') AS BOOLEAN), false) AS is_end "
    "FROM (SELECT event_id, js, unnest(json_extract_string(js, '$.rtn_data.data[*].link_product_detail')) AS h FROM ok) WHERE length(h) > 0 "
    "UNION ALL SELECT event_id, NULL, true FROM j WHERE js IS NULL OR json_type(js, '$.rtn_data') IS DISTINCT FROM 'OBJECT'",
)
def q_parse_list_payload(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", F.expr(_PAYLOAD).alias("payload"))
    urls, end = P.parse_list_payload(F.col("payload"), F.lit(_BASE))
    out = ev.select("event_id", urls.alias("urls"), end.alias("is_end"))
    return out.select("event_id", F.explode_outer("urls").alias("url"), "is_end")


# batch payloads: "urls" as list or string, "url" as string, blanks, non-objects
_BATCH = (
    "concat('{\"Items\":[{\"urls\":[\" https://a.example.com/p', CAST(event_id AS STRING), ' \",\"\",\"https://a.example.com/q', CAST(user_id AS STRING), "
    "'\"]},{\"url\":\"https://b.example.com/r', CAST(event_id AS STRING), '\"},{\"urls\":\"  \"},7,{\"urls\":\"https://c.example.com/s', "
    "CAST(event_id % 13 AS STRING), '\"}]}')"
)


@register(
    "flatten_batch_items",
    "WITH b AS (SELECT event_id, CAST(" + _BATCH + " AS JSON) AS js FROM events), "
    "it AS (SELECT event_id, unnest(json_extract(js, '$.Items[*]')) AS item FROM b), "
    "u AS (SELECT event_id, CASE WHEN json_type(item, '$.urls') = 'ARRAY' THEN json_extract_string(item, '$.urls[*]') "
    "WHEN json_type(item, '$.urls') = 'VARCHAR' AND length(trim(json_extract_string(item, '$.urls'))) > 0 THEN [json_extract_string(item, '$.urls')] "
    "WHEN json_type(item, '$.url') = 'VARCHAR' THEN [json_extract_string(item, '$.url')] ELSE [] END AS us FROM it WHERE json_type(item) = 'OBJECT') "
    "SELECT event_id, trim(x) AS url FROM (SELECT event_id, unnest(us) AS x FROM u) WHERE length(trim(x)) > 0",
)
def q_flatten_batch_items(spark, sf):
    from pricelens.sources.io import flatten_batch_items

    ev = read_table(spark, sf, "events").select("event_id", F.expr(_BATCH).alias("payload"))
    return flatten_batch_items(ev, "payload").select("event_id", "url")


# one manifest per event: most are short, one in ten may be longer than a batch
_LAST = "CASE WHEN event_id % 10 = 3 THEN event_id % 250 ELSE event_id % 4 END"
_MANIFEST = f"to_json(transform(sequence(0, CAST({_LAST} AS INT)), i -> concat('https://x.example.com/p', CAST(event_id AS STRING), '/', CAST(i AS STRING))))"
_MANIFEST_DUCK = f"to_json(list_transform(range(0, CAST({_LAST} AS INT) + 1), lambda i: concat('https://x.example.com/p', CAST(event_id AS VARCHAR), '/', CAST(i AS VARCHAR))))"


@register(
    "scan_url_manifest",
    f"WITH m AS (SELECT event_id, {_MANIFEST_DUCK} AS manifest FROM events) "
    "SELECT event_id, CAST(generate_subscripts(CAST(manifest AS VARCHAR[]), 1) - 1 AS INTEGER) AS pos, unnest(CAST(manifest AS VARCHAR[])) AS url FROM m",
)
def q_scan_url_manifest(spark, sf):
    from pricelens.sources.io import explode_manifest

    ev = read_table(spark, sf, "events").select("event_id", F.expr(_MANIFEST).alias("manifest"))
    return explode_manifest(ev, "manifest").select("event_id", "pos", "url")


@register(
    "assign_batches",
    f"WITH m AS (SELECT event_id, {_MANIFEST_DUCK} AS manifest FROM events), "
    "u AS (SELECT event_id, generate_subscripts(CAST(manifest AS VARCHAR[]), 1) - 1 AS pos, unnest(CAST(manifest AS VARCHAR[])) AS url FROM m) "
    "SELECT event_id, CAST(floor(pos / 100) * 100 AS INTEGER) AS batch_id, count(*) AS n_items, min(url) AS first_url FROM u GROUP BY 1, 2",
)
def q_assign_batches(spark, sf):
    from pricelens.sources.io import assign_batches, explode_manifest

    ev = read_table(spark, sf, "events").select("event_id", F.expr(_MANIFEST).alias("manifest"))
    b = assign_batches(explode_manifest(ev, "manifest"))
    return b.groupBy("event_id", "batch_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("url").alias("first_url"))


@register(
    "flat_text",
    "WITH a AS (SELECT doc_id, trim(regexp_replace(replace(replace(text, chr(160), ' '), chr(13), ''), '\\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents) "
    "SELECT doc_id, trim(regexp_replace(regexp_replace(t, '\\s*\\n\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g')) AS text FROM a",
)
def q_flat_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", flat_text(F.col("text")).alias("text"))


def _flat_sql(x: str) -> str:
    t = f"trim(regexp_replace(replace(replace({x}, chr(160), ' '), chr(13), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'))"
    return f"trim(regexp_replace(regexp_replace({t}, '\\s*\\n\\s*', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


@register(
    "parse_forum_post",
    "SELECT doc_id AS page_id, concat('T', CAST(doc_id AS VARCHAR), ' ', source) AS title, "
    + _flat_sql("concat(text, chr(10), 'n', CAST(doc_id AS VARCHAR), chr(10), 'end')")
    + " AS body, concat('c ', lang, ' || second ', CAST(doc_id AS VARCHAR)) AS comments FROM documents",
)
def q_parse_forum_post(spark, sf):
    return P.parse_forum_posts(shape(spark, sf, "forum_pages").select("page_id", "post_html"), "post_html")


@register(
    "post_links",
    "SELECT concat('https://forum.example.com/b/list.php?page=', CAST(doc_id % 3 AS VARCHAR)) AS list_url, 1 AS row_no, CAST(doc_id AS VARCHAR) AS seq, "
    "concat('https://forum.example.com/b/view.php?a=1&seq=', CAST(doc_id AS VARCHAR)) AS url FROM documents",
)
def q_post_links(spark, sf):
    return P.post_links(shape(spark, sf, "forum_pages"), "list_html", "url")


@register(
    "paging_numbers",
    "SELECT doc_id AS page_id, CASE WHEN doc_id % 7 IN (0, 5) THEN '5,12' WHEN doc_id % 7 < 5 THEN concat(CAST(doc_id % 7 AS VARCHAR), ',5,12') "
    "ELSE concat('5,', CAST(doc_id % 7 AS VARCHAR), ',12') END AS pages, 12 AS n_pages FROM documents",
)
def q_paging_numbers(spark, sf):
    h = F.col("list_html")
    return shape(spark, sf, "forum_pages").select(
        "page_id", F.array_join(P.paging_numbers(h).cast("array<string>"), ",").alias("pages"), P.total_pages(h).alias("n_pages")
    )
