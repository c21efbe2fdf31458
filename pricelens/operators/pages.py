"""Page parsing: fetched HTML / JSON payloads -> listing rows, links and crawl manifests.

Every rule is a native Column expression over the (url, html) rows, so page parsing is
one projection over a distributed scan; nothing is fetched here (pages arrive as data).
Tag-level rules are the regular-expression rules of the shop sites; forum selectors are
expressed as the equivalent patterns on the page markup.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.functions.text import flat_text, let, py_strip

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
# Category id -> label of the store-style site; unknown ids give ''.
CATEGORY_LABELS = {177: "엔진", 178: "미션", 179: "샤시", 180: "바디", 181: "트림"}
API_PATH = "/exec/front/Product/ApiProductNormal"
MARKET_PATTERNS = {
    "name": [
        r"부품명</span>\s*</th>\s*<td>\s*<span[^>]*>(.*?)</span>",
        r"<h2 class=\"titleFont\"[^>]*>(.*?)</h2>",
        r"var\s+product_name\s*=\s*'([^']*)'",
    ],
    "price": [
        r"id=\"span_product_price_text\">(.*?)</strong>",
        r"판매가</span>\s*</th>\s*<td>\s*<span[^>]*>\s*<strong[^>]*>(.*?)</strong>",
    ],
    "part_no": [r"부품번호</span>\s*</th>\s*<td>\s*<span[^>]*>(.*?)</span>"],
    "car_type": [
        r"xans-product-additional\s+simple_desc_top[^>]*>\s*(.*?)\s*</div>",
        r"\[차종\s*및\s*연식\]\s*</b>\s*<br>\s*(.*?)</span>",
    ],
}
STORE_PATTERNS = {
    "official_name": [
        r"상품명</span>\s*</span>\s*<span class=\"con\">\s*<span[^>]*>(.*?)</span>",
        r"<div class=\"product_title[^>]*\">(.*?)<span class=\"delivery",
        r"var\s+product_name\s*=\s*'([^']*)'",
    ],
    "price": [
        r"id=\"span_product_price_text\">(.*?)</strong>",
        r"판매가</span>\s*</span>\s*<span class=\"con\">\s*<span[^>]*>(.*?)</span>",
    ],
    "part_no": [
        r"부품번호</span>\s*</span>\s*<span class=\"con\">\s*<span[^>]*>(.*?)</span>",
        r"\(([\w\-]+)\)\s*<span class=\"delivery",
    ],
    "applicable": [
        r"\[차종\s*및\s*연식\]\s*</b>\s*<br>\s*(.*?)</span>",
        r"simple_desc_css[^>]*>.*?<span class=\"con\">\s*<span[^>]*>(.*?)</span>",
    ],
    "category": [
        r"<li class=\"\"><a href=\"/category/[^/]+/\d+/\">(.*?)</a></li>\s*<li class=\"displaynone\">",
        r"var\s+gfa_cate2\s*=\s*\"([^\"]*)\"",
        r"category_name\":\"([^\"]+)\"",
    ],
}
PRICE_VAR = r"var\s+product_price\s*=\s*'(\d+)'"
WON = "원"
APPLICABLE_PREFIX = "[차종 및 연식]"
PARTSRO_KEYS = ["상품명", "정식 부품명", "부품번호", "판매가", "적용차(생산연도)", "브랜드"]

PARTSRO_COLUMNS = {"name": "상품명", "price": "판매가", "official_name": "정식 부품명", "part_no": "부품번호", "applicable": "적용차(생산연도)"}


# --- text -----------------------------------------------------------------------------------

def _named_references() -> Column:
    """The HTML5 names of the standard library's table, by first letter: letter -> name -> text.
    One constant, folded once per plan."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in sorted(html5.items()):
        by_letter.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


def _numeric_reference(digits: Column) -> Column:
    """The character of a decimal or x-hexadecimal number, as HTML5 maps it."""
    hexadecimal = digits.rlike("^[xX]")
    body = F.regexp_replace(digits, "^[xX]?0*", "")
    # more digits than any character has: far beyond the last one
    code = F.when(F.length(body) > 8, F.lit(1 << 40)).when(F.length(body) == 0, F.lit(0)).otherwise(
        F.when(hexadecimal, F.conv(body, 16, 10)).otherwise(body).try_cast("bigint")
    )
    # C1 numbers mean Windows-1252 characters
    c1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    fixed = F.create_map(*[x for n, t in {0: "\ufffd", 0x0D: "\r", **c1}.items() for x in (F.lit(n).cast("bigint"), F.lit(t))])
    beyond = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    no_character = (
        code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF)
        | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    )
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(fixed, code), F.when(beyond, F.lit("\ufffd")).when(no_character, F.lit("")).otherwise(char))


REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: names that HTML5 knows without their semicolon, longest first
BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def unescape_html(c: Column) -> Column:
    """Character references decoded in one pass from left to right over the full HTML5 table
    (what a reference decodes to is not decoded again); unknown ones stay."""
    names = _named_references()

    def decoded(piece: Column) -> Column:
        s = F.substring(piece, 2, 64)
        digits = F.regexp_extract(s, "^#([0-9]+|[xX][0-9a-fA-F]+);?$", 1)
        whole = F.try_element_at(F.try_element_at(names, F.substring(s, 1, 1)), s)
        bare = F.regexp_extract(s, f"^({BARE_NAMES})", 1)
        start = F.try_element_at(F.try_element_at(names, F.substring(bare, 1, 1)), bare)
        named = F.coalesce(whole, F.when(F.length(bare) > 1, F.concat(start, F.substr(s, F.length(bare) + 1))), piece)
        return F.when(F.length(digits) > 0, _numeric_reference(digits)).when(F.length(piece) > 1, named).otherwise(piece)

    def read(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"(?s){REFERENCE}|&|[^&]+"), 0)
        text = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&"), decoded(p)).otherwise(p)), "")
        return F.when(t.contains("&"), text).otherwise(t)

    return let(c, read)


def html_clean_text(c: Column) -> Column:
    """Tags -> space, unescape entities, nbsp -> space, collapse whitespace, trim."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    t = F.replace(unescape_html(t), F.lit(" "), F.lit(" "))
    return py_strip(F.regexp_replace(t, r"(?U)\s+", " "))


def first_match(html: Column, patterns: list[str], clean=html_clean_text) -> Column:
    """Cleaned group 1 of the first pattern that matches (case-insensitive, dot-all);
    a match with an empty group still wins; no match anywhere -> ''."""
    return clean(F.coalesce(*[_group(html, "(?is)", p) for p in patterns], F.lit("")))


def _group(text: Column, flags: str, pattern: str) -> Column:
    """Group 1 of the pattern's first match, null without a match: one pass over the text, as
    the match takes all that follows and so is the only one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(f"{flags}(?:{pattern})(?s:.*)"), 1), F.lit(1))


def _price_fallback(html: Column) -> Column:
    return F.concat(F.format_number(_group(html, "", PRICE_VAR).cast("decimal(38,0)"), 0), F.lit(WON))


def _staged_name(df: DataFrame, field: str) -> str:
    name = f"_{field}"
    while name in df.columns:
        name = f"_{name}"
    return name


def extract_product_fields(pages: DataFrame, site: str, html_col: str = "html") -> DataFrame:
    """One listing row per detail page, per-site patterns; price falls back to the
    JS variable with a thousands format."""
    h = F.col(html_col)
    if site in ("market", "store"):
        patterns = MARKET_PATTERNS if site == "market" else STORE_PATTERNS
        # every field is matched and cleaned in a projection of its own, so what reads it twice
        # below doesn't match again
        staged = {k: _staged_name(pages, k) for k in patterns}
        rows = pages.select("*", *[first_match(h, v).alias(staged[k]) for k, v in patterns.items()])
        fields = {k: F.col(name) for k, name in staged.items()}
        price = fields["price"]
        fields["price"] = F.when(F.length(price) > 0, price).otherwise(F.coalesce(_price_fallback(h), F.lit("")))
        if site == "store":
            fields["applicable"] = py_strip(F.replace(fields["applicable"], F.lit(APPLICABLE_PREFIX), F.lit("")))
            official = fields["official_name"]
            fields["name"] = let(
                py_strip(F.regexp_replace(official, r"(?U)\s*\([^)]*\)\s*$", "")),
                lambda stripped: F.when(F.length(stripped) > 0, stripped).otherwise(official),
            )
        return rows.select(*[F.col(f"`{c}`") for c in pages.columns], *[v.alias(k) for k, v in fields.items()])
    if site == "partsro":
        rows = pages.select("*", partsro_detail(h).alias("detail"))
        columns = [F.coalesce(F.col("detail")[key], F.lit("")).alias(name) for name, key in PARTSRO_COLUMNS.items()]
        return rows.select("*", *columns).drop("detail")
    raise ValueError(f"unknown site {site!r}")


def partsro_detail(html: Column) -> Column:
    """Detail-table rows (th -> td) of the known keys as a map; <br> in a value -> ' / '.
    Falls back to a JSON-LD description for the applicable vehicles."""
    table = F.regexp_extract(html, r"(?is)<div[^>]*class=\"[^\"]*xans-product-detaildesign[^\"]*\"[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>\s*<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>"), 0)

    def kv(r: Column) -> Column:
        k = html_clean_text(F.regexp_extract(r, r"(?is)<th[^>]*>(.*?)</th>", 1))
        v = F.regexp_replace(F.regexp_extract(r, r"(?is)<td[^>]*>(.*?)</td>", 1), r"(?i)<br\s*/?>", " / ")
        return F.struct(k.alias("key"), html_clean_text(v).alias("value"))

    entries = F.filter(F.transform(rows, kv), lambda e: e["key"].isin(*PARTSRO_KEYS))
    m = F.map_from_entries(let(entries, lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, 1 << 20), lambda o: o["key"] == e["key"]))))
    ld = F.regexp_extract(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", 1)
    desc = F.regexp_extract(ld, r"\"description\"\s*:\s*\"([^\"]+)\"", 1)
    fallback = F.when(F.length(desc) > 0, F.map_from_arrays(F.array(F.lit("적용차(생산연도)")), F.array(py_strip(F.regexp_replace(desc, r"(?U)\s+", " ")))))
    return F.when(m.getItem("적용차(생산연도)").isNull() & fallback.isNotNull(), F.map_concat(m, fallback)).otherwise(m)


# --- urls ---------------------------------------------------------------------------------------

def category_from_url(url: Column) -> Column:
    """P16: '/category/<id>/' in the path, else the 'cate_no' query value; id -> label; unknown -> ''."""
    labels = F.create_map(*[x for k, v in CATEGORY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    path_id = F.regexp_extract(url, r"/category/(\d+)/", 1)
    q = F.try_parse_url(url, F.lit("QUERY"), F.lit("cate_no"))
    return F.when(
        F.length(path_id) > 0, F.coalesce(labels[path_id.try_cast("int")], F.lit(""))
    ).otherwise(F.coalesce(F.when(F.length(q) > 0, labels[q.try_cast("int")]), F.lit("")))


def cate_no_required(list_url: Column) -> Column:
    """Whitespace removed; query 'cate_no', else '/category/<x>/<id>/' in the path;
    null when neither (callers route such rows to a reject table)."""
    u = F.regexp_replace(list_url, r"(?U)\s+", "")
    q = F.try_parse_url(u, F.lit("QUERY"), F.lit("cate_no"))
    path = F.try_parse_url(u, F.lit("PATH"))
    p = F.regexp_extract(F.coalesce(path, F.lit("")), r"/category/[^/]+/(\d+)/", 1)
    return F.coalesce(F.when(F.length(q) > 0, q), F.when(F.length(p) > 0, p))


REJECT_NO_CATEGORY = "list_url must include cate_no or /category/.../<id>/ path"


def crawl_manifest_rejects(categories: DataFrame, url_col: str) -> DataFrame:
    """The rows that :func:`crawl_manifest` can't turn into list URLs, with the reason."""
    return categories.where(cate_no_required(F.col(url_col)).isNull()).withColumn("reject_reason", F.lit(REJECT_NO_CATEGORY))


def crawl_manifest(categories: DataFrame, url_col: str, max_pages: int, count: int, supplier_code: str) -> DataFrame:
    """One list-API URL per (category, page 1..max_pages) - a generator, not a join.
    Rows without a category number are in :func:`crawl_manifest_rejects`."""
    u = F.regexp_replace(F.col(url_col), r"(?U)\s+", "")
    cate = cate_no_required(F.col(url_col))
    proto = F.try_parse_url(u, F.lit("PROTOCOL"))
    host = F.try_parse_url(u, F.lit("AUTHORITY"))
    rows = categories.select("*", cate.alias("cate_no"), proto.alias("_proto"), host.alias("_host")).where(F.col("cate_no").isNotNull())
    rows = rows.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    query = F.concat(
        F.lit("cate_no="), F.url_encode(F.col("cate_no")),
        F.lit("&supplier_code="), F.url_encode(F.lit(supplier_code)),
        F.lit("&page="), F.col("page").cast("string"),
        F.lit("&bInitMore=F&count="), F.lit(str(count)),
    )
    return rows.withColumn("api_url", F.concat(F.col("_proto"), F.lit("://"), F.col("_host"), F.lit(API_PATH), F.lit("?"), query)).drop("_proto", "_host")


def replace_cate_no(url: Column, cate_no: Column) -> Column:
    """P18 helper: the URL with its cate_no value replaced (added when absent)."""
    has = url.rlike(r"[?&]cate_no=")
    sep = F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.when(has, _replace_value(url, cate_no)).otherwise(F.concat(url, sep, F.lit("cate_no="), cate_no.cast("string")))


def _replace_value(url: Column, value: Column) -> Column:
    pre = F.regexp_extract(url, r"^(.*?[?&]cate_no=)", 1)
    post = F.regexp_extract(url, r"^.*?[?&]cate_no=[^&#]*(.*)$", 1)
    return F.concat(pre, value.cast("string"), post)


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve an href against the page URL (absolute, scheme-relative, root-relative, relative)."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    base_dir = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(base_dir, href))
    )


LIST_PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("rtn_code", T.StringType()),
        T.StructField(
            "rtn_data",
            T.StructType(
                [
                    T.StructField("data", T.ArrayType(T.StructType([T.StructField("link_product_detail", T.StringType())]))),
                    T.StructField("end", T.BooleanType()),
                ]
            ),
        ),
    ]
)


def parse_list_payload(payload: Column, base_url: Column) -> tuple[Column, Column]:
    """(detail URLs resolved against the base, end flag); malformed -> ([], true)."""
    j = F.from_json(payload, LIST_PAYLOAD_SCHEMA)
    rtn = j["rtn_data"]
    hrefs = F.filter(F.transform(F.coalesce(rtn["data"], F.array()), lambda x: x["link_product_detail"]), lambda h: F.length(h) > 0)
    urls = F.transform(hrefs, lambda h: resolve_url(base_url, h))
    bad = j.isNull() | rtn.isNull()
    return (
        F.when(bad, F.array().cast("array<string>")).otherwise(urls),
        F.when(bad, F.lit(True)).otherwise(F.coalesce(rtn["end"], F.lit(False))),
    )


# --- forum pages --------------------------------------------------------------------------------

def _class_of(tag: Column) -> Column:
    """The class attribute of a start tag (either quote, or none), blank-padded."""
    v = F.regexp_extract(tag, r"(?is)\sclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(v, r"(?is)^\sclass\s*=\s*", ""), "[\"'\\s]+", " "), F.lit(" "))


def _holds(classes: Column, names: str) -> Column:
    out = F.lit(True)
    for name in names.split("."):
        out = out & classes.contains(f" {name} ")
    return out


def _has_classes(tag: Column, names: str) -> Column:
    return _holds(_class_of(tag), names)


def _tags(parts: Column, element: str) -> Column:
    """What the fold needs of each part of a page cut at the element's tags, read once: whether
    a start tag (1), an end tag (-1) or neither (0) leads it, and the start tag's classes."""
    start, end = (parts_re.format(element) for parts_re in (r"(?i)^<{}\b", r"(?i)^</{}\b"))
    return F.transform(
        parts,
        lambda part: F.when(part.rlike(start), F.struct(F.lit(1).alias("step"), _class_of(F.regexp_extract(part, r"^(<[^>]*>?)", 1)).alias("classes")))
        .when(part.rlike(end), F.struct(F.lit(-1).alias("step"), F.lit("").alias("classes")))
        .otherwise(F.struct(F.lit(0).alias("step"), F.lit("").alias("classes"))),
    )


def _spans(tags: Column, paths: list[tuple[str, ...]]) -> Column:
    """The elements that the paths name, as (path, part of the start tag, part of the end tag),
    by one fold over the tags.  Its state is numbers only: the depth, and per path the depth at
    which each element on it is open (-1: none) and the part where the last one began."""
    state = "struct<part:int,depth:int,at:array<int>,found:array<struct<path:int,first:int,last:int>>>"
    width = [len(path) + 1 for path in paths]
    base = [sum(width[:k]) for k in range(len(paths))]
    zero = F.struct(
        F.lit(0).alias("part"), F.lit(0).alias("depth"), F.array(*[F.lit(-1)] * sum(width)).alias("at"), F.array().alias("found")
    ).cast(state)

    def span(k: int, s: Column) -> Column:
        return F.struct(F.lit(k).alias("path"), F.get(s["at"], F.lit(base[k] + len(paths[k]))).alias("first"), s["part"].alias("last"))

    def step(s: Column, tag: Column) -> Column:
        start, end = tag["step"] == 1, tag["step"] == -1
        depth = F.greatest(s["depth"] + tag["step"], F.lit(0))  # an end tag of nothing counts for nothing
        at, closed = [], []
        for k, path in enumerate(paths):
            inside = F.lit(True)
            for j, names in enumerate(path):
                now = F.get(s["at"], F.lit(base[k] + j))
                opens = (now < 0) & start & inside & _holds(tag["classes"], names)
                closes = (now >= 0) & end & (depth < now)
                at.append(F.when(opens, depth).when(closes, -1).otherwise(now))
                inside = now >= 0
            at.append(F.when(opens, s["part"]).otherwise(F.get(s["at"], F.lit(base[k] + len(path)))))
            closed.append(F.when(closes, span(k, s)))
        ended = F.filter(F.array(*closed), lambda x: x.isNotNull())
        return F.struct(
            (s["part"] + 1).alias("part"),
            depth.alias("depth"),
            F.when(tag["step"] == 0, s["at"]).otherwise(F.array(*at)).alias("at"),
            F.when(end & (F.size(ended) > 0), F.concat(s["found"], ended)).otherwise(s["found"]).alias("found"),
        ).cast(state)

    def finish(s: Column) -> Column:
        unclosed = [F.when(F.get(s["at"], F.lit(base[k] + len(path) - 1)) >= 0, span(k, s)) for k, path in enumerate(paths)]
        return F.concat(s["found"], F.filter(F.array(*unclosed), lambda x: x.isNotNull()))

    return F.aggregate(tags, zero, step, finish)


def inner_htmls(html: Column, element: str, paths: list[tuple[str, ...]]) -> Column:
    """For each path, all inner markups of ``element`` tags that match the path's last class
    list and lie within elements that match the earlier ones, in page order.

    The page is cut at the element's tags and folded once for all paths, counting the nesting
    depth, so an element ends at its own end tag whatever is nested in it (an unclosed one, at
    the page's end).  Markup is put together once per element that was found."""
    parts = F.split(html, rf"(?i)(?=<{element}\b)|(?=</{element}\b)")

    def markup(parts: Column, span: Column) -> Column:
        head = F.get(parts, span["first"])
        rest = F.array_join(F.slice(parts, span["first"] + 2, span["last"] - span["first"] - 1), "")
        return F.concat(F.regexp_replace(head, r"^<[^>]*>?", ""), rest)

    def of_path(k: int, parts: Column, spans: Column) -> Column:
        return F.transform(F.filter(spans, lambda x: x["path"] == k), lambda x: markup(parts, x))

    return let(parts, lambda p: let(_spans(_tags(p, element), paths), lambda spans: F.array(*[of_path(k, p, spans) for k in range(len(paths))])))


def inner_html(html: Column, element: str, *path: str) -> Column:
    """:func:`inner_htmls` of one path."""
    return F.get(inner_htmls(html, element, [path]), F.lit(0))


def _node_text(fragment: Column, sep: str = " ") -> Column:
    t = F.regexp_replace(fragment, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", sep)
    return unescape_html(t)


def _first_text(found: Column, path: int, sep: str = " ") -> Column:
    return flat_text(_node_text(F.coalesce(F.get(F.get(found, F.lit(path)), F.lit(0)), F.lit("")), sep))


#: where a post page holds its title (the first that has a text counts) and its body
TITLE_PATHS = [("detail.view", "head.pc-view", "subject"), ("detail.view", "head.mo-view", "subject"), ("detail.view", "subject")]
BODY_PATH = ("detail.view", "cont")


def forum_post(html: Column) -> Column:
    """A struct (title, body, comments joined ' || ') of a forum post page; within the
    detail view and the comment box only, nested markup included."""

    def fields(found: Column) -> Column:
        page_title = flat_text(_node_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
        titles = [*[_first_text(found, k) for k in range(len(TITLE_PATHS))], page_title]
        title = F.coalesce(*[let(t, lambda x: F.when(F.length(x) > 0, x)) for t in titles], F.lit(""))
        return F.struct(title.alias("title"), _first_text(found, len(TITLE_PATHS), sep="\n").alias("body"), F.array_join(F.filter(comments, lambda c: F.length(c) > 0), " || ").alias("comments"))

    box = F.regexp_extract(html, r"(?is)<[^>]*\bid\s*=\s*[\"']?commentSkinBox\b[^>]*>(.*)$", 1)
    comments = F.transform(inner_html(box, "div", "commentCont"), lambda c: flat_text(_node_text(c, "\n")))
    return let(inner_htmls(html, "div", [*TITLE_PATHS, BODY_PATH]), fields)


def parse_forum_post(html: Column) -> tuple[Column, Column, Column]:
    """P21 as three columns; :func:`parse_forum_posts` reads each page once for all three."""
    post = forum_post(html)
    return post["title"], post["body"], post["comments"]


def parse_forum_posts(pages: DataFrame, html_col: str) -> DataFrame:
    """The pages with ``title``, ``body`` and ``comments`` in place of their markup.  The
    post is a staged struct, so its fields are not parsed anew one by one."""
    others = [c for c in pages.columns if c not in (html_col, "title", "body", "comments")]
    staged = pages.select(*others, forum_post(F.col(html_col)).alias("_post"))
    return staged.select(*others, *[F.col(f"_post.{c}").alias(c) for c in ("title", "body", "comments")])


#: an href value: either quote, or none
HREF = r"href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"


def _href(tag: Column) -> Column:
    return F.concat(*[F.regexp_extract(tag, "(?is)" + HREF, k) for k in (1, 2, 3)])


def post_links(pages: DataFrame, html_col: str, url_col: str, include_notice: bool = False) -> DataFrame:
    """(seq, absolute url) of post links in the rows of table bodies; notice rows skipped
    unless asked.  Attributes may stand in either quote or none."""
    bodies = F.array_join(F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tbody\b[^>]*>(.*?)(?:</tbody\s*>|</table\s*>|$)"), 1), "\n")
    rows = F.regexp_extract_all(bodies, F.lit(r"(?is)(<tr\b[^>]*>.*?)(?=<tr\b|</tr\s*>|$)"), 1)
    out = pages.select(F.col(url_col).alias("list_url"), F.posexplode(rows).alias("row_no", "row"))
    if not include_notice:
        out = out.where(~_class_of(F.regexp_extract("row", r"^(<[^>]*>)", 1)).contains("notice_bg"))
    cells = F.regexp_extract_all(F.col("row"), F.lit(r"(?is)(<td\b[^>]*>.*?)(?=<td\b|</td\s*>|$)"), 1)
    cells = F.filter(cells, lambda c: _has_classes(F.regexp_extract(c, r"^(<[^>]*>)", 1), "subject"))
    anchors = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(r"(?is)<a\b[^>]*>"), 0)))
    hrefs = F.filter(F.transform(anchors, _href), lambda h: h.contains("view.php?"))
    out = out.withColumn("href", py_strip(unescape_html(F.coalesce(F.get(hrefs, F.lit(0)), F.lit(""))))).where(F.length("href") > 0)
    out = out.withColumn("url", resolve_url(F.col("list_url"), F.col("href")))
    out = out.withColumn("seq", F.coalesce(F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("seq")), F.lit("")))
    return out.where(F.length("seq") > 0).select("list_url", "row_no", "seq", "url")


def paging_numbers(html: Column) -> Column:
    """Page numbers > 0 linked from the paging blocks, distinct and sorted."""
    blocks = F.flatten(F.array(*[inner_html(html, element, "paging") for element in ("div", "ul", "p")]))
    anchors = F.regexp_extract_all(F.array_join(blocks, "\n"), F.lit(r"(?is)<a\b[^>]*>"), 0)
    hrefs = F.transform(anchors, lambda a: unescape_html(_href(a)))
    nums = F.transform(hrefs, lambda h: F.regexp_extract(h, r"[?&]page=([0-9]+)", 1).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(nums, lambda n: n.isNotNull() & (n > 0))))


def total_pages(html: Column) -> Column:
    """The greatest linked page number, 0 without paging."""
    return F.coalesce(F.array_max(paging_numbers(html)), F.lit(0))
