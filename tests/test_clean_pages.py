"""Goldens: part numbers and prices (FIXTURES 4), page rules, entry contract."""

from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.operators import pages as P
from pricelens.operators.clean import clean_listings


def test_partsro_part_numbers_and_prices(spark):
    rows = [("2741025000x4", "40,000원"), ("2741025000x4", "10,002원"), ("구형(ABC123)", "5,000"),
            ("단종되어 ABC1234567 로 대체", ""), ("AB-12345-X", "1"), ("P1", "99999999999")]
    df = spark.createDataFrame([(p, pr, "이름", "All") for p, pr in rows], "part_no string, price string, official_name string, applicable string")
    got = [(r["part_no"], r["price"]) for r in clean_listings(df, "partsro").collect()]
    assert got == [("2741025000", 10000), ("2741025000", 2501), ("ABC123", 5000), ("ABC1234567", None), ("12345", 1), ("P1", None)]


def test_store_and_market_names(spark):
    s = spark.createDataFrame([("필터 에어 (28113-1R100)", "x", "7,000원", ""), ("필터", " 97133 ", "문의", "")],
                              "official_name string, part_no string, price string, applicable string")
    got = [(r["part_no"], r["name"], r["price"]) for r in clean_listings(s, "store").collect()]
    assert got == [("28113-1R100", "필터 에어", 7000), ("97133", "필터", None)]
    m = spark.createDataFrame([("필터 (신형)", "A1", "1,200.50", None)], "name string, part_no string, price string, car_type string")
    r = clean_listings(m, "market").first()
    assert (r["name"], r["price"], r["car_type"]) == ("필터", 120050, "All")


def test_page_rules(spark):
    html = '<h1></h1><title>T &amp;lt; &#65;&#x42;</title>'
    df = spark.createDataFrame([(html, "https://s.example.com/category/177/x?cate_no=180", '{"rtn_data":{"data":[{"link_product_detail":"/a"}],"end":true}}')],
                               "h string, u string, j string")
    urls, end = P.parse_list_payload(F.col("j"), F.lit("https://s.example.com/list/"))
    r = df.select(
        P.first_match(F.col("h"), [r"<h1>(.*?)</h1>", r"<title>(.*?)</title>"]).alias("fm"),
        P.html_clean_text(F.col("h")).alias("clean"), P.category_from_url(F.col("u")).alias("cat"),
        urls.alias("urls"), end.alias("end"), T.flat_text(F.lit("a\r\n\n\n b  c ")).alias("flat"),
    ).first()
    assert r["fm"] == ""  # the first pattern matches with an empty group and wins
    assert r["clean"] == "T &lt; AB"
    assert r["cat"] == "엔진"
    assert r["urls"] == ["https://s.example.com/a"] and r["end"] is True
    assert r["flat"] == "a b c"
    bad = spark.createDataFrame([("not json",)], "j string").select(*P.parse_list_payload(F.col("j"), F.lit("x"))).first()
    assert bad[0] == [] and bad[1] is True


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 131


def test_part_no_present_equals_cascade_nonempty(spark):
    """The filter's one-regex test agrees with the cascade on random part-number cells."""
    import random

    from pricelens.functions import text as T

    rng = random.Random(5)
    pieces = ["AB12", "x", "X", "3", "(", ")", " ", "단종되어 ", "로", "-", "가", "12345", "\n", "Q"]
    vals = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(3000)] + [None, "", "  "]
    df = spark.createDataFrame([(v,) for v in vals], "p string")
    got = df.select(
        (F.coalesce(F.length(T.part_no_cascade(F.trim("p"))), F.lit(0)) > 0).alias("a"),
        F.coalesce(T.part_no_present(F.trim("p")), F.lit(False)).alias("b"),
    ).collect()
    assert all(r["a"] == r["b"] for r in got)
    assert sum(r["a"] for r in got) > 100


FORUM = (
    "<html><title>TT</title><body><div class='detail view'><div class=\"head pc-view\"><div class=subject>My <b>title</b></div></div>"
    "<div class=\"cont\">a<div><div>b</div></div>c &amp; d</div></div><div class='cont'>elsewhere</div>"
    "<div id=\"commentSkinBox\"><ul class=commentBox><li><div class='commentCont'>one<div>two</div></div></li>"
    "<li><div class=\"commentCont\"> </div></li><li><div class=commentCont>three</div></ul></div>"
    "<table><tbody><tr class='notice_bg'><td class='subject'><a href='view.php?seq=1'>n</a>"
    "<tr><td class=\"subject left\"><a href=\"/x\">i</a><a href='/b/view.php?a=1&amp;seq=22'>p</a></td></tr></tbody></table>"
    "<div class='paging'><a href='?page=3'>3</a><div><a href=\"list.php?x=1&amp;page=12\">12</a></div><a href=?page=0>0</a></div>"
)


def test_forum_rules_follow_nesting_and_either_quote(spark):
    df = spark.createDataFrame([("http://h.com/d/list.php", FORUM), ("http://h.com/", ""), ("http://h.com/e", "<div class='detail view'><div class=cont>open")], "url string, html string")
    title, body, comments = P.parse_forum_post(F.col("html"))
    h = F.col("html")
    rows = df.select(title.alias("t"), body.alias("b"), comments.alias("c"), P.paging_numbers(h).alias("p"), P.total_pages(h).alias("n")).collect()
    assert tuple(rows[0]) == ("My title", "a b c & d", "one two || three", [3, 12], 12)
    assert tuple(rows[1]) == ("", "", "", [], 0)
    assert rows[2]["b"] == "open"
    links = P.post_links(df, "html", "url").collect()
    assert [(r["seq"], r["url"]) for r in links] == [("22", "http://h.com/b/view.php?a=1&seq=22")]
    assert P.post_links(df, "html", "url", include_notice=True).count() == 2


def _inner(html, path):
    """The element rule in plain Python: a walk over the tags with the open elements."""
    import re

    tags = list(re.finditer(r"(?i)<(/?)div\b([^>]*)>?", html))
    depth, opened, found = 0, [None] * len(path), []
    for m in tags:
        if m[1]:
            depth -= 1
            if opened[-1] is not None and depth < opened[-1][0]:
                found.append(html[opened[-1][1] : m.start()])
            opened = [None if o is not None and depth < o[0] else o for o in opened]
        else:
            depth += 1
            has = re.search(r"class='([^']*)'", m[2])
            classes = set(has[1].split()) if has else set()
            before = list(opened)
            for j, names in enumerate(path):
                if before[j] is None and (j == 0 or before[j - 1] is not None) and set(names.split(".")) <= classes:
                    opened[j] = (depth, m.end())
    if opened[-1] is not None:
        found.append(html[opened[-1][1] :])
    return found


def test_elements_of_many_paths_equal_a_walk_over_the_tags(spark):
    import random

    rng = random.Random(3)
    pieces = ["<div class='a'>", "<div class='b c'>", "<div class='c'>", "<div>", "</div>", "</div>", "</div>", "x", "<b>y</b>", "<DIV class='a b'>", "<divider>", " "]
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    paths = [("a",), ("a", "c"), ("b.c",), ("a", "b", "c")]
    df = spark.createDataFrame(list(enumerate(pages)), "id long, html string")
    for r in df.select("id", P.inner_htmls(F.col("html"), "div", paths).alias("found")).collect():
        assert [list(x) for x in r["found"]] == [_inner(pages[r["id"]], path) for path in paths], pages[r["id"]]


def test_forum_pages_of_many_tags_are_read_in_linear_time(spark):
    """200,000 tags in one post; each page is parsed by one projection, its fields are not."""
    import time

    body = "<div>x</div>" * 100_000
    df = spark.createDataFrame([(1, f"<div class='detail view'><div class='cont'>{body}</div></div>", "kept"), (2, None, "none")], "id int, html string, title string")
    start = time.monotonic()
    rows = P.parse_forum_posts(df, "html").collect()
    assert rows[0]["body"].count("x") == 100_000 and time.monotonic() - start < 60
    assert rows[0].asDict().keys() == {"id", "title", "body", "comments"}
    plan = P.parse_forum_posts(df, "html")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 2


def test_references_decode_as_the_standard_library_does(spark):
    import html
    import random

    r = random.Random(2)
    parts = ["&", "amp;", "amp", "lt", "lt;", "notit;", "notin;", "eacute", "euro;", "#38", "#38;", "#X1F600;", "#0;", "#128;", "#x80", "#13;", "#55296;", "#1114112;", "#99999999999999999999;", "#65534;", "#1;", "NotEqualTilde;", "a", " ", ";", "#", "copyright"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 6))) for _ in range(2000)] + ["", "&#38;amp;", "&eacute;&euro;&Agrave;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["u"] for x in df.select("i", P.unescape_html(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == [html.unescape(t) for t in texts]


def test_urls_without_category_are_rejected_not_lost(spark):
    df = spark.createDataFrame([("https://s.com/list?cate_no=5",), ("https://s.com/other",), (None,)], "u string")
    assert P.crawl_manifest(df, "u", 2, 10, "S").count() == 2
    assert sorted(r["u"] or "" for r in P.crawl_manifest_rejects(df, "u").collect()) == ["", "https://s.com/other"]


def test_first_match_takes_the_first_pattern_once(spark):
    texts = ["<H1>\n</H1><title>t</title><h1>later</h1>", "<title>a &amp; b</title><h2>x</h2><h2>y</h2>", "nothing", "", None, "<h2>p|q</h2>tail\nand more"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, h string")
    patterns = [r"<h1>(.*?)</h1>", r"<title>(.*?)</title>", r"nope|<h2>(.*?)</h2>(?=tail|<h2>)"]
    got = [r["v"] for r in df.select("k", P.first_match(F.col("h"), patterns).alias("v")).orderBy("k").collect()]
    assert got == ["", "a & b", "", "", "", "p|q"]


def test_product_fields_are_matched_once_and_keep_clashing_columns(spark):
    page = (
        "<div class=\"product_title big\">Filter (X)<span class=\"delivery\"></span>"
        "<script>var product_price = '1234567'</script><b>[차종 및 연식]</b><br> [차종 및 연식] Bongo </span>"
    )
    df = spark.createDataFrame([(1, page, "kept"), (2, None, None), (3, "<p>" * 2000, "x")], "id int, html string, _price string")
    out = P.extract_product_fields(df, "store")
    rows = {r["id"]: r for r in out.collect()}
    assert (rows[1]["official_name"], rows[1]["name"], rows[1]["price"], rows[1]["applicable"], rows[1]["_price"]) == (
        "Filter (X)", "Filter", "1,234,567원", "Bongo", "kept")
    for k in (2, 3):
        assert [rows[k][c] for c in ("official_name", "name", "price", "part_no", "applicable", "category")] == [""] * 6
    # the optimizer leaves the fields staged: each pattern stands in the plan once
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("var\\s+product_name") == 1 and plan.count("span_product_price_text") == 1
