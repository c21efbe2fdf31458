"""Retrieval queries: text helpers, system inference, vector / lexical / fused lists,
iterative validation, evidence selection and the per-estimate summaries.

Every list uses the production scores: vector lists (cosine in double) and lexical lists
(0.7 cover density + 0.3 trigram similarity).  The DuckDB oracle finds minimal covers by a
self-join over token positions, independently of the operator's sliding window.  External
validation scores are a deterministic formula of the ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions import text as T
from pricelens.functions.similarity import trigram_similarity
from pricelens.operators import retrieval as R
from pricelens.operators.load import unique_docs
from pricelens.plans.registry import register
from pricelens.session import stored
from pricelens.sources.tables import SHAPES, read_table, shape, shape_cte

CTE = shape_cte("repair_doc", "symptom_inputs")
QP_CTE = shape_cte("repair_doc", "symptom_inputs", "quote_parts")

# --- shared Spark inputs --------------------------------------------------------------------


def _docs(spark, sf, cache):
    return shape(spark, sf, "repair_doc", cache)


def _texts(spark, sf, cache):
    """The rows of ``_docs`` without their vectors: a document has one for each vector of its id, and
    one if there is none.  Only ids that several vectors share can make more rows than documents, so
    no text is shuffled to the others."""
    if "repair_doc_texts" not in cache:
        vectors = read_table(spark, sf, "embeddings")
        shared = vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("vec_id IS NOT NULL AND n > 1")
        shared = stored(shared.select("vec_id", F.explode(F.expr("sequence(1, n)"))).select("vec_id"))
        none = F.lit(None).cast(vectors.schema["embedding"].dataType)
        cache["repair_doc_texts"] = spark.sql(
            SHAPES["repair_doc"], documents=read_table(spark, sf, "documents"), embeddings=shared.withColumn("embedding", none)
        )
    return cache["repair_doc_texts"]


def _symptoms(spark, sf, cache):
    rows = R.symptom_rows(shape(spark, sf, "symptom_inputs", cache))
    emb = read_table(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("qvec"))
    return rows.join(emb, rows["estimate_id"] * 10 + rows["symptom_no"] == emb["vec_id"], "left").drop("vec_id")


VALIDATION_EXPR = (
    "CAST((estimate_id * 7 + symptom_no * 13 + doc_id * 31) % 100 AS DOUBLE) / 100 "
    "- CASE WHEN estimate_id % 4 = pass - 1 THEN 0.0 ELSE 0.3 END"
)
VALIDATION_KEEP = "doc_id % 4 <> 1"


def _validation(queries):
    def fn(cands):
        q = queries.select("qid", "estimate_id", "symptom_no", "pass")
        return cands.join(q, "qid").select(
            "qid", "doc_id", F.expr(VALIDATION_EXPR).alias("similarity_score"), F.expr(VALIDATION_KEEP).alias("keep")
        )

    return fn


# --- shared DuckDB pieces -------------------------------------------------------------------------

NS = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
TRIG = (
    "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
    "lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
)
KW = "list_filter(regexp_split_to_array({x}, '[\\s,./()\\-_\\[\\]{{}}]+'), lambda t: length(t) >= 2)"


def _systems_sql(x: str) -> str:
    parts = []
    for name, kws in R.SYSTEM_KEYWORD_RULES.items():
        cond = " OR ".join(f"contains(lower({x}), '{k.lower()}')" for k in kws)
        parts.append(f"CASE WHEN {cond} THEN '{name}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda s: s IS NOT NULL)"


def _compact_sql(x: str) -> str:
    kws = KW.format(x=x)
    firsts = f"list_filter({kws}, lambda t, i: NOT list_contains(list_transform(({kws})[1:i-1], lambda y: lower(y)), lower(t)))"
    return f"CASE WHEN len({firsts}) > 0 THEN array_to_string(({firsts})[1:10], ' ') ELSE {x} END"


SYM_SQL = (
    "sym0 AS (SELECT estimate_id, vehicle_model, " + NS.format(x="s") + " AS symptom_text, i FROM (SELECT estimate_id, vehicle_model, "
    "unnest(string_split_regex(symptom_text_raw, '\\|\\||\\n+')) AS s, generate_subscripts(string_split_regex(symptom_text_raw, '\\|\\||\\n+'), 1) AS i "
    "FROM symptom_inputs)), "
    "sym AS (SELECT estimate_id, vehicle_model, symptom_text, CAST(row_number() OVER (PARTITION BY estimate_id ORDER BY i) AS INTEGER) AS symptom_no "
    "FROM sym0 WHERE length(symptom_text) > 0), "
    "symv AS (SELECT s.*, e.embedding AS qvec, " + _systems_sql("s.symptom_text") + " AS systems "
    "FROM sym s LEFT JOIN embeddings e ON e.vec_id = s.estimate_id * 10 + s.symptom_no)"
)


def _queries_sql(passes=(1, 2, 3)) -> str:
    sel = []
    for p in passes:
        text = _compact_sql("symptom_text") if p == 2 else "symptom_text"
        scope = "'common'" if p > 2 else "vehicle_model"
        sel.append(
            f"SELECT concat_ws('|', CAST(estimate_id AS VARCHAR), CAST(symptom_no AS VARCHAR), '{p}') AS qid, estimate_id, symptom_no, "
            f"{p} AS pass, {scope} AS scope, {text} AS query_text, systems, qvec FROM symv"
        )
    return "q AS (" + " UNION ALL ".join(sel) + ")"


TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
DOCT_SQL = (
    "dt AS (SELECT id, vehicle_model, system_category, symptom_embedding, " + TRIG.format(x="symptom_text") + " AS ts, "
    + TRIG.format(x="evidence_text") + " AS te, "
    + TOK.format(x="concat(coalesce(symptom_text, ''), ' ', coalesce(evidence_text, ''))") + " AS dtok FROM repair_doc)"
)
# minimal covers: for each query-token position, the latest position of every query token up
# to it; the window from the earliest of those is minimal if its last token occurs once in it
COVER_SQL = (
    "full_pairs AS (SELECT q.qid, d.id AS doc_id, q.qterms, d.dtok FROM (SELECT *, list_distinct(" + TOK.format(x="query_text") + ") AS qterms FROM q) q "
    "JOIN dt d ON d.vehicle_model = q.scope AND (len(q.systems) = 0 OR list_contains(q.systems, d.system_category)) "
    "WHERE len(q.qterms) > 0 AND list_has_all(d.dtok, q.qterms)), "
    "occ AS (SELECT qid, doc_id, len(qterms) AS n, term, pos FROM (SELECT qid, doc_id, qterms, unnest(dtok) AS term, generate_subscripts(dtok, 1) AS pos FROM full_pairs) "
    "WHERE list_contains(qterms, term)), "
    "num AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY pos) AS k, lag(pos) OVER (PARTITION BY qid, doc_id, term ORDER BY pos) AS prev FROM occ), "
    "latest AS (SELECT a.qid, a.doc_id, a.n, a.pos, a.k, a.prev, b.term, max(b.pos) AS lp FROM num a JOIN num b ON b.qid = a.qid AND b.doc_id = a.doc_id AND b.pos <= a.pos "
    "GROUP BY a.qid, a.doc_id, a.n, a.pos, a.k, a.prev, b.term), "
    "win AS (SELECT qid, doc_id, n, pos, k, prev, min(lp) AS l, count(*) AS have FROM latest GROUP BY qid, doc_id, n, pos, k, prev), "
    "cover AS (SELECT w.qid, w.doc_id, sum(0.1 / (1 + (w.pos - w.l) - (w.k - f.k))) AS density FROM win w "
    "JOIN num f ON f.qid = w.qid AND f.doc_id = w.doc_id AND f.pos = w.l WHERE w.have = w.n AND (w.prev IS NULL OR w.prev < w.l) GROUP BY w.qid, w.doc_id)"
)
PAIRS_SQL = (
    "pairs AS (SELECT q.qid, q.estimate_id, q.symptom_no, q.pass, d.id AS doc_id, "
    "list_cosine_similarity(CAST(q.qvec AS DOUBLE[]), CAST(d.symptom_embedding AS DOUBLE[])) AS vscore, "
    "0.7 * coalesce(cv.density, 0) + "
    "0.3 * greatest(CASE WHEN len(qt) + len(d.ts) > 0 THEN len(list_intersect(qt, d.ts)) / (len(qt) + len(d.ts) - len(list_intersect(qt, d.ts))) ELSE 0 END, "
    "CASE WHEN len(qt) + len(d.te) > 0 THEN len(list_intersect(qt, d.te)) / (len(qt) + len(d.te) - len(list_intersect(qt, d.te))) ELSE 0 END) AS lscore "
    "FROM (SELECT *, " + TRIG.format(x="query_text") + " AS qt FROM q) q JOIN dt d ON d.vehicle_model = q.scope "
    "AND (len(q.systems) = 0 OR list_contains(q.systems, d.system_category)) LEFT JOIN cover cv ON cv.qid = q.qid AND cv.doc_id = d.id)"
)
LISTS_SQL = (
    "vl AS (SELECT * FROM (SELECT qid, doc_id, vscore AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY vscore DESC NULLS LAST, doc_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= {fetch}), "
    "ll AS (SELECT * FROM (SELECT qid, doc_id, lscore AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY lscore DESC, doc_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= {fetch}), "
    "fu0 AS (SELECT coalesce(v.qid, l.qid) AS qid, coalesce(v.doc_id, l.doc_id) AS doc_id, v.rank AS vrank, l.rank AS lrank, "
    "CASE WHEN v.rank IS NOT NULL THEN 1.0 / (60.0 + v.rank) ELSE 0.0 END AS vector_rrf, CASE WHEN l.rank IS NOT NULL THEN 1.0 / (60.0 + l.rank) ELSE 0.0 END AS lexical_rrf "
    "FROM vl v FULL OUTER JOIN ll l ON v.qid = l.qid AND v.doc_id = l.doc_id), "
    "fu AS (SELECT * FROM (SELECT *, vector_rrf + lexical_rrf AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY vector_rrf + lexical_rrf DESC, "
    "coalesce(vrank, lrank + {fetch})) AS INTEGER) AS fused_rank FROM fu0) WHERE fused_rank <= {top})"
)


def retrieval_sql(passes=(1, 2, 3), top=20) -> str:
    fetch = max(top * 4, top)
    return (
        shape_cte("repair_doc", "symptom_inputs", "quote_parts") + ", " + SYM_SQL + ", " + _queries_sql(passes) + ", " + DOCT_SQL + ", " + COVER_SQL + ", " + PAIRS_SQL
        + ", " + LISTS_SQL.format(fetch=fetch, top=top) + " "
    )


def _hybrid_pipeline(spark, sf, passes=(1, 2, 3), top=20):
    cache: dict = {}
    docs = _docs(spark, sf, cache)
    queries = R.pass_queries(_symptoms(spark, sf, cache), passes)
    fetch = max(top * 4, top)
    vec, lex = R.hybrid_lists(queries, docs, fetch, texts=_texts(spark, sf, cache))
    # a few rows per query with several readers: searched once, and small beside the documents
    return queries, vec, lex, stored(R.fuse_rankings(vec, lex, top, fetch))


# --- text helpers ------------------------------------------------------------------------------------------


@register("norm_space", CTE + "SELECT id, " + NS.format(x="coalesce(evidence_text, '')") + " AS text FROM repair_doc")
def q_norm_space(spark, sf):
    return _docs(spark, sf, {}).select("id", T.norm_space(F.col("evidence_text")).alias("text"))


@register(
    "norm_part",
    shape_cte("quote_parts") + "SELECT estimate_id, no, regexp_replace(lower(" + NS.format(x="coalesce(part_official_name, '')")
    + "), '[\\s_\\-/(),.]+', '', 'g') AS pkey FROM quote_parts",
)
def q_norm_part(spark, sf):
    return shape(spark, sf, "quote_parts").select("estimate_id", "no", T.norm_part(F.col("part_official_name")).alias("pkey"))


@register(
    "split_parts",
    CTE + ", x AS (SELECT id, " + NS.format(x="p") + " AS part, i FROM (SELECT id, unnest(string_split_regex(repair_parts, '[,/|\\n]+')) AS p, "
    "generate_subscripts(string_split_regex(repair_parts, '[,/|\\n]+'), 1) AS i FROM repair_doc)), "
    "y AS (SELECT *, regexp_replace(lower(part), '[\\s_\\-/(),.]+', '', 'g') AS k FROM x WHERE length(part) > 0), "
    "z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY i) AS rn FROM y) WHERE rn = 1) "
    "SELECT id, part, CAST(row_number() OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS pos FROM z",
)
def q_split_parts(spark, sf):
    d = _docs(spark, sf, {})
    return d.select("id", F.posexplode(T.split_parts(F.col("repair_parts"))).alias("pos", "part")).select(
        "id", "part", (F.col("pos") + 1).alias("pos")
    )


@register(
    "dedupe_ordered",
    CTE + ", x AS (SELECT id, " + NS.format(x="p") + " AS part, i FROM (SELECT id, unnest(string_split_regex(repair_parts, '[,/|\\n]+')) AS p, "
    "generate_subscripts(string_split_regex(repair_parts, '[,/|\\n]+'), 1) AS i FROM repair_doc)), "
    "y AS (SELECT *, regexp_replace(lower(part), '[\\s_\\-/(),.]+', '', 'g') AS k FROM x WHERE length(part) > 0) "
    "SELECT id, string_agg(part, ',' ORDER BY i) AS parts FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY i) AS rn FROM y) WHERE rn = 1) GROUP BY id",
)
def q_dedupe_ordered(spark, sf):
    d = _docs(spark, sf, {})
    return d.select("id", F.array_join(T.split_parts(F.col("repair_parts")), ",").alias("parts")).where(F.length("parts") > 0)


@register("symptom_rows", CTE + ", " + SYM_SQL + " SELECT estimate_id, symptom_no, symptom_text FROM sym")
def q_symptom_rows(spark, sf):
    return _symptoms(spark, sf, {}).select("estimate_id", "symptom_no", "symptom_text")


@register(
    "split_symptoms",
    CTE + ", " + SYM_SQL + " SELECT estimate_id, count(*) AS n_symptoms, string_agg(symptom_text, ' || ' ORDER BY symptom_no) AS symptoms FROM sym GROUP BY estimate_id",
)
def q_split_symptoms(spark, sf):
    s = shape(spark, sf, "symptom_inputs").select("estimate_id", T.split_symptoms(F.col("symptom_text_raw")).alias("s"))
    return s.where(F.size("s") > 0).select("estimate_id", F.size("s").cast("long").alias("n_symptoms"), F.array_join("s", " || ").alias("symptoms"))


@register(
    "extract_keywords",
    CTE + ", " + SYM_SQL + ", k AS (SELECT estimate_id, symptom_no, " + KW.format(x="symptom_text") + " AS kws FROM sym) "
    "SELECT estimate_id, symptom_no, unnest(kws) AS keyword, CAST(generate_subscripts(kws, 1) AS INTEGER) AS pos FROM k",
)
def q_extract_keywords(spark, sf):
    s = _symptoms(spark, sf, {})
    return s.select("estimate_id", "symptom_no", F.posexplode(T.extract_keywords(F.col("symptom_text"))).alias("pos", "keyword")).select(
        "estimate_id", "symptom_no", "keyword", (F.col("pos") + 1).alias("pos")
    )


@register(
    "compact_query",
    CTE + ", " + SYM_SQL + " SELECT estimate_id, symptom_no, " + _compact_sql("symptom_text") + " AS query FROM sym",
)
def q_compact_query(spark, sf):
    return _symptoms(spark, sf, {}).select("estimate_id", "symptom_no", T.compact_query(F.col("symptom_text")).alias("query"))


@register(
    "summarize_text",
    CTE + ", n AS (SELECT id, " + NS.format(x="coalesce(evidence_text, '')") + " AS t FROM repair_doc) "
    "SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE concat(rtrim(substr(t, 1, 119)), '…') END AS summary FROM n",
)
def q_summarize_text(spark, sf):
    return _docs(spark, sf, {}).select("id", T.summarize_text(F.col("evidence_text")).alias("summary"))


_FENCED = (
    "CASE event_id % 3 WHEN 0 THEN concat('```json\n', props, '\n```') WHEN 1 THEN concat('  ```', props, '```  ') ELSE props END"
)


@register(
    "strip_json_fence",
    "WITH f AS (SELECT event_id, trim(" + _FENCED + ", ' \n') AS t FROM events), "
    "g AS (SELECT event_id, CASE WHEN starts_with(t, '```') THEN trim(trim(t, '`'), ' \n') ELSE t END AS u, starts_with(t, '```') AS fenced FROM f), "
    "h AS (SELECT event_id, CASE WHEN fenced AND starts_with(lower(u), 'json') THEN trim(substr(u, 5), ' \n') ELSE u END AS body FROM g) "
    "SELECT event_id, body, CAST(json_extract_string(body, '$.k') AS BIGINT) AS k FROM h",
)
def q_strip_json_fence(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", F.expr(_FENCED).alias("raw"))
    body = T.strip_json_fence(F.col("raw"))
    return ev.select("event_id", body.alias("body")).select("event_id", "body", F.get_json_object("body", "$.k").cast("long").alias("k"))


_VERDICT_TEXT = (
    "CASE id % 7 WHEN 0 THEN concat('[근거: common_only] 견적서는 다음 이유로 과잉정비입니다. ', symptom_text) "
    "WHEN 1 THEN concat('[근거: hyundai_model_pdf_only]  견적서는 현재 근거 기준 표준 범위입니다. ', symptom_text) "
    "WHEN 2 THEN concat('견적서는 과잉정비가 아닙니다. [보조판단: 일반 정비상식] ', symptom_text) "
    "WHEN 3 THEN concat(symptom_text, ' 과잉정비 의심 [근거: 기타]') "
    "WHEN 4 THEN concat('[근거: hyundai_model_pdf_plus_common] 표준정비 ', symptom_text) "
    "WHEN 5 THEN '' ELSE symptom_text END"
)
_STRIP_TAG = "regexp_replace(" + NS.format(x="coalesce(vt, '')") + ", '^\\[[^\\]]+\\]\\s*', '')"


@register(
    "verdict_from_text",
    CTE + f", v AS (SELECT id, {_VERDICT_TEXT} AS vt FROM repair_doc), w AS (SELECT id, {_STRIP_TAG} AS t FROM v) "
    "SELECT id, CASE WHEN length(t) = 0 THEN false WHEN contains(t, '과잉정비가 아닙니다') OR contains(t, '과잉정비 아님') THEN false "
    "WHEN contains(t, '표준 범위') OR contains(t, '표준정비') OR contains(t, '이상 없음') THEN false WHEN contains(t, '과잉정비') THEN true ELSE false END AS verdict FROM w",
)
def q_verdict_from_text(spark, sf):
    d = _docs(spark, sf, {}).select("id", F.expr(_VERDICT_TEXT).alias("vt"))
    return d.select("id", T.verdict_from_text(F.col("vt")).alias("verdict"))


@register(
    "verdict_strict",
    CTE + f", v AS (SELECT id, {_VERDICT_TEXT} AS vt FROM repair_doc), w AS (SELECT id, {_STRIP_TAG} AS t FROM v) "
    "SELECT id, CASE WHEN starts_with(t, '견적서는 다음 이유로 과잉정비입니다.') THEN true WHEN starts_with(t, '견적서는 현재 근거 기준 표준 범위입니다.') THEN false END AS verdict FROM w",
)
def q_verdict_strict(spark, sf):
    d = _docs(spark, sf, {}).select("id", F.expr(_VERDICT_TEXT).alias("vt"))
    return d.select("id", T.verdict_strict(F.col("vt")).alias("verdict"))


_LABELS_SQL = "CASE code WHEN 'hyundai_model_pdf_plus_common' THEN '현대 정비 지침서 + 일반 정비 지침' WHEN 'hyundai_model_pdf_only' THEN '현대 정비 지침서' WHEN 'common_only' THEN '일반 정비 지침' ELSE '' END"


@register(
    "split_evidence_tag",
    CTE + f", v AS (SELECT id, " + NS.format(x=f"coalesce({_VERDICT_TEXT}, '')") + " AS t FROM repair_doc), "
    "w AS (SELECT id, t, regexp_matches(t, '^\\[(근거:\\s*[^\\]]+)\\]\\s*(.*)$') AS head, regexp_extract(t, '^\\[(근거:\\s*[^\\]]+)\\]\\s*(.*)$', 2) AS rest, "
    "trim(regexp_extract(regexp_extract(t, '^\\[(근거:\\s*[^\\]]+)\\]\\s*(.*)$', 1), '근거:\\s*(.+)$', 1)) AS code FROM v) "
    "SELECT id, " + NS.format(x="trim(regexp_replace(CASE WHEN head THEN rest ELSE t END, '\\[(보조판단|근거):[^\\]]+\\]', '', 'g'))")
    + f" AS body, CASE WHEN head THEN {_LABELS_SQL} ELSE '' END AS label FROM w",
)
def q_split_evidence_tag(spark, sf):
    d = _docs(spark, sf, {}).select("id", F.expr(_VERDICT_TEXT).alias("vt"))
    body, label = T.split_evidence_tag(F.col("vt"))
    return d.select("id", body.alias("body"), label.alias("label"))


@register(
    "source_label",
    CTE + ", n AS (SELECT id, " + NS.format(x="coalesce(document_source, '')") + " AS c FROM repair_doc) "
    "SELECT id, CASE c WHEN 'hyundai_model_pdf' THEN '현대 차종 정비지침' WHEN 'common' THEN '일반 정비 지침' "
    "ELSE CASE WHEN length(c) > 0 THEN c ELSE '문서 근거' END END AS label FROM n",
)
def q_source_label(spark, sf):
    return _docs(spark, sf, {}).select("id", T.source_label(F.col("document_source")).alias("label"))


@register(
    "consumable_flag",
    shape_cte("quote_parts") + ", n AS (SELECT estimate_id, no, regexp_replace(lower(" + NS.format(x="coalesce(part_official_name, '')")
    + "), '[\\s_\\-/(),.]+', '', 'g') AS k FROM quote_parts) SELECT estimate_id, no, "
    + " OR ".join(f"contains(k, '{w}')" for w in T.CONSUMABLE_PART_KEYWORDS) + " AS consumable FROM n",
)
def q_consumable_flag(spark, sf):
    return shape(spark, sf, "quote_parts").select("estimate_id", "no", T.consumable_flag(F.col("part_official_name")).alias("consumable"))


@register(
    "infer_system",
    CTE + ", " + SYM_SQL + " SELECT estimate_id, symptom_no, unnest(systems) AS system FROM symv",
)
def q_infer_system(spark, sf):
    s = _symptoms(spark, sf, {})
    return s.select("estimate_id", "symptom_no", F.explode(R.infer_systems(F.col("symptom_text"))).alias("system"))


@register(
    "trigram_similarity",
    CTE + ", t AS (SELECT id, " + TRIG.format(x="symptom_text") + " AS a, " + TRIG.format(x="evidence_text") + " AS b FROM repair_doc) "
    "SELECT id, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS similarity FROM t",
)
def q_trigram_similarity(spark, sf):
    d = _docs(spark, sf, {})
    return d.select("id", F.round(trigram_similarity(F.col("symptom_text"), F.col("evidence_text")), 6).alias("similarity"))


@register(
    "unique_docs",
    CTE + ", r AS (SELECT id, document_source, CASE WHEN id % 9 = 0 THEN 'common' ELSE vehicle_model END AS vehicle_model, "
    "CASE WHEN id % 9 = 0 THEN 'same' ELSE symptom_text END AS symptom_text, system_category, CASE WHEN id % 9 = 0 THEN 'p' ELSE repair_parts END AS repair_parts, "
    "CASE WHEN id % 9 = 0 THEN 'e' ELSE evidence_text END AS evidence_text FROM repair_doc) "
    "SELECT min(id) AS id, vehicle_model, symptom_text, repair_parts, CAST(length(evidence_text) AS INTEGER) AS evidence_len FROM r "
    "GROUP BY vehicle_model, symptom_text, repair_parts, evidence_text",
)
def q_unique_docs(spark, sf):
    d = _docs(spark, sf, {})
    dup = F.col("id") % 9 == 0
    r = d.select(
        "id", "document_source",
        F.when(dup, F.lit("common")).otherwise(F.col("vehicle_model")).alias("vehicle_model"),
        F.when(dup, F.lit("same")).otherwise(F.col("symptom_text")).alias("symptom_text"),
        "system_category",
        F.when(dup, F.lit("p")).otherwise(F.col("repair_parts")).alias("repair_parts"),
        F.when(dup, F.lit("e")).otherwise(F.col("evidence_text")).alias("evidence_text"),
    )
    return unique_docs(r).select("id", "vehicle_model", "symptom_text", "repair_parts", F.length("evidence_text").alias("evidence_len"))


@register(
    "unseen_only",
    "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def q_unseen_only(spark, sf):
    """Items whose id was already seen (labelled) are skipped - a left anti join."""
    d = read_table(spark, sf, "documents").select("doc_id", "source")
    seen = read_table(spark, sf, "labels").select("doc_id")
    return d.join(seen, "doc_id", "left_anti")


# --- retrieval lists ------------------------------------------------------------------------------------------


@register(
    "retrieval_scope",
    CTE + ", " + SYM_SQL + " SELECT s.estimate_id, s.symptom_no, count(d.id) AS n_docs FROM symv s LEFT JOIN repair_doc d "
    "ON d.vehicle_model = s.vehicle_model AND (len(s.systems) = 0 OR list_contains(s.systems, d.system_category)) GROUP BY 1, 2",
)
def q_retrieval_scope(spark, sf):
    """F7 as counts: per symptom, documents in scope (model and inferred systems) -
    documents are counted per (model, system) first, so no symptom x doc rows form."""
    cache: dict = {}
    docs = _docs(spark, sf, cache)
    s = _symptoms(spark, sf, cache).withColumn("systems", R.infer_systems(F.col("symptom_text")))
    per = docs.groupBy("vehicle_model", "system_category").agg(F.count(F.lit(1)).alias("n"))
    any_sys = s.where(F.size("systems") == 0).join(per, "vehicle_model", "left").groupBy("estimate_id", "symptom_no").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs")
    )
    with_sys = (
        s.where(F.size("systems") > 0).select("estimate_id", "symptom_no", "vehicle_model", F.explode("systems").alias("system_category"))
        .join(per, ["vehicle_model", "system_category"], "left")
        .groupBy("estimate_id", "symptom_no").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))
    )
    return any_sys.unionByName(with_sys).select("estimate_id", "symptom_no", F.col("n_docs").cast("long").alias("n_docs"))


@register(
    "cosine_topk",
    retrieval_sql((1,)) + "SELECT qid, doc_id, round(score, 6) AS score FROM vl WHERE rank <= 3",
)
def q_cosine_topk(spark, sf):
    cache: dict = {}
    queries = R.pass_queries(_symptoms(spark, sf, cache), (1,))
    return R.vector_list(queries, R.vector_index(_docs(spark, sf, cache)), 3).select("qid", "doc_id", F.round("score", 6).alias("score"))


@register("topk_vector", retrieval_sql((1,)) + "SELECT qid, doc_id, round(score, 6) AS score, rank FROM vl")
def q_topk_vector(spark, sf):
    cache: dict = {}
    queries = R.pass_queries(_symptoms(spark, sf, cache), (1,))
    v = R.vector_list(queries, R.vector_index(_docs(spark, sf, cache)), 80)
    return v.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("rank_positions", retrieval_sql((1,)) + "SELECT qid, doc_id, rank FROM ll")
def q_rank_positions(spark, sf):
    _, _, lex, _ = _hybrid_pipeline(spark, sf, (1,))
    return lex.select("qid", "doc_id", "rank")


@register("topk_lexical", retrieval_sql((1,)) + "SELECT qid, doc_id, round(score, 6) AS score, rank FROM ll")
def q_topk_lexical(spark, sf):
    """K1 with the full lexical score (cover density + trigram)."""
    cache: dict = {}
    queries = R.pass_queries(_symptoms(spark, sf, cache), (1,))
    return R.lexical_list(queries, R.lexical_index(_texts(spark, sf, cache)), 80).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@register("lexical_score", retrieval_sql((1,)) + "SELECT qid, doc_id, round(score, 6) AS score FROM ll WHERE rank <= 5")
def q_lexical_score(spark, sf):
    """R2: full lexical scores of the top 5 documents per symptom."""
    cache: dict = {}
    queries = R.pass_queries(_symptoms(spark, sf, cache), (1,))
    return R.lexical_list(queries, R.lexical_index(_texts(spark, sf, cache)), 5).select("qid", "doc_id", F.round("score", 6).alias("score"))


@register(
    "rrf",
    retrieval_sql((1,)) + "SELECT qid, doc_id, round(vector_rrf, 9) AS vector_rrf, round(lexical_rrf, 9) AS lexical_rrf, round(score, 9) AS score FROM fu",
)
def q_rrf(spark, sf):
    *_, fused = _hybrid_pipeline(spark, sf, (1,))
    return fused.select("qid", "doc_id", F.round("vector_rrf", 9).alias("vector_rrf"), F.round("lexical_rrf", 9).alias("lexical_rrf"), F.round("score", 9).alias("score"))


@register("fuse_rankings", retrieval_sql((1,)) + "SELECT qid, doc_id, vrank, lrank FROM fu")
def q_fuse_rankings(spark, sf):
    *_, fused = _hybrid_pipeline(spark, sf, (1,))
    return fused.select("qid", "doc_id", "vrank", "lrank")


@register("topk_fused", retrieval_sql((1,)) + "SELECT qid, doc_id, fused_rank FROM fu")
def q_topk_fused(spark, sf):
    *_, fused = _hybrid_pipeline(spark, sf, (1,))
    return fused.select("qid", "doc_id", "fused_rank")


@register(
    "keyword_boost",
    retrieval_sql((1,)) + ", kq AS (SELECT qid, list_distinct(" + KW.format(x="query_text") + ") AS kws FROM q) "
    "SELECT f.qid, f.doc_id, CAST(len(list_filter(kq.kws, lambda k: contains(" + NS.format(x="coalesce(d.symptom_text, '')") + ", k))) AS INTEGER) AS keyword_hits "
    "FROM fu f JOIN kq ON kq.qid = f.qid JOIN repair_doc d ON d.id = f.doc_id",
)
def q_keyword_boost(spark, sf):
    cache: dict = {}
    queries, _, _, fused = _hybrid_pipeline(spark, sf, (1,))
    docs = _texts(spark, sf, cache).select(F.col("id").alias("doc_id"), F.col("symptom_text").alias("doc_symptom_text"))
    return fused.join(queries.select("qid", "query_text"), "qid").join(R.named_docs(docs, fused), "doc_id").select(
        "qid", "doc_id", R.keyword_hits(F.col("query_text"), F.col("doc_symptom_text")).alias("keyword_hits")
    )


# --- validation and passes ----------------------------------------------------------------------------------------

VAL_SQL = (
    "val AS (SELECT f.qid, f.doc_id, f.score, f.fused_rank, q.estimate_id, q.symptom_no, q.pass, "
    "CAST((q.estimate_id * 7 + q.symptom_no * 13 + f.doc_id * 31) % 100 AS DOUBLE) / 100 - CASE WHEN q.estimate_id % 4 = q.pass - 1 THEN 0.0 ELSE 0.3 END AS similarity_score, "
    "(f.doc_id % 4 <> 1) AS ext_keep FROM fu f JOIN q ON q.qid = f.qid), "
    "att AS (SELECT *, ext_keep AND similarity_score >= 0.72 AS keep FROM val), "
    "kept AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity_score DESC, score DESC, fused_rank) AS INTEGER) AS kept_rank "
    "FROM att WHERE keep) WHERE kept_rank <= 5), "
    "st AS (SELECT q.qid, q.estimate_id, q.symptom_no, q.pass, (SELECT count(*) FROM fu WHERE fu.qid = q.qid) AS candidate_count, "
    "(SELECT count(*) FROM kept WHERE kept.qid = q.qid) AS kept_count, coalesce((SELECT avg(similarity_score) FROM kept WHERE kept.qid = q.qid), 0.0) AS avg_similarity_score FROM q), "
    "st2 AS (SELECT *, kept_count >= 2 AND avg_similarity_score >= 0.65 AS ok FROM st), "
    "ch AS (SELECT estimate_id, symptom_no, coalesce(min(pass) FILTER (WHERE ok), max(pass)) AS chosen_pass, bool_or(ok) AS satisfied FROM st2 GROUP BY 1, 2) "
)


def _iterated(spark, sf):
    cache: dict = {}
    sym = _symptoms(spark, sf, cache)
    return R.iterative_passes(sym, _docs(spark, sf, cache), _validation(R.pass_queries(sym)), texts=_texts(spark, sf, cache))


def _passes_pipeline(spark, sf):
    queries, vec, lex, fused = _hybrid_pipeline(spark, sf, (1, 2, 3))
    val = _validation(queries)(fused)
    return queries, fused, val


@register(
    "attach_validation",
    retrieval_sql() + ", " + VAL_SQL + " SELECT qid, doc_id, round(similarity_score, 6) AS similarity_score, keep FROM att",
)
def q_attach_validation(spark, sf):
    queries, fused, val = _passes_pipeline(spark, sf)
    return R.attach_validation(fused, val).select("qid", "doc_id", F.round("similarity_score", 6).alias("similarity_score"), "keep")


@register(
    "keep_rule",
    retrieval_sql() + ", " + VAL_SQL + " SELECT qid, count(*) FILTER (WHERE keep) AS n_keep, count(*) FILTER (WHERE ext_keep AND NOT keep) AS n_below_cutoff FROM att GROUP BY qid",
)
def q_keep_rule(spark, sf):
    queries, fused, val = _passes_pipeline(spark, sf)
    a = R.attach_validation(fused, val).join(val.select("qid", "doc_id", F.col("keep").alias("ext_keep")), ["qid", "doc_id"])
    return a.groupBy("qid").agg(
        F.count(F.when(F.col("keep"), 1)).alias("n_keep"), F.count(F.when(F.col("ext_keep") & ~F.col("keep"), 1)).alias("n_below_cutoff")
    )


@register("kept_order", retrieval_sql() + ", " + VAL_SQL + " SELECT qid, doc_id, kept_rank FROM kept")
def q_kept_order(spark, sf):
    queries, fused, val = _passes_pipeline(spark, sf)
    a = R.attach_validation(fused, val)
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy(F.col("similarity_score").desc(), F.col("score").desc(), F.col("fused_rank"))
    return a.where("keep").withColumn("kept_rank", F.row_number().over(w)).where(F.col("kept_rank") <= R.MAX_KEEP).select("qid", "doc_id", "kept_rank")


@register(
    "validation_stats",
    retrieval_sql() + ", " + VAL_SQL + " SELECT qid, candidate_count, kept_count, round(avg_similarity_score, 6) AS avg_similarity_score FROM st",
)
def q_validation_stats(spark, sf):
    queries, fused, val = _passes_pipeline(spark, sf)
    stats, _ = R.select_pass(fused, queries, val)
    return stats.select("qid", "candidate_count", "kept_count", F.round("avg_similarity_score", 6).alias("avg_similarity_score"))


@register(
    "iterative_retrieval",
    retrieval_sql() + ", " + VAL_SQL + " SELECT estimate_id, symptom_no, chosen_pass, satisfied FROM ch",
)
def q_iterative_retrieval(spark, sf):
    """R6 over its frontier: a pass runs only for symptoms that the one before left open."""
    passes = _iterated(spark, sf)["passes"]
    return passes.where("pass = chosen_pass").select("estimate_id", "symptom_no", "chosen_pass", "satisfied")


@register(
    "pass_frontier",
    retrieval_sql() + ", " + VAL_SQL + " SELECT p.pass, count(*) AS n_symptoms, count(*) FILTER (WHERE ch.chosen_pass = p.pass AND ch.satisfied) AS n_satisfied "
    "FROM ch JOIN (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS pass) p ON p.pass <= ch.chosen_pass GROUP BY p.pass",
)
def q_pass_frontier(spark, sf):
    """How many symptoms each pass retrieved for, and how many it satisfied."""
    return _iterated(spark, sf)["passes"].groupBy("pass").agg(
        F.count(F.lit(1)).alias("n_symptoms"), F.count(F.when(F.col("satisfied") & (F.col("pass") == F.col("chosen_pass")), 1)).alias("n_satisfied")
    )


@register(
    "no_validator_path",
    retrieval_sql((1,)) + " SELECT qid, doc_id, fused_rank AS kept_rank FROM fu WHERE fused_rank <= 5",
)
def q_no_validator_path(spark, sf):
    queries, vec, lex, fused = _hybrid_pipeline(spark, sf, (1,))
    _, kept = R.select_pass(fused, queries, None)
    return kept.select("qid", "doc_id", "kept_rank")


# --- per-symptom diagnosis -----------------------------------------

DIAG_SQL = (
    ", merged AS (SELECT k.estimate_id, k.symptom_no, k.doc_id, k.score, k.similarity_score, k.kept_rank, false AS is_fallback FROM kept k "
    "JOIN ch ON ch.estimate_id = k.estimate_id AND ch.symptom_no = k.symptom_no AND ch.chosen_pass = k.pass), "
    "vl20 AS (SELECT * FROM vl WHERE rank <= 20 AND ends_with(qid, '|1')), ll20 AS (SELECT * FROM ll WHERE rank <= 20 AND ends_with(qid, '|1')), "
    "fb0 AS (SELECT coalesce(v.qid, l.qid) AS qid, coalesce(v.doc_id, l.doc_id) AS doc_id, v.rank AS vrank, l.rank AS lrank, "
    "CASE WHEN v.rank IS NOT NULL THEN 1.0 / (60.0 + v.rank) ELSE 0.0 END + CASE WHEN l.rank IS NOT NULL THEN 1.0 / (60.0 + l.rank) ELSE 0.0 END AS score "
    "FROM vl20 v FULL OUTER JOIN ll20 l ON v.qid = l.qid AND v.doc_id = l.doc_id), "
    "fb AS (SELECT q.estimate_id, q.symptom_no, f.doc_id, f.score, 0.0 AS similarity_score, f.kept_rank, true AS is_fallback FROM "
    "(SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(vrank, lrank + 20)) AS INTEGER) AS kept_rank FROM fb0) f JOIN q ON q.qid = f.qid "
    "WHERE f.kept_rank <= 5 AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.estimate_id = q.estimate_id AND m.symptom_no = q.symptom_no)), "
    "md AS (SELECT * FROM merged UNION ALL SELECT * FROM fb), "
    "ev AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY estimate_id, symptom_no ORDER BY kept_rank) AS INTEGER) AS evidence_no FROM md WHERE score >= 0.02) WHERE evidence_no <= 3), "
    "cnt AS (SELECT s.estimate_id, s.symptom_no, "
    "coalesce(sum(st2.candidate_count) FILTER (WHERE st2.pass <= least(ch.chosen_pass, 2)), 0) AS used_model_docs, "
    "coalesce(sum(st2.candidate_count) FILTER (WHERE st2.pass = 3 AND ch.chosen_pass = 3), 0) AS used_common_docs "
    "FROM symv s JOIN ch ON ch.estimate_id = s.estimate_id AND ch.symptom_no = s.symptom_no "
    "JOIN st2 ON st2.estimate_id = s.estimate_id AND st2.symptom_no = s.symptom_no GROUP BY 1, 2), "
    "dm AS (SELECT m.estimate_id, m.symptom_no, count(*) FILTER (WHERE len(list_filter(" + KW.format(x="s.symptom_text")
    + ", lambda k: contains(concat(coalesce(d.symptom_text, ''), ' ', coalesce(d.evidence_text, '')), k))) > 0) AS direct_match_count "
    "FROM merged m JOIN symv s ON s.estimate_id = m.estimate_id AND s.symptom_no = m.symptom_no JOIN repair_doc d ON d.id = m.doc_id GROUP BY 1, 2), "
    "ps AS (SELECT s.estimate_id, s.symptom_no, s.symptom_text, s.vehicle_model, array_to_string(s.systems, ',') AS inferred_systems, "
    "CASE WHEN ch.satisfied THEN 'ok' ELSE 'insufficient_evidence' END AS match_status, ch.chosen_pass, "
    "CAST(c.used_model_docs AS BIGINT) AS used_model_docs, CAST(c.used_common_docs AS BIGINT) AS used_common_docs, "
    "CAST(coalesce(dm.direct_match_count, 0) AS BIGINT) AS direct_match_count, "
    "CAST((SELECT count(*) FROM ev WHERE ev.estimate_id = s.estimate_id AND ev.symptom_no = s.symptom_no) AS BIGINT) AS n_evidence "
    "FROM symv s JOIN ch ON ch.estimate_id = s.estimate_id AND ch.symptom_no = s.symptom_no "
    "JOIN cnt c ON c.estimate_id = s.estimate_id AND c.symptom_no = s.symptom_no "
    "LEFT JOIN dm ON dm.estimate_id = s.estimate_id AND dm.symptom_no = s.symptom_no) "
)


def _diagnosis(spark, sf):
    cache: dict = {}
    docs = _docs(spark, sf, cache)
    sym = _symptoms(spark, sf, cache)
    queries = R.pass_queries(sym, (1, 2, 3))
    out = R.diagnose_symptoms(sym, docs, _validation(queries), texts=_texts(spark, sf, cache))
    return out, cache


@register("evidence_floor", retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + " SELECT estimate_id, symptom_no, doc_id, evidence_no, is_fallback FROM ev")
def q_evidence_floor(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return out["evidence"].select("estimate_id", "symptom_no", "doc_id", "evidence_no", "is_fallback")


@register("fallback_retrieval", retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + " SELECT estimate_id, symptom_no, doc_id, kept_rank FROM md WHERE is_fallback")
def q_fallback_retrieval(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return out["match_docs"].where("is_fallback").select("estimate_id", "symptom_no", "doc_id", "kept_rank")


@register(
    "direct_match_count",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + " SELECT estimate_id, symptom_no, direct_match_count FROM ps",
)
def q_direct_match_count(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return out["symptoms"].select("estimate_id", "symptom_no", "direct_match_count")


@register(
    "symptom_diagnosis",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + " SELECT * FROM ps",
)
def q_symptom_diagnosis(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return out["symptoms"]


@register(
    "evidence_scope",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + " SELECT estimate_id, CASE WHEN sum(used_model_docs) > 0 AND sum(used_common_docs) > 0 THEN 'hyundai_model_pdf_plus_common' "
    "WHEN sum(used_model_docs) > 0 THEN 'hyundai_model_pdf_only' WHEN sum(used_common_docs) > 0 THEN 'common_only' ELSE 'no_evidence' END AS evidence_scope FROM ps GROUP BY estimate_id",
)
def q_evidence_scope(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return R.evidence_scope(out["symptoms"])


@register(
    "quote_part_list",
    shape_cte("quote_parts") + " SELECT estimate_id, " + NS.format(x="coalesce(part_official_name, '')") + " AS part, min(no) AS first_no FROM quote_parts "
    "WHERE length(" + NS.format(x="coalesce(part_official_name, '')") + ") > 0 GROUP BY 1, 2",
)
def q_quote_part_list(spark, sf):
    return R.quote_part_list(shape(spark, sf, "quote_parts"))


@register(
    "unrelated_parts",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL
    + ", qp AS (SELECT estimate_id, " + NS.format(x="coalesce(part_official_name, '')") + " AS part, min(no) AS first_no FROM quote_parts "
    "WHERE length(" + NS.format(x="coalesce(part_official_name, '')") + ") > 0 GROUP BY 1, 2), "
    "ok_est AS (SELECT estimate_id FROM ps GROUP BY estimate_id HAVING min(n_evidence) > 0), "
    "qk AS (SELECT qp.*, regexp_replace(lower(part), '[\\s_\\-/(),.]+', '', 'g') AS k FROM qp JOIN ok_est USING (estimate_id)), "
    "qk2 AS (SELECT * FROM qk WHERE length(k) > 0 AND NOT (" + " OR ".join(f"contains(k, '{w}')" for w in T.CONSUMABLE_PART_KEYWORDS) + ")), "
    "ex0 AS (SELECT md.estimate_id, " + NS.format(x="p") + " AS ep FROM (SELECT md.estimate_id, unnest(string_split_regex(coalesce(d.repair_parts, ''), '[,/|\\n]+')) AS p "
    "FROM md JOIN repair_doc d ON d.id = md.doc_id) md), "
    "ex AS (SELECT DISTINCT estimate_id, regexp_replace(lower(ep), '[\\s_\\-/(),.]+', '', 'g') AS ek FROM ex0 WHERE length(ep) > 0) "
    "SELECT q.estimate_id, q.part, q.first_no FROM qk2 q WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.estimate_id = q.estimate_id "
    "AND length(ex.ek) > 0 AND (contains(q.k, ex.ek) OR contains(ex.ek, q.k)))",
)
def q_unrelated_parts(spark, sf):
    out, cache = _diagnosis(spark, sf)
    qp = R.quote_part_list(shape(spark, sf, "quote_parts", cache))
    return R.unrelated_parts(qp, out["symptoms"], out["match_docs"])


# --- evidence texts -------------------------------------------------------------------------------------

SRC_LABEL_SQL = (
    "CASE " + NS.format(x="coalesce({c}, '')") + " WHEN 'hyundai_model_pdf' THEN '현대 차종 정비지침' WHEN 'common' THEN '일반 정비 지침' "
    "ELSE CASE WHEN length(" + NS.format(x="coalesce({c}, '')") + ") > 0 THEN " + NS.format(x="coalesce({c}, '')") + " ELSE '문서 근거' END END"
)
EVJ_SQL = ", evd AS (SELECT ev.*, d.document_source, d.system_category, d.repair_parts, d.evidence_text, d.symptom_text AS doc_symptom_text FROM ev JOIN repair_doc d ON d.id = ev.doc_id) "


@register(
    "evidence_rows",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + EVJ_SQL
    + ", x AS (SELECT e.*, s.symptom_text AS rs, " + SRC_LABEL_SQL.format(c="e.document_source") + " AS lbl, "
    + NS.format(x="coalesce(e.system_category, '')") + " AS cat, " + NS.format(x="coalesce(e.repair_parts, '')") + " AS rp, "
    + "CASE WHEN length(" + NS.format(x="coalesce(e.evidence_text, '')") + ") <= 120 THEN " + NS.format(x="coalesce(e.evidence_text, '')")
    + " ELSE concat(rtrim(substr(" + NS.format(x="coalesce(e.evidence_text, '')") + ", 1, 119)), '…') END AS ex "
    "FROM evd e JOIN symv s ON s.estimate_id = e.estimate_id AND s.symptom_no = e.symptom_no) "
    "SELECT estimate_id, symptom_no, evidence_no, concat('증상', CAST(symptom_no AS VARCHAR), '-근거', CAST(evidence_no AS VARCHAR)) AS tag, "
    + NS.format(x="rs") + " AS related_symptom, " + NS.format(x="coalesce(document_source, '')") + " AS source_code, lbl AS source_label, "
    "cat AS system_category, doc_id, " + NS.format(x="coalesce(doc_symptom_text, '')") + " AS document_symptom_text, rp AS repair_parts, ex AS evidence_excerpt, "
    "concat(CASE WHEN length(ex) > 0 THEN ex ELSE '관련 근거 문구 요약 없음' END, CASE WHEN length(rp) > 0 THEN concat(' (예상 정비항목: ', rp, ')') ELSE '' END) AS description, "
    "concat(" + NS.format(x="rs") + ", ' 증상 판단에 참고한 ', lbl, CASE WHEN length(cat) > 0 THEN concat(' (', cat, ')') ELSE '' END, ' 문서 근거입니다.') AS why_used FROM x",
)
def q_evidence_rows(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return R.evidence_rows(out["evidence"], out["symptoms"])


@register(
    "report_evidence_rows",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + EVJ_SQL
    + "SELECT e.estimate_id, e.symptom_no, e.evidence_no, s.symptom_text, coalesce(e.document_source, '') AS document_source, "
    "CASE WHEN length(coalesce(e.evidence_text, '')) > 70 THEN concat(substr(e.evidence_text, 1, 70), '…') ELSE coalesce(e.evidence_text, '') END AS evidence_short "
    "FROM evd e JOIN symv s ON s.estimate_id = e.estimate_id AND s.symptom_no = e.symptom_no WHERE e.evidence_no <= 2",
)
def q_report_evidence_rows(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return R.report_evidence_rows(out["evidence"], out["symptoms"])


@register(
    "evidence_prompt",
    retrieval_sql() + ", " + VAL_SQL + DIAG_SQL + EVJ_SQL
    + ", ln AS (SELECT estimate_id, symptom_no, string_agg(concat('[', CAST(evidence_no AS VARCHAR), '] source=', coalesce(document_source, ''), ' (', "
    + SRC_LABEL_SQL.format(c="document_source") + ", ') score=', printf('%.4f', score), ' | system=', coalesce(system_category, ''), "
    "' | expected=', coalesce(repair_parts, ''), ' | evidence=', coalesce(evidence_text, '')), chr(10) ORDER BY evidence_no) AS lines FROM evd GROUP BY 1, 2), "
    "bl AS (SELECT p.estimate_id, p.symptom_no, concat('증상', CAST(p.symptom_no AS VARCHAR), ': ', p.symptom_text, chr(10), '직접매칭수: ', "
    "CAST(p.direct_match_count AS VARCHAR), chr(10), '근거:', chr(10), coalesce(ln.lines, '(없음)')) AS block FROM ps p "
    "LEFT JOIN ln ON ln.estimate_id = p.estimate_id AND ln.symptom_no = p.symptom_no) "
    "SELECT estimate_id, string_agg(block, chr(10) || chr(10) ORDER BY symptom_no) AS prompt FROM bl GROUP BY estimate_id",
)
def q_evidence_prompt(spark, sf):
    out, _ = _diagnosis(spark, sf)
    return R.evidence_prompt(out["evidence"], out["symptoms"])


@register(
    "validation_request",
    retrieval_sql((1,))
    + "SELECT f.qid, CAST(to_json(list({'id': d.id, 'candidate_symptom_text': " + NS.format(x="coalesce(d.symptom_text, '')")
    + ", 'evidence_text': " + NS.format(x="coalesce(d.evidence_text, '')") + ", 'system_category': " + NS.format(x="coalesce(d.system_category, '')")
    + ", 'document_source': " + NS.format(x="coalesce(d.document_source, '')") + "} ORDER BY f.fused_rank)) AS VARCHAR) AS request "
    "FROM fu f JOIN repair_doc d ON d.id = f.doc_id GROUP BY f.qid",
)
def q_validation_request(spark, sf):
    queries, vec, lex, fused = _hybrid_pipeline(spark, sf, (1,))
    return R.validation_request(fused, _texts(spark, sf, {}))
