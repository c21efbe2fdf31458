"""Symptom -> repair-document retrieval for all symptoms at once.

Inputs
* ``docs`` (repair documents): id, document_source, vehicle_model, symptom_text,
  system_category, repair_parts, evidence_text, symptom_embedding (array<float>)
* ``symptoms``: estimate_id, symptom_no, symptom_text, vehicle_model, qvec (array<float>)
* ``validation`` (optional external scores): qid, doc_id, similarity_score, keep

Plan
* vector (R1/K2) and lexical (R2/K1) lists are exact per-query top-k over block indexes
  (:mod:`pricelens.operators.blocks`), keyed by vehicle model and system; an index is built
  once and read by every pass; blocks that can't hold a result are not scored.
* R6 runs its passes over a frontier: pass n retrieves only for symptoms that pass n-1 left
  unsatisfied, each pass with its own text and vector.
* fusion (R4/J8) is a full outer join of the two lists per (query, doc), ranks from
  ``row_number``; every later step is joins and aggregates keyed by symptom.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.text import compact_query, consumable_flag, extract_keywords, fill_template, norm_part, norm_space, split_parts
from pricelens.operators.blocks import DOCS_PER_BLOCK, DOCS_PER_GROUP, BlockIndex, bounded_topk, build_index
from pricelens.operators.postings import LexicalBlocks, VectorBlocks
from pricelens.session import cut_lineage, stored

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
SYSTEM_KEYWORD_RULES = {
    "엔진": ["엔진", "부조", "노킹", "진동", "소음", "터보", "부스트"],
    "점화": ["점화", "코일", "플러그", "미스파이어", "실화"],
    "연료": ["연료", "인젝터", "펌프", "연비", "시동지연"],
    "냉각": ["냉각", "수온", "과열", "냉각수", "라디에이터"],
    "배기": ["배기", "매니폴드", "촉매", "머플러", "매연"],
    "제동": ["브레이크", "제동", "abs", "패드", "디스크"],
    "공조": ["에어컨", "히터", "송풍", "냉방", "공조"],
    "변속기": ["변속", "미션", "기어", "변속충격", "슬립"],
    "전기충전": ["배터리", "충전", "알터네이터", "발전기", "전압", "크랭킹"],
    "조향현가": ["핸들", "조향", "현가", "하체", "쇼크", "얼라인먼트", "쏠림"],
    "시동 시스템": ["시동모터", "스타터"],
    "바디전장": ["도어", "창문", "와이퍼", "등화", "계기판", "스마트키"],
}
COMMON_MODEL = "common"
RRF_K = 60.0
TOP_K = 20
FETCH_FACTOR = 4
LEX_W_COVER, LEX_W_TRIGRAM = 0.7, 0.3
KEEP_CUTOFF = 0.72
MIN_KEEP, MAX_KEEP = 2, 5
MIN_AVG_SCORE = 0.65
MIN_EVIDENCE_SCORE = 0.02
EVIDENCE_PER_SYMPTOM = 3
FALLBACK_TOP_K = 5
MODEL_PHASE_PASSES = 2
STATUS_OK, STATUS_INSUFFICIENT = "ok", "insufficient_evidence"
SCOPE_BOTH = "hyundai_model_pdf_plus_common"
SCOPE_MODEL = "hyundai_model_pdf_only"
SCOPE_COMMON = "common_only"
SCOPE_NONE = "no_evidence"
REPORT_EVIDENCE_DOCS = 2
REPORT_EXCERPT_LEN = 70


# --- scalar helpers ---------------------------------------------------------------------

def infer_systems(symptom_text: Column) -> Column:
    """Names of the systems whose keywords occur in the lower-cased symptom (rule order)."""
    t = F.lower(norm_space(symptom_text))
    hits = []
    for name, kws in SYSTEM_KEYWORD_RULES.items():
        cond = F.lit(False)
        for k in kws:
            cond = cond | t.contains(k.lower())
        hits.append(F.when(cond, F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def keyword_hits(query_text: Column, doc_symptom_text: Column) -> Column:
    """Distinct query keywords found in the document's symptom text."""
    hay = norm_space(doc_symptom_text)
    return F.size(F.filter(F.array_distinct(extract_keywords(query_text)), lambda k: F.instr(hay, k) > 0))


def in_scope(doc_model: Column, doc_system: Column, model: Column, systems: Column) -> Column:
    """same vehicle model and, when systems were inferred, a listed system."""
    return (doc_model == model) & ((F.size(systems) == 0) | F.array_contains(systems, doc_system))


# --- lists ------------------------------------------------------------------------------------

def lexical_index(docs: DataFrame, w_cover: float = LEX_W_COVER, w_trigram: float = LEX_W_TRIGRAM,
                  docs_per_group: int = DOCS_PER_GROUP, docs_per_block: int = DOCS_PER_BLOCK) -> BlockIndex:
    """Postings of the documents' trigrams and tokens by block, stored."""
    rows = docs.select(
        F.col("id").cast("long").alias("doc_id"), F.col("vehicle_model").alias("scope"), F.col("system_category").alias("system"),
        F.coalesce("symptom_text", F.lit("")).alias("symptom_text"), F.coalesce("evidence_text", F.lit("")).alias("evidence_text"),
    )
    return build_index(rows, LexicalBlocks(w_cover, w_trigram), docs_per_group, docs_per_block)


def vector_index(docs: DataFrame, docs_per_group: int = DOCS_PER_GROUP, docs_per_block: int = DOCS_PER_BLOCK) -> BlockIndex:
    """The documents' vectors in blocks of near ones, stored."""
    rows = docs.select(
        F.col("id").cast("long").alias("doc_id"), F.col("vehicle_model").alias("scope"), F.col("system_category").alias("system"),
        F.col("symptom_embedding").alias("embedding"),
    )
    return build_index(rows, VectorBlocks(), docs_per_group, docs_per_block)


def vector_list(queries: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """K2: top-k documents by cosine similarity, null scores last, id tie-break."""
    return bounded_topk(queries, index, k)


def lexical_list(queries: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """K1: top-k documents by lexical score (zero scores admitted), id tie-break."""
    return bounded_topk(queries, index, k)


def fuse_rankings(vec: DataFrame, lex: DataFrame, top_k: int, fetch_k: int) -> DataFrame:
    """J8 + R4 + K3: reciprocal-rank fusion of two ranked lists, top_k per query.

    Order: fused score desc, then first appearance (vector rank, then lexical rank) -
    the stable sort of a list built vector-first."""
    v = vec.select("qid", "doc_id", F.col("rank").alias("vrank"), F.col("score").alias("vector_score"))
    lx = lex.select("qid", "doc_id", F.col("rank").alias("lrank"), F.col("score").alias("lexical_score"))
    j = v.join(lx, ["qid", "doc_id"], "full_outer")
    rv = F.when(F.col("vrank").isNotNull(), 1.0 / (RRF_K + F.col("vrank"))).otherwise(F.lit(0.0))
    rl = F.when(F.col("lrank").isNotNull(), 1.0 / (RRF_K + F.col("lrank"))).otherwise(F.lit(0.0))
    j = j.withColumn("vector_rrf", rv).withColumn("lexical_rrf", rl).withColumn("score", rv + rl)
    appear = F.coalesce(F.col("vrank"), F.col("lrank") + F.lit(fetch_k))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), appear.asc())
    return j.withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= top_k)


def pass_queries(symptoms: DataFrame, passes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One query row per (symptom, pass): pass 1 model + symptom, pass 2 model + compacted
    query, pass 3 common documents + symptom.  ``qid`` = '<estimate>|<symptom>|<pass>'.  Each
    pass has the vector of its own text: ``qvec`` of the symptom, ``compact_qvec`` (if that
    column is given) of the compacted one."""
    compact_vector = "compact_qvec" if "compact_qvec" in symptoms.columns else "qvec"
    base = symptoms.select(
        "estimate_id", "symptom_no", "vehicle_model", "qvec", F.col(compact_vector).alias("compact_qvec"),
        norm_space(F.col("symptom_text")).alias("symptom_text"),
    ).withColumn("systems", infer_systems(F.col("symptom_text")))
    rows = []
    for p in passes:
        text = compact_query(F.col("symptom_text")) if p == 2 else F.col("symptom_text")
        scope = F.lit(COMMON_MODEL) if p > MODEL_PHASE_PASSES else F.col("vehicle_model")
        vector = F.col("compact_qvec") if p == 2 else F.col("qvec")
        rows.append(base.select("estimate_id", "symptom_no", "systems", vector.alias("qvec"), F.lit(p).alias("pass"),
                                scope.alias("scope"), text.alias("query_text"), F.col("symptom_text")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn(
        "qid", F.concat_ws("|", F.col("estimate_id").cast("string"), F.col("symptom_no").cast("string"), F.col("pass").cast("string"))
    )


def hybrid_lists(queries: DataFrame, docs: DataFrame, fetch_k: int, w_cover: float = LEX_W_COVER,
                 w_trigram: float = LEX_W_TRIGRAM, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vector and lexical top-``fetch_k`` lists for every query row.  ``texts``: the same
    documents, if they can be had at less cost where no vector is read."""
    vec = vector_list(queries, vector_index(docs), fetch_k)
    return vec, lexical_list(queries, lexical_index(docs if texts is None else texts, w_cover, w_trigram), fetch_k)


def hybrid_candidates(queries: DataFrame, docs: DataFrame, top_k: int = TOP_K, w_cover: float = LEX_W_COVER,
                      w_trigram: float = LEX_W_TRIGRAM) -> DataFrame:
    """Hybrid retrieval (vector + lexical, fused) for every query row: (qid, doc_id, score, fused_rank, ...)."""
    fetch_k = max(top_k * FETCH_FACTOR, top_k)
    return fuse_rankings(*hybrid_lists(queries, docs, fetch_k, w_cover, w_trigram), top_k, fetch_k)


def attach_validation(cands: DataFrame, validation: DataFrame, keep_cutoff: float = KEEP_CUTOFF) -> DataFrame:
    """J9 + R7: candidates with external scores; missing -> 0.0 / not kept; keep needs the
    external flag and a score >= cutoff."""
    v = validation.select("qid", "doc_id", F.col("similarity_score").cast("double").alias("_sim"), F.col("keep").alias("_keep"))
    return (
        cands.join(v, ["qid", "doc_id"], "left")
        .withColumn("similarity_score", F.coalesce("_sim", F.lit(0.0)))
        .withColumn("keep", F.coalesce(F.col("_keep"), F.lit(False)) & (F.col("similarity_score") >= keep_cutoff))
        .drop("_sim", "_keep")
    )


def select_pass(cands: DataFrame, queries: DataFrame, validation: DataFrame | None,
                max_keep: int = MAX_KEEP, min_keep: int = MIN_KEEP, min_avg: float = MIN_AVG_SCORE) -> tuple[DataFrame, DataFrame]:
    """Per symptom, the first pass with >= min_keep kept docs and avg similarity >=
    min_avg, else the last pass run.  Returns (per-pass stats, kept docs of the chosen pass)."""
    qkeys = queries.select("qid", "estimate_id", "symptom_no", "pass")
    counts = cands.groupBy("qid").agg(F.count(F.lit(1)).alias("candidate_count"))
    if validation is None:
        scored = cands.withColumn("similarity_score", F.lit(0.0)).withColumn("keep", F.lit(True))
        order = [F.col("fused_rank").asc()]
    else:
        scored = attach_validation(cands, validation)
        order = [F.col("similarity_score").desc(), F.col("score").desc(), F.col("fused_rank").asc()]
    w = Window.partitionBy("qid").orderBy(*order)
    kept = scored.where(F.col("keep")).withColumn("kept_rank", F.row_number().over(w)).where(F.col("kept_rank") <= max_keep)
    kstats = kept.groupBy("qid").agg(
        F.count(F.lit(1)).alias("kept_count"), F.avg("similarity_score").alias("avg_similarity_score")
    )
    stats = (
        qkeys.join(counts, "qid", "left").join(kstats, "qid", "left")
        .select(
            "qid", "estimate_id", "symptom_no", "pass",
            F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
            F.coalesce("kept_count", F.lit(0)).alias("kept_count"),
            F.coalesce("avg_similarity_score", F.lit(0.0)).alias("avg_similarity_score"),
        )
    )
    if validation is None:
        stats = stats.where(F.col("pass") == 1).withColumn("ok", F.lit(False)).withColumn("avg_similarity_score", F.lit(0.0))
        chosen = stats.select("estimate_id", "symptom_no", F.lit(1).alias("chosen_pass"), F.lit(False).alias("satisfied"))
    else:
        stats = stats.withColumn("ok", (F.col("kept_count") >= min_keep) & (F.col("avg_similarity_score") >= min_avg))
        chosen = stats.groupBy("estimate_id", "symptom_no").agg(
            F.min(F.when(F.col("ok"), F.col("pass"))).alias("_ok_pass"), F.max("pass").alias("_last")
        ).select(
            "estimate_id", "symptom_no",
            F.coalesce("_ok_pass", "_last").alias("chosen_pass"), F.col("_ok_pass").isNotNull().alias("satisfied"),
        )
    stats = stats.join(chosen, ["estimate_id", "symptom_no"]).withColumn("executed", F.col("pass") <= F.col("chosen_pass"))
    kept_chosen = kept.join(qkeys, "qid").join(chosen, ["estimate_id", "symptom_no"]).where(F.col("pass") == F.col("chosen_pass"))
    return stats, kept_chosen


def symptom_rows(inputs: DataFrame, text_col: str = "symptom_text_raw") -> DataFrame:
    """One row per symptom (split on two pipes or newlines), numbered from 1."""
    from pricelens.functions.text import split_symptoms

    return inputs.select(
        *[c for c in inputs.columns if c != text_col],
        F.posexplode(split_symptoms(F.col(text_col))).alias("symptom_no", "symptom_text"),
    ).withColumn("symptom_no", F.col("symptom_no") + 1)


def iterative_passes(symptoms: DataFrame, docs: DataFrame, validation_fn=None, w_cover: float = LEX_W_COVER,
                     w_trigram: float = LEX_W_TRIGRAM, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The retrieval passes, each over the frontier that the pass before left.

    Pass 1 retrieves for every symptom; pass n + 1 only for those without enough kept documents
    after pass n.  Both indexes are built once.  Returns ``queries`` (of executed passes only),
    ``candidates``, ``passes`` (statistics per executed pass), ``kept`` (documents of the chosen
    pass) and the first pass's ``vector`` and ``lexical`` lists.  ``texts``: as for
    :func:`hybrid_lists`."""
    fetch_k = max(TOP_K * FETCH_FACTOR, TOP_K)
    vectors, postings = vector_index(docs), lexical_index(docs if texts is None else texts, w_cover, w_trigram)
    key = ["estimate_id", "symptom_no"]
    frontier = symptoms
    found: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = []
    first = None
    for p in (1,) if validation_fn is None else (1, 2, 3):
        queries = cut_lineage(pass_queries(frontier, (p,)))
        vec = vector_list(queries, vectors, fetch_k)
        lex = lexical_list(queries, postings, fetch_k)
        if p == 1:  # the fallback reads the first lists again
            first = vec, lex
        # at most 20, 1 and 5 small rows per query, each with several readers
        cands = cut_lineage(fuse_rankings(vec, lex, TOP_K, fetch_k))
        stats, kept = select_pass(cands, queries, None if validation_fn is None else validation_fn(cands))
        stats, kept = cut_lineage(stats), cut_lineage(kept)
        found.append((queries, cands, stats, kept))
        frontier = frontier.join(stats.where("satisfied").select(*key), key, "left_anti")
    queries, cands, stats, kept = (reduce(DataFrame.unionByName, x) for x in zip(*found))
    # the chosen pass is the last that ran: the first that is satisfied, or the last of all
    chosen = stats.groupBy(*key).agg(F.max("pass").alias("chosen_pass"), F.max("satisfied").alias("satisfied"))
    stats = cut_lineage(stats.drop("chosen_pass", "satisfied").join(chosen, key))
    kept = kept.drop("chosen_pass", "satisfied").join(chosen, key).where(F.col("pass") == F.col("chosen_pass"))
    return {"queries": queries, "candidates": cands, "passes": stats, "kept": kept, "vector": first[0], "lexical": first[1]}


def named_docs(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` a row of ``hits`` has.  Hits (stored, so that their size
    is known) are a few rows per query: only their documents' texts are shuffled to them."""
    return docs.join(hits.select("doc_id"), "doc_id", "left_semi")


def diagnose_symptoms(symptoms: DataFrame, docs: DataFrame, validation_fn=None, w_cover: float = LEX_W_COVER,
                      w_trigram: float = LEX_W_TRIGRAM, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The per-symptom retrieval diagnosis for all symptoms.

    ``validation_fn(cands) -> DataFrame(qid, doc_id, similarity_score, keep)`` supplies the
    external scores (None = no validator: pass 1 only).  Returns DataFrames:
    ``candidates``, ``passes``, ``symptoms`` (status, counters, direct matches, evidence
    count), ``match_docs``, ``evidence``.  ``texts``: as for :func:`hybrid_lists`.
    """
    run = iterative_passes(symptoms, docs, validation_fn, w_cover, w_trigram, texts)
    queries, cands, stats, kept = (run[x] for x in ("queries", "candidates", "passes", "kept"))
    vec, lex = run["vector"], run["lexical"]

    doc_fields = (docs if texts is None else texts).select(
        F.col("id").cast("long").alias("doc_id"), "document_source", "vehicle_model", F.col("symptom_text").alias("doc_symptom_text"),
        "system_category", "repair_parts", "evidence_text",
    )
    merged = kept.select("estimate_id", "symptom_no", "doc_id", "score", "similarity_score", "kept_rank")
    # fallback (R8): symptoms with nothing kept take the hybrid top 5 of the pass-1 query;
    # its lists of 20 are the first 20 ranks of the pass-1 lists already computed
    qkeys = queries.select("qid", "estimate_id", "symptom_no", "pass")
    p1 = qkeys.where(F.col("pass") == 1).select("qid")
    fb_fetch = max(FALLBACK_TOP_K * FETCH_FACTOR, FALLBACK_TOP_K)
    fb = fuse_rankings(
        vec.join(p1, "qid", "left_semi").where(F.col("rank") <= fb_fetch),
        lex.join(p1, "qid", "left_semi").where(F.col("rank") <= fb_fetch),
        FALLBACK_TOP_K, fb_fetch,
    )
    has_kept = merged.select("estimate_id", "symptom_no").distinct()
    fb = fb.join(qkeys, "qid").join(has_kept, ["estimate_id", "symptom_no"], "left_anti").select(
        "estimate_id", "symptom_no", "doc_id", "score", F.lit(0.0).alias("similarity_score"), F.col("fused_rank").alias("kept_rank")
    )
    match = merged.withColumn("is_fallback", F.lit(False)).unionByName(fb.withColumn("is_fallback", F.lit(True)))
    match = stored(match)
    match = cut_lineage(match.join(named_docs(doc_fields, match), "doc_id", "left"))
    ev_w = Window.partitionBy("estimate_id", "symptom_no").orderBy("kept_rank")
    evidence = (
        match.where(F.col("score") >= MIN_EVIDENCE_SCORE)
        .withColumn("evidence_no", F.row_number().over(ev_w))
        .where(F.col("evidence_no") <= EVIDENCE_PER_SYMPTOM)
    )
    # direct matches count the kept docs (before any fallback)
    kws = symptoms.select("estimate_id", "symptom_no", extract_keywords(F.col("symptom_text")).alias("kws"))
    hay = F.concat_ws(" ", F.coalesce("doc_symptom_text", F.lit("")), F.coalesce("evidence_text", F.lit("")))
    direct = (
        match.where(~F.col("is_fallback")).join(kws, ["estimate_id", "symptom_no"])
        .groupBy("estimate_id", "symptom_no")
        .agg(F.count(F.when(F.exists("kws", lambda k: F.instr(hay, k) > 0), 1)).alias("direct_match_count"))
    )
    executed = stats.where(F.col("executed"))
    counters = executed.groupBy("estimate_id", "symptom_no").agg(
        F.sum(F.when(F.col("pass") <= MODEL_PHASE_PASSES, F.col("candidate_count")).otherwise(0)).alias("used_model_docs"),
        F.sum(F.when(F.col("pass") > MODEL_PHASE_PASSES, F.col("candidate_count")).otherwise(0)).alias("used_common_docs"),
        F.max(F.col("satisfied")).alias("satisfied"),
        F.max("chosen_pass").alias("chosen_pass"),
    )
    n_ev = evidence.groupBy("estimate_id", "symptom_no").agg(F.count(F.lit(1)).alias("n_evidence"))
    per_symptom = (
        symptoms.select("estimate_id", "symptom_no", norm_space(F.col("symptom_text")).alias("symptom_text"), "vehicle_model")
        .withColumn("inferred_systems", F.array_join(infer_systems(F.col("symptom_text")), ","))
        .join(counters, ["estimate_id", "symptom_no"], "left")
        .join(direct, ["estimate_id", "symptom_no"], "left")
        .join(n_ev, ["estimate_id", "symptom_no"], "left")
        .select(
            "estimate_id", "symptom_no", "symptom_text", "vehicle_model", "inferred_systems",
            F.when(F.coalesce("satisfied", F.lit(False)), F.lit(STATUS_OK)).otherwise(F.lit(STATUS_INSUFFICIENT)).alias("match_status"),
            F.coalesce("chosen_pass", F.lit(1)).alias("chosen_pass"),
            F.coalesce("used_model_docs", F.lit(0)).cast("long").alias("used_model_docs"),
            F.coalesce("used_common_docs", F.lit(0)).cast("long").alias("used_common_docs"),
            F.coalesce("direct_match_count", F.lit(0)).cast("long").alias("direct_match_count"),
            F.coalesce("n_evidence", F.lit(0)).cast("long").alias("n_evidence"),
        )
    )
    per_symptom = cut_lineage(per_symptom)
    return {"candidates": cands, "passes": stats, "symptoms": per_symptom, "match_docs": match, "evidence": evidence}


def evidence_scope(per_symptom: DataFrame) -> DataFrame:
    """Per estimate, which document phases supplied candidates."""
    t = per_symptom.groupBy("estimate_id").agg(
        F.sum("used_model_docs").alias("m"), F.sum("used_common_docs").alias("c")
    )
    return t.select(
        "estimate_id",
        F.when((F.col("m") > 0) & (F.col("c") > 0), F.lit(SCOPE_BOTH))
        .when(F.col("m") > 0, F.lit(SCOPE_MODEL))
        .when(F.col("c") > 0, F.lit(SCOPE_COMMON))
        .otherwise(F.lit(SCOPE_NONE))
        .alias("evidence_scope"),
    )


def quote_part_list(parts: DataFrame) -> DataFrame:
    """Order-keeping distinct normalized part names per estimate (first line wins)."""
    n = parts.select("estimate_id", "no", norm_space(F.col("part_official_name")).alias("part")).where(F.length("part") > 0)
    return n.groupBy("estimate_id", "part").agg(F.min("no").alias("first_no"))


def unrelated_parts(quote_parts: DataFrame, per_symptom: DataFrame, match_docs: DataFrame) -> DataFrame:
    """Non-consumable quoted parts matched by no candidate document's expected part
    (containment either way on normalized names); nothing when an estimate has a
    symptom without evidence."""
    blocked = per_symptom.where(F.col("n_evidence") == 0).select("estimate_id").distinct()
    # few beside the quoted parts and stored, so that their size is known before these are grouped
    have = stored(per_symptom.select("estimate_id").distinct().join(blocked, "estimate_id", "left_anti"))
    expected = (
        match_docs.select("estimate_id", F.explode(split_parts(F.col("repair_parts"))).alias("ep"))
        .select("estimate_id", norm_part(F.col("ep")).alias("ek"))
        .where(F.length("ek") > 0)
        .distinct()
    )
    # the filtered quoted parts feed four branches below: compute them once
    q = cut_lineage(
        quote_parts.join(have, "estimate_id", "left_semi")
        .where(~consumable_flag(F.col("part")))
        .withColumn("qk", norm_part(F.col("part")))
        .where(F.length("qk") > 0)
    )
    qkeys = q.select("estimate_id", F.col("qk").alias("s")).distinct()
    ekeys = expected.select("estimate_id", F.col("ek").alias("s"))
    hit = contained_pairs(ekeys, qkeys).select("estimate_id", F.col("hay").alias("qk"))
    hit = hit.unionByName(contained_pairs(qkeys, ekeys).select("estimate_id", F.col("needle").alias("qk")))
    return q.join(hit, ["estimate_id", "qk"], "left_anti").select("estimate_id", "part", "first_no")


GRAM = 3


def _grams(s: Column, q: Column) -> Column:
    """The distinct ``q``-grams of a text of at least ``q`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - q + 1), lambda i: F.substring(s, i, q)))


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(estimate_id, needle, hay) for distinct keys (estimate_id, s) of which the first lies in
    the second, in the same estimate.

    Every needle is anchored at the one of its grams (of GRAM characters, or the whole of a
    shorter needle) that the fewest hays of the estimate hold; a needle with a gram that no hay
    holds is in none.  Only hays that hold the anchor are compared.  A hay gives as many rows as
    it has grams, a needle one."""
    needles = needles.select("estimate_id", F.col("s").alias("needle"), F.least(F.length("s"), F.lit(GRAM)).alias("q"))
    sizes = needles.select("estimate_id", "q").distinct()
    held = hays.join(sizes, "estimate_id").where(F.col("q") <= F.length("s"))
    held = held.select("estimate_id", F.col("s").alias("hay"), F.explode(_grams(F.col("s"), F.col("q"))).alias("gram"))
    common = held.groupBy("estimate_id", "gram").agg(F.count(F.lit(1)).alias("hays"))
    own = needles.select("estimate_id", "needle", F.explode(_grams(F.col("needle"), F.col("q"))).alias("gram"))
    own = own.join(common, ["estimate_id", "gram"], "left")
    anchors = own.groupBy("estimate_id", "needle").agg(
        F.min_by("gram", F.struct("hays", "gram")).alias("gram"), F.count(F.when(F.col("hays").isNull(), 1)).alias("missing")
    )
    pairs = anchors.where(F.col("missing") == 0).join(held, ["estimate_id", "gram"])
    return pairs.where(F.contains("hay", "needle")).select("estimate_id", "needle", "hay")


# --- evidence texts ------------------------------------------------------------------------------

# Explanation and prompt wording.
EVIDENCE_TAG = "증상{s}-근거{e}"
WHY_USED = "{symptom} 증상 판단에 참고한 {label}{hint} 문서 근거입니다."
NO_SUMMARY = "관련 근거 문구 요약 없음"
EXPECTED_PARTS = " (예상 정비항목: {parts})"
PROMPT_HEAD = "증상{s}: {symptom}\n직접매칭수: {direct}\n근거:\n"
PROMPT_EMPTY = "(없음)"
PROMPT_LINE = "[{i}] source={src} ({label}) score={score} | system={system} | expected={parts} | evidence={evidence}"


def evidence_rows(evidence: DataFrame, per_symptom: DataFrame) -> DataFrame:
    """One numbered explanation row per (symptom i, evidence j)."""
    from pricelens.functions.text import source_label, summarize_text

    e = evidence.join(per_symptom.select("estimate_id", "symptom_no", F.col("symptom_text").alias("related_symptom")), ["estimate_id", "symptom_no"])
    code = norm_space(F.col("document_source"))
    label = source_label(F.col("document_source"))
    cat = norm_space(F.col("system_category"))
    parts = norm_space(F.col("repair_parts"))
    excerpt = summarize_text(F.col("evidence_text"))
    hint = F.when(F.length(cat) > 0, F.concat(F.lit(" ("), cat, F.lit(")"))).otherwise(F.lit(""))
    desc = F.concat(
        F.when(F.length(excerpt) > 0, excerpt).otherwise(F.lit(NO_SUMMARY)),
        F.when(F.length(parts) > 0, fill_template(EXPECTED_PARTS, parts=parts)).otherwise(F.lit("")),
    )
    return e.select(
        "estimate_id", "symptom_no", "evidence_no",
        fill_template(EVIDENCE_TAG, s=F.col("symptom_no").cast("string"), e=F.col("evidence_no").cast("string")).alias("tag"),
        norm_space(F.col("related_symptom")).alias("related_symptom"),
        code.alias("source_code"), label.alias("source_label"), cat.alias("system_category"),
        F.col("doc_id"), norm_space(F.col("doc_symptom_text")).alias("document_symptom_text"),
        parts.alias("repair_parts"), excerpt.alias("evidence_excerpt"), desc.alias("description"),
        fill_template(WHY_USED, symptom=norm_space(F.col("related_symptom")), label=label, hint=hint).alias("why_used"),
    )


def report_evidence_rows(evidence: DataFrame, per_symptom: DataFrame, n_docs: int = REPORT_EVIDENCE_DOCS,
                         max_len: int = REPORT_EXCERPT_LEN) -> DataFrame:
    """The first ``n_docs`` evidence documents per symptom, evidence cut to ``max_len`` chars + '…'."""
    ev = F.coalesce(F.col("evidence_text"), F.lit(""))
    short = F.when(F.length(ev) > max_len, F.concat(F.substring(ev, 1, max_len), F.lit("…"))).otherwise(ev)
    return (
        evidence.where(F.col("evidence_no") <= n_docs)
        .join(per_symptom.select("estimate_id", "symptom_no", "symptom_text"), ["estimate_id", "symptom_no"])
        .select("estimate_id", "symptom_no", "evidence_no", "symptom_text",
                F.coalesce("document_source", F.lit("")).alias("document_source"), short.alias("evidence_short"))
    )


def evidence_prompt(evidence: DataFrame, per_symptom: DataFrame) -> DataFrame:
    """One prompt text per estimate: per symptom its direct-match count and numbered
    evidence lines (text only; nothing is sent anywhere).  Bounded groups: a symptom has
    at most three evidence lines and an estimate a handful of symptoms."""
    from pricelens.functions.text import source_label

    line = fill_template(
        PROMPT_LINE, i=F.col("evidence_no").cast("string"), src=F.coalesce("document_source", F.lit("")),
        label=source_label(F.col("document_source")), score=F.format_string("%.4f", F.col("score")),
        system=F.coalesce("system_category", F.lit("")), parts=F.coalesce("repair_parts", F.lit("")),
        evidence=F.coalesce("evidence_text", F.lit("")),
    )
    lines = evidence.groupBy("estimate_id", "symptom_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_no", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines")
    )
    blocks = per_symptom.join(lines, ["estimate_id", "symptom_no"], "left").select(
        "estimate_id", "symptom_no",
        F.concat(
            fill_template(PROMPT_HEAD, s=F.col("symptom_no").cast("string"), symptom=F.col("symptom_text"), direct=F.col("direct_match_count").cast("string")),
            F.coalesce(F.col("lines"), F.lit(PROMPT_EMPTY)),
        ).alias("block"),
    )
    return blocks.groupBy("estimate_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symptom_no", "block"))), lambda x: x["block"]), "\n\n").alias("prompt")
    )


def validation_request(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """Per query, the JSON array of normalized candidate fields in candidate order."""
    d = docs.select(
        F.col("id").cast("long").alias("doc_id"),
        norm_space(F.col("symptom_text")).alias("candidate_symptom_text"),
        norm_space(F.col("evidence_text")).alias("evidence_text"),
        norm_space(F.col("system_category")).alias("system_category"),
        norm_space(F.col("document_source")).alias("document_source"),
    )
    items = cands.join(named_docs(d, cands), "doc_id").select(
        "qid", "fused_rank",
        F.struct(F.col("doc_id").alias("id"), "candidate_symptom_text", "evidence_text", "system_category", "document_source").alias("item"),
    )
    return items.groupBy("qid").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("fused_rank", "item"))), lambda x: x["item"])).alias("request")
    )
