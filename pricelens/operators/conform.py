"""Conform job: free-text vehicle names -> canonical vehicle names.

``conform_vehicles(df, canonical)`` replaces ``car_type`` in every row.  ``canonical`` is a
DataFrame parameter (canonical_name, idx) - idx is the list order used for ties.

Plan:
1. P7 default (null/blank -> 'all'), then the *distinct* trimmed strings (A13) - the
   expensive matcher runs once per spelling, not per row.  The mapping is keyed on the
   trimmed string itself, so two spellings with one match key never multiply rows (Q1).
2. Candidates: a raw name and a canonical name that share no character score 0 on the
   ratio, the token Jaccard and the containment test, and no keyword of that canonical
   name can occur in the raw name - such pairs can never be chosen.  So candidate pairs
   come from an equi-join on shared characters against the broadcast character table
   of the (size-checked) canonical dimension; no cross join, exact result.
3. Scores: ratio (Arrow UDF, M1) + native Jaccard (M2) and containment (M3);
   ``0.7 r + 0.2 j + 0.1 c``; argmax with ties to the earliest canonical (M4).  The ratio
   runs only for pairs whose upper bound (the quick ratio from the multiset character
   overlap the candidate join already counts) reaches the exact score of the name's
   best-bounded pair - exact, and most pairs never reach Python.
4. Below 0.55: longest contained keyword, then ratio to the base name, then list order
   (M5); none -> 'unknown'.  Special values (M6) never reach the matcher.
5. Left join of the rows with the mapping (J1); a miss -> 'unknown'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.similarity import containment, sequence_ratio, token_jaccard
from pricelens.functions.text import base_name, default_vehicle, norm_text, token_set
from pricelens.operators.broadcast import checked_broadcast
from pricelens.session import cut_lineage

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
W_RATIO, W_JACCARD, W_CONTAINS = 0.7, 0.2, 0.1
ACCEPT_SCORE = 0.55
ALL, UNKNOWN = "all", "unknown"
# markers of a variant name: no bare first-word keyword is derived for these
VARIANT_MARKERS = ["하이브리드", "일렉트릭", "플러그인", "택시", "쿠페"]
VARIANT_MARKERS_LOWER = ["electrified", "hybrid", "electric"]
VARIANT_SUFFIX_LOWER = " n"
MODEL_CODE = r"^[A-Za-z]{1,4}\p{Nd}{1,4}[A-Za-z]?$"

# largest canonical dimension we broadcast; beyond it the char table joins by shuffle
MAX_BROADCAST_CANONICAL_ROWS = 200_000


def derive_keywords(base: Column) -> Column:
    """Keyword set of a base name: the base, the base without spaces, model-code
    tokens, and the first token when there are >= 2 tokens and no variant marker."""
    b = base
    low = F.lower(b)
    tokens = F.filter(F.split(b, r"(?U)\s+"), lambda t: F.length(t) > 0)
    marker = F.lit(False)
    for m in VARIANT_MARKERS:
        marker = marker | b.contains(m)
    for m in VARIANT_MARKERS_LOWER:
        marker = marker | low.contains(m)
    marker = marker | low.endswith(VARIANT_SUFFIX_LOWER)
    codes = F.filter(tokens, lambda t: t.rlike(MODEL_CODE))
    first = F.when(~marker & (F.size(tokens) >= 2), F.array(F.element_at(tokens, 1))).otherwise(F.array().cast("array<string>"))
    kws = F.concat(F.array(b, F.replace(b, F.lit(" "), F.lit(""))), codes, first)
    return F.array_distinct(F.filter(kws, lambda k: F.length(k) > 0))


def canonical_features(canonical: DataFrame) -> DataFrame:
    """The canonical dimension with everything the matcher needs, computed once."""
    base = base_name(F.col("canonical_name"))
    return canonical.select(
        "canonical_name",
        F.col("idx").cast("long").alias("idx"),
        norm_text(F.col("canonical_name")).alias("c_norm"),
        norm_text(base).alias("c_base_norm"),
        token_set(F.col("canonical_name")).alias("c_tokens"),
        F.array_distinct(
            F.filter(F.transform(derive_keywords(base), lambda k: norm_text(k)), lambda k: F.length(k) > 0)
        ).alias("c_keywords"),
    )


def special_value(raw: Column) -> Column:
    """M6: null/blank/'all' -> 'all'; nothing alphanumeric left -> 'unknown'; else null."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (
        F.when(F.length(t) == 0, F.lit(ALL))
        .when(F.lower(t) == ALL, F.lit(ALL))
        .when(F.length(norm_text(t)) == 0, F.lit(UNKNOWN))
    )


def _char_counts(c: Column) -> Column:
    """(ch, n) for every distinct character of a string (names are short)."""
    chars = F.filter(F.split(c, ""), lambda x: F.length(x) > 0)
    return F.transform(
        F.array_distinct(chars), lambda ch: F.struct(ch.alias("ch"), F.size(F.filter(chars, lambda x: x == ch)).alias("n"))
    )


def candidate_pairs(raw: DataFrame, feats: DataFrame) -> DataFrame:
    """Pairs (raw, canonical) sharing at least one character of their normalized forms,
    with ``m_ub`` = the multiset character overlap (an upper bound on matched characters)."""
    cchars = feats.select("canonical_name", F.inline(_char_counts(F.col("c_norm")))).withColumnRenamed("n", "cn")
    cchars = checked_broadcast(cchars, MAX_BROADCAST_CANONICAL_ROWS * 64)
    rchars = raw.select("raw", F.inline(_char_counts(F.col("r_norm")))).withColumnRenamed("n", "rn")
    return rchars.join(cchars, "ch").groupBy("raw", "canonical_name").agg(F.sum(F.least("rn", "cn")).alias("m_ub"))


def _score(ratio: Column) -> Column:
    return W_RATIO * ratio + W_JACCARD * F.col("jaccard") + W_CONTAINS * F.col("contains")


def pair_features(raw: DataFrame, feats: DataFrame) -> DataFrame:
    """Per candidate pair, everything but the ratio (all native): jaccard, containment,
    keyword match length and ``score_ub``, the score with the ratio replaced by its upper
    bound 2 * m_ub / (|a| + |b|) (``difflib``'s quick ratio, never below the ratio)."""
    pairs = candidate_pairs(raw, feats).join(raw, "raw").join(checked_broadcast(feats, MAX_BROADCAST_CANONICAL_ROWS), "canonical_name")
    kw_len = F.aggregate(
        F.filter(F.col("c_keywords"), lambda k: F.instr(F.col("r_norm"), k) > 0),
        F.lit(0),
        lambda acc, k: F.greatest(acc, F.length(k)),
    )
    quick = 2.0 * F.col("m_ub") / (F.length("r_norm") + F.length("c_norm"))
    return pairs.select(
        "raw", "canonical_name", "idx", "r_norm", "c_norm", "c_base_norm",
        token_jaccard(F.col("r_tokens"), F.col("c_tokens")).alias("jaccard"),
        containment(F.col("r_norm"), F.col("c_norm")).alias("contains"),
        kw_len.alias("kw_len"),
        quick.alias("quick_ratio"),
    ).withColumn("score_ub", _score(F.col("quick_ratio")))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Exact ratio and score for the pairs that can still be a name's best match.

    The pair with the highest upper bound per name is scored first; its exact score is a
    floor for that name's best, so only pairs whose upper bound reaches the floor are
    scored with the (Python) ratio.  Exact: a skipped pair scores at most its bound, below
    a score already found, so it can neither win nor tie."""
    ub_order = F.struct(F.col("score_ub"), (-F.col("idx")).alias("i"))
    first = pairs.groupBy("raw").agg(F.max_by(F.struct("r_norm", "c_norm", "jaccard", "contains"), ub_order).alias("t")).select(
        "raw", (W_RATIO * sequence_ratio(F.col("t.r_norm"), F.col("t.c_norm")) + W_JACCARD * F.col("t.jaccard")
                + W_CONTAINS * F.col("t.contains")).alias("_floor"),
    )
    live = pairs.join(first, "raw").where(F.col("score_ub") >= F.col("_floor") - 1e-9).drop("_floor")
    return live.withColumn("ratio", sequence_ratio(F.col("r_norm"), F.col("c_norm"))).withColumn("score", _score(F.col("ratio")))


def match_vehicles(raw_values: DataFrame, canonical: DataFrame) -> DataFrame:
    """Distinct raw strings (column ``raw``) -> (raw, canonical, score, method)."""
    feats = canonical_features(canonical)
    # distinct spellings are few next to the rows and feed three consumers: cut lineage once
    raw = cut_lineage(
        raw_values.select("raw").distinct().select(
            "raw",
            special_value(F.col("raw")).alias("special"),
            norm_text(F.col("raw")).alias("r_norm"),
            token_set(F.regexp_replace(F.col("raw"), r"(?U)^\s+|\s+$", "")).alias("r_tokens"),
        )
    )
    to_match = raw.where(F.col("special").isNull()).select("raw", "r_norm", "r_tokens")
    pairs = cut_lineage(pair_features(to_match, feats))
    scored = score_pairs(pairs)
    # one row per spelling, read by the fallback and the mapping: cut lineage once so the
    # ratio UDF runs once
    best = cut_lineage(scored.groupBy("raw").agg(
        F.max_by(F.struct("canonical_name", "score"), F.struct(F.col("score"), (-F.col("idx")).alias("i"))).alias("b"),
    ))
    # keyword fallback only for names below the acceptance score; the ratio to the base
    # name is computed for their keyword-matching candidates alone
    low = best.where(F.col("b.score") < ACCEPT_SCORE).select("raw")
    kw_pairs = pairs.where(F.col("kw_len") > 0).join(low, "raw", "left_semi").withColumn(
        "base_ratio", sequence_ratio(F.col("r_norm"), F.col("c_base_norm"))
    )
    kw = kw_pairs.groupBy("raw").agg(
        F.max_by(F.col("canonical_name"), F.struct(F.col("kw_len"), F.col("base_ratio"), (-F.col("idx")).alias("i"))).alias("kw")
    )
    matched = (
        raw.join(best, "raw", "left")
        .join(kw, "raw", "left")
        .select(
            "raw",
            F.coalesce(
                F.col("special"),
                F.when(F.col("b.score") >= ACCEPT_SCORE, F.col("b.canonical_name")),
                F.col("kw"),
                F.lit(UNKNOWN),
            ).alias("canonical"),
            F.col("b.score").alias("score"),
            F.when(F.col("special").isNotNull(), F.lit("special"))
            .when(F.col("b.score") >= ACCEPT_SCORE, F.lit("score"))
            .when(F.col("kw").isNotNull(), F.lit("keyword"))
            .otherwise(F.lit("none"))
            .alias("method"),
        )
    )
    return matched


def conform_vehicles(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """Conform job: every row kept, ``car_type`` replaced by its canonical name."""
    cols = df.columns
    base = df.withColumn("car_type", F.lit(ALL)) if "car_type" not in cols else df.withColumn("car_type", default_vehicle(F.col("car_type")))
    out_cols = cols if "car_type" in cols else cols + ["car_type"]
    mapping = match_vehicles(base.select(F.col("car_type").alias("raw")), canonical)
    return apply_vehicle_map(base, mapping.select("raw", "canonical")).select(*out_cols)


def apply_vehicle_map(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Left join rows with (raw -> canonical) on the trimmed string; miss -> 'unknown'."""
    m = mapping.select(F.col("raw").alias("car_type"), F.col("canonical").alias("_canon"))
    return df.join(m, "car_type", "left").withColumn("car_type", F.coalesce(F.col("_canon"), F.lit(UNKNOWN))).drop("_canon")
