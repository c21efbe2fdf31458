"""Scalar text expressions (all JVM-side ``Column`` expressions, no Python per row).

Patterns that stand for Python's Unicode-aware ``\\s``/``\\d``/``str.split()`` carry the
``(?U)`` flag; patterns that stand for Spark's own ``regexp_replace`` calls keep Java's
default ASCII classes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
# Verdict phrases of the free-text diagnosis parser.
VERDICT_NEGATIONS = ["과잉정비가 아닙니다", "과잉정비 아님"]
VERDICT_NORMAL = ["표준 범위", "표준정비", "이상 없음"]
VERDICT_OVER = ["과잉정비"]
# Report-style verdict prefixes.
VERDICT_STRICT_OVER = "견적서는 다음 이유로 과잉정비입니다."
VERDICT_STRICT_NORMAL = "견적서는 현재 근거 기준 표준 범위입니다."
# Evidence-scope codes and labels (display parser, then report parser).
EVIDENCE_LABELS = {
    "hyundai_model_pdf_plus_common": "현대 정비 지침서 + 일반 정비 지침",
    "hyundai_model_pdf_only": "현대 정비 지침서",
    "common_only": "일반 정비 지침",
}
REPORT_EVIDENCE_LABELS = dict(EVIDENCE_LABELS, no_evidence="근거 문서 없음")
# Document source labels; unknown codes show as themselves, blank as the default.
SOURCE_LABELS = {"hyundai_model_pdf": "현대 차종 정비지침", "common": "일반 정비 지침"}
SOURCE_LABEL_DEFAULT = "문서 근거"
# Consumable part keywords (matched on the normalized part name).
CONSUMABLE_PART_KEYWORDS = [
    "점화플러그", "엔진오일", "오일필터", "에어필터", "캐빈필터", "에어컨필터",
    "브레이크패드", "브레이크라이닝", "와이퍼", "냉각수", "미션오일", "부동액",
]
# Evidence summary length and ellipsis.
SUMMARY_MAX_LEN = 120
ELLIPSIS = "…"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element ``transform``),
    so a sub-expression used several times is not recomputed per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill_template(template: str, **cols: Column) -> Column:
    """Fill a ``{name}`` template with columns via ``concat`` (no string formatting per row);
    null if a column is null."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [cols[piece] if k % 2 else F.lit(piece) for k, piece in enumerate(pieces) if piece]
    return F.concat(*parts)


def lit_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


# --- prices and part numbers (clean jobs) ------------------------------------------

def price_to_int(c: Column, digits_only: bool = True) -> Column:
    """Drop every non-digit, empty -> null, ``try_cast`` to int (over-long -> null)."""
    digits = F.regexp_replace(c, r"[^0-9]", "") if digits_only else c
    return F.when(F.length(digits) > 0, digits.try_cast("int"))


PACK_RE = r"^([A-Za-z0-9]+)[xX](\d+)$"


def pack_part(raw_part_no: Column) -> Column:
    return F.regexp_extract(raw_part_no, PACK_RE, 1)


def pack_qty(raw_part_no: Column) -> Column:
    q = F.regexp_extract(raw_part_no, PACK_RE, 2)
    return F.when(F.length(q) > 0, q.try_cast("int"))


def unit_price_from_pack(price: Column, qty: Column) -> Column:
    """Price / qty rounded half-up when qty > 0, else price."""
    return F.when(
        price.isNotNull() & qty.isNotNull() & (qty > 0),
        F.round(price / qty, 0).try_cast("int"),
    ).otherwise(price)


def strip_trailing_paren(c: Column) -> Column:
    """Remove one trailing ``( ... )`` group (Java classes, as Spark's own call)."""
    return F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")


def trailing_paren_content(c: Column) -> Column:
    return F.regexp_extract(c, r"\(([^()]+)\)\s*$", 1)


def part_no_from_name(official_name: Column, part_no: Column) -> Column:
    """Part number = trailing paren content of the (trimmed) name, else trim(part_no)."""
    extracted = trailing_paren_content(F.trim(official_name))
    return F.when(F.length(extracted) > 0, extracted).otherwise(F.trim(part_no))


def name_without_part_no(official_name: Column) -> Column:
    on = F.trim(official_name)
    extracted = trailing_paren_content(on)
    return F.when(F.length(extracted) > 0, strip_trailing_paren(on)).otherwise(on)


def _nonempty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def part_no_cascade(raw: Column, pack: Column | None = None) -> Column:
    """P5: pack pattern, paren code, discontinued-replacement, whole code, first run >= 5."""
    t = F.trim(raw)
    pk = pack_part(t) if pack is None else pack
    cands = F.array(
        pk,
        F.regexp_extract(t, r"\(([A-Za-z0-9]+)\)", 1),
        F.regexp_extract(t, r"단종되어\s*([A-Za-z0-9]+)\s*로", 1),
        F.when(t.rlike(r"^[A-Za-z0-9]+$"), t).otherwise(F.lit("")),
        F.regexp_extract(t, r"([A-Za-z0-9]{5,})", 1),
    )
    # first non-empty candidate; each candidate is evaluated once
    return F.try_element_at(F.filter(cands, lambda c: F.length(c) > 0), F.lit(1))


def part_no_present(raw: Column) -> Column:
    """True exactly when ``part_no_cascade(raw)`` is non-empty, as one regex test: each
    candidate's group is non-empty iff its pattern matches, and a pack match is a whole
    code.  Filters use this instead of the cascade they would otherwise inline."""
    t = F.trim(raw)
    return t.rlike(r"^[A-Za-z0-9]+$|\([A-Za-z0-9]+\)|단종되어\s*[A-Za-z0-9]+\s*로|[A-Za-z0-9]{5,}")


# --- vehicle keys (conform job) ------------------------------------------------------

def default_vehicle(c: Column) -> Column:
    """null/blank -> 'all', else trim (Spark trim, spaces only)."""
    return F.when(c.isNull() | (F.length(F.trim(c)) == 0), F.lit("all")).otherwise(F.trim(c))


def match_key(c: Column) -> Column:
    """lower(trim), keep only [0-9a-z가-힣]."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^0-9a-z가-힣]", "")


def norm_text(c: Column) -> Column:
    """Lower-case, keep letters and digits of any script."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def token_set(c: Column) -> Column:
    """P10: distinct lower-case alphanumeric runs."""
    return F.array_distinct(
        F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 0)
    )


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace on both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def base_name(c: Column) -> Column:
    """Canonical name without its trailing paren group."""
    return py_strip(F.regexp_replace(c, r"(?U)\s*\([^)]*\)\s*$", ""))


# --- web-side normalizers ------------------------------------------------------------

def norm_space(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def norm_part(c: Column) -> Column:
    """P25: lower, drop whitespace and ``_ - / ( ) , .``."""
    return F.regexp_replace(F.lower(norm_space(c)), r"(?U)[\s_\-/(),.]+", "")


def split_parts(c: Column) -> Column:
    """Split on , / | newline; normalize; order-keeping dedupe on norm_part."""
    items = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), r"[,/|\n]+"), lambda x: norm_space(x)),
        lambda x: F.length(x) > 0,
    )
    # sorted by key and place, the first of each run of equal keys stays; work grows as n log n
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(norm_part(x).alias("k"), i.alias("i"), x.alias("x"))))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    firsts = once(keyed, lambda s: F.filter(s, lambda e, j: (j == 0) | (e["k"] != F.get(s, j - 1)["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"], e["x"].alias("x")))), lambda e: e["x"])


def split_symptoms(c: Column) -> Column:
    """Split on two pipes or newline runs, drop blanks."""
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), r"\|\||\n+"), lambda x: norm_space(x)),
        lambda x: F.length(x) > 0,
    )


def extract_keywords(c: Column) -> Column:
    """Split on whitespace/punctuation, keep tokens of length >= 2."""
    return F.filter(F.split(norm_space(c), r"(?U)[\s,./()\-_\[\]{}]+"), lambda x: F.length(x) >= 2)


def compact_query(c: Column, max_keywords: int = 10) -> Column:
    """First ``max_keywords`` case-insensitively distinct keywords, else the text."""
    kws = extract_keywords(c)
    low = F.transform(kws, lambda x: F.lower(x))
    firsts = F.filter(kws, lambda x, i: ~F.exists(F.slice(low, F.lit(1), i), lambda y: y == F.lower(x)))
    picked = F.slice(firsts, 1, max_keywords)
    return F.when(F.size(picked) > 0, F.array_join(picked, " ")).otherwise(norm_space(c))


def summarize_text(c: Column, max_len: int = SUMMARY_MAX_LEN) -> Column:
    """Normalized text cut to ``max_len`` chars with an ellipsis."""
    t = norm_space(c)
    cut = F.concat(F.rtrim(F.substring(t, 1, max_len - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(t) <= max_len, t).otherwise(cut)


def strip_json_fence(c: Column) -> Column:
    """Remove a leading code fence (and a ``json`` tag) before parsing."""
    t = py_strip(F.coalesce(c, F.lit("")))
    unfenced = py_strip(F.regexp_replace(t, r"^`+|`+$", ""))
    untagged = F.when(F.lower(unfenced).startswith("json"), py_strip(F.substring(unfenced, 5, 1 << 30))).otherwise(unfenced)
    return F.when(t.startswith("```"), untagged).otherwise(t)


def _strip_leading_tag(c: Column) -> Column:
    return F.regexp_replace(norm_space(c), r"(?U)^\[[^\]]+\]\s*", "")


def _contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def verdict_from_text(c: Column) -> Column:
    """Negation > normal phrase > over phrase > False."""
    t = _strip_leading_tag(c)
    return (
        F.when(F.length(t) == 0, F.lit(False))
        .when(_contains_any(t, VERDICT_NEGATIONS), F.lit(False))
        .when(_contains_any(t, VERDICT_NORMAL), F.lit(False))
        .when(_contains_any(t, VERDICT_OVER), F.lit(True))
        .otherwise(F.lit(False))
    )


def verdict_strict(c: Column) -> Column:
    """Report variant: prefix match -> True / False, else null."""
    t = _strip_leading_tag(c)
    return F.when(t.startswith(VERDICT_STRICT_OVER), F.lit(True)).when(t.startswith(VERDICT_STRICT_NORMAL), F.lit(False))


def split_evidence_tag(c: Column) -> tuple[Column, Column]:
    """Leading ``[근거: code]`` -> (body, label); other evidence/aux tags removed."""
    t = norm_space(c)
    head = r"(?U)^\[(근거:\s*[^\]]+)\]\s*(.*)$"
    has_head = t.rlike(head)
    rest = F.regexp_extract(t, head, 2)
    code = py_strip(F.regexp_extract(F.regexp_extract(t, head, 1), r"(?U)근거:\s*(.+)$", 1))
    drop_tags = lambda x: norm_space(py_strip(F.regexp_replace(x, r"\[(보조판단|근거):[^\]]+\]", "")))
    body = F.when(has_head, drop_tags(rest)).otherwise(drop_tags(t))
    label = F.when(has_head, F.coalesce(lit_map(EVIDENCE_LABELS)[code], F.lit(""))).otherwise(F.lit(""))
    return body, label


def report_evidence_label(c: Column) -> Column:
    """Report variant: code of a leading ``[근거: ...]`` tag mapped to its label, else the code."""
    t = norm_space(c)
    code = py_strip(F.regexp_extract(t, r"(?U)^\[근거:\s*([^\]]+)\]", 1))
    return F.coalesce(lit_map(REPORT_EVIDENCE_LABELS)[code], code)


def source_label(c: Column) -> Column:
    """Source code -> label; unknown -> the code; blank -> default."""
    code = norm_space(c)
    return F.coalesce(lit_map(SOURCE_LABELS)[code], F.when(F.length(code) > 0, code), F.lit(SOURCE_LABEL_DEFAULT))


def consumable_flag(part: Column) -> Column:
    """normalized part name contains any consumable keyword."""
    # bound once: a pushed-down filter gets no common-subexpression elimination
    return let(norm_part(part), lambda k: _contains_any(k, CONSUMABLE_PART_KEYWORDS))


def flat_text(c: Column) -> Column:
    """P20: nbsp -> space, CR dropped, 3+ newlines -> 2, trim; then every newline with its
    surrounding whitespace -> one space, whitespace runs of 2+ -> one space, trim."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    t = F.replace(t, F.lit("\r"), F.lit(""))
    t = py_strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    t = F.regexp_replace(t, r"(?U)\s*\n\s*", " ")
    t = F.regexp_replace(t, r"(?U)\s{2,}", " ")
    return py_strip(t)
