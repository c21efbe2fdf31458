"""Vehicle-cell parsing: one free-text cell -> ordered, de-duplicated vehicle list.

Three rule sets (market, store, partsro) share one skeleton built from native array
expressions (``split`` / ``transform`` / ``filter`` / ``flatten`` / ``array_distinct``),
so the whole parse stays inside whole-stage codegen with no Python worker.

Skeleton: trim -> rule-set pre-processing -> split pieces on commas -> a piece with
``/`` splits again, and when its first sub-piece ends in a drive code such as
``4X2`` after a non-digit prefix, later bare codes get that prefix -> per-token
normalization -> validity filter -> order-keeping dedupe -> empty means ``["All"]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.text import let, py_strip

# ---------------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------------
ALL_VEHICLES = "All"
# Words that mark a token as a part rather than a vehicle (substring, any case).
PART_WORDS = r"(?i)(ASSY|BRACKET|BOLT|NUT|SCREW|GASKET|SEAL|HOSE|DUCT|COVER|REINF|CHECKER|CLIP|GROMMET|LATCH|GUARD)"
MARKET_CELL_PREFIX = r"(?U)^\[차종\s*및\s*연식\]\s*"
MARKET_ALL_WORDS = ["전차종", "전 차종"]
MARKET_ALL_ONLY = r"(?U)^전\s*차종$"
MARKET_TOKEN_PREFIX = r"(?U)^차종\s*[:：]?\s*"
MARKET_YEAR_PAREN = r"(?U)\s*\((?:[^)]*~[^)]*|\d{4}[^)]*)\)\s*"
MARKET_PAREN_THEN_WORD = r"(?U)\)\s+(?=[A-Za-z0-9가-힣])"
STORE_YEAR_COMMA = r"(?U)(\d{2,4})\s*,\s*(\d{2,4}\s*년식)"
PARTSRO_YEAR_INLINE = r"(?U)(?:\b(?:19|20)\d{2}(?:[./-]\d{1,2})?\b|(?:\b\d{4}\s*년식\b)|(?:~\s*(?:19|20)\d{2}))"
PARTSRO_DATE_STYLE = r"(?iU)\b\d{2}\s*:\s*-?[A-Z]{3}\.?\d{4}\b"
DRIVE_CODE = r"(?U)^\d+X\d+$"
DRIVE_CODE_WITH_PREFIX = r"(?U)^(.*\D)\s*(\d+X\d+)$"
FULLWIDTH_COMMA = "，"

# a character that never occurs in a cell, used to protect "16,19년식" from the comma split
_PROTECTED_COMMA = ""


def _collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def _strip_chars(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def valid_vehicle_token(t: Column) -> Column:
    """non-empty, longer than one char, no ``_``, no part word anywhere."""
    return (F.length(t) > 1) & ~t.contains("_") & ~t.rlike(PART_WORDS)


def _norm_market(t: Column) -> Column:
    t = py_strip(t)
    t = F.regexp_replace(t, MARKET_TOKEN_PREFIX, "")
    t = F.regexp_replace(t, MARKET_YEAR_PAREN, " ")
    return py_strip(_strip_chars(_collapse_ws(t), " -"))


def _norm_store(t: Column) -> Column:
    return py_strip(_strip_chars(_collapse_ws(t), " -"))


def _norm_partsro(t: Column) -> Column:
    t = F.replace(t, F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, r"(?U)\s*\([^)]*\)\s*", " ")
    t = F.regexp_replace(t, PARTSRO_YEAR_INLINE, " ")
    t = F.regexp_replace(t, PARTSRO_DATE_STYLE, " ")
    t = py_strip(_strip_chars(_collapse_ws(t), " -"))
    return py_strip(_strip_chars(t, ".,:;~"))


def _nonblank_pieces(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: py_strip(x)), lambda x: F.length(x) > 0)


def _piece_tokens(piece: Column, norm) -> Column:
    """One comma piece -> normalized tokens (slash split with drive-code prefix carry)."""

    def split_piece(subs: Column) -> Column:
        return let(
            py_strip(F.regexp_extract(F.element_at(subs, 1), DRIVE_CODE_WITH_PREFIX, 1)),
            lambda prefix: F.transform(
                subs,
                lambda s, i: norm(
                    F.when((i > 0) & (F.length(prefix) > 0) & s.rlike(DRIVE_CODE), F.concat(prefix, F.lit(" "), s)).otherwise(s)
                ),
            ),
        )

    return F.when(piece.contains("/"), split_piece(_nonblank_pieces(piece, r"(?U)\s*/\s*"))).otherwise(F.array(norm(piece)))


def _finish(tokens: Column) -> Column:
    return let(
        F.array_distinct(F.filter(tokens, valid_vehicle_token)),
        lambda kept: F.when(F.size(kept) > 0, kept).otherwise(_all()),
    )


def _all() -> Column:
    return F.array(F.lit(ALL_VEHICLES))


def vehicles_market(cell: Column) -> Column:
    """G1: market rule set."""
    w0, w1 = MARKET_ALL_WORDS

    def parse(t1: Column) -> Column:
        lead = t1.startswith(w0) | t1.startswith(w1)
        rest = (
            F.when(t1.startswith(w0), py_strip(F.substring(t1, len(w0) + 1, 1 << 30)))
            .when(t1.startswith(w1), py_strip(F.substring(t1, len(w1) + 1, 1 << 30)))
            .otherwise(t1)
        )
        t2 = F.replace(rest, F.lit(FULLWIDTH_COMMA), F.lit(","))
        t2 = py_strip(_collapse_ws(F.regexp_replace(t2, MARKET_PAREN_THEN_WORD, "), ")))
        per_piece = F.transform(
            _nonblank_pieces(t2, ","),
            lambda p: F.when(p.rlike(MARKET_ALL_ONLY), _all()).otherwise(_piece_tokens(p, _norm_market)),
        )
        tokens = F.concat(F.when(lead, _all()).otherwise(F.array().cast("array<string>")), F.flatten(per_piece))
        return (
            F.when(F.length(t1) == 0, _all())
            .when(~lead & t1.rlike(MARKET_ALL_ONLY), _all())
            .otherwise(_finish(tokens))
        )

    t0 = py_strip(cell)
    return F.when(cell.isNull() | (F.length(t0) == 0), _all()).otherwise(
        let(py_strip(F.regexp_replace(t0, MARKET_CELL_PREFIX, "")), parse)
    )


def vehicles_store(cell: Column) -> Column:
    """Store rule set (keeps "16,19년식" together)."""
    t0 = py_strip(F.coalesce(cell, F.lit("")))
    t1 = F.replace(t0, F.lit(FULLWIDTH_COMMA), F.lit(","))
    t1 = F.regexp_replace(t1, STORE_YEAR_COMMA, "$1" + _PROTECTED_COMMA + "$2")
    t1 = py_strip(_collapse_ws(t1))
    pieces = F.transform(_nonblank_pieces(t1, ","), lambda p: F.replace(p, F.lit(_PROTECTED_COMMA), F.lit(",")))
    tokens = F.flatten(F.transform(pieces, lambda p: _piece_tokens(p, _norm_store)))
    return F.when(F.length(t0) == 0, _all()).otherwise(_finish(tokens))


def vehicles_partsro(cell: Column) -> Column:
    """Partsro rule set (spaced slash is a comma; parens, years and dates removed)."""
    t0 = py_strip(F.coalesce(cell, F.lit("")))
    t1 = F.replace(t0, F.lit(FULLWIDTH_COMMA), F.lit(","))
    t1 = py_strip(_collapse_ws(t1))
    t1 = F.regexp_replace(t1, r"(?U)\s+/\s+", ",")
    pieces = _nonblank_pieces(t1, ",")
    tokens = F.flatten(F.transform(pieces, lambda p: _piece_tokens(p, _norm_partsro)))
    return F.when(F.length(t0) == 0, _all()).otherwise(_finish(tokens))


RULE_SETS = {"market": vehicles_market, "store": vehicles_store, "partsro": vehicles_partsro}
