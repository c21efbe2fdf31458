"""Document fingerprints by Order MinHash, in DataFrame expressions only.

A text's k-mers are runs of ``k`` words, each numbered by its occurrence (the second "of
the" differs from the first), hashed to 40 bits and kept with its place in the text.  The
hash orders them.  A permutation is that order begun at one of 64 evenly spaced
places and closed to a ring; of each the ``TUPLE`` (two) minimal k-mers of the whole text are
taken, put back into text order and hashed as a tuple.  Two texts agree in it only if the
same k-mers are minimal and stand in the same order, so the share of agreement follows the
edit distance and not the bag of words, for short texts, too.  The rotations share one hash:
the expected share is that of independent permutations, its variance is greater for texts of
few k-mers, where neighbouring rotations take the same tuple.

Each step is one projection over the row's own arrays: nothing is exploded, and a text's
work grows as n log n.  Equal texts have equal fingerprints.

The next document is a neighbour in the order of ids, then of the text's hash.  These narrow
keys are numbered along that order, and every so many-th key, a key that a row really has,
begins a range (``spark.sql.shuffle.partitions`` times ``RANGES_PER_PARTITION`` ranges).  The
first row of a range is also sent, as a lender, to the end of the range before, so one shuffle
of the texts by range and a window of one row give every document its successor.

Defined cases: null and empty texts (and texts of white space) have the empty fingerprint,
alike among themselves (likeness 1) and unlike any other (0); fewer than ``k`` words are one
k-mer; rows with one id follow each other by a hash of the text; null ids come last, by the same
hash; a single row is its own successor; an empty table gives no rows; places count up to 2^24 words, after that
they start anew (order among the farthest words only).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty
from pricelens.llm.order import placed

WORDS = 2
PLACE = 24
BIN = 58
RANGES_PER_PARTITION = 2


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _borders(a: Column, shift: int) -> Column:
    """Where, in a sorted array, the bits from ``shift`` on differ from those before."""
    part = lambda i: F.shiftright(F.get(a, i), shift)
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (part(i) != part(i - 1)))


def _packed(value: Column, place: Column) -> Column:
    """40 bits of the hash over 24 bits of the place."""
    return F.shiftleft(F.shiftright(value, PLACE), PLACE).bitwiseOR(place.cast("bigint").bitwiseAND(F.lit((1 << PLACE) - 1)))


def _numbered(sorted_kmers: Column) -> Column:
    """Hashes of (k-mer, occurrence) with their places, out of k-mers sorted by hash and place."""

    def number(s: Column) -> Column:
        u = lambda at, nth: _packed(F.xxhash64(F.shiftright(F.get(s, at), PLACE), nth), F.get(s, at))

        def runs(starts: Column) -> Column:
            end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(s))
            first = F.transform(starts, lambda at: u(at, F.lit(0)))
            repeats = F.filter(F.transform(starts, lambda at, j: F.struct(at.alias("at"), (end(j) - at).alias("n"))), lambda r: r["n"] > 1)
            later = F.transform(repeats, lambda r: F.transform(F.sequence(F.lit(1), r["n"] - 1), lambda nth: u(r["at"] + nth, nth)))
            return F.concat(first, F.flatten(later))

        return _with(_borders(s, PLACE), runs)

    return _with(sorted_kmers, number)


def _rotations(numbered: Column) -> Column:
    """For each of the 64 rotations: its number and the 32-bit hash of the two k-mers that come
    first from its start on, in text order; behind the last k-mer the first ones follow."""

    def pick(t: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1))

        def hashed(at: Column) -> Column:
            a, b = F.get(t, at), F.get(t, F.when(at + 1 < F.size(t), at + 1).otherwise(0))
            ha, hb = F.shiftright(a, PLACE), F.shiftright(b, PLACE)
            in_order = F.when(place(a) <= place(b), F.xxhash64(ha, hb)).otherwise(F.xxhash64(hb, ha))
            return F.shiftrightunsigned(F.when(F.size(t) < 2, F.xxhash64(ha)).otherwise(in_order), 32)

        def filled(at: Column, first: Column, last: Column) -> Column:
            return _with(hashed(at), lambda m: F.transform(F.sequence(first, last), lambda r: F.shiftleft(r, 32).bitwiseOR(m)))

        def rotations(starts: Column) -> Column:
            number = lambda j: F.shiftright(F.get(t, F.get(starts, j)), BIN)
            least, most = F.lit(-32).cast("bigint"), F.lit(31).cast("bigint")
            own = F.transform(starts, lambda at, j: filled(at, F.when(j == 0, least).otherwise(number(j - 1) + 1), number(j)))
            last = number(F.size(starts) - 1)
            around = F.when(last < most, filled(F.lit(0), last + 1, most)).otherwise(F.array().cast("array<bigint>"))
            return F.concat(F.flatten(own), around)

        return _with(_borders(t, BIN), rotations)

    return _with(numbered, pick)


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = WORDS) -> DataFrame:
    """``df`` and the fingerprint of its non-null string column ``text``: an array of
    bigint, one per rotation.  Helper columns are named after ``name`` and dropped."""
    kept = df.columns
    h, s, u = f"{name}_words", f"{name}_kmers", f"{name}_numbered"
    empty = F.array().cast("array<bigint>")
    words = F.array_remove(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), "")
    df = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias(h))
    kmers = _with(
        F.col(h),
        lambda a: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(a) - k, F.lit(0))),
            lambda i: _packed(F.xxhash64(*[F.get(a, i + j) for j in range(k)]), i),
        ),
    )
    # an array that two expressions read is computed in a projection of its own
    df = df.select(*kept, F.when(F.size(h) > 0, F.sort_array(kmers)).otherwise(empty).alias(s))
    df = df.select(*kept, F.when(F.size(s) > 0, F.sort_array(_numbered(F.col(s)))).otherwise(empty).alias(u))
    return df.select(*kept, F.when(F.size(u) > 0, _rotations(F.col(u))).otherwise(empty).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing rotations (0 to 1); two texts without words agree."""
    bins = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 32))))
    return F.when(bins == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(bins, F.lit(1)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), ".")


def _ranges(keys: DataFrame, ranges: int, width: int) -> tuple[Column, Column]:
    """The keys that begin a range, in order, and every ``width``-th of them, as arrays."""
    rows = placed(keys, [F.col("key")])
    step = max(1, -(-rows.count() // ranges))
    firsts = rows.filter(F.col("place") % step == 0).select("key.*").distinct()
    firsts = [r.asDict() for r in firsts.orderBy(*firsts.columns).collect()]  # as many as ranges
    kind = keys.select(F.array("key").alias("a")).schema["a"].dataType.simpleString()
    return tuple(F.from_json(F.lit(json.dumps(some)), kind) for some in (firsts, firsts[::width]))


def with_next(df: DataFrame, id_col: str, text: str, columns: list[str]) -> DataFrame:
    """``df`` and ``next_<column>`` of the following row in the order of the id, then of the
    hash of ``text`` (the first row's after the last); null ids come last."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    rows = df.withColumn("key", key)
    # the range is looked up in two steps, among every width-th first key, then among the next
    width = max(1, math.isqrt(ranges))
    firsts, some = _ranges(rows.select("key"), ranges, width)
    upto = lambda keys: F.size(F.filter(keys, lambda first: first <= F.col("key")))
    rows = rows.withColumn("coarse", upto(some) - 1)
    fine = upto(F.slice(firsts, F.col("coarse") * width + 1, F.lit(width))) - 1
    rows = rows.withColumn("in_range", F.col("coarse") * width + fine)
    own = F.struct(F.col("in_range").alias("at"), F.lit(0).alias("lent"))
    lent = F.struct(F.pmod(F.col("in_range") - 1, F.size(firsts)).alias("at"), F.lit(1).alias("lent"))
    is_first = F.col("key").eqNullSafe(F.get(firsts, F.col("in_range")))
    rows = rows.withColumn("copy", F.explode(F.when(is_first, F.array(own, lent)).otherwise(F.array(own))))
    w = Window.partitionBy("copy.at").orderBy("copy.lent", "key")
    rows = rows.select(*df.columns, "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return rows.filter("copy.lent = 0").drop("copy")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """One row per row of ``df``: its id, ``n_chars``, the ``edited`` text (its last quarter
    replaced by the beginning of the next document), the fingerprints ``print`` and
    ``edited_print``, and their likeness ``near_edited`` and ``near_next``."""
    docs = df.select(df[id_col].alias("id"), text_or_empty(df, text_col).alias("body"))
    docs = with_next(with_fingerprint(docs, "body", "print", k), "id", "body", ["body", "print"])
    n = F.length("body")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("body").substr(F.lit(1), n - quarter), F.col("next_body").substr(F.lit(1), quarter))
    docs = docs.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    docs = with_fingerprint(docs, "edited", "edited_print", k)
    return docs.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited",
        "print",
        "edited_print",
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
