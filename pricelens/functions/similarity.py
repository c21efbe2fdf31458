"""Similarity measures.

* M1 ``sequence_ratio``: Ratcliff-Obershelp ratio (2*M/T) from the standard library's
  ``difflib`` - the one measure with no Spark builtin, run as an Arrow-batched pandas
  UDF over (a, b) pairs.  Argument order matters (the measure is not symmetric).
* M2 ``token_jaccard``, M3 ``containment``, R1 ``cosine``, R3 ``trigram_similarity``:
  native array expressions.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """M1: ``SequenceMatcher(None, a, b).ratio()`` per pair; nulls read as ''."""
    out = [
        difflib.SequenceMatcher(None, x if isinstance(x, str) else "", y if isinstance(y, str) else "").ratio()
        for x, y in zip(a, b)
    ]
    return pd.Series(out, dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    """M2: |A n B| / |A u B| of two token sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """M3: 1.0 when either string contains the other, else 0.0."""
    return F.when(F.instr(b, a) > 0, 1.0).when(F.instr(a, b) > 0, 1.0).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, computed in double; null if either is null
    or has zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    na = F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    nb = F.aggregate(F.transform(b, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.when((na > 0) & (nb > 0), dot / (F.sqrt(na) * F.sqrt(nb)))


def trigrams(text: Column) -> Column:
    """Trigram set in the pg_trgm manner: lower-case words of alphanumerics, each padded
    with two spaces before and one after, all 3-character windows, distinct."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3)),
    )
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """|T(a) n T(b)| / |T(a) u T(b)|, 0 when both are empty."""
    return token_jaccard(trigrams(a), trigrams(b))
