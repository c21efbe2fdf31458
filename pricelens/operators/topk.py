"""Exact per-query top-k over a scoped document set, without materializing query x doc rows.

Documents are split into salt blocks per scope key and queries into blocks per scope;
each (scope, doc block, query block) cell meets in one ``cogroup`` task, whose pandas
function scores the cell with vectorized numpy and emits only that cell's top-k per
query.  A final window over at most ``doc_blocks * k`` rows per query keeps the global
top-k.  Order: score descending, null scores last, then document id ascending.

Block counts are sized *per scope* from the data: a scope holding a third of all
documents gets proportionally more blocks (``ceil(docs / docs_per_block)``), so no task
ever holds more than about ``docs_per_block`` documents and ``queries_per_block``
queries.  The per-scope counts are a small aggregate joined back (one row per scope).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT_SCHEMA = "qid string, doc_id long, score double"
DOCS_PER_BLOCK = 1000
QUERIES_PER_BLOCK = 1000

# scorer(queries_pdf, docs_pdf) -> float matrix (n_queries x n_docs), NaN = null score,
# -inf = document out of the query's scope (never returned)
Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _local_topk(scores: np.ndarray, doc_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise top-k indices: score desc, NaN last, id asc; -inf excluded."""
    rows, cols = [], []
    isnan = np.isnan(scores)
    for r in range(scores.shape[0]):
        s = scores[r]
        valid = np.where(~np.isneginf(s))[0]
        if valid.size == 0:
            continue
        sv = s[valid]
        nan = isnan[r][valid]
        # lexsort: last key is primary
        order = np.lexsort((doc_ids[valid], np.where(nan, 0.0, -sv), nan))
        take = valid[order[:k]]
        rows.append(np.full(take.size, r))
        cols.append(take)
    if not rows:
        return np.array([], dtype=int), np.array([], dtype=int)
    return np.concatenate(rows), np.concatenate(cols)


def _block_counts(df: DataFrame, scope: str, per_block: int, name: str) -> DataFrame:
    return df.groupBy(scope).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_block)).cast("int").alias(name))


def blocked_topk(
    queries: DataFrame,
    docs: DataFrame,
    scope: str,
    k: int,
    scorer: Scorer,
    doc_blocks: int | None = None,
    query_blocks: int | None = None,
    docs_per_block: int = DOCS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """``queries`` needs ``qid`` (string) and ``scope``; ``docs`` needs ``doc_id`` (long) and ``scope``.

    ``doc_blocks`` / ``query_blocks`` fix the block counts for every scope; left as None
    they are sized per scope from the data.  Returns (qid, doc_id, score, rank), rank 1..k.
    """
    if doc_blocks is None:
        nd = _block_counts(docs, scope, docs_per_block, "_nd")
    else:
        nd = docs.select(scope).distinct().withColumn("_nd", F.lit(doc_blocks))
    if query_blocks is None:
        nq = _block_counts(queries, scope, queries_per_block, "_nq")
    else:
        nq = queries.select(scope).distinct().withColumn("_nq", F.lit(query_blocks))
    blocks = nd.join(nq, scope, "inner")  # one row per scope present on both sides

    d = (
        docs.join(blocks, scope, "inner")
        .withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.col("_nd")).cast("int"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .drop("_nd", "_nq")
    )
    q = (
        queries.join(blocks, scope, "inner")
        .withColumn("_qb", F.pmod(F.xxhash64("qid"), F.col("_nq")).cast("int"))
        .withColumn("_db", F.explode(F.sequence(F.lit(0), F.col("_nd") - 1)))
        .drop("_nd", "_nq")
    )

    def cell(_key, qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or dpdf.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="object"), "doc_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        qpdf = qpdf.reset_index(drop=True)
        dpdf = dpdf.reset_index(drop=True)
        s = np.asarray(scorer(qpdf, dpdf), dtype="float64")
        ids = dpdf["doc_id"].to_numpy(dtype="int64")
        r, c = _local_topk(s, ids, k)
        sc = s[r, c] if r.size else np.array([], dtype="float64")
        return pd.DataFrame(
            {
                "qid": qpdf["qid"].to_numpy()[r] if r.size else pd.Series([], dtype="object"),
                "doc_id": ids[c] if r.size else pd.Series([], dtype="int64"),
                "score": np.where(np.isnan(sc), None, sc) if r.size else pd.Series([], dtype="float64"),
            }
        )

    local = d.groupBy(scope, "_db", "_qb").cogroup(q.groupBy(scope, "_db", "_qb")).applyInPandas(
        lambda key, dp, qp: cell(key, qp, dp), OUT_SCHEMA
    )
    w = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), F.col("doc_id").asc())
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
