"""Ranked lexical search with integer BM25 scores, by the Best Position Algorithm.

The documents of a block have one impact list per term: the documents that hold the term, by
descending impact (the term's part of the score, without its weight).  For a query, the lists
of its terms are read in rounds, each twice as deep as the one before.  Every document met is
looked up directly in all the lists, so its score is whole and its position is known in each of
them.  A list's best position is the end of the run of seen positions at its front, which is
often far beyond the position read last.  No unseen document can score more than the sum, over
the lists, of the weighted impact right after the best position.  Reading stops when this sum
is strictly below the k-th best score so far, so that equal scores are never lost; the k-th best
score of earlier blocks of a task counts from the start.

Three passes over the documents: one reads the texts and writes what they hold of the query
terms, one counts documents by term, one makes the blocks and searches them.  Query terms reach
the tasks in batches of ``batch_terms``; more queries mean more batches, each over all rows.

Cases: a null text has no terms and takes no part in any count; a document without terms is
not counted; a query without terms has no result; rows that repeat an id are documents each,
or queries each; documents without an id are ranked after equal scores with one; an empty table
gives an empty result.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty, utf8, written
from pricelens.llm.order import placed

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes that part terms become blanks, A-Z small letters
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

TOP = 10
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 21
BATCH_TERMS = 200_000
FIRST_DEPTH = 16
#: bytes of impacts kept for direct access, over all terms of a block
LOOKUP_BYTES = 64 << 20

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "query long, doc_id long, score long"


def query_terms(queries: DataFrame, id_col: str, text_col: str, batch_terms: int) -> DataFrame:
    """The queries with their distinct terms: (query, item, terms, batch); ``query`` numbers
    the rows.  A batch has about ``batch_terms`` terms, or one longer query."""
    lower = F.translate(text_or_empty(queries, text_col), UPPER, UPPER.lower())
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))))
    rows = queries.select(
        queries[id_col].alias("item"), terms.alias("terms"), F.monotonically_increasing_id().alias("tie")
    )
    rows = rows.filter(F.size("terms") > 0).withColumn("size", F.size("terms").cast("bigint"))
    rows = placed(written(rows), [F.col("item"), F.col("tie")], "size")
    return written(rows.select(F.col("place").alias("query"), "item", "terms", F.expr(f"before div {batch_terms}").alias("batch")))


def _read_texts(number_of: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in utf8(batch.column("body")):
                words = text.translate(FOLD).split()
                sizes.append(len(words))
                held = [(number_of[w], c) for w, c in Counter(words).items() if w in number_of]
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            numbers = pa.list_(pa.int32())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, numbers), pa.array(tfs, numbers)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return run


class Block:
    """The impact lists of some documents, by term: documents by descending impact."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        order = np.lexsort((docs, -impacts, terms))
        self.terms, first = np.unique(terms[order], return_index=True)
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.bounds = np.append(first, len(order))
        self.lookups: dict[int, np.ndarray] = {}
        self.kept = max(LOOKUP_BYTES // (4 * max(n_docs, 1)), 1)

    def at(self, terms: np.ndarray) -> list[tuple[int, int, int]]:
        """Of those terms that have a list here: (where in ``terms``, list, its length)."""
        place = np.searchsorted(self.terms, terms)
        there = np.flatnonzero(place < len(self.terms))
        there = there[self.terms[place[there]] == terms[there]]
        return [(int(j), int(place[j]), int(self.bounds[place[j] + 1] - self.bounds[place[j]])) for j in there]

    def lookup(self, which: int) -> np.ndarray:
        """Impacts by document, for direct access."""
        found = self.lookups.get(which)
        if found is None:
            while len(self.lookups) >= self.kept:
                self.lookups.pop(next(iter(self.lookups)))
            a, b = self.bounds[which], self.bounds[which + 1]
            found = np.zeros(self.n_docs, np.int32)
            found[self.docs[a:b]] = self.impacts[a:b]
            self.lookups[which] = found
        return found

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the ``k`` best, with their scores; ``known`` are the
        ``k`` best scores, or fewer, of other documents."""
        lists = self.at(terms)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w = np.array([weights[j] for j, _, _ in lists])
        starts = np.array([self.bounds[which] for _, which, _ in lists])
        lengths = np.array([n for _, _, n in lists])
        best = np.zeros(len(lists), np.int64)  # positions before this one are all seen
        seen = np.zeros(self.n_docs, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        table, depth = None, FIRST_DEPTH
        while True:
            open_ = best < lengths
            bound = int((w[open_] * self.impacts[starts[open_] + best[open_]]).sum())
            top = np.concatenate([known, scores])
            kth = int(np.partition(top, -k)[-k]) if len(top) >= k else 0
            if bound < kth or bound <= 0:
                return docs, scores
            if table is None:
                table = np.stack([self.lookup(which) for _, which, _ in lists])
            fresh = np.zeros(self.n_docs, bool)
            for i in np.flatnonzero(open_):
                fresh[self.docs[starts[i] + best[i] : starts[i] + min(max(depth, best[i] + FIRST_DEPTH), lengths[i])]] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            docs = np.concatenate([docs, new])
            scores = np.concatenate([scores, w @ table[:, new]])
            for i in np.flatnonzero(open_):
                rest = seen[self.docs[starts[i] + best[i] : starts[i] + lengths[i]]]
                gap = int(rest.argmin())
                best[i] += len(rest) if rest[gap] else gap
            depth *= 2


def _ranked(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best by score, then id, rows without an id last; ``known`` tells which have one."""
    order = np.lexsort((ids, ~known, -scores))[:k]
    return scores[order], ids[order], known[order]


def _search_blocks(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        best = [none] * len(queries)

        def search(part: pa.Table) -> None:
            n = part["n"].to_numpy()
            ids = part["doc_id"].combine_chunks()
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            lists = part["terms"].combine_chunks()
            docs = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
            tf = part["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 10 + 90 * n * n_docs // n_terms
            impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
            block = Block(lists.flatten().to_numpy(), docs, impacts, len(n))
            for q, (_, terms) in enumerate(queries):
                found, scores = block.search(terms, weights[terms], k, best[q][0])
                good = scores > 0
                if good.any():
                    merged = (scores[good], ids[found[good]], known[found[good]])
                    best[q] = _ranked(*(np.concatenate(two) for two in zip(best[q], merged)), k)

        waiting, rows, postings = [], 0, 0
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            start = 0
            for end in range(1, batch.num_rows + 1):
                rows, postings = rows + 1, postings + int(sizes[end - 1])
                if rows >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    search(pa.Table.from_batches([*waiting, batch.slice(start, end - start)]))
                    waiting, rows, postings, start = [], 0, 0, end
            if start < batch.num_rows:
                waiting.append(batch.slice(start))
        if waiting:
            search(pa.Table.from_batches(waiting))
        for (number, _), (scores, ids, known) in zip(queries, best):
            if len(scores):
                columns = [pa.array(np.full(len(scores), number)), pa.array(ids, mask=~known), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return run


def _search_batch(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(query, doc_id, score): each task's ``k`` best documents of each query."""
    vocabulary = sorted({t for _, terms in queries for t in terms})
    number_of = {t.encode(): i for i, t in enumerate(vocabulary)}
    numbered = [(q, np.array([number_of[t.encode()] for t in terms], np.int32)) for q, terms in queries]
    held = written(docs.mapInArrow(_read_texts(number_of), POSTINGS).filter("n > 0"))
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    # as many rows as the batch has terms
    df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64
    )
    return held.filter(F.size("terms") > 0).mapInArrow(_search_blocks(numbered, weights, n_docs, n_terms or 1, k), FOUND)


def search(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    k: int = TOP,
    batch_terms: int = BATCH_TERMS,
) -> DataFrame:
    """The ``k`` best documents of each query with a score above 0: the query's id, ``rank``,
    the document's id and ``score``."""
    asked = query_terms(queries, query_id, query_text, batch_terms)
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("body"))
    docs = docs.filter(F.col("body").isNotNull())
    last = asked.agg(F.max("batch")).first()[0]
    found = []
    for batch in range(0 if last is None else last + 1):
        rows = asked.filter(F.col("batch") == batch).select("query", "terms").collect()
        if rows:
            found.append(_search_batch(docs, [(r["query"], r["terms"]) for r in rows], k))
    spark: SparkSession = df.sparkSession
    all_found = reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # a query's rows of all tasks meet in two steps
    some = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("query").orderBy(*order)
    all_found = all_found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
    ranked = all_found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
    ranked = ranked.join(asked.select("query", "item"), "query")
    return ranked.select(F.col("item").alias(query_id), "rank", F.col("doc_id").alias(id_col), "score")
