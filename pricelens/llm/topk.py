"""Exact top-k inner-product search in three phases with a uniform threshold.

A vector's components are split into ``slices``: each slice is a node that knows its part of
every score.  Nodes work on blocks: a task scores one block of queries against one block of
rows within one slice (a matrix product), and sends on only what the phase asks for.

1. Gather: each node sends the ``k`` + 1 greatest parts per query.  The rows named by any
   node are scored exactly; the k-th greatest of them is a safe cutoff, no final score is
   below it.
2. Collect: a score that reaches the cutoff has a part of at least cutoff / slices on some
   node (pigeonhole), so each node sends the parts that reach this uniform threshold.  A
   row's unsent parts are below it, which bounds its score from above; rows whose bound is
   below the cutoff are dropped.
3. Resolve: the remaining rows are scored exactly and the ``k`` best are kept.

Rows with equal vectors are one class, searched once, as are queries: a class stands for
its ``k`` + 1 smallest ids, which is all that any result can name.

Components are whole numbers (floor(scale * x)), scores exact: parts are computed in
double precision, whose sums are exact below 2^53 (checked; larger ones are an error).

Defined cases: vectors that are null, hold a null or a component that is not finite, or
differ in length from most (the longest common length) take no part, nor do null ids; ties
go to the smaller id; repeated ids are candidates each but a query is answered once per id;
with fewer candidates than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import written

SLICES = 2
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
EXACT = float(1 << 53)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): vectors of whole numbers of the rows that take part."""
    x = F.col("x").cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(df[id_col].alias("id"), df[vector_col].alias("x")).filter(F.col("id").isNotNull() & sound)
    return rows.select("id", F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(class, v, ids): distinct vectors, each with its ``keep`` smallest ids."""
    # a hot vector is thinned within salted parts first, then over the few ids that are left
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = Window.partitionBy("v", "salt").orderBy("id")
    part = part.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep)
    few = part.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, keep).alias("ids"))
    return few.select("v", "ids")


def _numbered(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with a number of their own, ``class``; an id may have several vectors."""
    return written(vectors.withColumn("class", F.monotonically_increasing_id()))


def _blocks(df: DataFrame, rows: int) -> int:
    return max(1, math.ceil(df.count() / rows))


def _pairs(queries: DataFrame, rows: DataFrame, emit, schema: str, slices: int, length: int) -> DataFrame:
    """``emit`` on every (query block, row block, slice): a task holds one of each."""
    row_blocks, query_blocks = _blocks(rows, BLOCK_ROWS), _blocks(queries, BLOCK_QUERIES)
    edges = [length * s // slices for s in range(slices + 1)]
    cut = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.slice("v", a + 1, b - a).alias("part")) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])).alias("c")
    number = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", number(query_blocks)).withColumn("rb", every(row_blocks)).select("*", cut).select("*", "c.s", "c.part").drop("c", "v")
    right = rows.withColumn("rb", number(row_blocks)).withColumn("qb", every(query_blocks)).select("class", "qb", "rb", cut).select("class", "qb", "rb", "c.s", "c.part")
    keys = ["qb", "rb", "s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(emit, schema)


def _parts(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    q, x = (np.array(d["part"].tolist(), float) for d in (left, right))
    return q @ x.T


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    slices: int = SLICES,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best rows of ``df`` for each row of
    ``queries``, without the row of the query's own id."""
    rows = whole_vectors(df, id_col, vector_col, scale)
    asked = whole_vectors(queries, id_col, vector_col, scale)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = length["n"] if length else 1
    slices = min(slices, length)
    rows, asked = rows.filter(F.size("v") == length), asked.filter(F.size("v") == length).distinct()
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0] or 0
    if float(largest) ** 2 * length >= EXACT:
        raise ValueError(f"components up to {largest} make scores that double precision can't hold exactly")
    keep = k + 1
    classes = _numbered(_classes(rows, keep)).select("class", "v", "ids")
    wanted = _numbered(asked.select("v").distinct()).select("class", "v")
    members = written(asked.join(wanted, "v").select("id", "class"))
    vectors = classes.select(F.col("class").alias("row"), F.col("v").alias("rv"), F.size("ids").alias("copies"))

    def gather(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "row": [], "part": [], "s": []})
        parts = _parts(left, right)
        n = min(keep, parts.shape[1])
        best = np.argpartition(-parts, n - 1, axis=1)[:, :n]
        return pd.DataFrame({
            "q": np.repeat(left["class"].to_numpy(), n),
            "row": right["class"].to_numpy()[best.ravel()],
            "part": np.take_along_axis(parts, best, 1).ravel(),
            "s": np.full(best.size, left["s"].iloc[0]),
        })

    named = _pairs(wanted, classes, gather, "q long, row long, part double, s int", slices, length)
    w = Window.partitionBy("q", "s").orderBy(F.desc("part"), "row")
    named = named.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("q", "row").distinct()
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    exact = written(_resolved(named, wanted, vectors))
    # the cutoff counts rows, not classes: a class fills as many places as it has ids; one
    # place more than k, for the query itself may be among them
    seen = exact.withColumn("places", F.sum("copies").over(by_score.rowsBetween(Window.unboundedPreceding, 0)))
    cutoff = seen.filter(F.col("places") >= keep).groupBy("q").agg(F.max("score").alias("cutoff"))
    bounded = wanted.join(cutoff, wanted["class"] == cutoff["q"], "left").select("class", "v", "cutoff")

    def collect(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "row": [], "part": []})
        parts = _parts(left, right)
        # without a cutoff (fewer rows than places) every row is sent
        least = left["cutoff"].astype(float).fillna(-np.inf).to_numpy() / slices
        a, b = np.nonzero(parts >= least[:, None])
        return pd.DataFrame({"q": left["class"].to_numpy()[a], "row": right["class"].to_numpy()[b], "part": parts[a, b]})

    sent = _pairs(bounded, classes, collect, "q long, row long, part double", slices, length)
    sent = sent.groupBy("q", "row").agg(F.sum("part").alias("known"), F.count("*").alias("nodes"))
    sent = sent.join(cutoff, "q", "left")
    # unsent parts are below cutoff / slices
    bound = F.col("known") + (slices - F.col("nodes")) * F.col("cutoff") / slices
    left_over = sent.filter(F.col("cutoff").isNull() | (bound >= F.col("cutoff"))).select("q", "row")
    best = _resolved(left_over, wanted, vectors)
    places = F.coalesce(F.sum("copies").over(by_score.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # rows of one score compete by id, so classes that tie with the last place stay as well
    last = Window.partitionBy("q")
    best = best.withColumn("before", places)
    best = best.withColumn("floor", F.min(F.when(F.col("before") < keep, F.col("score"))).over(last)).filter(F.col("score") >= F.col("floor"))
    found = best.join(classes.select(F.col("class").alias("row"), "ids"), "row").select("q", "score", F.explode("ids").alias("id"))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep).select("q", "score", "id")
    answers = members.select(F.col("id").alias("query_id"), F.col("class").alias("q")).join(found, "q").filter("query_id <> id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _resolved(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q, row, score, copies): exact scores of (q, row) pairs."""
    whole = pairs.join(queries.select(F.col("class").alias("q"), "v"), "q").join(vectors, "row")
    products = F.zip_with("v", "rv", lambda a, b: a * b)
    return whole.select("q", "row", F.aggregate(products, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("score"), "copies")
