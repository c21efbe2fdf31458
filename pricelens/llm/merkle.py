"""Merkle manifest of a dataset: a tree of digests per group, proofs, and folding.

A leaf is the SHA-256 of a row's fields.  In each group the leaves stand in a given order;
every ``arity`` consecutive nodes become their digest until one is left, the subroot; the
subroots, in group order, become the root in the same way.  A digest enters its parent as
lower-case hex text.

A parent keeps a copy of its SHA-256 state before each child's slot.  To fold another digest
up, the state of the slot is copied and goes on with that digest and the siblings to the right
only; what stands to the left is never hashed again.

The tree is built in blocks of arity ** levels consecutive nodes, one group of a task each, so
a pass over the table rises ``levels`` levels and the next pass has a block's root where the
one before had a block.  States live in the task that owns a block; for the levels above, a
block gets the siblings on its way to the root and makes those states once for all its leaves.

Cases: a null field counts as ``-``; rows with a null order value come first; equal order
values stand in leaf order; a null group is a group and the first; one row or one group is its
own subroot or root, with an empty proof; an empty table gives an empty result.  Extra columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import written
from pricelens.llm.order import joined_by_key, placed

ARITY = 2
LEVELS = 10  # 1,024 leaves a block

STEP = "array<struct<left:array<string>,right:array<string>>>"
#: a slot's state, the siblings to its left and to its right
Slot = tuple["hashlib._Hash", list[bytes], list[bytes]]


def fields_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields, each ``-`` if null, else its UTF-8 length, ``:``, itself."""

    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[one(f) for f in fields]), 256)


def parent_of(children: list[bytes]) -> tuple[bytes, list[Slot]]:
    """A parent's digest, and per child its slot with the state before it."""
    state, slots = hashlib.sha256(), []
    for k, child in enumerate(children):
        slots.append((state.copy(), children[:k], children[k + 1 :]))
        state.update(child)
    return state.hexdigest().encode(), slots


def raised(nodes: list[bytes], arity: int, levels: int, whole: bool) -> tuple[list[list[list[Slot]]], list[bytes]]:
    """The slots of the parents, level by level from below, and the nodes on top: after
    ``levels`` levels, or when one is left of a tree that is ``whole`` here."""
    tree = []
    while len(tree) < levels and not (whole and len(nodes) == 1):
        parents = [parent_of(nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        nodes = [digest for digest, _ in parents]
        tree.append([slots for _, slots in parents])
    return tree, nodes


def way_up(tree: list[list[list[Slot]]], place: int, arity: int) -> Iterator[Slot]:
    """The slots that a node at ``place`` of its block and its ancestors stand in."""
    for parents in tree:
        place, slot = divmod(place, arity)
        yield parents[place][slot]


def fold(digest: bytes, way: Iterable[Slot]) -> bytes:
    """What the top becomes with ``digest`` at the start of the way."""
    for state, _, right in way:
        resumed = state.copy()
        resumed.update(digest)
        for sibling in right:
            resumed.update(sibling)
        digest = resumed.hexdigest().encode()
    return digest


def slots_of(steps: list[dict]) -> list[Slot]:
    """The slots of a block's ancestors, whose states are made of the siblings to the left."""
    found = []
    for step in steps:
        left, right = ([s.encode() for s in step[side]] for side in ("left", "right"))
        found.append((hashlib.sha256(b"".join(left)), left, right))
    return found


def _nodes(block: pa.Table) -> list[bytes]:
    return [d.encode() for d in block["digest"].to_pylist()]


def _is_whole(block: pa.Table, arity: int, levels: int) -> bool:
    return block["nodes"][0].as_py() <= arity**levels


def _block_roots(arity: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        _, top = raised(_nodes(block), arity, levels, _is_whole(block, arity, levels))
        return block.select(["tree", "block"]).slice(0, 1).append_column("digest", pa.array([top[0].decode()]))

    return run


def _steps(arity: int, levels: int):
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree, _ = raised(_nodes(block), arity, levels, _is_whole(block, arity, levels))
        ways = [
            [
                {"left": [s.decode() for s in left], "right": [s.decode() for s in right]}
                for _, left, right in way_up(tree, k, arity)
            ]
            for k in range(block.num_rows)
        ]
        siblings = pa.list_(pa.string())
        kind = pa.list_(pa.struct([("left", siblings), ("right", siblings)]))
        return block.select(["tree", "place"]).append_column("steps", pa.array(ways, kind))

    return run


def climb(nodes: DataFrame, width: int, arity: int, levels: int) -> tuple[DataFrame, DataFrame | None]:
    """The top digest of each tree (tree, digest), and per block of ``arity ** levels`` nodes of
    the first pass the steps from its root to the top (tree, block, steps).  ``nodes`` has tree,
    place, digest and the tree's number of ``nodes``, at most ``width``."""
    size = arity**levels
    passes = []
    while True:
        nodes = nodes.withColumn("block", F.expr(f"place div {size}"))
        passes.append(nodes)
        tops = written(
            nodes.groupBy("tree", "block").applyInArrow(_block_roots(arity, levels), "tree long, block long, digest string")
        )
        if width <= size:
            break
        width = -(-width // size)
        counts = tops.groupBy("tree").agg(F.count("*").alias("nodes"))
        nodes = joined_by_key(tops.withColumnRenamed("block", "place"), counts, "tree", "place")
    ways = None
    for level in reversed(passes[1:]):
        made = level.groupBy("tree", "block").applyInArrow(_steps(arity, levels), f"tree long, place long, steps {STEP}")
        made = made.withColumn("block", F.expr(f"place div {size}"))
        if ways is not None:
            above = ways.select("tree", "block", F.col("steps").alias("above"))
            made = made.join(above, ["tree", "block"]).withColumn("steps", F.concat("steps", "above"))
        ways = written(made.select("tree", F.col("place").alias("block"), "steps"))
    return tops.select("tree", "digest"), ways


def _proofs(arity: int, levels: int):
    def run(leaves: pa.Table, way: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("place")
        tree, _ = raised(_nodes(leaves), arity, levels, _is_whole(leaves, arity, levels))
        above = slots_of(way["steps"][0].as_py())
        proofs, folded = [], []
        for k, new in enumerate(pc.coalesce(leaves["other"], leaves["digest"]).to_pylist()):
            up = [*way_up(tree, k, arity), *above]
            proofs.append([s.decode() for _, left, right in up for s in (*left, *right)])
            folded.append(fold(new.encode(), up).decode())
        tops = {name: pa.repeat(way[name][0], leaves.num_rows) for name in ("subroot", "root")}
        made = {"proof": pa.array(proofs, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string())}
        return pa.table({"id": leaves["id"], "leaf": leaves["digest"], **made, **tops})

    return run


def manifest(
    df: DataFrame,
    leaf: Column,
    other: Column | None = None,
    group_col: str = "lang",
    id_col: str = "doc_id",
    arity: int = ARITY,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``df``: its id, ``leaf``, ``proof`` (the siblings on the way to the
    root, from below, left to right), ``folded_root`` (what the root becomes with the digest
    ``other`` in the leaf's place, or with the leaf where that is null), ``subroot`` and
    ``root``.  ``leaf`` and ``other`` are digests made of the columns of ``df``; a group's
    leaves stand in order of the id."""
    kind = df.schema[id_col].dataType
    rows = df.select(
        df[id_col].alias("id"),
        df[group_col].alias("key"),
        leaf.alias("digest"),
        (F.lit(None).cast("string") if other is None else other).alias("other"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = placed(written(rows), [F.col(c) for c in ("key", "id", "digest", "tie")])
    trees = rows.groupBy("key").agg(F.count("*").alias("nodes"), F.min("place").alias("first"))
    trees = written(placed(trees, [F.col("key")]).withColumnRenamed("place", "tree"))
    n_trees, width = trees.agg(F.count("*"), F.max("nodes")).first()
    rows = joined_by_key(rows, trees, "key", "tie").withColumn("place", F.col("place") - F.col("first"))
    rows = written(rows.select("id", "tree", "nodes", "place", "digest", "other"))

    subroots, ways = climb(rows.drop("id", "other"), width or 0, arity, levels)
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    top = written(top.withColumn("nodes", F.lit(n_trees).cast("long")))
    roots, top_ways = climb(top, n_trees, arity, levels)

    # a subroot's way up: inside its block of subroots, then from the block to the root
    size = arity**levels
    nodes = top.withColumn("block", F.expr(f"place div {size}"))
    way = nodes.groupBy("tree", "block").applyInArrow(_steps(arity, levels), f"tree long, place long, steps {STEP}")
    if top_ways is not None:
        above = top_ways.withColumnRenamed("steps", "above")
        way = way.withColumn("block", F.expr(f"place div {size}")).join(above, ["tree", "block"])
        way = way.withColumn("steps", F.concat("steps", "above"))
    way = way.join(roots.withColumnRenamed("digest", "root"), "tree").select(F.col("place").alias("tree"), "steps", "root")
    way = written(way.join(subroots.withColumnRenamed("digest", "subroot"), "tree"))
    # a block's way up: from its root to the subroot, then on
    if ways is None:  # no tree has more than one block
        way = way.withColumn("block", F.lit(0).cast("long"))
    else:
        way = joined_by_key(ways.withColumnRenamed("steps", "below"), way, "tree", "block")
        way = way.withColumn("steps", F.concat("below", "steps")).drop("below")
    out = f"id {kind.simpleString()}, leaf string, proof array<string>, folded_root string, subroot string, root string"
    rows = rows.withColumn("block", F.expr(f"place div {size}"))
    found = rows.groupBy("tree", "block").cogroup(way.groupBy("tree", "block")).applyInArrow(_proofs(arity, levels), out)
    return found.withColumnRenamed("id", id_col)
