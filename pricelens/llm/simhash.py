"""SimHash near-duplicates with pivot distance tables.

Fingerprints: each shingle's hash votes on every bit; equal fingerprints are one class, so
copies never meet each other as rows.  Classes link at ``max_bits`` or fewer differing bits.

Search.  The 64 bits are split into ``max_bits`` + 2 blocks.  Fingerprints within
``max_bits`` bits agree on at least two whole blocks, so each class goes into one bucket per
pair of blocks (for three bits: ten keys of about 25 bits) and every link lies inside at
least one bucket.  Inside a bucket a
pivot distance table holds each fingerprint's Hamming distance to many reference
fingerprints.  By the triangle inequality the distance of two fingerprints is at least the
greatest difference of their coordinates: rows are sorted by the first coordinate, a row
is compared only with the stretch whose first coordinate is within ``max_bits``, pairs
whose any other coordinate differs more are discarded, and the survivors are verified bit
by bit.  A bucket sends on one link per fingerprint that it joins to an earlier one (a
spanning forest of the links found), never its pairs.

Buckets of near copies may be large: a bucket is dealt out in ``tile_rows``-sized parts,
each compared with itself and with the earlier parts, one pair of parts a task at most.

Components are found by minimum labels with pointer jumping over those links, a reliable
checkpoint a round; nothing is gathered on the driver.

Defined cases: null and empty texts (and texts of white space) have fingerprint zero, which
links like any other; fewer words than the shingle length make one shingle; repeated rows
and ids each keep their row, with the component of their fingerprint; a null id takes no
part in the choice of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import free_name, text_or_empty, utf8, written
from pricelens.llm.components import components

BITS = 64
SEED = 42
#: reference fingerprints of the pivot table: any will do, these are drawn once
PIVOTS = np.random.default_rng(7).integers(0, 2**64, 16, dtype=np.uint64)
TILE_ROWS = 8192
SCAN_ROWS = 1 << 16


def fingerprints_of(texts: list[bytes], shingle_words: int) -> np.ndarray:
    """SimHash of each UTF-8 text as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    hashes, sizes = [], []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
        n = len(words)
        if n <= shingle_words:
            if n:
                hashes.append(xxh64_intdigest(b" ".join(words), SEED))
            sizes.append(min(n, 1))
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - shingle_words] + 1).tolist()]
        hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)]
        sizes.append(n - shingle_words + 1)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    bits = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[full]
    votes = np.empty((len(full), BITS), np.int64)
    for byte in range(8):  # a byte at a time: the unpacked bits of a long text stay small
        votes[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(bits[:, byte : byte + 1], axis=1), first, axis=0, dtype=np.int64)
    won = np.packbits(2 * votes > sizes[full, None], axis=1)
    out[full] = np.ascontiguousarray(won).view(">u8").reshape(-1).astype(np.uint64)
    return out


def fingerprint(df: DataFrame, text_col: str = "text", shingle_words: int = 3) -> Column:
    """Column with each whole text's fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = utf8(batch)
            found = [fingerprints_of(texts[k : k + 256], shingle_words) for k in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())

    return simhash(text_or_empty(df, text_col))


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``max_bits`` + 2 blocks that cover all bits."""
    edges = [BITS * k // (max_bits + 2) for k in range(max_bits + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def bucket_keys(fp: Column, max_bits: int) -> Column:
    """Array of one bucket per pair of blocks: both blocks' bits and the pair's number."""
    parts = [F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in blocks(max_bits)]
    widest = max(width for _, width in blocks(max_bits))
    keys = []
    for n, (a, b) in enumerate(combinations(parts, 2)):
        pair = F.shiftleft(a, widest).bitwiseOR(b)
        keys.append(pair.bitwiseOR(F.lit(n << 2 * widest)) if 2 * widest + 8 < 63 else F.xxhash64(pair, F.lit(n)))
    return F.array(*keys)


def links_of_buckets(bucket: np.ndarray, tile: np.ndarray, within: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets (equal numbers in ``bucket``) that join what was not joined yet.
    ``within``: rows of one tile are compared; else only those of different tiles."""
    alike = np.flatnonzero(np.bincount(bucket)[bucket] > 1)  # the others meet no one
    alike = alike[np.lexsort((np.bitwise_count(fps[alike] ^ PIVOTS[0]), bucket[alike]))]
    bucket, tile, within, fps = bucket[alike], tile[alike], within[alike], fps[alike]
    table = [np.bitwise_count(fps ^ p).astype(np.int16) for p in PIVOTS]
    label, left, right = np.arange(len(fps)), [], []
    i, lag = np.arange(len(fps)), 0
    while True:
        lag += 1
        i = i[i + lag < len(fps)]
        # sorted by the first coordinate: who is too far at this lag is too far at the next
        i = i[(bucket[i] == bucket[i + lag]) & (table[0][i + lag] - table[0][i] <= max_bits)]
        if not len(i):
            break
        a = i[within[i] | (tile[i] != tile[i + lag])]
        for coordinate in table[1:]:
            a = a[np.abs(coordinate[a] - coordinate[a + lag]) <= max_bits]
        a = a[np.bitwise_count(fps[a] ^ fps[a + lag]) <= max_bits]
        a = a[label[a] != label[a + lag]]
        for x in a.tolist():
            u, v = x, x + lag
            while label[u] != u:
                u = label[u]
            while label[v] != v:
                v = label[v]
            if u != v:
                label[max(u, v)] = min(u, v)
                left.append(x)
                right.append(x + lag)
        if len(a):
            while (label[label] != label).any():
                label = label[label]
    return fps[left], fps[right]


def near_links(classes: DataFrame, max_bits: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of ``classes.fp`` that keep its
    components: two fingerprints are connected by links if and only if they are connected
    by steps of at most ``max_bits`` differing bits."""
    rows = classes.select("fp", F.explode(bucket_keys(F.col("fp"), max_bits)).alias("bucket"))
    large = rows.groupBy("bucket").count().filter(F.col("count") > tile_rows)
    large = large.select("bucket", F.ceil(F.col("count") / tile_rows).alias("tiles"))
    dealt = rows.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("bigint")))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    dealt = dealt.select(
        "bucket",
        (F.least("tile", "other") * F.col("tiles") + F.greatest("tile", "other")).alias("part"),
        "tile",
        (F.col("tile") == F.col("other")).alias("own"),
        "fp",
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            bucket, part, tile, own, fps = columns
            border = np.ones(len(fps), np.int64)
            border[1:] = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
            number = np.cumsum(border)
            # a part of one tile holds that tile's rows only; of two tiles, both
            mixed = np.zeros(number[-1] + 1, bool)
            mixed[number[~own]] = True
            a, b = links_of_buckets(number, tile, ~mixed[number], fps.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held.append(columns)
            count += len(columns[0])
            if count < SCAN_ROWS:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            # the last bucket may go on in the next batch
            open_from = int(np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])).max(initial=-1)) + 1
            if open_from:
                yield links([c[:open_from] for c in columns])
            held = [[c[open_from:] for c in columns]]
            count = len(columns[0]) - open_from
        if count:
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(scan, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per row of ``df``: its id, ``fp`` (signed 64-bit) and ``component_id``, the
    smallest id that is reachable over links."""
    prints = written(df.select(df[id_col], fingerprint(df, text_col, shingle_words).alias("fp")))
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("smallest")))
    member = components(near_links(classes, max_bits))  # node, root: of linked classes only
    linked = classes.join(member.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_class = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_class, "fp", "left").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``df``, all columns, with one row of each component: that of the smallest
    id (the one with the least text, if several rows have that id).  Rows with a null id
    can't be named and all stay."""
    found = near_duplicates(df, id_col, text_col, shingle_words, max_bits)
    kept = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("kept_id")).distinct()
    stay = df.join(kept, df[id_col] == kept["kept_id"], "left_semi")
    nth = free_name(df, "nth_of_id")
    stay = stay.withColumn(nth, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col)))
    return stay.filter(F.col(nth) == 1).drop(nth).union(df.filter(df[id_col].isNull()))
