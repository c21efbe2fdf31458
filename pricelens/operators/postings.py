"""The two kinds of retrieval blocks: postings of trigrams and tokens, and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions import lexical as LX
from pricelens.operators.blocks import Arrays, BlockKind

#: bounds are raised by this much, more than sums of doubles can be off
SLACK = 1e-9
#: a block of texts holds at most about this many characters (or one document), so what building
#: it takes doesn't grow with the documents that happen to be the longest of their group
BLOCK_CHARS = 1 << 20
#: numbers of a block's documents fit one byte
MOST_DOCS = 256


def _postings(docs: np.ndarray, words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, offsets, documents, sizes) out of (document, word) rows and the words' trigram
    codes, ``lengths`` of each word: for each distinct code the documents that hold it, and how many each document has."""
    pair = np.unique(docs * len(lengths) + words)
    docs, words = np.divmod(pair, max(len(lengths), 1))
    known, number = np.unique(codes, return_inverse=True)
    ends = np.cumsum(lengths)
    size = lengths[words]
    # the codes of each pair's word, one after the other
    at = np.arange(size.sum()) + np.repeat((ends - lengths)[words] - np.cumsum(size) + size, size)
    held = np.unique(number[at] * n + np.repeat(docs, size))
    code, docs = np.divmod(held, max(n, 1))
    used, first = np.unique(code, return_index=True)
    return known[used], np.append(first, len(code)), docs, np.bincount(docs, minlength=n)


def _held(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted ``codes`` of those ``wanted`` that are there."""
    at = np.searchsorted(codes, wanted)
    there = at < len(codes)
    at, wanted = at[there], wanted[there]
    return at[codes[at] == wanted]


class LexicalBlocks(BlockKind):
    """Score: ``w_cover`` x cover density of all query tokens (symptom + evidence) plus
    ``w_trigram`` x the greater trigram similarity to either text.

    A block has, per text, postings from trigrams to documents and the documents' numbers of
    trigrams, and the documents' tokens as numbers (two low bytes and two high ones apart, for the
    latter are mostly zero), from which a task makes postings to their places.  Its bound: a document
    shares at most the query trigrams that the block knows, and has at least as many trigrams
    as the block's smallest; the covers of the few documents that hold every query token, found
    through the token postings, are exact.  Documents of like size share a block, so long ones,
    which can't be similar to a short query, are bounded low."""

    arrays = {
        "s_codes": "<i8", "e_codes": "<i8", "least": "<i4", "words": "u1",
        "s_from": "<i4", "s_docs": "u1", "s_size": "<i4", "e_from": "<i4", "e_docs": "u1", "e_size": "<i4",
        "t_low": "<u2", "t_high": "<u2", "d_from": "<i4",
    }
    doc_columns = ["symptom_text", "evidence_text"]
    query_column = "query_text"

    def __init__(self, w_cover: float, w_trigram: float):
        self.w_cover, self.w_trigram = w_cover, w_trigram

    def weight(self, content: Column) -> Column:
        return F.octet_length(content)

    def arranged(self, docs: dict[str, list], size: int) -> list[np.ndarray]:
        texts = list(zip(docs["symptom_text"], docs["evidence_text"]))
        order = np.argsort([min(len(s), len(e)) for s, e in texts], kind="stable")
        blocks, first, held = [], 0, 0
        for at, d in enumerate(order):
            chars = len(texts[d][0]) + len(texts[d][1])
            if at > first and (at - first == min(size, MOST_DOCS) or held + chars > BLOCK_CHARS):
                blocks.append(np.sort(order[first:at]))
                first, held = at, 0
            held += chars
        return [*blocks, np.sort(order[first:])] if len(order) else []

    def build(self, docs: dict[str, list]) -> Arrays:
        n = len(docs["symptom_text"])
        met: dict[str, int] = {}
        rows = {}
        for side, column in (("s", "symptom_text"), ("e", "evidence_text")):
            texts = [[met.setdefault(w, len(met)) for w in LX.tokens(t)] for t in docs[column]]
            rows[side] = np.repeat(np.arange(n), [len(t) for t in texts]), np.array([w for t in texts for w in t], np.int64)
        words = sorted(met)
        sorted_number = np.empty(len(met), np.int64)
        sorted_number[[met[w] for w in words]] = np.arange(len(met))
        codes, lengths = LX.word_codes(list(met))
        found: Arrays = {}
        for side, (doc, word) in rows.items():
            found[f"{side}_codes"], found[f"{side}_from"], found[f"{side}_docs"], found[f"{side}_size"] = _postings(doc, word, codes, lengths, n)
        # a document's tokens: the symptom's, then the evidence's
        doc_of = np.concatenate([rows["s"][0], rows["e"][0]])
        by_doc = np.argsort(doc_of, kind="stable")
        doc_of, flat = doc_of[by_doc], sorted_number[np.concatenate([rows["s"][1], rows["e"][1]])[by_doc]]
        d_from = np.append(0, np.cumsum(np.bincount(doc_of, minlength=n)))
        least = [found["s_size"].min(), found["e_size"].min()]
        joined = np.frombuffer("\n".join(words).encode(), np.uint8)
        return found | {"least": np.array(least), "words": joined, "t_low": flat & 0xFFFF, "t_high": flat >> 16, "d_from": d_from}

    def opened(self, block: Arrays) -> Arrays:
        words = block["words"].tobytes().decode()
        numbers = {w: k for k, w in enumerate(words.split("\n"))} if words else {}
        tokens = block["t_low"].astype(np.int32) | block["t_high"].astype(np.int32) << 16
        places = np.argsort(tokens, kind="stable").astype(np.int32)
        starts = np.searchsorted(tokens[places], np.arange(len(numbers) + 1))
        return block | {"numbers": numbers, "w_from": starts, "w_place": places}

    def bound(self, query: str, block: Arrays) -> float:
        codes = LX.trigram_codes(query)
        similar = 0.0
        for side, least in zip("se", block["least"]):
            shared = len(_held(block[f"{side}_codes"], codes))
            if shared:
                similar = max(similar, shared / (len(codes) + max(int(least) - shared, 0)))
        return self.w_trigram * similar + SLACK * (similar > 0) + max(self._covers(query, block).values(), default=0.0)

    def scores(self, query: str, block: Arrays, n: int) -> np.ndarray:
        codes = LX.trigram_codes(query)
        similar = np.zeros(n)
        for side in "se":
            starts = block[f"{side}_from"]
            lists = [block[f"{side}_docs"][starts[k] : starts[k + 1]] for k in _held(block[f"{side}_codes"], codes)]
            if lists:
                shared = np.bincount(np.concatenate(lists), minlength=n).astype(np.float64)
                similar = np.maximum(similar, shared / (len(codes) + block[f"{side}_size"] - shared))
        found = self.w_trigram * similar
        for d, cover in self._covers(query, block).items():
            found[d] += cover
        return found

    def _covers(self, query: str, block: Arrays) -> dict[int, float]:
        """The weighted cover density of the documents that hold every token of the query."""
        terms = [block["numbers"].get(t) for t in dict.fromkeys(LX.tokens(query))]
        if not self.w_cover or not terms or None in terms:
            return {}
        places = [block["w_place"][block["w_from"][t] : block["w_from"][t + 1]] for t in terms]
        docs = [np.searchsorted(block["d_from"], p, "right") - 1 for p in places]
        everywhere = np.unique(min(docs, key=len))
        for held in docs:
            everywhere = everywhere[np.isin(everywhere, held)]
        found = {}
        for d in everywhere:
            occurrences = sorted((int(p), k) for k in range(len(terms)) for p in places[k][docs[k] == d])
            found[int(d)] = self.w_cover * LX.covers(occurrences, len(terms))
        return found


class VectorBlocks(BlockKind):
    """Score: cosine similarity; null where either vector is null, zero, or of another length.

    A group's vectors are dealt to the nearest of some of them, taken far from one another, so
    a block is a narrow cone: with the angle between query and the block's mean direction, less
    the widest angle in the block, no document's angle is smaller."""

    arrays = {"centre": "<f8", "radius": "<f8", "lengths": "<i4", "values": "<f8"}
    doc_columns = ["embedding"]
    query_column = "qvec"

    def weight(self, content: Column) -> Column:
        return F.when(content.isNotNull(), 8 * F.size(content))

    def arranged(self, docs: dict[str, list], size: int) -> list[np.ndarray]:
        vectors = [np.array(v or (), np.float64) for v in docs["embedding"]]
        alike = np.zeros(len(vectors), np.int64)  # null and zero vectors: class 0
        lengths = np.array([len(v) if np.linalg.norm(v) > 0 else 0 for v in vectors])
        for length in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == length)
            units = np.stack([vectors[r] for r in rows])
            units /= np.linalg.norm(units, axis=1)[:, None]
            pivot, nearest, at = 0, np.full(len(rows), -2.0), np.zeros(len(rows), np.int64)
            for p in range(-(-len(rows) // size)):
                near = units @ units[pivot]
                at[near > nearest] = p
                nearest = np.maximum(nearest, near)
                pivot = int(nearest.argmin())
            alike[rows] = alike.max() + 1 + at
        order = np.argsort(alike, kind="stable")
        runs = np.split(order, np.flatnonzero(np.diff(alike[order])) + 1)
        return [np.sort(run[k : k + size]) for run in runs for k in range(0, len(run), size)]

    def build(self, docs: dict[str, list]) -> Arrays:
        vectors = [np.array(v or (), np.float64) for v in docs["embedding"]]
        lengths = np.array([len(v) for v in vectors])
        units = [v / n for v in vectors if (n := np.linalg.norm(v)) > 0]
        centre, radius = np.zeros(0), np.array([np.inf])  # no cone: anything is possible
        if units and len({len(u) for u in units}) == 1:
            mean = np.mean(units, axis=0)
            if (n := np.linalg.norm(mean)) > 1e-6:
                centre = mean / n
                radius = np.array([np.arccos(np.clip(np.stack(units) @ centre, -1, 1)).max()])
        elif not units:
            radius = np.array([np.nan])  # null scores only
        return {"centre": centre, "radius": radius, "lengths": lengths, "values": np.concatenate(vectors) if vectors else np.zeros(0)}

    def bound(self, query: list | None, block: Arrays) -> float:
        vector = np.array(query or (), np.float64)
        centre, radius = block["centre"], block["radius"][0]
        norm = np.linalg.norm(vector)
        if not norm > 0 or np.isnan(radius) or (len(centre) and len(centre) != len(vector)):
            return np.nan
        angle = np.arccos(np.clip(centre @ vector / norm, -1, 1)) if len(centre) else 0.0
        return np.cos(max(angle - radius, 0.0)) + SLACK

    def scores(self, query: list | None, block: Arrays, n: int) -> np.ndarray:
        found = np.full(n, np.nan)
        vector = np.array(query or (), np.float64)
        if not (own := np.linalg.norm(vector)) > 0:
            return found
        lengths = block["lengths"]
        rows = np.flatnonzero(lengths == len(vector))
        if len(rows):
            at = (np.cumsum(lengths) - lengths)[rows][:, None] + np.arange(len(vector))
            matrix = block["values"][at]
            norms = np.linalg.norm(matrix, axis=1)
            # row by row, so that equal vectors score equal in any block
            products = (matrix * vector).sum(axis=1)
            found[rows] = np.divide(products, own * norms, out=np.full(len(rows), np.nan), where=norms > 0)
        return found
