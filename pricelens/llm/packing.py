"""Packing documents into training sequences by vector bin packing.

A piece is a vector: tokens, segments (one) and loss-bearing tokens.  A sequence has a
limit on each.  Pieces of full length make a sequence of their own; the others are placed
by the dot-product heuristic: an open sequence takes, again and again, the fitting piece
whose vector (as shares of the limits) has the greatest dot product with the room left.
When nothing fits whole and room is left on every limit, a piece is cut to fill it: pieces
may be cut anywhere, so a sequence closes full unless the segment limit closes it first.

Rows stay where they are: a task tokenizes and packs its own rows, window by window of
``window_pieces`` pieces, so nothing is shuffled and a task's memory is bounded.  What is
left of a task's last window is shorter than a sequence: it is cut into sequences whose
lengths are powers of two, which need no padding.  Sequence ids hold the task's partition
in the high bits; a task that runs again after a lost executor makes the same sequences.

Token ids are those of a byte-level BPE file of the ``tokenizers`` library.  Where the file
cuts texts by the usual pattern and every token is reached from its own bytes by the merges
(both are checked when it is read), merging the adjacent pair whose joined bytes have the
lowest id gives the same ids: a pair of tokens is never crossed by an earlier merge, so what
is between their ends was merged as if it stood alone.  Texts are then encoded whole by
``tiktoken`` with that file's own vocabulary; any other file is left to its own library.

Defined cases: a null or empty text is the closing id alone; a text of any length is cut;
ties go to the longer piece, then to the earlier one; repeated rows are packed each;
an empty table has no sequences.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pricelens.llm.common import text_or_empty

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

#: how a byte-level tokenizer cuts a text before it merges (fixed values), written so that
#: only a run of white space with a word behind it is matched going back
CUT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PLAIN_CUT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def spelled_bytes() -> dict[str, int]:
    """The character that spells a byte in a byte-level vocabulary -> that byte: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenIds:
    """Texts -> token ids as little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"added tokens of {path} are not plain literals")
        self.added = {t.content: array("I", [n]).tobytes() for n, t in added.items()}
        # the longest first, as the library takes them; no added tokens: a pattern that never matches
        self.literals = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")" if added else r"((?!))")
        # a byte-level token is spelled with a character for each byte, an added one by itself
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, n in self.tokenizer.get_vocab().items():
            self.n_bytes[n] = len(token)
        for n, token in added.items():
            self.n_bytes[n] = len(token.content.encode())
        self.ranked = self._ranked()

    def _ranked(self):
        """The same vocabulary as ranks, or None where equal ids aren't certain."""
        import tiktoken

        rules = json.loads(self.tokenizer.to_str())
        if any((rules["pre_tokenizer"] or {}).get(k) != v for k, v in PLAIN_CUT.items()) or any(rules["model"].get(k) != v for k, v in PLAIN_MODEL.items()):
            return None
        byte, model = spelled_bytes(), self.tokenizer.model
        vocab = rules["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in rules["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        reached = all(set(t) <= byte.keys() and [x.id for x in model.tokenize(t)] == [n] for t, n in vocab.items())
        # ids rank the merges, and what no merge makes is a single byte; all bytes are there
        ranks = {bytes(map(byte.get, t)): n for t, n in vocab.items()} if reached else {}
        if not reached or order != sorted(set(order)) or sum(len(t) == 1 for t in vocab) != 256 or len(vocab) != 256 + len(order):
            return None
        return tiktoken.Encoding("ranked", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return b"".join([self.added[part] if k % 2 else self._between(part) for k, part in enumerate(self.literals.split(text))])

    def bearing(self, text: str, ids: bytes, spans: list[dict] | None) -> bytes | None:
        """A byte for each id and one for the closing id: 1 if the token holds a byte of one of
        the spans of code points, for the closing id if the text's last byte is in one."""
        if spans is None:
            return None
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        step = np.zeros(int(byte_at[-1]) + 1, np.int64)
        for span in spans:
            if span is None or span["start"] is None or span["end"] is None:
                continue
            a, b = (min(max(span[k], 0), len(points)) for k in ("start", "end"))
            if a < b:
                step[byte_at[a]] += 1
                step[byte_at[b]] -= 1
        inside = np.cumsum(step[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(inside)])
        width = self.n_bytes[np.frombuffer(ids, np.uint32)]
        ends = np.cumsum(width)
        bears = (before[ends] > before[ends - width]).astype(np.uint8)
        return bears.tobytes() + bytes([len(inside) > 0 and bool(inside[-1])])

    def _between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of white space too long for its pattern's steps back
                pass
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass(slots=True)
class Piece:
    """``loss``: a byte for each token, 1 if the loss counts it; None: it counts all."""

    row: object
    start: int
    ids: bytes
    total: int
    loss: bytes | None = None

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss_tokens(self) -> int:
        return self.length if self.loss is None else sum(self.loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return (Piece(self.row, self.start, self.ids[: 4 * n], self.total, a), Piece(self.row, self.start + n, self.ids[4 * n :], self.total, b))


class Shelf:
    """Pieces that wait, by their vector; the dot-product choice runs over distinct vectors."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.queues: list[deque[Piece]] = []
        self.at: dict[tuple[int, int], int] = {}
        self.vectors = np.zeros((64, 2))
        self.left = np.zeros(64, np.int64)
        self.count = self.tokens = 0

    def put(self, piece: Piece) -> None:
        key = (piece.length, piece.loss_tokens)
        if key not in self.at:
            if len(self.at) == len(self.left):
                self._compact()
            self.at[key] = len(self.queues)
            self.vectors[len(self.queues)] = key
            self.queues.append(deque())
        k = self.at[key]
        self.queues[k].append(piece)
        self.left[k] += 1
        self.count += 1
        self.tokens += piece.length

    def _compact(self) -> None:
        """Forget vectors that no piece has any more; double the room if most are in use."""
        live = [(key, k) for key, k in self.at.items() if self.left[k]]
        size = max(64, 2 * len(live))
        vectors, left = np.zeros((size, 2)), np.zeros(size, np.int64)
        for n, (key, k) in enumerate(live):
            vectors[n], left[n] = key, self.left[k]
        self.queues = [self.queues[k] for _, k in live]
        self.at = {key: n for n, (key, _) in enumerate(live)}
        self.vectors, self.left = vectors, left

    def _take(self, k: int) -> Piece:
        self.left[k] -= 1
        self.count -= 1
        found = self.queues[k].popleft()
        self.tokens -= found.length
        return found

    def best(self, tokens: int, loss: int) -> Piece | None:
        """The fitting piece whose vector has the greatest dot product with the room left.
        Every piece is one segment, so that share is the same for all and moves no choice."""
        n = len(self.queues)
        v, lim = self.vectors[:n], self.limits
        score = v[:, 0] * (tokens / lim.tokens**2) + v[:, 1] * (loss / lim.loss_tokens**2)
        score[(v[:, 0] > tokens) | (v[:, 1] > loss) | (self.left[:n] <= 0)] = -1
        k = int(score.argmax()) if n else -1
        return None if k < 0 or score[k] < 0 else self._take(k)

    def shortest(self) -> Piece:
        n = len(self.queues)
        return self._take(int(np.where(self.left[:n] > 0, self.vectors[:n, 0], np.inf).argmin()))

    def fill(self, target: int) -> list[tuple[Piece, int]]:
        """One sequence of at most ``target`` tokens: its pieces and their offsets."""
        placed, at, loss = [], 0, self.limits.loss_tokens
        while at < target and len(placed) < self.limits.segments and self.count:
            piece = self.best(target - at, loss)
            if piece is None:
                piece = self.shortest()
                n = min(target - at, piece.length)
                if piece.loss is None:
                    n = min(n, loss)
                else:  # as far as the loss-bearing tokens fit
                    n = min(n, int(np.searchsorted(np.cumsum(np.frombuffer(piece.loss, np.uint8), dtype=np.int64), loss, "right")))
                if n <= 0:
                    self.put(piece)
                    break
                if n < piece.length:
                    piece, rest = piece.cut(n)
                    self.put(rest)
            placed.append((piece, at))
            at += piece.length
            loss -= piece.loss_tokens
        return placed


def sequences(pieces: Iterator[Piece], limits: Limits, window_pieces: int) -> Iterator[list[tuple[Piece, int]]]:
    """Sequences out of a stream of whole documents (as pieces of any length)."""
    shelf = Shelf(limits)
    for piece in pieces:
        while piece.length >= limits.tokens:
            whole, rest = piece.cut(limits.tokens)
            if whole.loss_tokens > limits.loss_tokens:
                half, whole = whole.cut(limits.tokens // 2)
                shelf.put(half)
                shelf.put(whole)
            else:
                yield [(whole, 0)]
            piece = rest
        if piece.length:
            shelf.put(piece)
        while shelf.count > window_pieces and shelf.tokens >= limits.tokens:
            yield shelf.fill(limits.tokens)
    while shelf.count:
        target = limits.tokens if shelf.tokens >= limits.tokens else 1 << (shelf.tokens.bit_length() - 1)
        yield shelf.fill(target)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    closing_id: int = 1,
    window_pieces: int = 2048,
    loss_col: str | None = None,
) -> DataFrame:
    """One row per piece: the id of its row, ``start`` (ids of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
    ``offset`` in that sequence.

    ``loss_col`` names an array of structs (``start``, ``end``): spans of code points of the
    text, end exclusive, whose tokens bear loss, as the answers of instruction data.  Spans may
    overlap, run past the text or be empty; a null array means that every token bears loss.
    Pieces then have ``loss`` too, a byte for each id.  Without the column every token bears
    loss.  A sequence that the loss limit closes is padded."""
    if limits.tokens < 1 or limits.segments < 1 or limits.loss_tokens < 1:
        raise ValueError("every limit is one or more")
    closing = np.array([closing_id], "<u4").tobytes()
    id_type = df.schema[id_col].dataType
    rows_per_batch = 4096

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_ids(tokenizer_path)
        kind = None

        def documents() -> Iterator[Piece]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                every = [None] * batch.num_rows if loss_col is None else batch.column(2).to_pylist()
                for row, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), every, strict=True):
                    ids = tokens.encode(text)
                    yield Piece(row, 0, ids + closing, len(ids) // 4 + 1, tokens.bearing(text, ids, spans))

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            row, start, length, ids, total, sequence, offset, loss = map(list, zip(*rows, strict=True))
            longs = [pa.array(x, pa.int64()) for x in (start, length, total, sequence, offset)]
            columns = [pa.array(row, kind), longs[0], longs[1], pa.array(ids, pa.binary()), *longs[2:]]
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            if loss_col is not None:
                columns.append(pa.array([b"\1" * n if x is None else x for x, n in zip(loss, length, strict=True)], pa.binary()))
                names.append("loss")
            return pa.RecordBatch.from_arrays(columns, names)

        sequence_id, rows = TaskContext.get().partitionId() << 40, []
        for placed in sequences(documents(), limits, window_pieces):
            rows += [(p.row, p.start, p.length, p.ids, p.total, sequence_id, offset, p.loss) for p, offset in placed]
            sequence_id += 1
            if len(rows) >= rows_per_batch:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    columns, schema = [df[id_col], text_or_empty(df, text_col).alias("packed_text")], f"`{id_col}` {id_type.simpleString()}, {PIECES}"
    if loss_col is not None:
        columns.append(df[loss_col].cast("array<struct<start: bigint, end: bigint>>").alias("packed_loss"))
        schema += ", loss binary"
    return df.select(*columns).mapInArrow(pack, schema)
