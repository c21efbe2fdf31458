"""SentencePiece encoding and decoding by a table of distinct chunks.

In a vocabulary where no piece has a character before a white-space marker, a piece
never crosses the border in front of a run of markers.  The normalized text (marker,
then the text with every space as a marker) is therefore a sequence of marked words - a
run of markers and what follows it up to the next marker - that the model segments
independently.  A task keeps a table of the distinct marked words it has met, segments
each once with the library, and joins ids (and decoded bytes) back by position.  The
table is bounded: at ``table_limit`` entries it starts anew, which costs time, never rows.

Defined cases: a null or empty text has the begin and end ids only and decodes to the
empty text; a literal marker character in a text is a space to the library and here; a
text of any length is handled whole; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import struct_array, text_or_empty

MARK = "▁"
TABLE_LIMIT = 400_000

MARKED_WORD = re.compile(r" +[^ ]*")
ROUND_TRIP = "struct<n_tokens:bigint,ids:binary,decoded:string>"


class ChunkTable:
    """Distinct marked words -> (ids as little-endian unsigned 32-bit, decoded UTF-8)."""

    def __init__(self, model_path: str, limit: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = limit
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.lone_mark = [self.sp.piece_to_id(MARK)]
        self.begin = np.array([self.sp.bos_id()], "<u4").tobytes()
        self.end = np.array([self.sp.eos_id()], "<u4").tobytes()
        if any(MARK in p.lstrip(MARK) for p in map(self.sp.id_to_piece, range(self.sp.get_piece_size()))):
            raise ValueError(f"pieces of {model_path} cross white-space markers")

    def add(self, words: list[str]) -> None:
        """Segment the words that the table lacks; a full table starts anew with these words."""
        missing = {w for w in words if w not in self.table}
        if len(self.table) + len(missing) > self.limit:
            self.table.clear()
            missing = set(words)
        todo = list(missing)
        # the library puts a marker in front of what it encodes: it stands for the word's first
        segmented = self.sp.encode([w[1:] for w in todo], num_threads=1)
        for word, ids in zip(todo, segmented, strict=True):
            ids = ids if word != " " else self.lone_mark
            # its decoder drops one leading marker, the first of the word
            self.table[word] = (np.array(ids, "<u4").tobytes(), b" " + self.sp.decode(ids).encode())

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids with begin and end, and the text that they decode to."""
        if not text:
            return self.begin + self.end, ""
        words = MARKED_WORD.findall(" " + text.replace(MARK, " "))
        try:
            found = [self.table[w] for w in words]
        except KeyError:
            self.add(words)
            found = [self.table[w] for w in words]
        ids = b"".join([x[0] for x in found])
        return self.begin + ids + self.end, b"".join([x[1] for x in found])[1:].decode()


@lru_cache(maxsize=2)
def chunk_table(model_path: str, limit: int) -> ChunkTable:
    """One table for a worker process, kept from task to task."""
    return ChunkTable(model_path, limit)


def round_trip(df: DataFrame, model_path: str, text_col: str = "text", table_limit: int = TABLE_LIMIT) -> Column:
    """Column of ``n_tokens``, ``ids`` (little-endian unsigned 32-bit, with begin and end)
    and ``decoded`` for each text of ``df``."""

    @F.arrow_udf(ROUND_TRIP)
    def segment(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = chunk_table(model_path, table_limit)
        for batch in batches:
            ids, decoded = zip(*map(table.round_trip, batch.to_pylist()), strict=True) if len(batch) else ((), ())
            yield struct_array({
                "n_tokens": (pa.int64(), [len(x) // 4 for x in ids]),
                "ids": (pa.binary(), list(ids)),
                "decoded": (pa.string(), list(decoded)),
            })

    return segment(text_or_empty(df, text_col))


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``n_tokens``, ``ids`` and ``decoded``."""
    return df.select(df[id_col], round_trip(df, model_path, text_col).alias("trip")).select(id_col, "trip.*")
