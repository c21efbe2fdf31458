"""Toxicity by compression distance: zstandard dictionaries of ordinary and toxic text.

Two content dictionaries are trained on labelled texts.  The ordinary one holds stretches
of ordinary text.  The toxic one holds the same stretches and, in front, the byte strings
that toxic texts repeat and ordinary texts lack: the five-byte grams whose document
frequency in the toxic sample stands out against the ordinary sample are merged into the
stretches they cover.  (In the ordinary dictionary the place behind is filled with bytes
that occur in no text, so both have one size and offsets cost the same.)  A text is cut
into word-aligned windows of ``window`` bytes; each is compressed with either dictionary.
Shared language compresses alike, so the difference of the two lengths is what toxic
stretches save.  A stretch of dictionary text follows each window, so that zstandard never
falls back to storing it raw.  The differences of all windows of a whole text (greatest,
sums of the greatest, mean, share of windows with a saving) are calibrated to a
probability by logistic regression on the sample; the threshold is one half.

The fit reads at most ``sample_toxic`` and ``sample_ordinary`` labelled texts (the smallest
by a hash of the id), at most ``sample_chars`` of each, and near copies among them count
once: a bounded sample, whatever the corpus.  Scores read whole texts.

Defined cases: a null or empty text is scored as one empty window (a low score); a label
that is null or neither 0 nor 1 teaches nothing; a document with several labels is toxic if
any says so; with no toxic or no ordinary label every score is the share of toxic labels
(0 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import struct_array, text_or_empty, utf8
from pricelens.llm.simhash import fingerprints_of

GRAM = 5
FOLDS = 5
TAIL = 80


def windows(text: bytes, size: int) -> list[bytes]:
    """Word-aligned stretches of at least ``size`` bytes (the last may be shorter)."""
    out, held, n = [], [], 0
    for word in text.split():
        held.append(word)
        n += len(word) + 1
        if n >= size:
            out.append(b" ".join(held))
            held, n = [], 0
    if held:
        out.append(b" ".join(held))
    return out or [b""]


def _grams(text: bytes) -> np.ndarray:
    """Distinct grams of the text's words, as numbers."""
    b = np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes = np.zeros(n, np.uint64)
    for k in range(GRAM):
        codes = codes << np.uint64(8) | b[k : k + n]
    return np.unique(codes)


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([_grams(t) for t in texts]), return_counts=True)


def _without_near_copies(texts: list[bytes], bits: int = 8) -> list[bytes]:
    prints = fingerprints_of(texts, 3)
    kept: list[int] = []
    for k in range(len(texts)):
        if not kept or np.bitwise_count(prints[kept] ^ prints[k]).min() > bits:
            kept.append(k)
    return [texts[k] for k in kept]


def _stretches(texts: list[bytes], grams: set[int], size: int) -> bytes:
    """The stretches of words that the grams cover, the most frequent last, within ``size``."""
    found: Counter[bytes] = Counter()
    for text in texts:
        for word in text.split():
            w = b" " + word + b" "
            covered = bytearray(len(w))
            for k in range(len(w) - GRAM + 1):
                if int.from_bytes(w[k : k + GRAM], "big") in grams:
                    covered[k : k + GRAM] = b"\1" * GRAM
            at = 0
            for stretch in bytes(covered).split(b"\0"):
                if stretch:
                    found[w[at : at + len(stretch)]] += 1
                at += len(stretch) + 1
    return b"".join(s for s, n in sorted(found.items(), key=lambda x: (x[1], x[0])) if n > 1)[-size:]


@dataclass(frozen=True)
class Model:
    """What scoring needs; a few hundred kilobytes at most."""

    ordinary: bytes = b""
    toxic: bytes = b""
    tail: bytes = b""
    window: int = 48
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.0
    threshold: float = field(default=0.5)


@lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard as z

    flags = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    how = z.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=5, target_length=32, strategy=z.STRATEGY_LAZY, **flags)
    out = []
    for content in (ordinary, toxic):
        dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=how)
        out.append(z.ZstdCompressor(dict_data=dictionary, compression_params=how))
    return out


def savings(model: Model, text: bytes) -> np.ndarray:
    """Bytes that the toxic dictionary saves, window by window."""
    plain, toxic = (c.compress for c in _compressors(model.ordinary, model.toxic))
    cut = [w + model.tail for w in windows(text.lower(), model.window)]
    return np.array([len(plain(w)) - len(toxic(w)) for w in cut], float)


def _features(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.empty((len(texts), 7))
    for k, text in enumerate(texts):
        saved = np.sort(savings(model, text))[::-1]
        n = len(saved)
        out[k] = (saved[0], saved[:2].sum(), saved[:4].sum(), saved.mean(), (saved >= 3).mean(), min((saved >= 3).sum(), 8), np.log(n))
    return out


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability that each text is toxic."""
    if not model.weights:
        return np.full(len(texts), model.prior)
    x = (_features(model, texts) - model.mean) / model.scale
    return 1 / (1 + np.exp(-(x @ np.array(model.weights[:-1]) + model.weights[-1]).clip(-35, 35)))


def fit(toxic: list[str], ordinary: list[str], prior: float, window: int = 48, toxic_bytes: int = 12_000, ordinary_bytes: int = 20_000) -> Model:
    """Dictionaries and calibration out of labelled texts; ``prior``: share of toxic labels."""
    if not toxic or not ordinary:
        return Model(prior=prior)
    bad = _without_near_copies([t.encode().lower() for t in toxic])
    good = _without_near_copies([t.encode().lower() for t in ordinary])
    codes, counts = _frequencies(bad)
    known, known_counts = _frequencies(good)
    at = np.searchsorted(known, codes).clip(max=max(len(known) - 1, 0))
    seen = np.where(known[at] == codes, known_counts[at], 0) if len(known) else np.zeros(len(codes))
    expected = (seen + 1) * len(bad) / len(good)
    stands_out = (counts > 8 * expected) & (counts - expected > 4 * np.sqrt(expected + 1)) & (counts >= 0.005 * len(bad))
    found = _stretches(bad, set(codes[stands_out].tolist()), toxic_bytes)
    plain = [w for t in good for w in windows(t, 200)]
    order = np.random.default_rng(0).permutation(len(plain))
    shared = b" ".join(plain[k] for k in order[: 1 + ordinary_bytes // 150])[:ordinary_bytes]
    filler = np.random.default_rng(3).integers(0xF8, 0x100, len(found) + 1, dtype=np.uint8).tobytes()
    model = Model(ordinary=shared + filler, toxic=shared + b" " + found, tail=b" " + shared[-TAIL:], window=window, prior=prior)
    x = _features(model, bad + good)
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(y == 1, max(prior, 1e-6) / len(bad), max(1 - prior, 1e-6) / len(good)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, 1e-2), 1e-6]
    for _ in range(40):  # Newton's steps
        p = 1 / (1 + np.exp(-(x @ w).clip(-35, 35)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), slope)
    return Model(model.ordinary, model.toxic, model.tail, window, tuple(mean), tuple(scale), tuple(w), prior)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_toxic: int = 600,
    sample_ordinary: int = 2400,
    sample_chars: int = 20_000,
) -> Model:
    """A model from the labelled rows of ``df``; ``labels``: ids and labels to learn from."""
    told = labels.filter(labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("labelled_id")).agg(F.max(label_col).alias("label"))
    total, ill = told.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = float(ill) / total if total else 0.0
    order = F.xxhash64("labelled_id"), F.col("labelled_id")
    picked = told.filter("label = 1").orderBy(*order).limit(sample_toxic).union(told.filter("label = 0").orderBy(*order).limit(sample_ordinary))
    # bounded: sample_toxic + sample_ordinary ids
    texts = df.select(df[id_col].alias("labelled_id"), F.substring(text_or_empty(df, text_col), 1, sample_chars).alias("sample"))
    rows = texts.join(F.broadcast(picked), "labelled_id").distinct().collect()
    rows.sort(key=lambda r: (r["labelled_id"], r["sample"]))
    return fit([r["sample"] for r in rows if r["label"] == 1], [r["sample"] for r in rows if r["label"] == 0], prior)


def toxicity(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column of ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,predicted:int>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = scores(shared.value, utf8(batch))
            yield struct_array({"score": (pa.float64(), found.tolist()), "predicted": (pa.int32(), (found >= shared.value.threshold).astype(int).tolist())})

    return score(text_or_empty(df, text_col))


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % of


def train_outside_fold(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """A model from the labels whose ids are outside the held-out fold (remainder 0)."""
    return train(docs, labels.filter(fold(labels[id_col], FOLDS) != 0), id_col)
