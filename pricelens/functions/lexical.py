"""In-task lexical scoring helpers (numpy/pandas inside Spark tasks).

Definitions (ours, after the PostgreSQL documentation):
* tokens: lower-case runs of letters/digits; positions count every token.
* cover density: the query is conjunctive (a document missing a query token scores 0);
  every minimal window of positions holding all distinct query tokens adds
  ``0.1 / (1 + noise)``, noise = non-query positions inside the window.
* trigram similarity: words padded with two spaces before and one after, distinct
  3-character windows, |A n B| / |A u B| (0 when both are empty).
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"[^\W_]+")
COVER_WEIGHT = 0.1


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@lru_cache(maxsize=1 << 17)
def _word_trigrams(word: str) -> tuple[str, ...]:
    p = "  " + word + " "
    return tuple(p[i : i + 3] for i in range(len(p) - 2))


def trigram_set(text: str | None) -> set[str]:
    # a word's trigrams do not depend on where it occurs: each distinct word once, and
    # words repeat across the documents of a task, so their trigrams are cached
    return set().union(*map(_word_trigrams, set(tokens(text))))


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of words as whole numbers, three code points each, one word's after the
    other, and how many each word has."""
    points = np.frombuffer("".join([f"  {w} " for w in words]).encode("utf-32-le"), "<u4").astype(np.int64)
    count = np.array([len(w) + 1 for w in words], np.int64)
    first = np.cumsum(count + 2) - count - 2
    at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    return points[at] << 42 | points[at + 1] << 21 | points[at + 2], count


@lru_cache(maxsize=1 << 12)
def trigram_codes(text: str | None) -> np.ndarray:
    """The distinct trigrams of a query text as sorted whole numbers."""
    return np.unique(word_codes(list(set(tokens(text))))[0])


def covers(occurrences: list[tuple[int, int]], n: int) -> float:
    """Sum over minimal covers of 0.1 / (1 + noise), out of the places of ``n`` query terms in a
    document as (place, term), in order of place."""
    count = [0] * n
    have = left = 0
    total = 0.0
    for right, (place, term) in enumerate(occurrences):
        have += count[term] == 0
        count[term] += 1
        while count[occurrences[left][1]] > 1:
            count[occurrences[left][1]] -= 1
            left += 1
        if have == n and count[term] == 1:
            total += COVER_WEIGHT / (1 + (place - occurrences[left][0]) - (right - left))
    return total


def cover_density(doc_tokens: list[str], query_terms: list[str]) -> float:
    """Sum over minimal covers of 0.1 / (1 + noise); 0 when a term is missing."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(query_terms))}
    return covers([(pos, terms[t]) for pos, t in enumerate(doc_tokens) if t in terms], len(terms)) if terms else 0.0


def trigram_jaccard_matrix(q_sets: list[set[str]], d_sets: list[set[str]], chunk: int = 512) -> np.ndarray:
    """|Q_i n D_j| / |Q_i u D_j| for all pairs of one block, via a vocabulary of the
    query trigrams (document trigrams outside it only count towards |D_j|).  Documents are
    processed in chunks so the dense indicator matrix stays bounded."""
    vocab: dict[str, int] = {}
    for s in q_sets:
        for g in s:
            vocab.setdefault(g, len(vocab))
    nq, nd, v = len(q_sets), len(d_sets), max(len(vocab), 1)
    qm = np.zeros((nq, v), dtype=np.float32)
    for i, s in enumerate(q_sets):
        if s:
            qm[i, [vocab[g] for g in s]] = 1.0
    inter = np.zeros((nq, nd), dtype=np.float64)
    for start in range(0, nd, chunk):
        part = d_sets[start : start + chunk]
        dm = np.zeros((len(part), v), dtype=np.float32)
        for j, s in enumerate(part):
            if len(s) > len(vocab):
                hit = [idx for g, idx in vocab.items() if g in s]
            else:
                hit = [vocab[g] for g in s if g in vocab]
            if hit:
                dm[j, hit] = 1.0
        inter[:, start : start + len(part)] = qm @ dm.T
    qs = np.array([len(s) for s in q_sets], dtype=np.float64)[:, None]
    ds = np.array([len(s) for s in d_sets], dtype=np.float64)[None, :]
    union = qs + ds - inter
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(union > 0, inter / union, 0.0)
    return out
