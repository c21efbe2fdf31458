"""Language-model scores by prediction by partial matching, beside a unigram base.

One pass over the training texts counts words and byte contexts: a task counts in numpy
and dictionaries and sends on distinct keys, so what is shuffled is the vocabulary and the
contexts that the corpus has, not its tokens.

Model.  Contexts of five and four bytes, over all bytes, lie in a table that grows with the
corpus: after a context that was seen n times, before d distinct bytes, a byte has (2c - 1) / 2n
if it was seen there c > 0 times, and d / 2n of its probability in the next shorter context; an
unseen context leaves it to the shorter one.  Below are contexts of up to three symbols: the
``SYMBOLS`` - 1 most frequent training bytes each are one, the others share the last and are told
apart by their frequency, so this trie has at most 64^4 leaves whatever the corpus (a proven
bound for what is broadcast).  There a symbol's probability starts in the longest context: a
symbol seen there has (2c - 1) / 2n, the escape has d / 2n (n: count of what is left, d: distinct
symbols), and an escape goes on in the next shorter context without the symbols that were seen
before (symbol exclusion), at last to the uniform distribution.  A text (A-Z lower-cased, as for
the base) is preceded by line ends and followed by an end symbol, whose code length counts too.

What the long contexts give a window (a context of five bytes and the byte after it) is linear in
the trie's probability of the byte.  The two numbers of the ``frequent_windows`` most frequent
windows are broadcast; a document's other windows travel once each, with the trie's probability
and their frequency in it, to the numbers of the distinct ones, seen in training or not: any
window gets the same score by either way.

Base.  Sum over words and one end of log10((c + 0.5) / (N + 0.5 (V + 1))).  Counts of the
``frequent`` most frequent words are broadcast (a bound in rows and in bytes: such words
have at most ``frequent_bytes`` bytes) and looked up in place; a document's other words
travel with their frequency in it to the word counts and meet again by document.

Defined cases: a null or empty text is the end alone; a null id counts as the empty text
for the fold; with no training texts every byte is uniform and every word unknown;
repeated rows are scored each; texts of any length are scored whole, slice by slice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pricelens.llm.common import struct_array, text_or_empty, utf8, written

BITS = 6
SYMBOLS = 1 << BITS
ORDER = 3
LONG = 5
START = b"\n" * ORDER
END = b"\0"
SLICE = 1 << 20
FLUSH_WORDS = 400_000
FLUSH_GRAMS = 2_000_000
SCORED_AT_ONCE = 4 << 20


def slices(texts: list[bytes], back: int = ORDER) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Runs of at most about SLICE bytes that each begin with ``back`` bytes of context: bytes,
    which text each stretch belongs to, and where its symbols begin in the run."""
    run, of, at, size = [], [], [], 0
    for k, text in enumerate(texts):
        whole = START[:1] * back + text + END
        for begin in range(0, len(whole) - back, SLICE):
            part = whole[begin : begin + SLICE + back]
            of.append(k)
            at.append(size)
            run.append(part)
            size += len(part)
            if size >= SLICE:
                yield b"".join(run), of, at
                run, of, at, size = [], [], [], 0
    if run:
        yield b"".join(run), of, at


def _inner(size: int, at: list[int], back: int = ORDER) -> np.ndarray:
    """Mask of the windows of ``back`` + 1 bytes that lie within one stretch."""
    keep = np.ones(size - back, bool)
    starts = np.array(at[1:], np.int64)
    for k in range(1, back + 1):
        keep[starts - k] = False
    return keep


def _windows(b: np.ndarray) -> np.ndarray:
    """The windows of LONG + 1 bytes, as numbers."""
    codes = np.zeros(len(b) - LONG, np.uint64)
    for k in range(LONG + 1):
        codes <<= np.uint64(8)
        codes |= b[k : len(b) - LONG + k]
    return codes


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of LONG + 1 bytes of the texts, as numbers, and their counts."""
    found, held = [], 0
    for run, _, at in slices(texts, LONG):
        b = np.frombuffer(run, np.uint8)
        found.append(np.unique(_windows(b)[_inner(len(b), at, LONG)], return_counts=True))
        held += len(found[-1][0])
        if held > FLUSH_GRAMS:
            found = [_merged(found)]
            held = 0
    return _merged(found)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, gram, n): counts of words (gram null), of windows of LONG + 1 bytes (word
    null) and of texts (both null) over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        texts = 0

        def rows(word=None, gram=None, n=()) -> pa.RecordBatch:
            size = len(n)
            columns = [
                pa.array(word, pa.binary()) if word is not None else pa.nulls(size, pa.binary()),
                pa.array(gram, pa.int64()) if gram is not None else pa.nulls(size, pa.int64()),
                pa.array(n, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["word", "gram", "n"])

        def flush_words() -> Iterator[pa.RecordBatch]:
            keys = list(words)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield rows(word=part, n=[words[w] for w in part])
            words.clear()

        def flush_grams() -> Iterator[pa.RecordBatch]:
            codes, n = _merged(grams)
            grams.clear()
            for k in range(0, len(codes), 100_000):
                yield rows(gram=codes[k : k + 100_000].astype(np.int64), n=n[k : k + 100_000])

        for batch in batches:
            column = [t.lower() for t in utf8(batch.column(0))]
            texts += len(column)
            for t in column:
                words.update(t.split())
                if len(words) > FLUSH_WORDS:
                    yield from flush_words()
            grams.append(gram_counts(column))
            if sum(len(c) for c, _ in grams) > FLUSH_GRAMS:
                grams[:] = [_merged(grams)]
                if len(grams[0][0]) > FLUSH_GRAMS // 2:
                    yield from flush_grams()
        yield from flush_words()
        yield from flush_grams()
        if texts:
            yield rows(n=[texts])

    parts = docs.select(text_or_empty(docs, text_col).alias("t")).mapInArrow(count, "word binary, gram bigint, n bigint")
    return written(parts.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def distributions(order: int, rows: np.ndarray, tails: np.ndarray, excluded: np.ndarray, counts: list[np.ndarray]) -> np.ndarray:
    """Probability of each symbol that is not excluded.  ``counts[k]`` holds the counts of
    symbols by context of k symbols: ``rows`` are the contexts' rows at ``order``, ``tails``
    their numbers, of which the last symbols number the shorter contexts."""
    if order < 0:
        left = ~excluded
        return left / np.maximum(left.sum(axis=1, keepdims=True), 1)
    c = np.where(excluded, 0, counts[order][rows])
    seen = c > 0
    n, d = c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    rest = excluded | seen
    goes_on = ~rest.all(axis=1, keepdims=True)  # nothing to escape to: the escape's share is theirs
    whole = np.maximum(np.where(goes_on, 2 * n, 2 * n - d), 1)
    escape = np.where(n > 0, d / whole, 1.0) * goes_on
    shorter = tails & ((1 << BITS * max(order - 1, 0)) - 1)
    lower = distributions(order - 1, shorter, shorter, rest, counts)
    return np.where(seen, (2 * c - 1) / whole, escape * lower)


@dataclass(frozen=True)
class Trie:
    """The pretrained model as tables: a row of logarithms for each context."""

    symbol: np.ndarray  # byte -> symbol
    within: np.ndarray  # byte -> log10 of its share of the last symbol, 0 for others
    row: np.ndarray  # context of three symbols -> row of ``logs``
    logs: np.ndarray

    def symbol_logs(self, b: np.ndarray) -> np.ndarray:
        """log10 probability of each byte after the first ORDER ones."""
        s = self.symbol[b]
        context = np.zeros(len(b) - ORDER, np.int32)
        for k in range(ORDER):
            context <<= BITS
            context |= s[k : len(b) - ORDER + k]
        return self.logs[self.row[context] + s[ORDER:]].astype(np.float64) + self.within[b[ORDER:]]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text by contexts of symbols alone."""
        out = np.zeros(len(texts))
        for run, of, at in slices(texts):
            b = np.frombuffer(run, np.uint8)
            got = self.symbol_logs(b)
            got[~_inner(len(b), at)] = 0
            np.add.at(out, of, np.add.reduceat(got, np.minimum(at, len(got) - 1)))
        return out


@dataclass(frozen=True)
class Windows:
    """The most frequent windows, sorted: a byte's probability is ``own`` + ``passed`` x that in
    the trie."""

    codes: np.ndarray
    own: np.ndarray
    passed: np.ndarray

    def score(self, model: Trie, texts: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """log10 probability of each text without its windows that are not here, and those: text,
        window, how often it is in the text, the trie's probability of its byte."""
        out = np.zeros(len(texts))
        others: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for run, of, at in slices(texts, LONG):
            b = np.frombuffer(run, np.uint8)
            inner = _inner(len(b), at, LONG)
            text = np.repeat(of, np.diff([*at, len(b)]))[:-LONG][inner]
            p = 10 ** model.symbol_logs(b[LONG - ORDER :])[inner]
            distinct, back = np.unique(_windows(b)[inner], return_inverse=True)
            place = np.searchsorted(self.codes, distinct)
            here = place < len(self.codes)
            here[here] = self.codes[place[here]] == distinct[here]
            own, passed = np.zeros(len(distinct)), np.zeros(len(distinct))
            own[here], passed[here] = self.own[place[here]], self.passed[place[here]]
            met = here[back]
            out += np.bincount(text[met], np.log10(own[back[met]] + passed[back[met]] * p[met]), len(texts))
            others.append((text[~met], distinct[back[~met]], p[~met]))
        text, window, p = (np.concatenate(x) for x in zip(*others)) if others else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))
        order = np.lexsort((window, text))
        text, window, p = text[order], window[order], p[order]
        first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(window) != 0))[: len(text)])
        times = np.diff(np.append(first, len(text)))
        return out, {"text": text[first], "window": window[first].astype(np.int64), "times": times, "p": p[first]}


def trie(counts: DataFrame) -> Trie:
    """The model of the counted corpus.  What reaches the driver: 256 byte counts, then
    counts of at most 64^4 windows of symbols."""
    grams = counts.filter("gram is not null").select("gram", "n")
    frequency = np.zeros(256, np.int64)
    for byte, n in grams.groupBy(F.expr("gram & 255").alias("byte")).agg(F.sum("n")).collect():
        frequency[byte] = n
    order = np.lexsort((np.arange(256), -frequency))
    symbol = np.full(256, SYMBOLS - 1, np.int32)
    symbol[order[: SYMBOLS - 1]] = np.arange(SYMBOLS - 1)
    others = symbol == SYMBOLS - 1
    within = np.where(others, np.log10((frequency + 0.5) / (frequency[others].sum() + 0.5 * others.sum())), 0.0)
    to_symbol = F.array(*[F.lit(int(x)) for x in symbol])
    code = F.lit(0).cast("bigint")
    for k in range(ORDER, -1, -1):
        byte = F.shiftright("gram", 8 * k).bitwiseAND(F.lit(255))
        code = F.shiftleft(code, BITS).bitwiseOR(F.element_at(to_symbol, (byte + 1).cast("int")))
    found = grams.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).toArrow()
    codes, n = found["code"].to_numpy().astype(np.int64), found["n"].to_numpy()
    shorter = [np.bincount(codes & ((1 << BITS * (k + 1)) - 1), n, 1 << BITS * (k + 1)).astype(np.int64).reshape(-1, SYMBOLS) for k in range(ORDER)]
    contexts, rank = np.unique(codes >> BITS, return_inverse=True)
    known, tails = len(contexts), 1 << BITS * (ORDER - 1)
    longest = np.zeros((known, SYMBOLS), np.int64)
    longest[rank, codes & (SYMBOLS - 1)] = n
    # a row for each longest context that was seen, then one for each shorter context
    logs = np.empty((known + tails, SYMBOLS), np.float32)
    for k in range(0, known, 8192):
        part = np.arange(k, min(k + 8192, known))
        logs[part] = np.log10(distributions(ORDER, part, contexts[part] & (tails - 1), np.zeros((len(part), SYMBOLS), bool), [*shorter, longest]))
    for k in range(0, tails, 8192):
        part = np.arange(k, min(k + 8192, tails))
        logs[known + part] = np.log10(distributions(ORDER - 1, part, part, np.zeros((len(part), SYMBOLS), bool), shorter))
    row = known + (np.arange(1 << BITS * ORDER) & (tails - 1))
    row[contexts] = np.arange(known)
    return Trie(symbol, within, (row * SYMBOLS).astype(np.int32), logs.reshape(-1))


@dataclass(frozen=True)
class Unigrams:
    tokens: int  # N
    distinct: int  # V
    ends: int
    frequent: dict[bytes, int]

    @property
    def floor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def _step() -> Column:
    """Counts fall into a few hundred steps; whole steps are taken while they fit."""
    return F.floor(F.log2(F.col("n")) * 8)


def _most_frequent(rows: DataFrame, most: int, usable: Column) -> tuple[list[Row], int | None]:
    """The steps that counts fall into, and the least of which all usable rows are taken, while
    no more than ``most`` rows are."""
    steps = rows.groupBy(_step().alias("step")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.count(F.when(usable, 1)).alias("usable")).collect()
    least, held = None, 0
    for s in sorted(steps, key=lambda s: -s["step"]):
        held += s["usable"]
        if held > most:
            break
        least = s["step"]
    return steps, least


def unigrams(counts: DataFrame, frequent: int, frequent_bytes: int) -> Unigrams:
    """Totals, and the counts of at most ``frequent`` most frequent words."""
    words = counts.filter("word is not null")
    short = F.length("word") <= frequent_bytes
    ends = counts.filter("word is null and gram is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    steps, least = _most_frequent(words, frequent, short)
    table = {}
    if least is not None:
        table = {bytes(r["word"]): r["n"] for r in words.filter(short & (_step() >= least)).select("word", "n").collect()}
    return Unigrams(sum(s["n"] for s in steps) + ends, sum(s["rows"] for s in steps) + (ends > 0), ends, table)


def long_contexts(counts: DataFrame) -> list[DataFrame]:
    """The counted windows of LONG + 1 and of LONG bytes, each with the table of their contexts:
    (code, n) and (code, n, d)."""
    found = []
    windows = counts.filter("gram is not null").select(F.col("gram").alias("code"), "n")
    for size in (LONG + 1, LONG):
        if size <= LONG:
            last = F.col("code").bitwiseAND(F.lit((1 << 8 * size) - 1))
            windows = written(windows.groupBy(last.alias("code")).agg(F.sum("n").alias("n")))
        contexts = windows.groupBy(F.shiftright("code", 8).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("d"))
        found += [windows, written(contexts)]
    return found


def window_numbers(asked: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(window, own, passed) for distinct windows, counted or not."""
    rows, own, passed = asked.select("window"), F.lit(0.0), F.lit(1.0)
    for k, (windows, contexts) in enumerate(zip(tables[::2], tables[1::2])):
        code = F.col("window").bitwiseAND(F.lit((1 << 8 * (LONG + 1 - k)) - 1))
        rows = rows.withColumn("code", code).join(windows.select("code", F.col("n").alias(f"c{k}")), "code", "left")
        rows = rows.withColumn("code", F.shiftright(code, 8)).join(contexts.select("code", F.col("n").alias(f"n{k}"), F.col("d").alias(f"d{k}")), "code", "left")
        own = own + passed * F.coalesce((2 * F.col(f"c{k}") - 1) / (2 * F.col(f"n{k}")), F.lit(0.0))
        passed = passed * F.coalesce(F.col(f"d{k}") / (2 * F.col(f"n{k}")), F.lit(1.0))
    return rows.select("window", own.alias("own"), passed.alias("passed"))


def frequent_table(counts: DataFrame, tables: list[DataFrame], most: int) -> Windows:
    """At most ``most`` most frequent windows."""
    grams = counts.filter("gram is not null").select(F.col("gram").alias("window"), "n")
    _, least = _most_frequent(grams, most, F.lit(True))
    kept = grams.filter(_step() >= least) if least is not None else grams.limit(0)
    own = [F.col(c).cast("float").alias(c) for c in ("own", "passed")]
    rows = window_numbers(kept, tables).select("window", *own).toArrow()
    codes = rows["window"].to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return Windows(codes[order], rows["own"].to_numpy()[order], rows["passed"].to_numpy()[order])


def score_documents(
    df: DataFrame,
    counts: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = 200_000,
    frequent_bytes: int = 64,
    frequent_windows: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``."""
    base = unigrams(counts, frequent, frequent_bytes)
    tables = long_contexts(counts)
    shared = df.sparkSession.sparkContext.broadcast((trie(counts), base, frequent_table(counts, tables, frequent_windows)))

    @F.arrow_udf(
        "struct<n_tokens:bigint,n_known:bigint,base:double,score:double,rare:array<struct<word:binary,times:bigint>>,"
        "windows:array<struct<window:bigint,times:bigint,p:double>>>"
    )
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, uni, frequent_ones = shared.value
        logs = _frequent_logs(uni)
        end = np.log10((uni.ends + 0.5) / uni.floor)
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        for texts in _some(batches):
            tokens, known, sums, rare = [], [], [], []
            for text in texts:
                words = text.split()
                sure, total, others = int(uni.ends > 0), end, []
                for word, times in Counter(words).items():
                    log = logs.get(word)
                    if log is None:
                        others.append({"word": word, "times": times})
                    else:
                        total += times * log
                        sure += times
                tokens.append(len(words) + 1)
                known.append(sure)
                sums.append(total)
                rare.append(others)
            scores, left = frequent_ones.score(model, texts)
            starts = np.searchsorted(left["text"], np.arange(len(texts) + 1)).astype(np.int32)
            windows = struct_array({"window": (pa.int64(), left["window"]), "times": (pa.int64(), left["times"]), "p": (pa.float64(), left["p"])})
            yield struct_array({
                "n_tokens": (pa.int64(), tokens),
                "n_known": (pa.int64(), known),
                "base": (pa.float64(), sums),
                "score": (pa.float64(), scores),
                "rare": (rare_type, rare),
                "windows": (pa.list_(windows.type), pa.ListArray.from_arrays(pa.array(starts), windows)),
            })

    row = F.monotonically_increasing_id()
    found = df.select(df[id_col].alias("id"), look_up(text_or_empty(df, text_col)).alias("f"), row.alias("row"))
    found = written(found.select("row", "id", "f.*"))
    # the document itself travels as a word that no text has: its key holds a space
    own = F.struct(F.encode(F.concat(F.lit(" "), F.col("row").cast("string")), "UTF-8").alias("word"), F.lit(0).cast("bigint").alias("times"))
    parts = found.select("row", "id", "n_tokens", "n_known", "base", "score", F.posexplode(F.concat(F.array(own), F.col("rare"))).alias("at", "part"))
    first = F.col("at") == 0
    carried = [F.when(first, F.col(c)).alias(c) for c in ("id", "n_tokens", "n_known", "base", "score")]
    parts = parts.select("row", *carried, F.col("part.word").alias("word"), F.col("part.times").alias("times"))
    words = counts.filter("word is not null").select("word", "n")
    met = parts.join(words, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(base.floor))
    met = met.select("row", "id", "n_tokens", "n_known", "base", "score", (F.col("times") * log).alias("rare_base"), F.when(F.col("n") > 0, F.col("times")).alias("rare_known"))
    rare = found.select("row", F.inline("windows"))
    numbers = window_numbers(rare.select("window").distinct(), tables)
    log = F.log10(F.col("own") + F.col("passed") * F.col("p"))
    rare = rare.join(numbers, "window").select("row", (F.col("times") * log).alias("rare_score"))
    gathered = met.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("id", "n_tokens", "n_known", "base", "score")],
        F.sum("rare_base").alias("rare_base"),
        F.coalesce(F.sum("rare_known"), F.lit(0)).alias("rare_known"),
        F.coalesce(F.sum("rare_score"), F.lit(0.0)).alias("rare_score"),
    )
    return gathered.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(base.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("rare_base")).alias("base_score"),
        (F.col("score") + F.col("rare_score")).alias("score"),
    )


def _some(batches: Iterator[pa.Array]) -> Iterator[list[bytes]]:
    """The lower-cased texts, at most about SCORED_AT_ONCE bytes (or one text) at a time."""
    for batch in batches:
        texts, held = [], 0
        for text in utf8(batch):
            if texts and held + len(text) > SCORED_AT_ONCE:
                yield texts
                texts, held = [], 0
            texts.append(text.lower())
            held += len(text)
        yield texts


_LOGS: dict[int, dict[bytes, float]] = {}


def _frequent_logs(uni: Unigrams) -> dict[bytes, float]:
    """log10 probability of each frequent word, made once per worker."""
    if id(uni) not in _LOGS:
        _LOGS.clear()
        _LOGS[id(uni)] = {w: float(np.log10((n + 0.5) / uni.floor)) for w, n in uni.frequent.items()}
    return _LOGS[id(uni)]
