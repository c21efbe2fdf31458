"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: the base patterns and looser ones
(numbers with separators, spelled-out addresses, account numbers, long IP addresses).  Of
digit groups that follow each other every run of whole groups is proposed, of an address and
an account number every end, so neighbours never hide each other; the trees choose.  A span that a base rule accepts (e-mail; IPv4 address with parts up to 255; card number of 13
to 19 digits passing Luhn's sum; international phone number of 9 to 15 digits) always
stays.  Boosted trees give every other proposal a probability from features of its format
(digits, groups, separators, checksums, letters around it) and of its context (words that
stand before and behind it); a proposal of a kind is taken from that kind's threshold on,
the most probable first, unless it overlaps what is taken already.

The trees are trained on generated sentences that hold personal data and look-alikes
(order numbers, prices, dates, versions, hashes) among words of at most ``sample_texts``
texts of the table (the smallest by a hash): a bounded fit.  Two thirds of the sentences
train; on the others each kind's threshold is the lowest with ``precision`` among what it
selects.  Scans read whole texts.

Defined cases: a null text is the empty one and has no spans; texts of any length are
scanned whole; offsets are code points, ends exclusive; repeated rows give equal results.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import text_or_empty, text_sample
from pricelens.llm.gbt import Boosted, boost

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("number", "address", "account", "ip6")
ORDER = {kind: i for i, kind in enumerate(KINDS + ADDED_KINDS)}
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a run of digits that a match begins in is taken from its first digit: nothing is tried twice
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: digit groups with one or two separators between; numbers are runs of whole groups
GROUPS = re.compile(r"[0-9]++(?:[\x20().\-/]{1,2}[0-9]++)*+")
NUMBER_DIGITS = range(7, 20)
AT = re.compile(r"\[at\]|\(at\)|\bat\b|@", re.I)
HOST = re.compile(r"\s?[A-Za-z0-9-]{1,63}")
JOINT = re.compile(r"\s?(\[dot\]|\(dot\)|\bdot\b|\.)(\s?)([A-Za-z0-9-]{1,63})", re.I)
#: a place where an account number begins, and the longest that may be one
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9]))")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
HINTS = re.compile(r"[0-9@]|\bat\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    packed = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules: leftmost and non-overlapping within each kind."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            spans.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _alnum(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """Every run of whole digit groups with 7 to 19 digits."""
    for m in GROUPS.finditer(text):
        if m.end() - m.start() < NUMBER_DIGITS[0]:
            continue
        groups = [g.span() for g in re.finditer("[0-9]+", m[0])]
        groups = [(a + m.start(), b + m.start()) for a, b in groups]
        for i, (start, _) in enumerate(groups):
            if _alnum(text, start - 1):
                continue
            begin = start - 1 if text[start - 1 : start] in ("(", "+") and not _alnum(text, start - 2) else start
            digits = 0
            for a, b in groups[i : i + NUMBER_DIGITS[-1]]:
                digits += b - a
                if digits > NUMBER_DIGITS[-1]:
                    break
                if digits in NUMBER_DIGITS and not _alnum(text, b):
                    yield ("number", begin, b)


def _addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """From each separator the local part backwards and one to four joints of the domain
    forwards."""
    for at in AT.finditer(text):
        end = at.start() - (at.start() > 0 and text[at.start() - 1].isspace())
        start = end
        while start > max(0, end - 64) and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at.end()) if start < end else None
        for _ in range(4 if m else 0):
            m = JOINT.match(text, m.end())
            if not m:
                break
            yield ("address", start, m.end())


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    """From each place where an account number may begin, every end behind a whole group."""
    for m in ACCOUNT.finditer(text):
        start, end = m.span(1)
        for at in [*(k for k in range(start + 12, end) if text[k] == " "), end]:
            if 12 <= at - start - text.count(" ", start, at) <= 35:
                yield ("account", start, at)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data beyond the base rules; they may overlap, and of
    neighbours each is proposed on its own."""
    yield from _numbers(text)
    yield from _addresses(text)
    yield from _accounts(text)
    if ":" in text:
        for m in IP6.finditer(text):
            yield ("ip6", *m.span())


#: what words near a span tell
CONTEXT = [
    "phone tel telephone call mobile cell fax whatsapp sms dial teléfono téléphone telefon móvil",
    "mail email contact write reach address correo courriel",
    "card visa mastercard amex credit debit payment carte tarjeta karte",
    "iban account bank swift bic konto compte cuenta",
    "ssn social security passport id identity national tax",
    "ip host server address from login client",
    "order invoice ref reference ticket case tracking no number item sku isbn issn part serial",
    "price total amount cost usd eur dollars sum paid",
    "version release build v date on since year page chapter vol",
]
CONTEXT_GROUP: dict[str, list[int]] = {}
for _k, _group in enumerate(CONTEXT):
    for _word in _group.split():
        CONTEXT_GROUP.setdefault(_word, []).append(_k)
NEAR = re.compile(r"[^\W\d_]+")
WIDTH = len(ADDED_KINDS) + 2 * len(CONTEXT) + 36
SCORED = 4096


def features(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """A row for each proposal: its format, then its context."""
    x = np.zeros((len(spans), WIDTH))
    for row, (kind, start, end) in zip(x, spans, strict=True):
        s = text[start:end]
        digits = "".join(c for c in s if "0" <= c <= "9")
        groups = re.findall(r"[0-9]+", s)
        separators = set(re.findall(r"[^0-9A-Za-z]", s))
        row[ORDER[kind] - len(KINDS)] = 1
        at = len(ADDED_KINDS)
        for k, part in enumerate((text[max(0, start - 40) : start], text[end : end + 24])):
            for word in NEAR.findall(part.lower()):
                for g in CONTEXT_GROUP.get(word, ()):
                    row[at + k * len(CONTEXT) + g] = 1
        at += 2 * len(CONTEXT)
        before, behind = text[start - 1 : start], text[end : end + 1]
        sizes = [len(g) for g in groups]
        # what a neighbour looks like that is joined to the span, and how the parts of a domain are joined
        left, right = text[max(0, start - 2) : start], text[end : end + 2]
        joints = [j for j in JOINT.finditer(s, AT.search(s).end())] if kind == "address" else []
        kinds = {j[1].lower() for j in joints}
        row[at:] = (
            len(s), len(digits), len(groups), max(sizes, default=0), min(sizes, default=0), sizes[0] if sizes else 0, sizes[-1] if sizes else 0,
            len(separators), " " in separators, "-" in separators, "." in separators, "/" in separators, "(" in s, s.startswith("+"), ":" in s,
            luhn(digits) if digits else 0, kind == "account" and mod97(s), len(set(digits)),
            sizes == [3, 2, 4], sizes in ([3, 3, 4], [3, 4], [2, 2, 2, 2, 2]), any(w in s.lower() for w in ("[at]", "(at)")), any(w in s.lower() for w in ("dot", "(dot)")),
            before in (":", "#", "$", "€", "v", "=", '"'), behind in ("%", "$", "€", ":", '"', "/"),
            _joined(left[::-1], " "), _joined(left[::-1], "-./()"), _joined(right, " "), _joined(right, "-./("),
            sizes[1] if len(sizes) > 1 else 0, s.count(" "), s.count("-"),
            len(joints), len(kinds), any(j[1] == "." and j[2] for j in joints), len(joints[-1][3]) if joints else 0, JOINT.match(text, end) is not None,
        )
    return x


def _joined(beside: str, by: str) -> bool:
    """A separator stands beside the span and a digit or a further separator behind it."""
    return len(beside) == 2 and beside[0] in by and (beside[1].isdigit() or beside[1] in "()")


class Sentences:
    """Generated texts with the spans of the personal data in them."""

    def __init__(self, words: list[str], seed: int = 5):
        self.words, self.r = words, random.Random(seed)

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "#" else c for c in pattern)

    def word(self) -> str:
        return re.sub(r"[^A-Za-z]", "", self.r.choice(self.words)).lower() or "a"

    def account(self, right: bool) -> str:
        r = self.r
        body = "".join(r.choice("0123456789") for _ in range(r.choice([14, 16, 18])))
        country = r.choice(["DE", "FR", "ES", "GB", "NL", "IT"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        if not right:
            check = (check + r.randint(1, 90)) % 97
        found = f"{country}{check:02d}{body}"
        return " ".join(found[k : k + 4] for k in range(0, len(found), 4)) if r.random() < 0.5 else found

    def private(self) -> tuple[str, str]:
        """(lead, personal data)"""
        r = self.r
        x = r.random()
        if x < 0.4:
            phone = self.digits(r.choice(["(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "0# ## ## ## ##", "0### ######", "0##/#######", "00## ### ######", "555-####", "##########"]))
            return r.choice(["call", "phone:", "tel.", "Tel:", "mobile", "fax", "reach me at", "telefon", "téléphone", "", ""]), phone
        if x < 0.55:
            return r.choice(["SSN", "ssn:", "social security number", "id", ""]), self.digits("###-##-####")
        if x < 0.75:
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."), ("[at]", ".")])
            return r.choice(["mail", "write to", "contact", "email:", ""]), f"{self.word()}{r.choice(['', '.', '_'])}{self.word()}{at}{self.word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if x < 0.88:
            return r.choice(["IBAN", "account", "iban:", "konto", ""]), self.account(True)
        return r.choice(["ip", "from", "host", ""]), ":".join(f"{r.randint(0, 65535):x}" for _ in range(8))

    def alike(self) -> tuple[str, str]:
        """(lead, what only looks like personal data)"""
        r = self.r
        x = r.random()
        if x < 0.45:
            shape = r.choice(["########", "##########", "####-##-##", "##/##/####", "##.##.####", "####-####", "###-#######", "######-##", "#.##.#####", "############", "### ### ###", "#,###,###", "978-#-##-######-#", "20######", "#### #### ####"])
            return r.choice(["order", "invoice no.", "ref", "item", "on", "ISBN", "version", "total", "page", "part", "serial", "#", "$", "tracking", "", ""]), self.digits(shape)
        if x < 0.7:
            return "", f"{self.word()} at {self.word()}. {self.word()}"
        if x < 0.8:
            return r.choice(["part", "serial", "code", ""]), self.account(False)
        if x < 0.9:
            return r.choice(["at", "from", ""]), self.digits(r.choice(["1#:#4:#3", "##:##:##:##", "1:2:3:4", "#:##:##"]))
        return r.choice(["hash", "commit", "id"]), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 32, 40])))

    def sentence(self) -> tuple[str, list[tuple[int, int]]]:
        r = self.r
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(r.choices(self.words, k=r.randint(2, 9))) + " "
            beside = r.choice([1, 1, 1, 2, 3])  # neighbours with nothing between them
            for left in range(beside, 0, -1):
                mine = r.random() < 0.5 or beside > 1
                lead, found = self.private() if mine else self.alike()
                text += f"{lead} " if lead and left == beside else ""
                if mine:
                    spans.append((len(text), len(text) + len(found)))
                text += found + r.choice([" ", ", ", ". ", ".\n"] if left == 1 else [" ", " ", ", ", "; ", "\n"])
        return text + " ".join(r.choices(self.words, k=3)), spans


@dataclass(frozen=True)
class Model:
    trees: Boosted
    thresholds: tuple[float, ...]  # by added kind


def fit(sample: list[str], sentences: int = 1500, precision: float = 0.95) -> Model:
    """Trees and thresholds from generated sentences among the sample's words."""
    words = [w for text in sample for w in text.split() if len(w) < 25 and not HINTS.search(w)]
    made = Sentences(words[:200_000] or ["the", "of", "and"])
    rows, labels, kinds, tests = [], [], [], []
    for k in range(sentences):
        text, mine = made.sentence()
        base = base_spans(text)
        found = [s for s in proposals(text) if not _meets(s, base)]
        rows.append(features(text, found))
        # personal if it covers the same stretch but for a character at either end
        labels += [any(abs(s[1] - a) <= 1 and abs(s[2] - b) <= 1 for a, b in mine) for s in found]
        kinds += [ORDER[s[0]] - len(KINDS) for s in found]
        tests += [k % 3 == 0] * len(found)
    x, y, kind, test = np.concatenate(rows), np.array(labels, float), np.array(kinds), np.array(tests)
    trees = boost(x[~test], y[~test], trees=60, depth=4)
    p = trees.probability(x[test])
    thresholds = []
    for k in range(len(ADDED_KINDS)):
        own = kind[test] == k
        order = np.argsort(-p[own])
        right = np.cumsum(y[test][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds.append(max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1)
    return Model(trees, tuple(thresholds))


def train(df: DataFrame, text_col: str = "text", sample_texts: int = 100, sample_chars: int = 10_000) -> Model:
    """A model for the texts of ``df``; reads at most ``sample_chars`` of ``sample_texts``."""
    return fit(text_sample(df.select(text_or_empty(df, text_col).alias("t")), "t", sample_texts, sample_chars))


def _meets(span: tuple[str, int, int], others: list[tuple[str, int, int]]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)


def find_private(model: Model, text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed, then start."""
    if not HINTS.search(text):
        return []
    base = base_spans(text)
    covered = np.array(sorted((a, b) for _, a, b in base)).reshape(-1, 2)
    reach = np.maximum.accumulate(covered[:, 1]) if len(covered) else covered[:, 1]

    def free(span: tuple[str, int, int]) -> bool:
        k = int(np.searchsorted(covered[:, 0], span[2], "left"))
        return k == 0 or reach[k - 1] <= span[1]

    found = (s for s in proposals(text) if free(s))
    taken: list[tuple[str, int, int]] = []
    picked = []
    while part := list(islice(found, SCORED)):  # memory is bounded for a text that is all digits
        p = model.trees.probability(features(text, part))
        picked += [(q, s) for q, s in zip(p, part, strict=True) if q >= model.thresholds[ORDER[s[0]] - len(KINDS)]]
    starts: dict[int, bool] = {}
    for _, s in sorted(picked, key=lambda x: (-x[0], x[1][1], -x[1][2])):
        if not any(at in starts for at in range(s[1], s[2])):
            starts.update(dict.fromkeys(range(s[1], s[2]), True))
            taken.append(s)
    return sorted(base + taken, key=lambda s: (ORDER[s[0]], s[1]))


def private_spans(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column with the spans of each whole text: kind, start, end."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in find_private(shared.value, t)] for t in batch.to_pylist()], kind)

    return scan(text_or_empty(df, text_col))


def scan_private(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and ``private`` (array of kind, start, end)."""
    return df.select(df[id_col], private_spans(df, model, text_col).alias("private"))
