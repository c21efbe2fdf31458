"""Ranked search, Merkle manifest and curriculum against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.llm import best_position, curriculum, merkle
from pricelens.llm.order import placed

# names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, tree int, digest string, size int, target int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Été", "don't", "x-y", "日本", "𝒳"]
    out = []
    for k in range(300):
        text = " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=r.choice([0, 1, 3, 20, 60])))
        out.append((k + 2**61 * (k % 2), text, r.choice(["en", "de", None, "z\U0001f600"]), r.choice(["a", "b", "b", "b", None, "é"]), len(text)))
    out += out[:7] + out[:3]  # repeated rows
    out += [(5, None, "en", "b", None), (None, None, None, None, None), (None, "w1 w2", "fr", "only", 5), (9, "", "xx", "void", 0)]
    out += [(11, " ".join(r.choices(words, k=30000)), "en", "long", 1)]
    out += [(1000 + k, "w1 w2 same", "en", "b", 10) for k in range(40)]  # equal scores
    return [(*x, 1, 1, "d", 1, 1) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_places_and_sums_before(spark):
    r = random.Random(1)
    data = [(r.randint(0, 9), r.randint(0, 5), k) for k in range(500)]
    df = spark.createDataFrame(data, "a int, weight long, k long").repartition(7)
    got = placed(df, [F.col("a"), F.col("k")], "weight").collect()
    total = 0
    for place, row in enumerate(sorted(data, key=lambda x: (x[0], x[2]))):
        found = [g for g in got if g["place"] == place]
        assert [(g["a"], g["weight"], g["k"], g["before"]) for g in found] == [(*row, total)]
        total += row[1]
    assert placed(df.limit(0), [F.col("a")], "weight").collect() == []


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(nodes, arity):
    """The levels of a tree, and the siblings on each leaf's way up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    proofs = []
    for leaf in range(len(nodes)):
        proof = []
        for level in levels[:-1]:
            first = leaf // arity * arity
            proof += [d for k, d in enumerate(level[first : first + arity], first) if k != leaf]
            leaf //= arity
        proofs.append(proof)
    return levels[-1][0], proofs


def brute_root(groups, arity):
    subs = [brute_tree(leaves, arity) for _, leaves in groups]
    root, ways = brute_tree([s for s, _ in subs], arity)
    return root, subs, ways


@pytest.mark.parametrize("arity,levels", [(2, 2), (3, 1), (2, 10)])
def test_merkle_equals_brute_force(docs, rows, arity, levels):
    def leaf_of(x, more=0):
        values = [x[0], x[3], x[2], None if x[4] is None else x[4] + more, x[1]]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = merkle.fields_digest([F.col(c) for c in fields])
    changed = merkle.fields_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    hit = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    got = merkle.manifest(docs, leaf, F.when(hit, changed), arity=arity, levels=levels).collect()
    groups = defaultdict(list)
    for x in rows:
        groups[x[2]].append(x)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, leaf_of(x)))
    leaves = [(g, [leaf_of(x) for x in groups[g]]) for g in order]
    root, subs, ways = brute_root(leaves, arity)
    want, found = Counter(), Counter()
    for t, g in enumerate(order):
        for k, x in enumerate(groups[g]):
            folded = root
            if x[0] is not None and x[0] % 3 == 0 and x[4] is not None:
                other = [(h, [*ls[:k], leaf_of(x, 1), *ls[k + 1 :]] if h == g else ls) for h, ls in leaves]
                folded = brute_root(other, arity)[0]
            want[(x[0], leaf_of(x), subs[t][0], root, tuple(subs[t][1][k] + ways[t]), folded)] += 1
    for r in got:
        found[(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"]), r["folded_root"])] += 1
    assert found == want
    assert merkle.manifest(docs.limit(0), leaf).collect() == []
    one = merkle.manifest(docs.filter("doc_id = 9 and text = ''"), leaf).collect()
    assert [(r["proof"], r["subroot"], r["root"], r["folded_root"]) for r in one] == [([], r["leaf"], r["leaf"], r["leaf"]) for r in one]


def test_folding_needs_only_the_state_and_the_right():
    nodes = [sha(str(k)).encode() for k in range(11)]
    tree, top = merkle.raised(nodes, 3, 9, True)
    for k, node in enumerate(nodes):
        bare = [(state, [], right) for state, _, right in merkle.way_up(tree, k, 3)]
        assert merkle.fold(node, bare) == top[0]
        assert merkle.fold(b"0" * 64, bare) != top[0]


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, k):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms_of(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block,batch", [(4096, 200_000), (16, 3)])
def test_ranked_search_equals_brute_force(spark, docs, rows, monkeypatch, block, batch):
    monkeypatch.setattr(best_position, "BLOCK_DOCS", block)
    monkeypatch.setattr(best_position, "FIRST_DEPTH", 2)
    items = [(1, "W1 w2 été w1"), (2, None), (3, "unknown"), (4, ""), (None, "日本 w7"), (4, "w1 w2 same"), (4, "w1 w2 same")]
    items += [(10 + k, " ".join(f"w{j}" for j in range(k, k + 12))) for k in range(12)]
    queries = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, score int, query int")
    got = best_position.search(docs, queries, batch_terms=batch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search([(x[0], x[1]) for x in rows], items, 10)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert best_position.search(docs.limit(0), queries).collect() == []
    assert best_position.search(docs, queries.limit(0)).collect() == []


def test_search_stops_early_and_reads_whole_ties():
    r = np.random.default_rng(3)
    n, terms = 5000, np.arange(3, dtype=np.int32)
    impacts = r.integers(1, 10**6, 3 * n)
    impacts[:40] = 999_999
    block = best_position.Block(np.repeat(terms, n), np.tile(np.arange(n), 3), impacts, n)
    weights = np.array([5, 1, 1])
    docs, scores = block.search(terms, weights, 10, np.zeros(0, np.int64))
    whole = weights @ impacts.reshape(3, n)
    assert len(docs) < n / 2 and len(set(docs)) == len(docs) and (scores == whole[docs]).all()
    kth = np.sort(whole)[-10]
    assert set(np.flatnonzero(whole >= kth)) <= set(docs)
    known = np.full(10, whole.max() + 1)
    assert len(block.search(terms, weights, 10, known)[0]) < len(docs)


def brute_targets(sizes, weights, repeats):
    total, held = sum(sizes.values()), set()
    while True:
        open_ = sum(w for s, w in weights.items() if s not in held)
        rate = (total - sum(repeats * sizes[s] for s in held)) / open_ if open_ else 0
        more = {s for s in sizes if s not in held and weights[s] * rate > repeats * sizes[s]}
        if not more:
            return {s: repeats * sizes[s] if s in held else weights[s] * rate for s in sizes}
        held |= more


def test_mix_meets_targets_and_schedules(spark, docs, rows):
    sizes = defaultdict(int)
    for x in rows:
        sizes[x[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))
    plan = {"a": [(0, 4), (0.5, 0), (1, 4)], "b": [(0, 1), (1, 1)], None: [(0, 0), (1, 9)], "é": [(0, 7), (1, 0)], "long": [(0, 1), (1, 3)], "only": [(0, 1), (1, 1)]}
    schedule = spark.createDataFrame([(s, float(t), float(w)) for s, k in plan.items() for t, w in k], "source string, time double, weight double")
    weights = {s: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(k, k[1:])) for s, k in plan.items()} | {"void": 0}
    want = brute_targets(sizes, weights, 3)
    mixed = curriculum.mix(docs, schedule)
    got = mixed.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((x[0], x[3]) for x in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        words = [c["words"] for c in r["copies"]]
        assert sum(words) <= 3 * r["size"] and all(0 < w <= r["size"] for w in words)
        taken[r["source"]] += sum(words)
    assert dict(taken) == {s: math.floor(t + 0.5) for s, t in want.items()}
    # words taken up to a time follow the integral of the schedule
    for s, k in plan.items():
        for until in (0.25, 0.5, 0.8):
            due = 0.0
            for (t0, w0), (t1, w1) in zip(k, k[1:]):
                x = min(max(until - t0, 0), t1 - t0)
                due += x * (w0 + w0 + (w1 - w0) * x / (t1 - t0)) / 2
            early = sum(c["words"] for r in got if r["source"] == s for c in r["copies"] if c["position"] <= until)
            longest = max(r["size"] for r in got if r["source"] == s)
            assert abs(early - due / weights[s] * want[s]) <= longest + 1
    order = curriculum.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == sum(taken.values())
    again = curriculum.mix(docs.repartition(3), schedule)
    key = lambda r: (r["doc_id"], r["source"], r["size"], tuple(r["copies"]))
    assert Counter(map(key, again.collect())) == Counter(map(key, got))


def test_mix_without_words_or_rows(spark, docs):
    schedule = curriculum.alternating_schedule(docs, [5, 2, 1])
    weights = {r["source"]: r["weight"] for r in curriculum.integrated(schedule).collect()}
    assert weights == {"a": 5, "b": 2, "long": 1, "only": 5, "void": 2, "é": 1, None: 5}
    assert curriculum.mix(docs.limit(0), schedule).collect() == []
    empty = curriculum.mix(docs.filter("text is null or text = ''"), schedule).collect()
    assert empty and all(r["target"] == 0 and r["copies"] == [] for r in empty)
    unknown = curriculum.mix(docs, schedule.limit(0)).collect()
    assert all(r["target"] == 0 and r["copies"] == [] for r in unknown)
