"""Goldens (FIXTURES 7) and brute-force checks of the blocked top-k."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pricelens.functions import lexical as LX
from pricelens.functions.text import split_parts, verdict_from_text
from pricelens.operators import retrieval as R


def test_fusion_values():
    assert abs(2 / 61 - 0.03279) < 1e-5 and 1 / 61 < R.MIN_EVIDENCE_SCORE
    assert all(2 / (60 + r) >= R.MIN_EVIDENCE_SCORE for r in range(1, 41)) and 2 / (60 + 41) < R.MIN_EVIDENCE_SCORE


def test_text_goldens(spark):
    df = spark.createDataFrame([("시동모터 소음", "배터리, 알터네이터/배 터리", "견적서는 과잉정비가 아닙니다."),
                                ("x", "", "견적서는 다음 이유로 과잉정비입니다.")], "s string, p string, v string")
    rows = df.select(R.infer_systems(F.col("s")).alias("sys"), split_parts(F.col("p")).alias("parts"), verdict_from_text(F.col("v")).alias("v")).collect()
    assert set(rows[0]["sys"]) == {"엔진", "시동 시스템"}
    assert rows[0]["parts"] == ["배터리", "알터네이터"]
    assert rows[0]["v"] is False and rows[1]["v"] is True


def _brute_cover(tokens, terms):
    terms = list(dict.fromkeys(terms))
    pos = [i for i, t in enumerate(tokens) if t in terms]
    total = 0.0
    for a in range(len(pos)):
        for b in range(a, len(pos)):
            window = tokens[pos[a]:pos[b] + 1]
            if not set(terms) <= set(window):
                continue
            inner = [p for p in pos if pos[a] <= p <= pos[b]]
            # minimal: dropping either end breaks coverage
            left = [tokens[p] for p in inner[1:]]
            right = [tokens[p] for p in inner[:-1]]
            if set(terms) <= set(left) or set(terms) <= set(right):
                continue
            noise = (pos[b] - pos[a]) - (len(inner) - 1)
            total += 0.1 / (1 + noise)
    return total


def test_cover_density_brute_force():
    rng = random.Random(3)
    vocab = list("abcdefg")
    for _ in range(300):
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        q = [rng.choice(vocab) for _ in range(rng.randint(1, 3))]
        assert math.isclose(LX.cover_density(doc, q), _brute_cover(doc, q), abs_tol=1e-12)


def test_trigram_matrix_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(30)]
    sets = [LX.trigram_set(t) for t in texts]
    m = LX.trigram_jaccard_matrix(sets[:10], sets[10:])
    for i in range(10):
        for j in range(20):
            a, b = sets[i], sets[10 + j]
            want = len(a & b) / len(a | b) if (a | b) else 0.0
            assert abs(m[i, j] - want) < 1e-9


def _docs_and_queries(spark, n_docs=60, n_q=5):
    rng = np.random.default_rng(1)
    words = ["brake", "noise", "engine", "oil", "pad", "battery", "door", "fan"]
    docs = []
    for i in range(n_docs):
        emb = None if i % 7 == 0 else [float(x) for x in rng.normal(size=8)]
        txt = " ".join(rng.choice(words, size=6))
        docs.append((i, "src", f"M{i % 2}", txt.split()[0], "", "p", txt, emb))
    ddf = spark.createDataFrame(
        docs, "id long, document_source string, vehicle_model string, symptom_text string, system_category string, repair_parts string, evidence_text string, symptom_embedding array<float>"
    )
    qs = [(f"q{k}", f"M{k % 2}", [], " ".join(rng.choice(words, size=2)), [float(x) for x in rng.normal(size=8)]) for k in range(n_q)]
    qdf = spark.createDataFrame(qs, "qid string, scope string, systems array<string>, query_text string, qvec array<float>")
    return docs, qs, ddf, qdf


def test_blocked_vector_topk_equals_brute_force(spark):
    docs, qs, ddf, qdf = _docs_and_queries(spark)
    got = {}
    for r in R.vector_list(qdf, R.vector_index(ddf, docs_per_group=15, docs_per_block=4), 7).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
    for qid, scope, _, _, qv in qs:
        cand = []
        for d in docs:
            if d[2] != scope:
                continue
            e = d[7]
            s = None if e is None else float(np.dot(qv, e) / (np.linalg.norm(qv) * np.linalg.norm(np.asarray(e, dtype=np.float32).astype(float))))
            cand.append((s is None, -(s or 0.0), d[0]))
        want = [c[2] for c in sorted(cand)[:7]]
        assert [d for _, d in sorted(got[qid])] == want


def test_blocked_lexical_topk_equals_brute_force(spark):
    docs, qs, ddf, qdf = _docs_and_queries(spark)
    got = {}
    for r in R.lexical_list(qdf, R.lexical_index(ddf, docs_per_group=15, docs_per_block=4), 5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
    for qid, scope, _, text, _ in qs:
        qt = LX.trigram_set(text)
        cand = []
        for d in docs:
            if d[2] != scope:
                continue
            sim = lambda t: (len(qt & LX.trigram_set(t)) / len(qt | LX.trigram_set(t))) if (qt | LX.trigram_set(t)) else 0.0
            terms = LX.tokens(text)
            toks = LX.tokens(d[3] + " " + d[6])
            s = 0.3 * max(sim(d[3]), sim(d[6])) + (0.7 * LX.cover_density(toks, terms) if set(terms) <= set(toks) else 0.0)
            cand.append((-s, d[0]))
        want = [c[1] for c in sorted(cand)[:5]]
        assert [d for _, d, _ in sorted(got[qid])] == want


def test_unrelated_parts_substring_join_matches_pairwise(spark):
    """The equi-join on substrings equals the pairwise containment test (either way)."""
    rng = random.Random(7)
    alphabet = "abc가나"

    def word():
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))

    quote, docs, symptoms = [], [], []
    for est in range(12):
        n_ev = 0 if est == 11 else 1  # estimate 11 has a symptom without evidence
        symptoms.append((est, 1, n_ev))
        # a hot estimate: many quoted and expected parts
        nq, nd = (40, 25) if est == 0 else (rng.randint(1, 6), rng.randint(0, 4))
        for no in range(nq):
            quote.append((est, word(), no + 1))
        for _ in range(nd):
            docs.append((est, ", ".join(word() for _ in range(rng.randint(1, 3)))))
    qp = spark.createDataFrame(quote, "estimate_id long, part string, first_no int").groupBy("estimate_id", "part").agg(
        F.min("first_no").alias("first_no"))
    ps = spark.createDataFrame(symptoms, "estimate_id long, symptom_no int, n_evidence long")
    md = spark.createDataFrame(docs, "estimate_id long, repair_parts string")
    got = {(r.estimate_id, r.part) for r in R.unrelated_parts(qp, ps, md).collect()}

    expected_keys: dict[int, set[str]] = {}
    for est, rp in docs:
        for p in rp.split(", "):
            expected_keys.setdefault(est, set()).add(p.lower())
    want = set()
    for est, part in {(e, p) for e, p, _ in quote}:
        if est == 11:
            continue
        q = part.lower()
        eks = expected_keys.get(est, set())
        if not any(e in q or q in e for e in eks):
            want.add((est, part))
    assert got == want


def test_contained_pairs_equal_pairwise(spark):
    rng = random.Random(11)
    word = lambda top: "".join(rng.choice("abcd") for _ in range(rng.randint(1, top)))
    needles = {(e, word(7)) for e in range(6) for _ in range(30)} | {(9, "abc")}
    hays = {(e, word(40 if e == 0 else 12)) for e in range(6) for _ in range(40)} | {(8, "abc")}
    schema = "estimate_id long, s string"
    got = R.contained_pairs(spark.createDataFrame(sorted(needles), schema), spark.createDataFrame(sorted(hays), schema)).collect()
    want = {(e, n, h) for e, n in needles for f, h in hays if e == f and n in h}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_block_search_reads_few_documents_and_loses_none():
    """Clustered vectors and texts of unlike size: bounds skip most blocks, results are whole."""
    from pricelens.operators import blocks as B
    from pricelens.operators.postings import LexicalBlocks, VectorBlocks

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = [list(centres[k % 20] + 0.05 * rng.normal(size=16)) for k in range(2000)] + [None, [0.0] * 16, [1.0]]
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words, size=int(rng.choice([4, 12, 200])))) for _ in range(1500)] + ["", "w1"]
    cases = [
        (VectorBlocks(), {"embedding": vectors}, [list(centres[k] + 0.05 * rng.normal(size=16)) for k in range(20)], 0.3),
        (LexicalBlocks(0.7, 0.3), {"symptom_text": [t + " x" for t in texts], "evidence_text": texts}, [" ".join(rng.choice(words, size=4)) for _ in range(20)], 0.8),
    ]
    for kind, docs, queries, most in cases:
        n = len(next(iter(docs.values())))
        places = kind.arranged(docs, 50)
        assert sorted(np.concatenate(places)) == list(range(n)) and max(map(len, places)) <= 50
        blocks = []
        for some in places:
            block = kind.build({c: [v[k] for k in some] for c, v in docs.items()})
            blocks.append((np.array(some), kind.opened({c: block[c].astype(t) for c, t in kind.arrays.items()})))
        read = 0
        for query in queries:
            whole = np.full(n, np.nan)
            for ids, block in blocks:
                whole[ids] = kind.scores(query, block, len(ids))
                assert not np.nanmax(whole[ids], initial=-1) > kind.bound(query, block)
            want = B._best(whole, np.arange(n), 10)
            ids, scores, scored = B.search_group(query, blocks, kind, 10)
            assert list(ids) == list(want) and list(scores) == list(whole[want])
            floored, _, fewer = B.search_group(query, blocks, kind, 10, floor=float(scores[4]))
            assert list(floored[:5]) == list(want[:5]) and fewer <= scored
            read += scored
        assert read / (n * len(queries)) < most, read / (n * len(queries))


def test_only_quotes_of_diagnosed_estimates_are_grouped(spark, monkeypatch):
    """The quoted parts of other estimates are left out before the lines are shuffled."""
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(R, "cut_lineage", cut)
    lines = spark.createDataFrame(
        [(e, n, p) for e in (1, 2, 3, None) for n, p in ((2, "brake pad"), (1, "door"), (3, "door"))], "estimate_id long, no int, part_official_name string"
    )
    per = spark.createDataFrame([(1, 1, 2), (2, 1, 0), (2, 2, 3), (None, 1, 1)], "estimate_id long, symptom_no int, n_evidence long")
    match = spark.createDataFrame([(1, "pad, x"), (2, "door")], "estimate_id long, repair_parts string")
    found = R.unrelated_parts(R.quote_part_list(lines), per, match).collect()
    assert [tuple(r) for r in found] == [(1, "door", 1)]
    assert plans[0].index("Aggregate") < plans[0].index("LeftSemi"), plans[0]


def test_only_named_documents_meet_their_hits(spark):
    import __spark_entry__ as E
    from conftest import SF001

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "doc_id long, t string")
    hits = spark.createDataFrame([(1,), (1,), (7,), (None,)], "doc_id long")
    assert [tuple(r) for r in R.named_docs(docs, hits).collect()] == [(1, "a"), (1, "a")]
    for key in ("keyword_boost", "validation_request"):
        plan = E.queries()[key](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan, key
