"""Block indexes: bounded by content, read where they lie, any number of queries."""

import numpy as np
import pytest

from pricelens.functions import lexical as LX
from pricelens.operators import blocks as B
from pricelens.operators import retrieval as R
from pricelens.operators.postings import BLOCK_CHARS, LexicalBlocks

DOC = "id long, vehicle_model string, system_category string, symptom_text string, evidence_text string, symptom_embedding array<float>"
QUERY = "qid string, scope string, systems array<string>, query_text string, qvec array<float>"


def test_long_texts_share_no_block():
    texts = ["a " * 10, "b " * (BLOCK_CHARS // 4), "c " * (BLOCK_CHARS // 4), "", "d " * BLOCK_CHARS, "e"]
    places = LexicalBlocks(0.7, 0.3).arranged({"symptom_text": texts, "evidence_text": texts}, 125)
    assert [list(p) for p in places] == [[0, 3, 5], [1], [2], [4]]
    many = ["x"] * 700
    assert max(map(len, LexicalBlocks(0.7, 0.3).arranged({"symptom_text": many, "evidence_text": many}, 500))) == 256


def test_a_block_of_very_many_words():
    kind = LexicalBlocks(0.7, 0.3)
    texts = [" ".join(f"w{k}" for k in range(70_000)), "w69999 w3", "w3 w5 w69999"]
    docs = {"symptom_text": texts, "evidence_text": ["", "", ""]}
    made = kind.build(docs)
    block = kind.opened({c: made[c].astype(t) for c, t in kind.arrays.items()})
    for query in ("w3 w69999", "w65536", "w5 w3"):
        terms, codes = LX.tokens(query), set(LX.trigram_codes(query).tolist())
        want = []
        for t in texts:
            tokens, own = LX.tokens(t), set(LX.trigram_codes(t).tolist())
            cover = LX.cover_density(tokens, terms) if set(terms) <= set(tokens) else 0.0
            want.append(0.3 * len(codes & own) / len(codes | own) + 0.7 * cover)
        assert kind.scores(query, block, 3) == pytest.approx(want)


def _tables(spark):
    rng = np.random.default_rng(8)
    words = ["brake", "noise", "engine", "oil", "pad", "battery", "door", "fan"]
    text = lambda n: " ".join(rng.choice(words, size=n))
    docs = [(k, f"M{k % 2}", "ab"[k // 2 % 2], text(2), text(6), None if k % 7 == 0 else [float(x) for x in rng.normal(size=4)]) for k in range(80)]
    docs += [(80, None, "a", "oil", "oil", None), (81, "M0", None, "oil", None, [1.0] * 4), (81, "M0", "a", "fan", "fan", [1.0] * 4)]
    queries = [(f"q{k}", f"M{k % 3}", [[], ["a"], ["a", "b", "a"]][k % 3], text(2), [float(x) for x in rng.normal(size=4)]) for k in range(9)]
    queries += [("none", None, [], "oil", None), ("null", "M0", None, "oil", None), ("novec", "M0", [], "", None)]
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(queries, QUERY)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_rounds_of_queries_and_groups_by_content_change_nothing(spark, monkeypatch):
    docs, queries = _tables(spark)
    build = {R.vector_list: R.vector_index, R.lexical_list: R.lexical_index}
    whole = {search: _rows(search(queries, index(docs), 5)) for search, index in build.items()}
    asked = {search: {r.qid for r in search(queries, index(docs), 5).collect()} for search, index in build.items()}
    assert all(a == {*(f"q{k}" for k in range(9) if k % 3 < 2), "novec"} for a in asked.values()), asked
    monkeypatch.setattr(B, "QUERIES_PER_ROUND", 2)
    monkeypatch.setattr(B, "GROUP_BYTES", 300)
    for search, index in build.items():
        made = index(docs, docs_per_block=3)
        assert made.groups > 1
        assert _rows(search(queries, made, 5)) == whole[search]


def test_a_search_shuffles_no_block(spark):
    docs, queries = _tables(spark)
    found = R.lexical_list(queries, R.lexical_index(docs), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "w_place" not in plan and "s_docs" not in plan


def test_a_part_is_cut_by_content_in_one_pass(spark, monkeypatch):
    docs, _ = _tables(spark)
    monkeypatch.setattr(B, "GROUP_BYTES", 100)
    kind = LexicalBlocks(0.7, 0.3)
    rows = R.lexical_index(docs, docs_per_group=1000).rows.collect()
    assert len({(r["scope"], r["system"], r["group"]) for r in rows}) > 8  # by number alone: one each of 5
    assert sum(r["n"] for r in rows) == docs.where("vehicle_model IS NOT NULL").count()
    content = docs.selectExpr("id", "octet_length(symptom_text) + coalesce(octet_length(evidence_text), 0) AS size").collect()
    sizes = {r["id"]: r["size"] for r in content}
    held = {}
    for r in rows:
        held.setdefault((r["scope"], r["system"], r["group"]), []).extend(np.frombuffer(r["doc_ids"], "<i8").tolist())
    assert all(len(ids) == 1 or sum(sizes[k] for k in ids) <= 100 for ids in held.values())
    assert set(kind.arrays) < set(rows[0].asDict())


def test_groups_run_on_over_batches():
    import pyarrow as pa

    def batch(rows):
        scopes, systems, groups, ids, weights = zip(*rows)
        return pa.RecordBatch.from_pydict({"scope": scopes, "system": systems, "group": groups, "doc_id": ids, "weight": weights})

    first = batch([("a", "x", 0, 1, 4), ("a", "x", 0, 2, 4)])
    second = batch([("a", "x", 0, 3, 1), ("a", "x", 0, 4, 99), ("a", "x", 1, 5, 0), ("b", "x", 0, 6, 5)])
    made = [(place, docs["doc_id"].to_pylist()) for docs, place in B._groups(iter([first, second]), 2, 9)]
    assert made == [(("a", "x", 0), [1, 2, 3]), (("a", "x", 2), [4]), (("a", "x", 1), [5]), (("b", "x", 0), [6])]
    assert not list(B._groups(iter([]), 1, 9))


def test_documents_without_vectors_have_equal_rows(spark, tmp_path):
    from pricelens.plans import q_retrieval as Q

    spark.createDataFrame([(k, f"a b{k} c d", "en") for k in (1, 2, 3, 3)] + [(None, "x", "en"), (4, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(1, [1.0]), (2, [1.0]), (2, None), (3, [2.0]), (3, [2.0]), (3, [2.0]), (None, [1.0]), (None, [1.0]), (9, [1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole, texts = Q._docs(spark, str(tmp_path), {}), Q._texts(spark, str(tmp_path), {})
    assert texts.schema == whole.schema
    assert _rows(texts.drop("symptom_embedding")) == _rows(whole.drop("symptom_embedding")) and texts.count() == 11
    plan = texts.drop("symptom_embedding")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
