"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import (
    best_position,
    curriculum,
    html_extract,
    merkle,
    order_minhash,
    packing,
    pieces,
    pii,
    ppm,
    secrets,
    simhash,
    topk,
    toxicity,
)
from pricelens.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def base_of(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    s = F.col("secrets")
    return found.select(
        "doc_id",
        *[count_of(s, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(span_list(base_of(s, secrets.KINDS)), 256).alias("base_sha256"),
        span_list(s).alias("spans"),
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_outside_fold(docs, table(spark, sf_dir, "labels"))
    return docs.select(
        "doc_id",
        (toxicity.fold(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"),
        toxicity.toxicity(docs, model).alias("found"),
    ).select("doc_id", "held_out", "found.*")


@query
def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = toxicity.fold(F.col("doc_id"), 5)
    counts = ppm.corpus_counts(docs.filter(remainder != 1))
    scored = ppm.score_documents(docs, counts)
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("print")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_extract.train(pages)
    text = html_extract.main_text(pages, model)
    found = pages.select("page_id", "url", text.alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.scan_private(docs, pii.train(docs))
    s = F.col("private")
    return found.select(
        "doc_id",
        *[count_of(s, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(span_list(base_of(s, pii.KINDS)), 256).alias("base_sha256"),
        span_list(s).alias("spans"),
    )


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = merkle.fields_digest(list(fields.values()))
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = merkle.fields_digest(list({**fields, "n_chars": one_more}.values()))
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    found = merkle.manifest(docs, leaf, F.when(hit, tampered))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = curriculum.mix(docs, curriculum.alternating_schedule(docs, [5, 2, 1]))
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    first = F.get("copies", F.lit(0))["position"]
    rows = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), first.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE["op5_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

ORACLE["op11_ranked_search"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), q AS (
    SELECT row_number() OVER () AS query, item_id, unnest(list_distinct(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark
), totals AS (
    SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), tf AS (
    SELECT row, doc_id, n, term, count(*) AS tf
    FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, totals GROUP BY term, n_docs
), scored AS (
    SELECT query, item_id, row, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN tf USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE["op12_merkle_manifest"] = """
WITH RECURSIVE fields AS (
    SELECT row_number() OVER () AS row, doc_id, lang, n_chars, CAST(doc_id AS VARCHAR) AS id,
           list_transform([CAST(doc_id AS VARCHAR), source, lang], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS head,
           list_transform([CAST(n_chars AS VARCHAR), CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)],
                          lambda x: coalesce(strlen(x) || ':' || x, '-')) AS size,
           coalesce(strlen(text) || ':' || text, '-') AS body
    FROM documents
), digests AS (
    SELECT row, doc_id, lang, sha256(array_to_string(head, '') || size[1] || body) AS leaf,
           sha256(array_to_string(head, '') || size[2] || body) AS changed,
           xor(list_reduce(range(8 * strlen(id)), lambda c, i:
               xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(id[i // 8 + 1]) ELSE 0 END) >> 1,
                   3988292384 * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(id[i // 8 + 1]) ELSE 0 END) & 1)),
               CAST(4294967295 AS BIGINT)), 4294967295) AS crc
    FROM fields
), leaves AS (
    SELECT row, doc_id, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS used,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY lang) AS nodes
    FROM digests
), low AS (
    SELECT tree, 0 AS level, place, nodes, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM low WHERE nodes > 1 GROUP BY tree, level, place // 2, nodes
), subroots AS (
    SELECT tree, level AS height, digest AS subroot FROM low WHERE nodes = 1
), high AS (
    SELECT 0 AS level, tree AS place, (SELECT count(*) FROM subroots) AS nodes, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, (nodes + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM high WHERE nodes > 1 GROUP BY level, place // 2, nodes
), steps AS (
    SELECT l.row, n.level, l.place >> n.level AS at, n.digest AS sibling
    FROM leaves l JOIN low n ON n.tree = l.tree AND n.place = xor(l.place >> n.level, 1)
    UNION ALL
    SELECT l.row, s.height + n.level, l.tree >> n.level, n.digest
    FROM leaves l JOIN subroots s USING (tree) JOIN high n ON n.place = xor(l.tree >> n.level, 1)
), heights AS (
    SELECT tree, height + (SELECT max(level) FROM high) AS height FROM subroots
), folded AS (
    SELECT row, 0 AS level, height, used AS digest FROM leaves JOIN heights USING (tree)
    UNION ALL
    SELECT f.row, f.level + 1, f.height,
           sha256(CASE WHEN s.at % 2 = 1 THEN s.sibling || f.digest ELSE f.digest || coalesce(s.sibling, '') END)
    FROM folded f LEFT JOIN steps s ON s.row = f.row AND s.level = f.level WHERE f.level < f.height
), proofs AS (
    SELECT row, string_agg(sibling, '' ORDER BY level) AS proof FROM steps GROUP BY row
)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN folded f ON f.row = l.row AND f.level = f.height
LEFT JOIN proofs p ON p.row = l.row, (SELECT digest FROM high WHERE nodes = 1) r
"""

ORACLE["op13_curriculum_mix"] = r"""
WITH sizes AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sizes GROUP BY source
), rates AS (
    SELECT 3.0::DOUBLE * source_size / weight AS room, source,
           (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (
               ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (
               ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
    FROM sources
), targets AS (
    SELECT source, source_size, weight, least(3.0::DOUBLE * source_size, weight * coalesce(
        (SELECT rate FROM rates WHERE room > rate ORDER BY room, source LIMIT 1), 0)) AS target
    FROM sources
), placed AS (
    SELECT doc_id, size, source_size, weight, target, CAST(floor(target + 0.5) AS BIGINT) AS due,
           CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, size
               ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), shares AS (
    SELECT *, greatest(0, least(size, due - start)) AS once, greatest(0, least(size, due - start - source_size)) AS twice,
           greatest(0, least(size, due - start - 2 * source_size)) AS thrice,
           weight * CASE WHEN weight = 5 THEN 1.5 WHEN weight = 1 THEN 0.5 ELSE 1 END AS w0,
           weight * CASE WHEN weight = 5 THEN 0.5 WHEN weight = 1 THEN 1.5 ELSE 1 END AS w1
    FROM placed
), gone AS (
    SELECT *, CASE WHEN once > 0 THEN (start + once / 2) / due * weight END AS gone FROM shares
)
SELECT doc_id, size, source_size, target, once + twice + thrice AS taken,
       CASE WHEN gone IS NOT NULL THEN least(2 * gone / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * gone, 0))), 1) END AS position
FROM gone
"""
