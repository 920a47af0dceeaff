"""The registered queries of this subpackage: thin bindings of operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import conversation, decontaminate, divergence, embeddings, jaccard, language, order_minhash, packing, quality, secrets, sharding, substrings, wavelet
from daybook.llm.common import held_out, table


def repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.learn_dictionaries(docs.where(~held_out()).select("text", "lang"))
    return language.identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.join(table(spark, sf_dir, "embeddings"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    return quality.scored(docs, quality.learn(docs.where(~held_out()), judged)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def decontaminated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_id")


def size_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.report(conversation.damaged(table(spark, sf_dir, "conversations")))


def order_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_array_dedup": repeats_removed,
    "op2_ngram_jaccard_join": jaccard_components,
    "op3_language_id": languages,
    "op4_secret_scans": secret_spans,
    "op5_embedding_near_dedup": vector_links,
    "op6_quality_classifier": quality_scores,
    "op7_token_binary_output": token_shards,
    "op8_best_fit_packing": packed,
    "op9_benchmark_decontamination": decontaminated_words,
    "op10_sharding": size_shards,
    "op11_conversation_repair": repaired_conversations,
    "op12_document_fingerprints": order_fingerprints,
    "op13_source_divergence_audit": source_divergence,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(ws, i, i + least(len(ws), 10) - 1) AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(w) AS n FROM iw),
dw AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN iw ON dw.w = iw.w),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op13_source_divergence_audit": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
voc AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (SELECT k.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v) AS p
      FROM kept k JOIN voc v USING (lang) JOIN tot g USING (lang) LEFT JOIN cnt c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.c + 1)) // (v.n + v.v) AS q FROM kept k JOIN voc v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
       FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item) ASC)::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
