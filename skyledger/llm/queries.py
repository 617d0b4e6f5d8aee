"""The registered queries of the llm operators, at production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import align, bpe, decontaminate, kneser_ney, langid, negatives, prefix_bpe, rules, sharding, simhash, substring, suffix_array, urls
from skyledger.llm.common import table


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def merge_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.fold() != 2))
    return langid.predictions(docs, model).withColumn("held_out", langid.fold() == 2)


def op3_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), rules.good_ids(table(spark, sf_dir, "labels")))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 40, ["lang", "source", "size"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), rank_file())


def op7_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), length=20)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(table(spark, sf_dir, "documents"), length=100).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "rule")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), merge_file(), piece_file())


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.token_digests(table(spark, sf_dir, "documents"), merge_file())


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_host_trust": op3_host_trust,
    "op4_kneser_ney": op4_kneser_ney,
    "op5_hilbert_shards": op5_hilbert_shards,
    "op6_bpe": op6_bpe,
    "op10_decontamination": op10_decontamination,
    "op7_suffix_automaton": op7_suffix_automaton,
    "op8_suffix_array": op8_suffix_array,
    "op9_quality_rules": op9_quality_rules,
    "op11_alignment": op11_alignment,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The exact operators whose results SQL can express and DuckDB gives over whole tables in some seconds.
ORACLE_SQL: dict[str, str] = {
    "op7_suffix_automaton": r"""WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d) x),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM windows) y WHERE n > 1),
    kept AS (SELECT z.doc_id, string_agg(word, ' ' ORDER BY z.at) AS text, COUNT(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d) z LEFT JOIN gone g ON g.doc_id = z.doc_id AND g.at = z.at WHERE g.at IS NULL GROUP BY z.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op13_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE label = own) x WHERE k <= 5)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
        SELECT p.anchor_id, p.id AS positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND n.label <> n.own AND 80 * p.score <= 100 * n.score AND n.score <= p.score) y WHERE rank <= 5""",
}
