"""Queries of the operators over their whole tables; SQL for those that SQL can express is in ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, fingerprints, minhash, negatives, packing, pii, quality, quality_sql, secrets, sentences, toxicity, urls, vectors
from .common import table


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "component_id", "kept")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], told.schema)
    nodes, members = chat.tree(told.unionByName(more), tokenizer_file("byte_bpe_50k.json"))
    return chat.read_back(nodes, members, tokenizer_file("byte_bpe_50k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("distance")


def tokenizer_file(name: str) -> str:
    """A tokenizer's file: a parameter of the operators, found here for the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    again = F.sha2(fim.restored(F.col("form"), F.col("output")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_url_filters": op4_url_filters,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scans": op10_secret_scans,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_fingerprints": op13_fingerprints,
}
#: All pairs: for the small tables on which the driver compares.
LINKS_SQL = f"""WITH RECURSIVE g AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  f AS MATERIALIZED (SELECT * FROM g WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  p AS MATERIALIZED (SELECT a.r AS x, b.r AS y FROM f a JOIN f b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {vectors.SIMILARITY}),
  reach AS (SELECT r AS x, r AS y FROM g UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
  c AS (SELECT reach.x AS r, min(g.vec_id) AS component_id FROM reach JOIN g ON g.r = reach.y GROUP BY reach.x), n AS (SELECT x AS r, count(*) AS n_links FROM p GROUP BY x)
  SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM g JOIN c USING (r) LEFT JOIN n USING (r)"""
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": LINKS_SQL, "op9_quality_rules": quality_sql.sql(), "op11_hard_negatives": negatives.SQL, "op12_fill_in_middle": fim.SQL}
