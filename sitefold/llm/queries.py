"""Queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.fill_in_middle import fill_in_middle, restored
from sitefold.llm.line_dedup import dedup_lines
from sitefold.llm.lloyd import cluster_vectors, with_inertia
from sitefold.llm.minhash_dedup import near_duplicates
from sitefold.llm.mixing import mix_to_targets
from sitefold.llm.packing import pack_documents
from sitefold.llm.quality import score_quality
from sitefold.llm.substring_dedup import remove_repeats
from sitefold.llm.sql import ORACLE_SQL  # noqa: F401
from sitefold.llm.token_counts import count_tokens
from sitefold.llm.url_filter import judge_urls
from sitefold.llm.vector_dedup import near_vectors
from sitefold.llm.vector_search import EVERY, top_inner_products
from sitefold.llm.winnowing import benchmark_hits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the query, longest first or not; given with the task.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where(f"vec_id % {EVERY} = 0"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_removed and the SHA-256 of the text that is kept."""
    deduped = dedup_lines(_table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the languages of the labelled documents."""
    docs = _table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return mix_to_targets(docs, labelled)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that occur in benchmark items, and a digest of those items."""
    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = [F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")]
    return hits.select("doc_id", "n_words", "n_hit", *items, (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each output and of the text that is restored from it."""
    cut = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_packing": op2_packing,
    "op3_exact_topk": op3_exact_topk,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clustering": op13_centroid_clustering,
}
