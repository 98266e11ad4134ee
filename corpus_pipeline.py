"""Documents to packed training windows, in five written stages.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; all but the last return the
columns that they are given. Rows that repeat a doc_id are one document throughout: they stay or go together. Rows with a null
doc_id are never duplicates. Null and empty texts are scored as texts without words, and those that stay are packed as their
end token alone. Empty tables give empty tables; columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.line_dedup import kept_lines, repeated_lines
from sitefold.llm.minhash_dedup import near_duplicates
from sitefold.llm.mixing import mix_to_targets
from sitefold.llm.packing import pack_documents
from sitefold.llm.quality import score_quality
from sitefold.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.where("predicted = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go; so do documents of which no line is left."""
    gone = repeated_lines(docs.select("doc_id", "text").where("doc_id IS NOT NULL"), Workspace(spark, "pipeline-lines"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    kept = kept_lines(rows, gone).where("n_removed = 0 OR trim(BOTH ' \\t\\r\\n' FROM kept_text) <> ''")
    text = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[text[c].alias(c) if c in text else F.col("row")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; languages of labelled documents are the domains."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    mixed = mix_to_targets(docs, docs.select("doc_id", F.col("lang").alias("domain")).join(labels, "doc_id"))
    copies = mixed.where("copies > 0").select(F.col("doc_id").alias("mixed_id"), "copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    repeated = rows.join(copies, F.col("row.doc_id").eqNullSafe(F.col("mixed_id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of up to 4096 tokens."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_copies), ("mixing to target weights", mixing), ("packing", packing)]
#: Tokenizers and the classifier have no SQL form; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written before the next one reads it."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = space.write(docs, f"stage{k}")
    return docs
