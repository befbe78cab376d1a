"""A corpus pipeline of five stages over `documents`: toxicity, line deduplication, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder and read again as the
next stage's docs. All stages but the last return the columns of documents. Empty tables pass through all stages; null texts count as empty;
rows with a null doc_id are kept by the stages that drop documents by id. Very long texts go through all stages whole. Of linked documents the one
with the smallest doc_id stays, of rows that repeat it in all columns but maps one. Columns of documents are carried along, but for those named like
the ones that the last stage adds (n_tokens, ids_sha256, decoded_sha256), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshql.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from meshql.llm.shared import cut, new_folder, table

#: Up to so many ids are sent to all workers to drop documents; with more, documents and ids are joined by shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in ids."""
    ids = cut(ids.where("doc_id is not null").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that many documents hold; n_chars is that of what is kept."""
    return line_dedup.dedup_lines(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; rows that repeat it whole go too."""
    found = cut(jaccard.near_components(docs))
    kept = _without(docs, found.where(F.col("doc_id") != F.col("component_id")).select("doc_id"))
    repeats = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    comparable = [c for c, kind in kept.dtypes if "map<" not in kind]
    return kept.dropDuplicates(comparable) if repeats else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, with n_tokens, ids_sha256 and decoded_sha256."""
    return bpe.bpe(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Toxicity and BPE can't be expressed in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        uri = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(uri)
        docs = spark.read.parquet(uri)
    return docs
