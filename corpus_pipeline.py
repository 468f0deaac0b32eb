"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm import decontaminate, mixing, ngram_join, suffix_dedup, toxicity
from gameline.llm.common import arrow_bounds, released, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of all documents."""
    arrow_bounds(spark)
    scored = toxicity.toxicity_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), F.lit(True), keep_text=True)
    return scored.where("predicted = 0").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8; of rows that repeat its
    id, one of the smallest text. Rows without an id stay."""
    arrow_bounds(spark)
    docs = docs.select(*COLUMNS)
    found = ngram_join.ngram_components(docs, k=5, percent=80)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier too; characters cut in two go with them. A document of
    which nothing but white space is left goes, if something was cut. A null text becomes an empty one."""
    cut = suffix_dedup.suffix_dedup(docs.select(*COLUMNS), 100, keep_bytes=False).withColumn("text", F.col("kept_text"))
    out = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    arrow_bounds(spark)
    return decontaminate.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents, with their tokens and probabilities."""
    return mixing.mixed(mixing.with_topic(docs.select(*COLUMNS))).where("sampled").select(*COLUMNS, "topic", "n_tokens", F.round("probability", 9).alias("probability"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeated_passages", repeated_passages_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]
#: SQL expresses neither the classifier nor the links' closure at this size; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            released(before)  # the source table is not a stored one and stays
    return docs
