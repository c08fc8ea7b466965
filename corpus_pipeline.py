"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, packing; a text operator each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm import decontaminate, fm, jaccard, packing, pii
from driftwise.llm.common import free_name, stored, table, widen
from driftwise.llm.queries import TOKENIZER, quality_model
from driftwise.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "quality_score")
    return widen(fm.score(docs, model, out=score).where(F.col(score) >= 0.5), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of links (words in fives, similarity 0.8): the one with the smallest id, rows without
    an id last; of rows that share an id the one with the smallest text. Documents without words are in no group and stay."""
    key = free_name(docs.columns, "doc_key")
    # Rows without an id get one behind all others, made from the text, so that copies share it.
    made = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn(key, F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.coalesce(F.col("doc_id").cast("long"), made)))
    found = jaccard.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, percent=80)
    marks = (found.where("doc_id is not null").groupBy(F.col("doc_id").alias(key))
             .agg(F.max(F.col("component_id") != F.col("doc_id")).alias("goes"), F.count("*").alias("n")).where("goes or n > 1"))
    marks = stored(marks, "pipeline-groups")
    left = keyed.join(marks.where("goes").select(key), key, "left_anti")
    again = marks.where("not goes").select(key)
    if not again.head(1):
        return widen(left, docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(again, key, "left_semi").groupBy(key).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return widen(left.join(again, key, "left_anti"), docs.columns).unionAll(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Documents are told apart by their text, so that copies share the verdict."""
    key = free_name(docs.columns, "text_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    leaked = decontaminate.leaks(keyed.select(key, "text"), key, table(spark, sf_dir, "benchmark"))
    return widen(keyed.join(leaked.select(F.col("key").alias(key)).distinct(), key, "left_anti"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    return widen(pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=0, size=1024)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
          ("PII", personal_data), ("packing", packed)]

#: Trained and tokenising stages have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
