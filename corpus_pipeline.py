"""A corpus pipeline over documents: quality classifier, line dedup, near-dedup, secret redaction, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of docs; where a stage
changes text, n_chars follows it. Null and empty texts get the classifier's score of their statistics, hold no lines, are like no other row, have no
secrets and are one piece of the end id; an empty table stays empty; repeated rows are judged alike; columns beside those of documents stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_dedup, packing, quality_classifier, secret_scan
from tessera.llm.common import table, written
from tessera.llm.queries import tokenizer_path


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores under its threshold. Labels of held-out ids aren't learned from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.fit(docs, labels.where(~quality_classifier.held_out(F.col("doc_id")))).keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier document holds out of the texts."""
    return _recounted(line_dedup.drop_repeated_lines(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: shingles of five words, similarity 0.8.

    Line dedup leaves of a near copy only the lines that differ, which resemble nothing. So the rows that arrive here are compared on their texts in
    documents, before lines were cut. It also bares copies that stood among other texts' lines, so the rows that are left are then compared on their
    texts as they arrive. Only rows still there are compared, so none goes for a copy that went. What is kept is the row as it arrives."""
    kept = near_dedup.keep_one_each(docs, whole=table(spark, sf_dir, "documents"))
    return near_dedup.keep_one_each(written(kept, "unlike-whole", compression="zstd"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    return _recounted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences: one row per piece."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near), ("secret scan", secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
