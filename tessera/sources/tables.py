"""The canonical tables, made from the driver's parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import catalog, chunking
from tessera.operators.ordering import numbered
from tessera.sources.layout import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, filename, text): every tenth document is a .txt file."""
    ending = F.when(F.col("doc_id") % 10 == 0, ".txt").otherwise(".pdf")
    return read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("filename"), "source", "text")


def registry(spark: SparkSession, d: str) -> DataFrame:
    return catalog.register(catalog.accepted_files(files(spark, d)))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    pages = spread(read(spark, d, "documents")).select("doc_id", F.lit(1).alias("page_number"), "text")
    return chunking.scan_page_text(pages).withColumn("element_no", F.lit(0))


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """(volume, page_number, doc_id, text): the documents of a source are the pages of one volume, numbered from 1 by doc_id."""
    rows = read(spark, d, "documents").select(F.col("source").alias("volume"), "doc_id", "text")
    return numbered(rows, "volume", ["doc_id"]).select("volume", (F.col("position") + 1).alias("page_number"), "doc_id", "text")


def chunks(spark: SparkSession, d: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return chunking.chunk_pages(page_text(spark, d), size, overlap)


def queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return read(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def web_pages(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return spread(read(spark, d, "pages")).select("page_id", "url", title.alias("title"), T.html_text(F.col("html")).alias("content"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements: the paragraphs of pages, whose type goes round by page and place; every seventh page is a full page."""
    parts = read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("element_no", "content"))
    kind = F.when(F.col("page_id") % 7 == 0, "full_page").otherwise(F.element_at(F.array(*map(F.lit, ("table", "text", "figure", "header"))), ((F.col("page_id") + F.col("element_no")) % 4 + 1).cast("int")))
    blank = F.when((F.col("page_id") + F.col("element_no")) % 5 == 0, F.lit("  ")).otherwise(F.col("content"))
    return parts.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "element_no", kind.alias("element_type"), blank.alias("content"))
