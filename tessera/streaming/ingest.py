"""Streams that run the batch operators on files as they arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.operators.chunking import chunk_pages, scan_page_text

#: Columns of the document files that the streams read.
DOCUMENTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunked(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """The batch chunk function, on a stream or a table."""
    pages = scan_page_text(docs.select("doc_id", F.lit(1).alias("page_number"), "text"))
    return chunk_pages(pages.withColumn("element_no", F.lit(0)), size, overlap)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all there is now to parquet; a restart goes on after the last committed batch."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes each batch's changed rows to a numbered folder under path/batches; a batch that runs again replaces its own. latest() reads the rows that
    stand, compact() writes them as one snapshot."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def _snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/snapshots")
    except AnalysisException:  # there's none yet
        return None


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last version of each key that upsert_to() wrote: the newest snapshot and the batches after it; folders of earlier ones aren't read."""
    rows, snapshots = spark.read.parquet(f"{path}/batches"), _snapshots(spark, path)
    if snapshots is not None:
        upto = snapshots.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") > upto).unionByName(snapshots.where(F.col("batch") == upto))
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("r.*")


def compact(spark: SparkSession, path: str, key: str) -> int:
    """Writes the rows that stand as a snapshot named by the last batch in it, and gives that number. A snapshot that fails is written anew by the next
    call; batches are never changed."""
    upto = spark.read.parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    latest(spark, path, key).write.mode("overwrite").parquet(f"{path}/snapshots/batch={upto}")
    return upto


def chunk_counts(docs: DataFrame) -> DataFrame:
    return chunked(docs).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def new_contents(docs: DataFrame, time_col: str | None = None, within: str = "1 day") -> DataFrame:
    """The first row of each content hash. By default a content is known for ever, so state grows by a hash per content.

    With an event time, a copy is dropped if it comes within so long after the first, and hashes older than the watermark leave the state."""
    hashed = F.sha2("text", 256).alias("content_hash")
    if time_col is None:
        return docs.select(hashed).dropDuplicates(["content_hash"])
    return docs.select(hashed, time_col).withWatermark(time_col, within).dropDuplicatesWithinWatermark(["content_hash"])
