"""Document registry, conversations, statistics and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_now() -> Column:
    """The time of the query in UTC, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def accepted_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files whose name ends in .pdf, in that case; with max_bytes also no larger than that."""
    out = files.where(F.col("filename").endswith(".pdf"))
    return out if max_bytes is None else out.where(F.col("file_size") <= max_bytes)


def register(files: DataFrame) -> DataFrame:
    """A registry row per file (doc_id, filename, text)."""
    return files.select(
        "doc_id", "filename", F.concat(F.lit("uploads/"), F.col("doc_id").cast("string"), F.lit("_"), F.col("filename")).alias("file_path"), F.octet_length("text").cast("long").alias("file_size"), F.sha2("text", 256).alias("content_hash"),
        F.lit("completed").alias("upload_status"), F.lit("pending").alias("processing_status"), F.lit(0).alias("total_pages"), F.lit(0).alias("processed_pages"),
    )


def first_of_content(docs: DataFrame) -> DataFrame:
    """(content_hash, doc_id, n_copies): the smallest id of each content."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def page_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count_distinct("page_number").alias("total_pages"), F.count_distinct("page_number").alias("processed_pages"))


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["n_chunks"])


def document_status(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Name, status, pages and chunks of each document; both counts come from one aggregation."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("page_number").alias("pages"))
    out = registry.join(counts, "doc_id", "left").na.fill(0, ["n_chunks", "pages"])
    return out.select("doc_id", "filename", "file_size", F.when(F.col("n_chunks") > 0, "completed").otherwise(F.col("processing_status")).alias("status"), F.col("pages").alias("processed_pages"), F.col("pages").alias("total_pages"), "n_chunks")


def outcomes(attempts: DataFrame) -> DataFrame:
    """Attempts (doc_id, error) to their final status and, where they ended well, when; the error goes to the metadata."""
    failed = F.col("error").isNotNull()
    return attempts.select("doc_id", F.when(failed, "failed").otherwise("completed").alias("processing_status"), F.when(~failed, utc_now()).alias("processed_at"), F.when(failed, F.to_json(F.struct("error"))).alias("metadata"))


def collection_stats(chunks: DataFrame, metric: str = "COSINE") -> DataFrame:
    """Per collection, and over all of them (collection null): documents, chunks, largest dimension of the vectors (embedding), metric."""
    found = chunks.rollup("collection").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.max(F.size("embedding")).alias("dimension"))
    return found.select("collection", "n_documents", "n_chunks", "dimension", F.lit(metric).alias("metric"))


def granted(queries: DataFrame, grants: DataFrame, roles: tuple[str, ...] = ("reader", "owner")) -> DataFrame:
    """(query_id, dataset): what the users of queries (query_id, user_id) may find by grants (user_id, dataset, role); null for who may find nothing.

    It goes to the search as `allowed`, so rights hold before every limit, and it has a row for each query and dataset, not for each document."""
    may = grants.where(F.col("role").isin(*roles)).select("user_id", "dataset").distinct()
    return queries.select("query_id", "user_id").join(may, "user_id", "left").select("query_id", "dataset")


def conversation_table(turns: DataFrame) -> DataFrame:
    """Turns (conversation_id, turn, role, content, created_at) to one row per conversation; the title is the first 50 characters of the first user turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conversation_id").agg(F.substring(first, 1, 50).alias("title"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("n_messages"))


def append_conversations(requests: DataFrame) -> DataFrame:
    """Requests (query_id, query, conversation_id) with the id they write to; those without one open a conversation of their own."""
    new = F.col("conversation_id").isNull()
    return requests.select("query_id", F.when(new, F.concat(F.lit("new_"), F.col("query_id").cast("string"))).otherwise(F.col("conversation_id").cast("string")).alias("conversation_id"), F.when(new, F.substring("query", 1, 50)).alias("title"), new.alias("is_new"))


def append_messages(requests: DataFrame) -> DataFrame:
    """A user row and an assistant row per request (query_id, query, answer, sources); the assistant's metadata has the sources as JSON."""
    asked = requests.select("query_id", F.lit("user").alias("role"), F.col("query").alias("content"), F.lit(None).cast("string").alias("metadata"))
    return asked.unionByName(requests.select("query_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.to_json(F.struct("sources")).alias("metadata")))


def history(turns: DataFrame, last: int = 4) -> DataFrame:
    """(conversation_id, history): the last turns of each conversation in their order, `role: content` by line.

    max-by-turn keeps `last` rows a conversation before they are gathered."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc("turn")))
    kept = turns.withColumn("r", rank).where(F.col("r") <= last)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "content").alias("t"))))
    return kept.groupBy("conversation_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("history"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def only(rows: DataFrame, wanted: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(wanted, key, "left_semi")


def of_documents(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of the documents in wanted (doc_id); an empty list means all."""
    return chunks if wanted.isEmpty() else only(chunks, wanted.select("doc_id"), "doc_id")


def token_usage(turns: DataFrame, *by: str) -> DataFrame:
    """Words by role, or by the columns named, with their subtotals (null)."""
    from tessera.functions.text import words

    by = by or ("role",)
    return turns.select(*by, F.size(words(F.col("content"))).cast("long").alias("n")).rollup(*by).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_messages"))


def hot_terms(turns: DataFrame, most: int = 20) -> DataFrame:
    from tessera.functions.text import tokens

    terms = turns.where("role = 'user'").select(F.explode(tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.orderBy(F.desc("n"), "term").limit(most)
