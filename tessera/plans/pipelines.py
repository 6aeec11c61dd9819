"""Compositions: ingest, and question answering from retrieval to groundedness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import answers, search
from tessera.operators.catalog import utc_now
from tessera.sources.scratch import written


def graded_hits(queries: DataFrame, chunks: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    return answers.grade(search.retrieve(queries, chunks, k, allowed=allowed))


def united(queries: DataFrame, graded: DataFrame, web: DataFrame) -> DataFrame:
    """Relevant chunks by rank, then web hits for the queries that have under two of them."""
    needed = answers.web_search_needed(queries, graded)
    relevant = graded.where("is_relevant").select("query_id", "chunk_id", "content", F.col("rerank_score").alias("score"), "rank")
    return answers.with_web_fallback(relevant, answers.web_chunks(web), needed)


def rag(queries: DataFrame, chunks: DataFrame, pages: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """One row per query: answer, web_search_needed, hallucination_score, n_sources. Graded hits and what is answered from are written once each."""
    graded = written(graded_hits(queries, chunks, k, allowed), "graded")
    needed = answers.web_search_needed(queries, graded)
    web = answers.web_corpus_search(queries.join(needed.where("web_search_needed"), "query_id", "left_semi"), pages)
    both = written(united(queries, graded, web), "united")
    context = answers.build_context(queries, both)
    n_sources = both.where("position <= 3").groupBy("query_id").agg(F.count("*").alias("n_sources"))
    rows = queries.join(context, "query_id").withColumn("answer", answers.answer(F.col("query"), F.col("context")))
    rows = rows.withColumn("hallucination_score", answers.hallucination(F.col("answer"), F.col("context")))
    return rows.join(needed, "query_id").join(n_sources, "query_id", "left").select("query_id", "answer", "web_search_needed", "hallucination_score", F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"))


def ingest(chunks: DataFrame) -> DataFrame:
    """chunks as the sink takes them: with a row id that a rerun gives again, their vector, metadata as JSON, score 0 and the time."""
    id_ = F.regexp_replace(F.md5("chunk_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    metadata = F.to_json(F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    return embedding.embed(chunks, "content").withColumns({"id": id_, "metadata": metadata, "score": F.lit(0.0), "created_at": utc_now()})
