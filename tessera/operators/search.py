"""Vector, keyword and hybrid search over whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import embedding as E
from tessera.functions import terms
from tessera.functions import text as T
from tessera.operators.grid import grid_search, limiting
from tessera.sources.scratch import written

#: Queries whose vectors are put into one matrix that every task holds: a bound on what is collected and broadcast. More go through the grid.
QUERY_BLOCK = 2048


def ranked(hits: DataFrame, by: str = "score", tie: str = "chunk_id", to: str = "rank") -> DataFrame:
    return hits.withColumn(to, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), tie)))


def top(hits: DataFrame, k: int, by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, with their rank; Spark cuts in each task before the shuffle."""
    return ranked(hits, by, tie).where(F.col("rank") <= k)


def _text_vectors(column: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: np.array([E.count_vector(t) for t in batch[column].to_pylist()]).reshape(batch.num_rows, E.DIM)


def _given_vectors(column: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: np.array(batch[column].to_pylist(), "f8")


def _search(rows: DataFrame, id_col: str, vector, ids: list, matrix: np.ndarray, k: int | None, allow=None) -> DataFrame:
    kind = f"query_id long, {id_col} {dict(rows.dtypes)[id_col]}, score double"
    return rows.mapInArrow(E.top_of_batches(vector, matrix, ids, id_col, k, allow), kind) if ids else rows.sparkSession.createDataFrame([], kind)


def _text_grid(asked: DataFrame, chunks: DataFrame, k: int, keep: str, allowed: DataFrame | None, denied: DataFrame | None) -> DataFrame:
    """Text queries of any number: both sides become vectors once and meet in a grid of blocks."""
    columns = [keep] if allowed is None else list(dict.fromkeys([keep, limiting(allowed)]))
    kinds = ", ".join(f"{c} {dict(chunks.dtypes)[c]}" for c in columns)
    queries = asked.select("query_id", "query").mapInArrow(E.count_vectors("query", "query_id"), f"query_id {dict(asked.dtypes)['query_id']}, vector array<int>")
    rows = chunks.select(*columns, "content").mapInArrow(E.count_vectors("content", *columns), f"{kinds}, vector array<int>")
    return grid_search(queries, rows, keep, k, allowed, denied)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 10, least: float | None = None, keep: str = "chunk_id", allowed: DataFrame | None = None, most_queries: int = QUERY_BLOCK, denied: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of the default embedder's largest cosine per query; the limit comes first, then the least score.

    allowed (query_id, doc_id) holds the documents that a query may find, before the limit; queries that it doesn't name may find all, and those that it
    names with null nothing. In place of doc_id it may have another column of chunks, such as the dataset that a document is in. denied (query_id,
    chunk_id) holds chunks that a query may not find, before the limit too. Scores are rounded to 6 places before ranking; ties go by id. Counts are
    whole numbers, so a score doesn't depend on the order of summing. Up to most_queries queries are one matrix that meets each batch of chunks; more are
    dealt to a grid. Only chunks with a score over 0 are hits."""
    least_score = F.col("score") > 0 if least is None else (F.col("score") > 0) & (F.col("score") >= least)
    asked = queries.select("query_id", "query").where("query_id IS NOT NULL")
    got = asked.limit(most_queries + 1).collect()
    if len(got) > most_queries:
        return top(_text_grid(asked, chunks, k, keep, allowed, denied), k, tie=keep).where(least_score)
    rows, limited = chunks.select(keep, "content"), set()
    if allowed is not None:
        # Each document's row names the queries that have it in their list: as many as the matrix has at most.
        named = allowed.join(F.broadcast(asked.select("query_id")), "query_id", "left_semi")
        limited = {r[0] for r in named.select("query_id").distinct().collect()}
        by = limiting(allowed)
        rows = chunks.select(keep, "content", by).join(named.groupBy(by).agg(F.collect_set("query_id").alias("for_queries")), by, "left").select(keep, "content", "for_queries")
    if denied is not None:
        named = denied.join(F.broadcast(asked.select("query_id")), "query_id", "left_semi")
        rows = rows.join(named.groupBy(keep).agg(F.collect_set("query_id").alias("not_for")), keep, "left")
    allow = None if allowed is None and denied is None else E.permitted([r[0] for r in got], limited)
    matrix = np.array([E.count_vector(r[1]) for r in got])
    return top(_search(rows, keep, _text_vectors("content"), [r[0] for r in got], matrix, k, allow), k, tie=keep).where(least_score)


def _given(queries: DataFrame, rows: DataFrame, id_col: str, k: int | None, most_queries: int) -> DataFrame:
    asked = queries.select("query_id", "embedding").where("query_id IS NOT NULL")
    got = asked.limit(most_queries + 1).collect()
    if len(got) > most_queries:
        return grid_search(asked.withColumnRenamed("embedding", "vector"), rows.select(id_col, F.col("embedding").alias("vector")), id_col, k)
    return _search(rows.select(id_col, "embedding"), id_col, _given_vectors("embedding"), [r[0] for r in got], np.array([r[1] for r in got], "f8"), k)


def vector_search_given(queries: DataFrame, rows: DataFrame, id_col: str, k: int, least: float | None = None, most_queries: int = QUERY_BLOCK) -> DataFrame:
    """The same for vectors that are there already: queries (query_id, embedding), rows (id_col, embedding)."""
    hits = top(_given(queries, rows, id_col, k, most_queries), k, tie=id_col)
    return hits if least is None else hits.where(F.col("score") >= least)


def vector_pairs(queries: DataFrame, rows: DataFrame, id_col: str, most_queries: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id_col, score) of every query with every row, by the same products: the rows that come out are as many as the pairs."""
    return _given(queries, rows, id_col, None, most_queries)


def pool_chunks(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that some pool holds."""
    return chunks.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi")


def _held(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tokens) by pool. A chunk is split into tokens once, however many pools it is in, and what moves to a pool's task are the
    tokens of its chunks: as many rows as the pool's search has as its limit."""
    return pool.select("query_id", "chunk_id").join(chunks.select("chunk_id", T.tokens(F.col("content")).alias("tokens")), "chunk_id", "left")


def vocabulary(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, term, df, n, total) of the terms that each pool keeps: MIN_DF <= df <= MAX_DF * n, of more than MAX_TERMS the most frequent, ties by
    the term's text."""
    return _held(pool, chunks).groupBy("query_id").applyInArrow(terms.pool_terms, "query_id long, term string, df long, n long, total long")


def keyword_search(queries: DataFrame, pool: DataFrame, chunks: DataFrame, k: int, least: float = 0.1) -> DataFrame:
    """(query_id, chunk_id, score, rank) by TF-IDF cosine inside each query's pool; only scores over `least` count.

    A pool (query_id, chunk_id) is a search's limit of rows, terms.MAX_POOL at most, and is weighed in one task; chunks holds those of all pools.
    Pools without a term that stays have no hits. A pool holds what its query may find, so a filter on documents belongs to the search that makes it."""
    asked = queries.where("query_id IS NOT NULL").select("query_id", T.tokens(F.col("query")).alias("tokens"))
    pairs = _held(pool, chunks).groupBy("query_id").cogroup(asked.groupBy("query_id"))
    found = pairs.applyInArrow(terms.pool_scores, f"query_id long, chunk_id {dict(pool.dtypes)['chunk_id']}, score double")
    return top(found.withColumn("score", T.rounded(F.col("score"), 6)).where(F.col("score") > least), k)


def fuse(vector: DataFrame, keyword: DataFrame, weight: float = 0.7) -> DataFrame:
    """Full outer join of both lists: (query_id, chunk_id, score, vector_score, keyword_score). A score that only one list has counts with its own weight.
    vector_score is the vector's own score, not the fused one."""
    v = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"))
    k = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"))
    both = v.join(k, ["query_id", "chunk_id"], "full_outer")
    fused = weight * F.coalesce("vector_score", F.lit(0.0)) + (1 - weight) * F.coalesce("keyword_score", F.lit(0.0))
    return both.select("query_id", "chunk_id", T.rounded(fused, 9).alias("score"), "vector_score", "keyword_score")


def rerank(hits: DataFrame) -> DataFrame:
    """hits with query, content, chunk_index and score get overlap_score and rerank_score: up to 20 % for common words, up to 10 % for an early chunk."""
    share = T.overlap_share(T.word_set(F.col("query")), T.word_set(F.col("content")))
    bonus = F.greatest(F.lit(0.0), 1.0 - F.col("chunk_index") * 0.01)
    return hits.withColumn("overlap_score", T.rounded(share, 6)).withColumn("rerank_score", T.rounded(F.col("score") * (1 + F.col("overlap_score") * 0.2 + bonus * 0.1), 9))


def score_details() -> Column:
    """The scores of a reranked hit by their names, with six decimals; those that it has."""
    names = ("keyword_score", "overlap_score", "rerank_score", "vector_score")
    shown = F.array(*[F.struct(F.lit(n).alias("key"), T.printed(F.col(n), 6).alias("value")) for n in names])
    return F.map_from_entries(F.filter(shown, lambda e: e["value"].isNotNull()))


def with_chunks(hits: DataFrame, chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """hits with their chunk's columns, and their query's text; texts are joined after ranking, to the rows that are left."""
    out = hits.join(chunks, "chunk_id")
    return out if queries is None else out.join(queries.select("query_id", "query"), "query_id")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, weight: float = 0.7, reranked: bool = True, allowed: DataFrame | None = None, recall: int | None = None, denied: DataFrame | None = None) -> DataFrame:
    """Hybrid retrieval: vector top 2k from 0.1, keyword top 2k inside the vector top 6k from 0.05, fusion, reranking, top k.

    allowed (query_id, doc_id) holds the documents that a query may find; queries that it doesn't name may find all. denied (query_id, chunk_id) are
    chunks that a query may not find. Both hold before every limit, as the keyword pool is the vector search's. With recall, both lists and
    what is reranked have so many rows in place of 2k. One vector search gives both the list and the keyword pool; it and the pool's chunks
    are written once, so no later step searches or cuts the corpus again."""
    each = recall or 2 * k
    if 3 * each > terms.MAX_POOL:
        raise ValueError(f"a keyword pool of {3 * each} chunks; {terms.MAX_POOL} is the most that one task weighs")
    wide = written(vector_search(queries, chunks, 3 * each, allowed=allowed, denied=denied), "hits")
    pool = wide.where(F.col("score") >= 0.05)
    near = written(pool_chunks(pool, chunks), "pool")
    fused = fuse(wide.where((F.col("rank") <= each) & (F.col("score") >= 0.1)), keyword_search(queries, pool, near, each), weight)
    hits = with_chunks(fused if recall is None else top(fused, recall).drop("rank"), near, queries)
    scored = rerank(hits) if reranked else hits.withColumn("overlap_score", F.lit(0.0)).withColumn("rerank_score", F.col("score"))
    return top(scored, k, "rerank_score")


def parent_search(queries: DataFrame, children: DataFrame, parents: DataFrame, children_k: int = 20, k: int = 5) -> DataFrame:
    """(query_id, parent_id, score, rank, content): searches children (parent_id, child_id, child), ranks parents (chunk_id, content) by their best child."""
    pieces = children.select(F.col("child_id").alias("chunk_id"), "parent_id", F.col("child").alias("content"))
    hits = vector_search(queries, pieces, children_k).drop("rank").join(pieces.select("chunk_id", "parent_id"), "chunk_id")
    best = top(hits.groupBy("query_id", "parent_id").agg(F.max("score").alias("score")), k, tie="parent_id")
    return best.join(parents.select(F.col("chunk_id").alias("parent_id"), "content"), "parent_id").select("query_id", "parent_id", "score", "rank", "content")
