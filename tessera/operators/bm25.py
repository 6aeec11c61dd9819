"""A stored BM25 index: postings by term in blocks of neighbouring chunks, each with the largest weight in it."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as T
from tessera.sources.scratch import scratch, written

#: Folders that terms are dealt over; chunks to a block; blocks of a query that are scored first; terms of queries that are scored in one task.
BUCKETS, BLOCK_CHUNKS, SEEDS, SHARD_TERMS = 32, 1024, 4, 32_768


@dataclass
class Bm25:
    """Where the index lies, its number of folders and of chunks."""

    path: str
    buckets: int
    n: int


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int").alias("bucket")


def _blocks(rows: int, buckets: int, mean: float, k1: float, b: float):
    """mapInArrow function: of each so many chunks that a task reads in turn, a list per term with the chunks that have it and their weights.

    The block is named by its first chunk's number. Terms are counted within their chunks here, and the lists of a block and folder move as one packed
    row, so no token and no list is a row that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows)):
            lists = part["tokens"]
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            coded = pc.list_flatten(lists).dictionary_encode()
            n = part.num_rows
            pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype("i8") * n + np.repeat(np.arange(n), lengths), return_counts=True)
            term, row = np.divmod(pairs, n)
            weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / mean))
            starts = np.flatnonzero(np.diff(term, prepend=-1))
            most = np.maximum.reduceat(weight, starts) if len(starts) else weight
            ends = np.append(starts, len(term)).astype("i4")
            entries = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([part["chunk"].take(pa.array(row)), pa.array(weight)], ["chunk", "weight"]))
            terms = coded.dictionary.take(pa.array(term[starts]))
            bucket = np.fromiter(map(zlib.crc32, terms.cast(pa.binary()).to_pylist()), "i8", len(terms)) % buckets
            lists = pa.RecordBatch.from_arrays([terms, pa.array(most), pa.array(np.diff(ends).astype("i8")), entries], ["term", "most", "size", "entries"])
            order = np.argsort(bucket, kind="stable")
            lists, folders = lists.take(pa.array(order)), np.unique(bucket)
            cuts = np.append(np.searchsorted(bucket[order], folders), len(order))
            packed = [_packed(lists.slice(low, high - low)) for low, high in itertools.pairwise(cuts.tolist())]
            block = pa.array(np.full(len(folders), part["chunk"][0].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(folders.astype("i4")), block, pa.array(packed, pa.binary())], ["bucket", "block", "lists"])

    return run


def _packed(lists: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lists.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(lists)
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per term, block and folder."""
    for batch in batches:
        for bucket, block, packed in zip(batch["bucket"].to_pylist(), batch["block"].to_pylist(), batch["lists"], strict=True):
            for lists in pa.ipc.open_stream(packed.as_buffer()):
                n = lists.num_rows
                yield pa.RecordBatch.from_arrays([lists["term"], pa.array(np.full(n, block), pa.int64()), *[lists[c] for c in ("most", "size", "entries")], pa.array(np.full(n, bucket), pa.int32())], ["term", "block", "most", "size", "entries", "bucket"])


def build_bm25(chunks: DataFrame, path: str | None = None, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS, block_chunks: int = BLOCK_CHUNKS) -> Bm25:
    """Writes the index of chunks (chunk_id, content), whose texts are cut into tokens once.

    A chunk is a number; a row of the postings is a term's chunks among block_chunks neighbouring ones with their weights, so no term's list is one row
    or one task, however many chunks have it. Terms lie in folders by their hash."""
    path = path or scratch(chunks.sparkSession, "bm25")
    listed = written(chunks.select("chunk_id", T.tokens(F.col("content")).alias("tokens")).withColumn("chunk", F.monotonically_increasing_id()), "tokens")
    n, mean = listed.agg(F.count("*"), F.avg(F.coalesce(F.size("tokens"), F.lit(0)))).first()
    listed.select("chunk", "chunk_id").write.mode("overwrite").parquet(f"{path}/chunks")
    kind = "term string, block long, most double, size long, entries array<struct<chunk: long, weight: double>>, bucket int"
    blocks = listed.select("chunk", "tokens").mapInArrow(_blocks(block_chunks, buckets, mean or 1.0, k1, b), "bucket int, block long, lists binary")
    blocks.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(4))).mapInArrow(_unpacked, kind).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    return Bm25(path, buckets, n)


def _cell(k: int, id_type: pa.DataType):
    """Scores one block for a shard of the queries; what comes out are each query's k best chunks in it, and all that may tie with the k-th."""

    def run(wanted: pa.Table, postings: pa.Table) -> pa.Table:
        ids, chunks, scores = [], [np.empty(0, "i8")], [np.empty(0)]
        if len(wanted) and len(postings):
            wanted = wanted.sort_by("query_id")
            entries = postings["entries"].combine_chunks()
            flat = entries.flatten()
            numbers, place = np.unique(flat.field("chunk").to_numpy(), return_inverse=True)
            weight = flat.field("weight").to_numpy()
            ends = np.cumsum(pc.list_value_length(entries).to_numpy())
            lists = {t: slice(a, b) for t, a, b in zip(postings["term"].to_pylist(), np.append(0, ends), ends, strict=False)}
            idf, terms = wanted["idf"].to_numpy(), wanted["term"].to_pylist()
            query = wanted["query_id"].combine_chunks().dictionary_encode()
            code = query.indices.to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
            for low, high in itertools.pairwise(cuts.tolist()):
                score = np.zeros(len(numbers))
                for at in range(low, high):
                    here = lists[terms[at]]
                    score[place[here]] += idf[at] * weight[here]
                hit = np.flatnonzero(score)
                if len(hit) > k:
                    hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-5]  # what rounds to the k-th score ties with it
                ids.append(np.full(len(hit), code[low]))
                chunks.append(numbers[hit])
                scores.append(score[hit])
        named = query.dictionary.take(pa.array(np.concatenate(ids))) if ids else pa.array([], id_type)
        return pa.table({"query_id": named, "chunk": pa.array(np.concatenate(chunks)), "score": pa.array(np.concatenate(scores))})

    return run


def _scored(wanted: DataFrame, postings: DataFrame, k: int, shards: int) -> DataFrame:
    """(query_id, chunk, score) of the blocks in wanted (query_id, term, idf, block): each query's k best of every block, with their ties.

    A block's lists move as they are, once for each shard of the queries; no posting becomes a row. The aliases keep Spark from taking a column of one side for the other's."""
    asked = wanted.select("query_id", "term", "idf", "block", F.pmod(F.xxhash64("query_id"), F.lit(shards)).alias("shard"))
    copies = postings.select("term", "block", "entries").join(asked.select("term", "block", "shard").distinct(), ["term", "block"]).select("term", "entries", *[F.col(c).alias(c) for c in ("block", "shard")])
    id_type = wanted.schema["query_id"].dataType
    cells = asked.groupBy("block", "shard").cogroup(copies.groupBy("block", "shard"))
    found = cells.applyInArrow(_cell(k, to_arrow_type(id_type)), f"query_id {id_type.simpleString()}, chunk long, score double")
    return found.withColumn("score", F.round("score", 6))


def search_bm25(spark: SparkSession, queries: DataFrame, index: Bm25, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query_id, chunk_id, score, rank): each query's k best chunks; the result is exact.

    Of the postings only the folders of the queries' terms are read. A block can't score more than the sum of its terms' largest weights; each query's
    `seeds` best blocks by that bound are scored first, and of the others only those whose bound reaches the k-th score so far. The bounds are read
    without the postings themselves."""
    terms = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term")).select("*", _bucket(F.col("term"), index.buckets))
    terms = written(terms, "terms")
    shards = max(1, -(-terms.count() // SHARD_TERMS))
    folders = sorted(r[0] for r in terms.select("bucket").distinct().collect())  # as many as there are folders
    postings = spark.read.parquet(f"{index.path}/postings").where(F.col("bucket").isin(folders))
    asked = terms.select("query_id", "term")
    postings = postings.join(asked.select("term").distinct(), "term", "left_semi")
    heads = written(postings.select("term", "block", "most", "size"), "heads")
    df = heads.groupBy("term").agg(F.sum("size").alias("df"))
    idf = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    blocks = written(weighed.join(heads.select("term", "block", "most"), "term"), "blocks")
    bounds = blocks.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = bounds.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
    bounds = written(bounds, "bounds")
    first = written(_scored(blocks.join(bounds.where(F.col("place") <= seeds), ["query_id", "block"], "left_semi").select("query_id", "term", "idf", "block"), postings, k, shards), "seeds")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk")
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    # The bound is of unrounded sums; a score that rounds up to the k-th one may still be a hit.
    further = bounds.where(F.col("place") > seeds).join(kth, "query_id", "left").where("least IS NULL OR bound >= least - 1e-5").select("query_id", "block")
    rest = _scored(blocks.join(further, ["query_id", "block"], "left_semi").select("query_id", "term", "idf", "block"), postings, k, shards)
    named = spark.read.parquet(f"{index.path}/chunks")
    # Ties go by chunk_id, so all that tie with the k-th score stay until it's known.
    close = first.unionByName(rest).withColumn("r", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("r") <= k)
    ranked = close.join(named, "chunk").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")
