"""A stored inverted file over vectors: cells as folders, product-quantised residuals for a first pass, exact cosine for what is left."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import embedding as E
from tessera.operators.grid import BLOCK
from tessera.sources.scratch import scratch

#: Rows that centres and codebooks are fitted on: a bound on what the driver gets. Words of a codebook; rows of a cell in one task.
FIT_ROWS, WORDS, SHARD = 20_000, 256, 16_384
#: Queries and rows of one product, so a task's memory doesn't grow with what its cell holds; cells nearest to a query that give it a first bound.
TILE_QUERIES, TILE_ROWS, FIRST_CELLS = 256, 2048, 16


@dataclass
class Ivf:
    """Where the index lies and what a search needs to know of it: both arrays are bounded by their parameters."""

    codes_path: str
    vectors_path: str
    id_col: str
    kind: str  # of the ids
    centres: np.ndarray  # cells x dimensions, unit length
    books: np.ndarray  # parts x WORDS x dimensions of a part
    shards: list[int]  # parts of each cell, by its size


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator, cosine: bool) -> np.ndarray:
    """k-means on a bounded sample; with fewer points than k, the points."""
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - (0 if cosine else 0.5 * (centres * centres).sum(axis=1)), axis=1)
        n = np.bincount(near, minlength=len(centres))[:, None]
        sums = np.stack([np.bincount(near, weights=points[:, d], minlength=len(centres)) for d in range(points.shape[1])], axis=1)
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        centres = _unit(centres) if cosine else centres
    return centres


def _encode(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    out = np.empty((len(residuals), parts), "u1")
    for p in range(parts):
        out[:, p] = np.argmax(residuals[:, p * width : (p + 1) * width] @ books[p].T - 0.5 * (books[p] * books[p]).sum(axis=1), axis=1)
    return out


def _decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def _vectors(batch, column: str = "embedding") -> np.ndarray:
    lists = batch[column].combine_chunks() if isinstance(batch[column], pa.ChunkedArray) else batch[column]
    sizes = lists.value_lengths().unique().to_pylist()
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes} dimensions in one table")
    return lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(lists), sizes[0] if sizes else 0)


def _code_kind(id_col: str, kind: str) -> str:
    return f"row long, {id_col} {kind}, code binary, off double, nearest boolean, cell int"


def build_ivf(rows: DataFrame, id_col: str, cells: int = 128, copies: int = 2, parts: int = 32, fit_rows: int = FIT_ROWS, seed: int = 7, path: str | None = None) -> Ivf:
    """Writes the index of rows (id_col, embedding): for each of a vector's `copies` nearest cells its id, the code of its residual and how far the code
    is off, in a folder per cell; and each vector once. Rows without an id or a vector aren't indexed.

    Centres and codebooks are fitted on fit_rows rows, those with the least hashes of their ids; every row is indexed. `parts` must divide the dimensions."""
    spark = rows.sparkSession
    path = path or scratch(spark, "ivf")
    rows = rows.select(id_col, "embedding").where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(fit_rows).select("embedding").toArrow()  # fit_rows at most
    rng = np.random.default_rng(seed)
    points = _unit(np.array(sample["embedding"].to_pylist(), "f8").reshape(len(sample), -1)) if len(sample) else np.zeros((1, parts))
    if points.shape[1] % parts:
        raise ValueError(f"{points.shape[1]} dimensions can't be cut into {parts} parts")
    centres = _means(points, cells, 10, rng, True)
    near = np.argsort(-(points @ centres.T), axis=1)[:, : max(1, copies)]
    residuals = np.concatenate([points - centres[near[:, i]] for i in range(near.shape[1])])
    residuals = residuals[rng.permutation(len(residuals))[: min(len(residuals), 8 * WORDS)]]
    width = points.shape[1] // parts
    books = np.stack([np.resize(_means(residuals[:, p * width : (p + 1) * width], WORDS, 4, rng, False), (WORDS, width)) for p in range(parts)])
    salts = [max(1, math.ceil(c / len(points) * n / SHARD)) for c in np.bincount(near.ravel(), minlength=len(centres)).tolist()]  # tasks that write a cell, by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_vectors(batch))
            best = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :copies]
            for i in range(best.shape[1]):
                residual = unit - centres[best[:, i]]
                codes = _encode(residual, books)
                off = residual - _decode(codes, books)
                columns = [batch["row"], batch[id_col], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt((off * off).sum(axis=1))), pa.array(np.full(len(codes), i == 0)), pa.array(best[:, i].astype("i4"))]
                yield pa.RecordBatch.from_arrays(columns, ["row", id_col, "code", "off", "nearest", "cell"])

    kind = dict(rows.dtypes)[id_col]
    coded = rows.mapInArrow(index, _code_kind(id_col, kind))
    coded.repartition("cell", F.pmod(F.xxhash64("row"), F.element_at(F.lit(salts), F.col("cell") + 1))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
    sizes = dict(spark.read.schema(_code_kind(id_col, kind)).parquet(f"{path}/codes").groupBy("cell").count().collect())  # a row for each cell
    return Ivf(f"{path}/codes", f"{path}/vectors", id_col, kind, centres, books, [max(1, -(-sizes.get(c, 0) // SHARD)) for c in range(len(centres))])


def _probes(centres: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_unit(_vectors(batch)) @ centres.T), axis=1, kind="stable")[:, :probes]
            for i in range(near.shape[1]):
                columns = [batch["query_id"], batch["embedding"], pa.array(near[:, i].astype("i4")), pa.array(np.full(len(near), i, "i4"))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "embedding", "cell", "place"])

    return run


class _Best:
    """Each query's k largest scores among the rows met so far, ties by the rows' order. With `least`, only scores of at least that count."""

    def __init__(self, k: int, queries: int, least: np.ndarray | None = None):
        self.k = k
        self.over = np.full(queries, -np.inf) if least is None else np.nextafter(least, -np.inf)  # what a score must be over to count
        self.query, self.row, self.score = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)

    def meet(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """scores: a tile of queries x rows, which come after all that were met."""
        place = scores.shape[1] - self.k
        if place > 0 and np.isneginf(self.over).any():
            self.over = np.maximum(self.over, np.nextafter(np.partition(scores, place, axis=1)[:, place], -np.inf))
        q, r = np.nonzero(scores > self.over[:, None])
        if not len(q):
            return
        query, row, score = np.concatenate([self.query, q]), np.concatenate([self.row, rows[r]]), np.concatenate([self.score, scores[q, r]])
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.over[query[last]] = np.maximum(self.over[query[last]], score[last])
        self.query, self.row, self.score = query[rank < self.k], row[rank < self.k], score[rank < self.k]


def _tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


def _about(rows: pa.Table, part: slice, centres: np.ndarray, books: np.ndarray) -> np.ndarray:
    """What the codes of some rows of a cell say of their vectors."""
    codes = rows["code"].slice(part.start, part.stop - part.start).to_pylist()
    return _decode(np.frombuffer(b"".join(codes), "u1").reshape(len(codes), -1), books) + centres[rows["cell"][0].as_py()]


# A unit query is no further from the true product than the code is off; scores are rounded to 6 places before they're ranked.
ROUNDED = 1e-6


def _first_pass(id_col: str, centres: np.ndarray, books: np.ndarray, most: int, by_low: bool):
    """Of each query the `most` rows of a cell with the largest lower bounds, or the nearest ones, by their codes: with the score's bounds."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "row", id_col, "low", "high"]
        rows = rows.sort_by([(id_col, "ascending"), ("row", "ascending")])
        unit, off = _unit(_vectors(asked)), rows["off"].to_numpy() + ROUNDED
        out = [pa.table([pa.array([], pa.int64()), rows["row"].slice(0, 0), rows[id_col].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.float64())], names)]
        for some in _tiles(len(asked) if len(rows) else 0, TILE_QUERIES):
            best = _Best(most, some.stop - some.start)
            for part in _tiles(len(rows), TILE_ROWS):
                near = unit[some] @ _about(rows, part, centres, books).T
                best.meet(near - off[part] if by_low else near, np.arange(part.start, part.stop))
            at, own = pa.array(best.row), off[best.row]
            near = best.score + own if by_low else best.score
            ids = asked["query_id"].combine_chunks().take(pa.array(best.query + some.start))
            out.append(pa.table([ids, rows["row"].take(at), rows[id_col].take(at), pa.array(near - own), pa.array(near + own)], names))
        return pa.concat_tables(out)

    return run


def _wanted(centres: np.ndarray, books: np.ndarray):
    """A cell's rows whose upper bound reaches what some query has as its least; as soon as one wants a row, no other is asked."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        unit, least, off = _unit(_vectors(asked)), asked["least"].to_numpy(), rows["off"].to_numpy() + ROUNDED
        wanted = np.zeros(len(rows), bool)
        for part in _tiles(len(rows) if len(asked) else 0, TILE_ROWS):
            about, left = _about(rows, part, centres, books), np.arange(part.start, part.stop)
            for some in _tiles(len(asked), TILE_QUERIES):
                hit = (unit[some] @ about[left - part.start].T + off[left] >= least[some, None]).any(axis=0)
                wanted[left[hit]] = True
                left = left[~hit]
        return rows.select(["row", "cell", "shard", "block"]).filter(pa.array(wanted))

    return run


def _scored(id_col: str, k: int):
    """Of each query the k rows of a cell with the largest cosines, ties by id, that reach its least."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "row", id_col, "score"]
        rows = rows.sort_by([(id_col, "ascending"), ("row", "ascending")])
        queries, vectors, least = _vectors(asked), _vectors(rows, "vector"), asked["least"].to_numpy()
        norms, unit, units = np.sqrt((queries * queries).sum(axis=1)), _unit(queries), _unit(vectors)
        out = [pa.table([pa.array([], pa.int64()), rows["row"].slice(0, 0), rows[id_col].slice(0, 0), pa.array([], pa.float64())], names)]
        for some in _tiles(len(asked) if len(rows) else 0, TILE_QUERIES):
            best = _Best(k, some.stop - some.start, least[some])
            for part in _tiles(len(rows), TILE_ROWS):
                # Only the rows that may count for some query get scores that are rounded, as SQL's are.
                may = np.flatnonzero((unit[some] @ units[part].T > (best.over - 2 * ROUNDED)[:, None]).any(axis=0)) + part.start
                if len(may):
                    best.meet(E._cosines(queries[some], norms[some], vectors[may]), may)
            at = pa.array(best.row)
            ids = asked["query_id"].combine_chunks().take(pa.array(best.query + some.start))
            out.append(pa.table([ids, rows["row"].take(at), rows[id_col].take(at), pa.array(best.score)], names))
        return pa.concat_tables(out)

    return run


def search_ivf(spark: SparkSession, queries: DataFrame, index: Ivf, k: int = 10, probes: int = 16, rescored: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k largest cosines among the rows in the query's `probes` nearest cells. All cells give the exact result.

    The scan reads the folders of the probed cells, and of these ids and codes. With rescored=None the codes' error bounds decide which rows are scored
    on their vectors, so nothing of the probed cells is lost: the query's nearest cells give what its k best reach at least, rows that reach that for
    some query of a block go to their cell's task with their vectors, and each task gives k rows a query at most, so no pair of query and row moves
    but those. Else so many rows of each query are scored. queries (query_id, embedding) may be of any number: only the numbers of the probed cells go
    to the driver. A task meets a block of queries and a part of a cell in tiles, so its memory is bounded."""
    asked = queries.select("query_id", "embedding").where("query_id IS NOT NULL AND embedding IS NOT NULL")
    probed = asked.mapInArrow(_probes(index.centres, probes), f"query_id long, embedding {dict(asked.dtypes)['embedding']}, cell int, place int")
    cells = sorted(r[0] for r in probed.select("cell").distinct().collect())  # as many as there are cells
    kind = index.kind
    rows = spark.read.schema(_code_kind(index.id_col, kind)).parquet(index.codes_path).where(F.col("cell").isin(cells))
    every = probes >= len(index.centres)
    if every:
        rows = rows.where("nearest")  # with all cells a row's nearest one has it
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    shards = F.element_at(F.lit(index.shards), F.col("cell") + 1)
    left = probed.select("query_id", "embedding", "cell", "place", block, F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    shard = F.pmod(F.xxhash64("row"), shards).cast("int").alias("shard")
    right = rows.select("row", index.id_col, "code", "off", "cell", shard, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["cell", "shard", "block"]
    first = _first_pass(index.id_col, index.centres, index.books, rescored or k, rescored is None)
    near = left.where(F.col("place") < FIRST_CELLS) if rescored is None else left
    found = near.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(first, f"query_id long, row long, {index.id_col} {kind}, low double, high double")
    once = found.groupBy("query_id", "row", index.id_col).agg(F.max("low").alias("low"), F.min("high").alias("high"))
    by_query = W.partitionBy("query_id")
    vectors = spark.read.parquet(index.vectors_path).withColumnRenamed("embedding", "vector")
    if rescored is None:
        kth = once.withColumn("r", F.row_number().over(by_query.orderBy(F.desc("low")))).where(F.col("r") <= k).groupBy("query_id").agg(F.min("low").alias("low"), F.count("*").alias("n"))
        bounded = left.join(kth, "query_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("low")).otherwise(float("-inf"))).select("query_id", "embedding", "least", *keys)
        wanted = bounded.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_wanted(index.centres, index.books), "row long, cell int, shard int, block int")
        met = bounded.groupBy(*keys).cogroup(wanted.join(vectors, "row").groupBy(*keys))
        scored = met.applyInArrow(_scored(index.id_col, k), f"query_id long, row long, {index.id_col} {kind}, score double")
        scored = scored.drop("row") if every else scored.groupBy("query_id", "row", index.id_col).agg(F.max("score").alias("score")).drop("row")
    else:
        left_over = once.withColumn("r", F.row_number().over(by_query.orderBy(F.desc(F.col("low") + F.col("high")), index.id_col))).where(F.col("r") <= rescored)
        pairs = left_over.select("query_id", "row").join(vectors, "row").join(asked, "query_id")
        scored = pairs.mapInArrow(E.pair_cosines(index.id_col), f"query_id long, {index.id_col} {kind}, score double")
    return scored.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), index.id_col))).where(F.col("rank") <= k)
