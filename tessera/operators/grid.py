"""Query vectors against row vectors when both sides grow: blocks of queries beside shards of rows, one bounded product to a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import embedding as E
from tessera.sources.scratch import written

#: Queries of a block and rows of a shard: what a task holds, and the sides of its product.
BLOCK, SHARD = 2048, 8192


def dealt(frame: DataFrame, size: int, to: str, label: str) -> tuple[DataFrame, int]:
    """The frame written once, with column `to` that deals its rows evenly over parts of about `size`, and the number of parts.

    Parts go by the row's number in the written table, so a key that many rows share makes no part larger."""
    rows = written(frame.withColumn("__row", F.monotonically_increasing_id()), label)
    parts = max(1, -(-rows.count() // size))
    return rows.withColumn(to, F.pmod(F.col("__row") + F.shiftright("__row", 33) * 7919, F.lit(parts)).cast("int")).drop("__row"), parts


def _every(frame: DataFrame, to: str, parts: int) -> DataFrame:
    # The aliases keep Spark from taking a column of one side for that of the other where both come from one table.
    return frame.select(*[F.col(c).alias(c) for c in frame.columns], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(to))


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table["vector"].to_pylist(), "f8").reshape(len(table), -1)


def _cell(id_col: str, k: int | None, checked: bool):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids = asked["query_id"].to_pylist()
        if not len(asked) or not len(rows):
            found = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), rows[id_col].combine_chunks().slice(0, 0), pa.array([], pa.float64())], ["query_id", id_col, "score"])
            return pa.Table.from_batches([found])
        queries, m = _matrix(asked), _matrix(rows)
        scores = E._cosines(queries, np.sqrt((queries * queries).sum(axis=1)), m)
        if checked:
            held = asked["limited"].to_pylist() if "limited" in asked.schema.names else []
            scores[~E.permitted(ids, {q for q, is_limited in zip(ids, held, strict=False) if is_limited})(rows)] = -np.inf
        batch = rows.select([id_col]).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([E._hits(batch, scores, E._best(scores, k), ids, id_col)])

    return run


def limiting(allowed: DataFrame | None) -> str:
    """The column of allowed that says what a query may find: doc_id, or another one that the rows have."""
    return next((c for c in allowed.columns if c != "query_id"), "doc_id") if allowed is not None else "doc_id"


def grid_search(queries: DataFrame, rows: DataFrame, id_col: str, k: int | None, allowed: DataFrame | None = None, denied: DataFrame | None = None, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, id_col, score): each query's k best rows of every shard, with their ties; ranking them gives the k best of all. k=None gives all pairs.

    queries (query_id, vector) and rows (id_col, vector) may be of any number: nothing is collected. A row moves once per block of queries, a query once
    per shard, and what comes out are k rows for each query and shard. allowed (query_id, doc_id) with rows' doc_id holds the documents that a query may
    find; queries that it doesn't name may find all. denied (query_id, id_col) are rows that a query may not find. Their pairs go to the rows' copies for
    their block, at most a block's queries each."""
    asked = queries.select("query_id", "vector").where("query_id IS NOT NULL")
    if allowed is not None:
        asked = asked.join(allowed.select("query_id", F.lit(True).alias("limited")).distinct(), "query_id", "left").na.fill(False, ["limited"])
    asked, blocks = dealt(asked, block, "block", "asked")
    kept = rows.select(id_col, "vector", *([limiting(allowed)] if allowed is not None and id_col != limiting(allowed) else []))
    kept, shards = dealt(kept, shard, "shard", "searched")
    copies = _every(kept, "block", blocks)
    for pairs, key, to in ((allowed, limiting(allowed), "for_queries"), (denied, id_col, "not_for")):
        if pairs is not None:
            named = pairs.join(asked.select("query_id", "block"), "query_id").groupBy(key, "block").agg(F.collect_set("query_id").alias(to))
            copies = copies.join(named, [key, "block"], "left")
    cells = _every(asked, "shard", shards).groupBy("block", "shard").cogroup(copies.groupBy("block", "shard"))
    return cells.applyInArrow(_cell(id_col, k, allowed is not None or denied is not None), f"query_id long, {id_col} {dict(rows.dtypes)[id_col]}, score double")
