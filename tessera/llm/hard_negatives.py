"""Hard negatives by Fagin's threshold algorithm on whole-number vectors.

Rows lie in shards, each with a list of its rows for every dimension, sorted by that component. For an anchor, the lists are read from their high or low
end by the sign of the anchor's component; rows that are met for the first time are scored whole by random access. No row further down can score more
than the sum of what the lists have come to, the threshold. A shard is done with an anchor when the threshold is strictly under the k-th score of each
of its windows; so ties are all met. The best of the shards are then ranked together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rows of a shard and anchors of a block: what one task holds at a time.
SHARD_ROWS, BLOCK_ANCHORS = 2048, 512
#: Rows of each list that are read before the threshold is looked at first; then each time twice as many.
FIRST_DEPTH = 8
#: Positives of an anchor, negatives of a window, and the window's edges in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a whole number; null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("int")))


def _matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; shorter vectors have zeros at their end."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(lists), width), "i8")
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """Rows with their sorted lists: place r of `order` has each dimension's row with the r-th smallest component."""

    def __init__(self, vectors: np.ndarray):
        largest = float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1]
        if largest >= 2.0**62:
            raise OverflowError("components are too large: scores don't fit a long")
        # Products and sums under 2**53 are exact in doubles, whose matrix product is faster.
        self.vectors = vectors.astype("f8") if largest < 2.0**52 else vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, anchor: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Rows met by sorted access, and their scores. It stops when enough(rows, scores, threshold) holds, or when all rows are met."""
        n, used = len(self.order), np.flatnonzero(anchor)
        met, rows, scores, depth, step = np.zeros(n, bool), np.zeros(0, "i8"), np.zeros(0, "i8"), 0, FIRST_DEPTH
        if not len(used):  # every score is 0: nothing to sort by
            return np.arange(n), np.zeros(n, "i8")
        weights, up = anchor[used], anchor[used] > 0
        while depth < n:
            end = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[n - end : n - depth, used[up]].ravel()] = True
            fresh[self.order[depth:end, used[~up]].ravel()] = True
            new = np.flatnonzero(fresh & ~met)
            met[new] = True
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, (self.vectors[new] @ anchor.astype(self.vectors.dtype)).astype("i8")])
            if len(rows) == n:
                break
            reached = np.where(up, self.values[n - end, used], self.values[end - 1, used])
            if enough(rows, scores, int((weights * reached).sum())):
                break
            depth, step = end, step * 2
        return rows, scores


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first k by descending score, then id."""
    return np.lexsort((ids, -scores))[:k]


def _kth(scores: np.ndarray, k: int) -> int | None:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    width = max(int(t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (anchors, rows))
    return _matrix(anchors["vector"], width), _matrix(rows["vector"], width)


def _emptied(names: list[str], wide: tuple[str, ...] = ()) -> pa.Table:
    return pa.table({n: pa.array([], pa.int64()) for n in names})


def _positives(k: int):
    """Of one shard and one block of anchors: each anchor's first k other rows with its label."""
    names = ["anchor", "positive_id", "positive", "positive_score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _emptied(names)
        a, r = _sides(anchors, rows)
        shard, out = Shard(r), []
        label, ids, key = (rows[c].to_numpy() for c in ("label", "vec_id", "row"))
        for vector, own, number in zip(a, anchors["label"].to_pylist(), anchors["row"].to_pylist(), strict=True):
            fits = (label == own) & (key != number)

            def enough(at, scores, threshold, fits=fits):
                least = _kth(scores[fits[at]], k)
                return least is not None and threshold < least

            at, scores = shard.search(vector, enough)
            at, scores = at[fits[at]], scores[fits[at]]
            best = _first(scores, ids[at], k)
            out.append((np.full(len(best), number), ids[at][best], key[at][best], scores[best]))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _negatives(k: int, low: int, high: int):
    """Of one shard and one block of anchors: for each window of an anchor, the first k rows of other labels inside it."""
    names = ["anchor", "positive", "negative_id", "negative_score"]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return _emptied(names)
        a, r = _sides(anchors, rows)
        shard, out = Shard(r), []
        label, ids = rows["label"].to_numpy(), rows["vec_id"].to_numpy()
        for vector, own, number, windows in zip(a, anchors["label"].to_pylist(), anchors["row"].to_pylist(), anchors["windows"].to_pylist(), strict=True):
            other = label != own
            edges = [(low * w["positive_score"], high * w["positive_score"]) for w in windows]

            def inside(scores, edge):
                return (100 * scores >= edge[0]) & (100 * scores <= edge[1])

            def enough(at, scores, threshold, other=other, edges=edges):
                scores = scores[other[at]]
                for edge in edges:
                    least = _kth(scores[inside(scores, edge)], k) if edge[0] <= edge[1] else None
                    # A window that isn't full yet is done when nothing further down reaches its lower edge.
                    if edge[0] <= edge[1] and not (100 * threshold < edge[0] or least is not None and threshold < least):
                        return False
                return True

            at, scores = shard.search(vector, enough)
            at, scores = at[other[at]], scores[other[at]]
            for w, edge in zip(windows, edges, strict=True):
                held = inside(scores, edge)
                best = _first(scores[held], ids[at[held]], k)
                out.append((np.full(len(best), number), np.full(len(best), w["positive"]), ids[at[held]][best], scores[held][best]))
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else _emptied(names)

    return run


def _grid(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int):
    """Every block of anchors beside every shard of rows. A row moves once per block and an anchor once per shard."""
    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("block", "shard")
    # Both come from one table: the aliases keep Spark from taking a column of one for that of the other.
    right = rows.select(*[F.col(c).alias(c) for c in ("vec_id", "row", "label", "vector", "shard")]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "shard")
    return left.cogroup(right)


def _ranked(found: DataFrame, keys: list[str], score: str, id_col: str, k: int, tie: str | None = None) -> DataFrame:
    order = [F.desc(score), id_col] + ([tie] if tie else [])
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` other rows of the
    same label, the first `negatives` rows of other labels whose score is between low and high hundredths of the positive's.

    vectors has vec_id long, label int and vector array<int>, see quantized(). Scores are whole inner products, ties go by vec_id. Rows with a null in
    any of the three take no part. Rows that repeat id, label and vector are one row; rows of one id that differ are rows of their own, each an anchor
    of its own where is_anchor holds. Vectors of different lengths are as if the shorter one ended in zeros. An anchor without a positive or without a
    row in its window gives no rows; an empty table gives none. Scores that don't fit a long are an error. Other columns aren't read.

    Rows are dealt evenly by their number in the written table, so a label, an id or a vector that many rows share lies in all shards. All anchors meet
    all rows: the number of cells is the product of both, and each is a task of bounded size that is done again alone if its executor is lost."""
    whole = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "vector").where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").distinct()
    rows = written(whole.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_anchors // block_anchors))
    # monotonically_increasing_id() counts up inside a task, so the remainder deals every task's rows in turn.
    rows = rows.withColumn("shard", F.pmod(F.col("row") + F.shiftright("row", 33) * 7919, F.lit(shards)).cast("int"))
    anchors = rows.where(is_anchor).select("row", "vec_id", "label", "vector", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    near = _grid(anchors.select("row", "label", "vector", "block"), rows, blocks, shards).applyInArrow(_positives(positives), "anchor long, positive_id long, positive long, positive_score long")
    pairs = written(_ranked(near, ["anchor"], "positive_score", "positive_id", positives, "positive").select("anchor", "positive_id", "positive", "positive_score"), "positives")
    windows = pairs.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("windows"))  # as many as `positives`
    asked = anchors.join(windows, F.col("row") == F.col("anchor")).select("row", "label", "vector", "windows", "block")
    far = _grid(asked, rows, blocks, shards).applyInArrow(_negatives(negatives, low, high), "anchor long, positive long, negative_id long, negative_score long")
    best = _ranked(far, ["anchor", "positive"], "negative_score", "negative_id", negatives)
    named = best.join(pairs, ["anchor", "positive"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
