"""Quality classifier: random Fourier features of document statistics, ridge regression by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Labelled rows that fit the model, those with the least hash of doc_id. A bound on the fit, not on what is scored.
FIT_ROWS = 20_000
#: Random features, ridge penalty, seed, and the score from which a document is good.
FEATURES, RIDGE, SEED, KEEP_FROM = 256, 1e-2, 7, 0.7
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True
N_STATS = 18


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def statistics(text: str | None) -> list[float]:
    """N_STATS numbers of one whole text; null counts as empty."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, n_chars = max(len(words), 1), max(len(text), 1)
    letters = max(counts[_UPPER].sum() + counts[_LOWER].sum() + counts[192:].sum(), 1)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    filled = [x for x in lines if x]
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), counts[_UPPER].sum() / letters, counts[_DIGIT].sum() / n_chars,
        min(counts[_SYMBOL].sum() / n, 3.0), min(counts[ord("!")] / n, 3.0), min(counts[_STOP].sum() / n, 3.0), counts[192:].sum() / letters,
        len(seen) / n, (max(seen.values()) if seen else 0) / n, repeats / n, np.log1p(len(filled)), 1 - len(set(filled)) / max(len(filled), 1),
        min(n / max(counts[_STOP].sum(), 1), 60.0), min(counts[ord("|")] / n, 1.0), len([w for w in seen if not any(map(str.isalpha, w))]) / max(len(seen), 1),
    ]


def _with_statistics(keep: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c, _ in keep), pa.array(stats, pa.list_(pa.float64()))], [*(c for c, _ in keep), "stats"])

    return run


def _isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean raw score and mean label of each block, both ascending."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([x, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b, a = blocks.pop(), blocks.pop()
            w = a[2] + b[2]
            blocks.append([(a[0] * a[2] + b[0] * b[2]) / w, (a[1] * a[2] + b[1] * b[2]) / w, w])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.phases)) * np.cos(np.clip((stats - self.mean) / self.scale, -8, 8) @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.steps_x, self.steps_y), 0, 1)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row's whole text, 0 to 1; null and empty texts get the score of their statistics, null ids stay.

        Repeated rows are scored alike, each for itself; an empty table gives an empty one; a text of any length is read whole; columns of docs but doc_id
        and text aren't read, whatever their names."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    stats = np.array([statistics(t) for t in batch["text"].to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.calibrated(model.raw(stats)))], ["doc_id", "score"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

    def keep(self, docs: DataFrame, score_from: float = KEEP_FROM) -> DataFrame:
        """The rows of docs that score score_from or more, with their columns as they are."""
        model = self
        good = F.pandas_udf(lambda s: _series(model.calibrated(model.raw(np.array([statistics(t) for t in s]).reshape(len(s), N_STATS))) >= score_from), "boolean")
        return docs.where(good("text"))


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: int = FEATURES) -> Model:
    """The model of labels (doc_id, quality) on the texts of docs.

    At most `rows` labelled documents are used, those with the least hash; a document with several labels counts by their majority, ties as 0; null
    ids and labels are left out. Of documents that repeat an id each row counts, with the id's label; empty tables of docs or labels leave no labelled row;
    other columns of both tables aren't read. Three quarters fit the ridge scores, the other quarter the calibration. With no labelled row every score is 0.5.
    The driver gets sums of a fixed size and, for the calibration, two numbers a row of that quarter."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.when(F.avg("quality") > 0.5, 1.0).otherwise(0.0).alias("y"))
    chosen = chosen.withColumn("draw", F.xxhash64("doc_id", F.lit(SEED))).orderBy("draw", "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "draw", "text")  # at most `rows` rows of 24 bytes
    train = written(joined.mapInArrow(_with_statistics([("y", pa.float64()), ("draw", pa.int64())]), "y double, draw long, stats array<double>"), "classifier-rows")
    moments = train.agg(F.count("*"), *[F.avg(F.col("stats")[i]) for i in range(N_STATS)], *[F.stddev_pop(F.col("stats")[i]) for i in range(N_STATS)]).first()
    mean, scale = np.array([x or 0.0 for x in moments[1 : N_STATS + 1]]), np.array([x or 0.0 for x in moments[N_STATS + 1 :]])
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(N_STATS, features)) * np.sqrt(1.0 / N_STATS)  # a Gaussian kernel as wide as the statistics' spread
    model = Model(mean, scale, directions, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not moments[0]:
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch["stats"].to_pylist()))
                y = batch["y"].to_numpy()
                left += z.T @ z
                right += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(list(range(features + 1)), pa.int32()), pa.array(list(left)), pa.array(right)], ["i", "row", "right"])

    fold = F.pmod("draw", F.lit(4)) == 0
    parts = train.where(~fold).coalesce(8).mapInArrow(sums, "i int, row array<double>, right double")
    left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
    for i, row, value in parts.collect():  # eight partial sums at most
        left[i] += row
        right[i] += value
    n = max(left[-1, -1], 1.0)
    weights = np.linalg.solve(left + RIDGE * n * 1e-2 * np.eye(features + 1), right)
    model = Model(mean, scale, model.directions, model.phases, weights, model.steps_x, model.steps_y)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.array(batch["stats"].to_pylist()))), batch["y"]], ["raw", "y"])

    pairs = np.array(train.where(fold).mapInArrow(held, "raw double, y double").collect()).reshape(-1, 2)
    if not len(pairs):
        pairs = np.array(train.mapInArrow(held, "raw double, y double").collect()).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    x, y = _isotonic(pairs[:, 0], pairs[:, 1])
    return Model(mean, scale, model.directions, model.phases, weights, x, y)
