"""The default embedder: hashed signed word counts, and how scores are made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 384
#: Words whose place a worker keeps: a bound on its memory.
CACHED_WORDS = 400_000
_SPACE = "[\\s\x1c-\x1f\x85]+"


class _Places(dict):
    """Word to bucket * 2 + (1 if its sign is minus)."""

    def __missing__(self, word: str) -> int:
        digest = md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        place = int(digest[:8], 16) % DIM * 2 + int(digest[8:10], 16) % 2
        if len(self) < CACHED_WORDS:
            self[word] = place
        return place


_PLACES = _Places()


def count_vector(text: str | None) -> np.ndarray:
    """Signed counts of the lower-cased words, DIM whole numbers."""
    places = np.fromiter(map(_PLACES.__getitem__, (text or "").lower().split()), "i8")
    signs = 1 - 2 * (places & 1)
    return np.bincount(places >> 1, weights=signs, minlength=DIM) if len(places) else np.zeros(DIM)


def sparse_weights(text: Column) -> Column:
    """The same counts in SQL: array of (bucket, sign), one for each word."""
    from tessera.functions.text import words

    digit = lambda w, at, n: F.conv(F.substring(F.md5(w.cast("binary")), at, n), 16, 10).cast("long")
    return F.transform(words(F.lower(text)), lambda w: F.struct((digit(w, 1, 8) % DIM).alias("bucket"), (1 - 2 * (digit(w, 9, 2) % 2)).alias("sign")))


#: What loaders gave, by their name: a worker loads a model once, however many tasks it runs.
_LOADED: dict[str, Callable] = {}


def _loaded(name: str, loader: Callable) -> Callable:
    # A function of the module: workers import it, so all their tasks see one dictionary. A nested one would bring its own copy.
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]


def _by_length(texts: list, batch_chars: int) -> Iterator[list[int]]:
    """Places of the texts by length, cut where the summed length would pass batch_chars; a longer text is alone. Texts of one length pad little."""
    held, total = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if held and total + len(texts[i]) > batch_chars:
            yield held
            held, total = [], 0
        held.append(i)
        total += len(texts[i])
    if held:
        yield held


def _count_vectors(texts: pd.Series) -> pd.Series:
    """count_vector() over its length for a whole batch: one count over rows and buckets."""
    words = [(t or "").lower().split() for t in texts]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    places = np.fromiter((_PLACES[w] for part in words for w in part), "i8", len(row))
    counts = np.bincount(row * DIM + (places >> 1), weights=1 - 2 * (places & 1), minlength=len(words) * DIM).reshape(-1, DIM)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return pd.Series(list(np.divide(counts, norm, out=np.zeros(counts.shape), where=norm > 0)))


def _vectors_by(embedder: Callable[[list[str | None]], list]) -> Callable[[pd.Series], pd.Series]:
    def run(texts: pd.Series) -> pd.Series:
        vectors = embedder(list(texts))
        if len(vectors) != len(texts):
            raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
        return pd.Series([None if v is None else np.asarray(v, "f8") for v in vectors], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return run


def embed(df: DataFrame, text_col: str, to: str = "embedding", loader: Callable[[], Callable[[list[str]], list]] | None = None, batch_chars: int = 200_000, embedder: Callable[[list[str | None]], list] | None = None) -> DataFrame:
    """df with a vector of each text, in the order of its rows. The default is count_vector() over its length (zeros for no words).

    A loader gives a function from a list of texts to their vectors. It's called once in a worker, before the first batch; its function gets texts of
    about one length at a time, batch_chars characters at most or one longer text. Null texts have no vector. Workers find a loader by its module and
    name, so two loaders need two names. An embedder is such a function itself, for one that needs no loading: it's sent with the tasks, gets a
    batch's texts in their order, nulls too, and decides the vectors of all."""
    if loader is not None and embedder is not None:
        raise ValueError("give a loader or an embedder")
    if embedder is not None:
        return df.withColumn(to, F.pandas_udf(_vectors_by(embedder), "array<double>")(text_col))
    if loader is None:
        return df.withColumn(to, F.pandas_udf(_count_vectors, "array<double>")(text_col))
    name = f"{loader.__module__}.{loader.__qualname__}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _loaded(name, loader)
        for texts in batches:
            known = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for places in _by_length([texts.iloc[i] for i in known], batch_chars):
                for place, vector in zip(places, model([texts.iloc[known[p]] for p in places]), strict=True):
                    out[known[place]] = np.asarray(vector, "f8")
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(run, "array<double>")(text_col))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over both lengths; 0 if one is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot / length).otherwise(F.lit(0.0))


def _best(scores: np.ndarray, k: int | None) -> np.ndarray:
    """Which scores are among their row's k best or tie with these; -inf never is."""
    keep = scores > -np.inf
    if k and scores.shape[1] > k:
        keep &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k][:, None]
    return keep


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To 6 places, halves away from zero as in SQL; in place. numpy's round takes halves to the even digit."""
    scores *= 1e6
    scores += np.copysign(0.5, scores)
    return np.divide(np.trunc(scores, out=scores), 1e6, out=scores)


def _cosines(queries: np.ndarray, norms: np.ndarray, m: np.ndarray) -> np.ndarray:
    length = norms[:, None] * np.sqrt((m * m).sum(axis=1))[None, :]
    return _rounded(np.divide(queries @ m.T, length, out=np.zeros(length.shape), where=length > 0))


def _hits(part: pa.RecordBatch, scores: np.ndarray, keep: np.ndarray, query_ids: list, id_col: str) -> pa.RecordBatch:
    q, c = np.nonzero(keep)
    return pa.RecordBatch.from_arrays([pa.array(np.array(query_ids, "i8")[q]), part[id_col].take(pa.array(c)), pa.array(scores[q, c])], ["query_id", id_col, "score"])


def permitted(ids: list, limited: set | None = None) -> Callable:
    """Function from a batch to the boolean matrix of the queries that may find each of its rows: those that the row's for_queries names or that have no
    limit, without those that its not_for names. A batch may lack either column."""
    free = np.array([i not in (limited or ()) for i in ids])
    place = {i: n for n, i in enumerate(ids)}

    def matrix(batch, vectors: np.ndarray | None = None) -> np.ndarray:
        out = np.repeat(free[:, None], batch.num_rows, axis=1)
        for column, may in (("for_queries", True), ("not_for", False)):
            if column in batch.schema.names:
                for row, named in enumerate(batch[column].to_pylist()):
                    if named:
                        out[[place[i] for i in named if i in place], row] = may
        return out

    return matrix


def top_of_batches(vector: Callable[[pa.RecordBatch], np.ndarray], queries: np.ndarray, query_ids: list, id_col: str, k: int | None, allow: Callable | None = None):
    """mapInArrow function: each batch's scores with all queries as one matrix product, of which each query's k best and their ties come out.

    No pair of query and row is ever a row of its own but those. With k=None all pairs come out, from fewer rows at a time. allow gives a boolean
    matrix of the pairs that count."""
    size = 2048 if k else 256
    norms = np.sqrt((queries * queries).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            m = vector(part)
            scores = _cosines(queries, norms, m)
            if allow is not None:
                scores[~allow(part, m)] = -np.inf
            yield _hits(part, scores, _best(scores, k), query_ids, id_col)

    return run


def pair_cosines(id_col: str):
    """mapInArrow function: rows (query_id, id_col, embedding, vector) to (query_id, id_col, score), rounded to 6 places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, m = (np.array(batch[c].to_pylist(), "f8").reshape(batch.num_rows, -1) for c in ("embedding", "vector"))
            length = np.sqrt((q * q).sum(axis=1)) * np.sqrt((m * m).sum(axis=1))
            score = _rounded(np.divide((q * m).sum(axis=1), length, out=np.zeros(len(q)), where=length > 0))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch[id_col], pa.array(score)], ["query_id", id_col, "score"])

    return run


def count_vectors(text_col: str, *keep: str):
    """mapInArrow function: the columns `keep` and the signed counts of a text as `vector`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_vector(t).astype("i4") for t in batch[text_col].to_pylist()]
            flat = pa.array(np.concatenate(counts)) if counts else pa.array([], pa.int32())
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], vectors], [*keep, "vector"])

    return run
