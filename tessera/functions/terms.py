"""TF-IDF inside one pool of chunks, over arrays of whole-number codes: a pool is a search's limit of rows, so it fits in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that a pool keeps, n-gram length, least documents, largest share of documents.
MAX_TERMS, NGRAM, MIN_DF, MAX_DF = 10_000, 3, 2, 0.8
#: Chunks that a pool may hold; a larger one is an error, as it has to be one search's limit.
MAX_POOL = 4096


class Pool:
    """Counts of the n-grams of a pool's chunks and of its query, whose tokens count as one more row.

    rows, term, tf are parallel: how often a row has a term. Each n-gram's code is made of the code of the n-gram one shorter and the code of its
    last token, so equal codes are equal texts."""

    def __init__(self, chunks: pa.Table, asked: pa.Table):
        if len(chunks) > MAX_POOL:
            raise ValueError(f"a pool of {len(chunks)} chunks; a search's limit of at most {MAX_POOL} makes a pool")
        self.n = len(chunks)
        lists = [t["tokens"].combine_chunks() for t in (chunks, asked)]
        coded = pa.concat_arrays([pc.list_flatten(x) for x in lists]).dictionary_encode()
        self.tokens, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype("i8")
        lengths = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False)
        row = np.full(len(self.codes), self.n)
        row[: lengths.sum()] = np.repeat(np.arange(self.n), lengths)
        terms, rows, self.first = [], [], []
        level, known = self.codes, 0
        for size in range(1, NGRAM + 1):
            starts = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, "i8")
            raw = self.codes[starts] if size == 1 else level[starts] * len(self.tokens) + self.codes[starts + size - 1]
            found, at, inverse = np.unique(raw, return_index=True, return_inverse=True)
            level = np.zeros(len(row), "i8")
            level[starts] = inverse
            terms.append(inverse + known)
            rows.append(row[starts])
            self.first.append(np.stack([starts[at], np.full(len(at), size)], axis=1))
            known += len(found)
        self.first = np.concatenate(self.first)
        pairs, self.tf = np.unique(np.concatenate(rows) * max(known, 1) + np.concatenate(terms), return_counts=True)
        self.rows, self.term = np.divmod(pairs, max(known, 1))
        held = self.rows < self.n
        self.df = np.bincount(self.term[held], minlength=known)
        self.total = np.bincount(self.term[held], weights=self.tf[held], minlength=known).astype("i8")
        self.kept = self._kept()
        self.idf = np.log((1 + self.n) / (1 + self.df)) + 1

    def texts(self, terms: np.ndarray) -> list[str]:
        spans = self.first[terms]
        return [" ".join(self.tokens.take(pa.array(self.codes[at : at + size])).to_pylist()) for at, size in spans.tolist()]

    def _kept(self) -> np.ndarray:
        """Which terms count: MIN_DF <= df <= MAX_DF * n; of more than MAX_TERMS the most frequent, ties by text."""
        kept = (self.df >= MIN_DF) & (self.df <= MAX_DF * self.n)
        if kept.sum() > MAX_TERMS:
            least = np.partition(self.total[kept], -MAX_TERMS)[-MAX_TERMS]
            tied = np.flatnonzero(kept & (self.total == least))
            kept &= self.total > least
            by_text = sorted(zip(self.texts(tied), tied.tolist(), strict=True))
            kept[[t for _, t in by_text[: MAX_TERMS - kept.sum()]]] = True
        return kept

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have a term of the query, and their cosine with it."""
        counts = self.kept[self.term]
        rows, term, weight = self.rows[counts], self.term[counts], (self.tf * self.idf[self.term])[counts]
        of_query = rows == self.n
        asked = np.zeros(len(self.df))
        asked[term[of_query]] = weight[of_query]
        rows, term, weight = rows[~of_query], term[~of_query], weight[~of_query]
        dot = np.bincount(rows, weights=weight * asked[term], minlength=self.n)
        norm = np.sqrt(np.bincount(rows, weights=weight * weight, minlength=self.n))
        hit = np.flatnonzero(dot > 0)
        return hit, dot[hit] / (norm[hit] * np.sqrt((asked * asked).sum()))


def pool_scores(key: tuple, chunks: pa.Table, asked: pa.Table) -> pa.Table:
    """(query_id, chunk_id, score) of a pool's chunks that have a term of the query."""
    chunks = chunks.sort_by("chunk_id")
    hit, score = Pool(chunks, asked).scores() if len(chunks) and len(asked) else (np.zeros(0, "i8"), np.zeros(0))
    query_id = pa.array([key[0].as_py()] * len(hit), pa.int64())
    return pa.table({"query_id": query_id, "chunk_id": chunks["chunk_id"].take(pa.array(hit)), "score": pa.array(score)})


def pool_terms(key: tuple, chunks: pa.Table) -> pa.Table:
    """(query_id, term, df, n, total) of the terms that a pool keeps."""
    pool = Pool(chunks.sort_by("chunk_id"), chunks.slice(0, 0))
    kept = np.flatnonzero(pool.kept)
    ints = {"df": pool.df[kept], "n": np.full(len(kept), pool.n), "total": pool.total[kept]}
    return pa.table({"query_id": pa.array([key[0].as_py()] * len(kept), pa.int64()), "term": pa.array(pool.texts(kept), pa.string()), **{c: pa.array(v, pa.int64()) for c, v in ints.items()}})
