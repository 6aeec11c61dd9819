"""Corpus-wide line dedup: range-partitioned line hashes, streamed in order of hash, document and position, give keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, written

#: Kinds of rows that a streamed partition emits.
DROP, PENDING, EDGE = 0, 1, 2
_LINES = "doc_id long, version long, pos int, k1 long, k2 long"
_FOUND = "kind int, doc_id long, version long, pos int, k1 long, k2 long"


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, at, keys = [], [], [], []
            for doc_id, version, text in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for pos, line in enumerate(text.split("\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars:
                        ids.append(doc_id)
                        versions.append(version)
                        at.append(pos)
                        keys.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))  # bytes.lower() changes A-Z alone
            pair = np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(at, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "version", "pos", "k1", "k2"])

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range. In memory: one batch and the current key.

    The first key of a range may have begun in an earlier range: its rows are PENDING. The EDGE rows say in which document the
    first and the last key of the range begin here; the least of a key's edges is where it really begins."""
    last, holder, first_run, opening = None, 0, True, None

    def emit(kind, doc, version, pos, k1, k2):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, "i4")), pa.array(doc), pa.array(version), pa.array(pos), pa.array(k1), pa.array(k2)], ["kind", "doc_id", "version", "pos", "k1", "k2"])

    for batch in batches:
        if not batch.num_rows:
            continue
        doc, version, pos, k1, k2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "version", "pos", "k1", "k2"))
        fresh = np.empty(len(doc), bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        fresh[0] = last is None or (k1[0], k2[0]) != last
        run = np.cumsum(fresh)
        holders = np.concatenate([[holder], doc[fresh]])
        if last is None:
            opening = (k1[0], k2[0], doc[0])
        inside = first_run & (run <= (1 if last is None else 0))
        drop = (doc != holders[run]) & ~inside
        for kind, mask in ((DROP, drop), (PENDING, inside)):
            if mask.any():
                yield emit(kind, doc[mask], version[mask], pos[mask], k1[mask], k2[mask])
        first_run = first_run and bool(inside[-1])
        last, holder = (k1[-1], k2[-1]), holders[run[-1]]
    if last is not None:
        for a, b, d in {opening, (*last, holder)}:
            yield emit(EDGE, np.array([d], "i8"), np.array([0], "i8"), np.array([0], "i4"), np.array([a], "i8"), np.array([b], "i8"))


def _bitmap(dropped: np.ndarray) -> bytes:
    keep = np.ones(-(-(int(dropped.max()) + 1) // 8) * 8, bool)  # whole bytes: bits beyond the last line mean keep
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes())


def _bitmaps(dropped: pd.Series) -> pd.Series:
    return dropped.map(_bitmap)


def kept_lines(lines: list[str], bitmap: bytes | None) -> list[str]:
    """The lines whose bit is 1; lines after the bitmap's end stay."""
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)].astype(bool).tolist()
    return [x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :]


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, version, keep_bitmap) of the documents that lose lines; version is the text's hash, so rows that repeat an id keep their own bitmaps.

    A line's key is the line stripped of white space, A-Z in lower case. A key of at least min_chars code points stays only in the smallest doc_id
    that holds it (all its lines there stay). Rows without an id neither hold nor lose lines. The ranges are cut on (hash, document, position),
    so a line that a third of the corpus shares is spread over many ranges."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL AND text <> ''")
    order = ["k1", "k2", "doc_id", "pos"]
    found = rows.mapInArrow(_hash_lines(min_chars), _LINES).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream, _FOUND)
    found = written(found, "line-decisions")
    begins = found.where(F.col("kind") == EDGE).groupBy("k1", "k2").agg(F.min("doc_id").alias("holder"))  # two rows a range at most
    pending = found.where(F.col("kind") == PENDING).join(F.broadcast(begins), ["k1", "k2"]).where("doc_id <> holder")
    dropped = found.where(F.col("kind") == DROP).select("doc_id", "version", "pos").unionAll(pending.select("doc_id", "version", "pos"))
    return dropped.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone")).select("doc_id", "version", F.pandas_udf(_bitmaps, "binary")("gone").alias("keep_bitmap"))


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with keep_bitmap (null: all lines stay)."""
    maps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "__doc_id", "version": "__version"})
    same = (docs["doc_id"] == maps["__doc_id"]) & (F.xxhash64(docs["text"]) == maps["__version"])
    return docs.join(maps, same, "left").drop("__doc_id", "__version")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the repeated lines cut out of text; null texts stay null. The columns stay as they are."""
    marked = with_bitmaps(docs.withColumnsRenamed({"keep_bitmap": "__own_keep_bitmap"}) if "keep_bitmap" in docs.columns else docs, min_chars)

    @F.pandas_udf("string")
    def cut(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else "\n".join(kept_lines(t.split("\n"), b)) for t, b in zip(text, bitmap, strict=True)], dtype=object)

    text = F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(cut("text", "keep_bitmap"))
    out = marked.withColumn("text", text).drop("keep_bitmap")
    return out.withColumnsRenamed({"__own_keep_bitmap": "keep_bitmap"}).select(*docs.columns)
