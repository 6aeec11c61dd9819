"""Best-fit packing of token sequences: local best fit, nearly full bins out, underfull bins merged up a tree as items of further rounds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import written

#: Tokens of a sequence; the id that ends a document.
CAPACITY, END_ID = 1024, 2
#: Pieces to a local partition; partitions to a merging one; underfull bins that a partition hands up, the emptiest first: more than FAN_IN.
LOCAL_ROWS, FAN_IN, KEEP = 4096, 16, 64
#: A bin with at most this many tokens of room is nearly full, so it's done where it stands.
WASTE = 4
#: Words whose ids a worker keeps: a bound on its memory. Other words are encoded each time.
CACHED_WORDS = 300_000
_PIECES = "doc_id long, version long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, "_Encoder"] = {}


class _Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes, by byte-level BPE over the vocabulary of a ``tokenizers`` file.

    The pattern attaches a blank to the word after it, so texts whose only white space next to a blank is none are encoded word by word and
    each word once per worker. Other texts are encoded whole. Where the file's added tokens stand in a text, they are cut out first and take their ids."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, self.added = file["model"]["vocab"], {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in file.get("added_tokens", ())}
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(chars[c] for c in token): rank for token, rank in vocab.items() if all(c in chars for c in token) and token not in self.added}
        self.bpe = tiktoken.Encoding("documents", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mixed = re.compile(r" \s|[^\S ] |\A\s|\s\Z")

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.bpe.encode_ordinary(word), "<u4").tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.marks.search(text):
            parts = [x for x in self.marks.split(text) if x]
            return b"".join([self.added[x] if x in self.added else self.plain(x) for x in parts])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text or len(text) < 64 or self.mixed.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + w for w in rest]))


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Encoder(path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, version, text in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    out.append((doc_id, version, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "version", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of each whole text (null: empty) with end_id after it. Documents over capacity are cut into pieces of capacity, the first may be
    shorter. version is the row's number, which keeps rows that repeat an id apart."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_cut(tokenizer_path, capacity, end_id), _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fill: items by descending size (ties by position), each into the fullest bin that holds it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8"), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order.tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, "i8")


def _handed_up(fill: np.ndarray, nearly: int) -> np.ndarray:
    """The underfull bins that go on, the emptiest KEEP.

    More can't save a sequence: after best fit a partition has one bin at most that is half full or less, and only such bins fit into others. A
    merging partition so has FAN_IN of them at most, which need no more than that many bins to go to, and of each partition the emptiest take them
    all if any do."""
    under = np.flatnonzero(fill < nearly)
    return under[np.argsort(fill[under], kind="stable")[:KEEP]]


def _pack_local(capacity: int, nearly: int):
    names = ["doc_id", "version", "piece", "bin", "place", "fill", "up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        part = rows["part"].to_numpy()
        for p in np.unique(part):
            mine = rows.filter(pa.array(part == p))
            bins, places, fill = best_fit(mine["length"].to_numpy(), capacity)
            up = np.zeros(len(fill), bool)
            up[_handed_up(fill, nearly)] = True
            made = [mine["doc_id"], mine["version"], mine["piece"], pa.array(bins + (int(p) << 32)), pa.array(places), pa.array(fill[bins]), pa.array(up[bins])]
            yield from pa.Table.from_arrays(made, names=names).to_batches()

    return run


def _merge(level: int, capacity: int, nearly: int, last: bool):
    kind = pa.schema([("sequence_id", pa.int64()), ("fill", pa.int64()), ("members", pa.list_(pa.struct([("bin", pa.int64()), ("base", pa.int64())]))), ("final", pa.bool_()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        groups = rows["group"].to_numpy()
        for g in np.unique(groups).tolist():
            mine = rows.filter(pa.array(groups == g))
            members, sizes = mine["members"].to_pylist(), mine["fill"].to_numpy()
            bins, bases, fill = best_fit(sizes, capacity)
            joined: list[list[dict]] = [[] for _ in fill]
            for inside, b, base in zip(members, bins.tolist(), bases.tolist(), strict=True):
                joined[b] += [{"bin": m["bin"], "base": m["base"] + base} for m in inside]
            goes = set() if last else set(_handed_up(fill, nearly).tolist())
            out = [{"sequence_id": (level << 56) + (g << 32) + b, "fill": int(fill[b]), "members": joined[b], "final": b not in goes, "part": g} for b in range(len(fill))]
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, waste: int = WASTE, local_rows: int = LOCAL_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """items (doc_id, version, piece, length <= capacity) with sequence_id and offset, gapless from 0.

    Whole pieces are sequences of their own. The rest is dealt by hash into partitions of about local_rows, one to a task, each packed by best fit. Bins with at most
    `waste` tokens of room are done; of the others a partition hands its KEEP emptiest to a partition of the next level, which takes
    fan_in partitions' bins as items, and so on to the root. What a task holds is bounded at each level, and no item is left out."""
    full = items.where(F.col("length") == capacity)
    rest = items.where(F.col("length") < capacity)
    n = max(1, -(-rest.count() // local_rows))
    key = F.xxhash64("doc_id", "version", "piece")
    dealt = rest.select("doc_id", "version", "piece", "length", F.pmod(key, F.lit(n)).alias("part")).repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", F.desc("length"), "doc_id", "version", "piece")
    nearly = capacity - waste
    local = written(dealt.mapInArrow(_pack_local(capacity, nearly), "doc_id long, version long, piece int, bin long, place long, fill long, up boolean"), "packed")
    bins = local.where("up").groupBy("bin").agg(F.first("fill").alias("fill")).select("fill", F.array(F.struct("bin", F.lit(0).cast("long").alias("base"))).alias("members"), F.shiftright("bin", 32).alias("part"))
    done, level = [], 1
    while True:
        n = -(-n // fan_in)
        sent = bins.select("fill", "members", F.floor(F.col("part") / fan_in).cast("long").alias("group")).repartitionById(n, F.col("group").cast("int")).sortWithinPartitions("group", F.desc("fill"), F.col("members")[0]["bin"])
        merged = written(sent.mapInArrow(_merge(level, capacity, nearly, n == 1), "sequence_id long, fill long, members array<struct<bin: long, base: long>>, final boolean, part long"), "merged")
        done.append(merged.where("final"))
        if n == 1:
            break
        bins, level = merged.where("NOT final"), level + 1
    moved = done[0]
    for more in done[1:]:
        moved = moved.unionByName(more)
    moved = moved.select("sequence_id", F.explode("members").alias("m")).select("sequence_id", F.col("m.bin").alias("bin"), F.col("m.base").alias("base"))
    placed = local.join(moved, "bin", "left").select("doc_id", "version", "piece", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"))
    # Local bins are numbered from 0 in part << 32, whole pieces below zero.
    whole = full.select("doc_id", "version", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast(LongType()).alias("offset"))
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id. Rows that repeat an id are packed each, rows without an id too. An empty table gives an empty
    table. Texts of any length are cut, one row at a time. Columns but doc_id and text aren't read, so clashing names don't matter."""
    cut = written(pieces(docs, tokenizer_path, capacity), "pieces")
    places = pack(cut, capacity)
    same = cut["doc_id"].eqNullSafe(places["doc_id"]) & (cut["version"] == places["version"]) & (cut["piece"] == places["piece"])
    return cut.join(places, same).select(cut["doc_id"], cut["piece"], "start", "length", "ids_crc32", "sequence_id", "offset")
