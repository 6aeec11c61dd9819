"""SentencePiece encoding and decoding as a relational lattice.

The distinct words' bounded-length substrings are exploded, joined to the piece table and grouped by word again; a fold with Spark's higher-order
aggregate picks the path, for words of every length up to LONGEST. Unigram models take Viterbi's. BPE models take the path that their merges give, the best score first: Viterbi over
a BPE model's scores, which are ranks of merges, gives other pieces than SentencePiece does."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, written

SPACE_MARK = "▁"
#: Words over so many characters don't fit the fold's 64-bit masks; their state is an array of boundaries.
MASK_CHARS = 60
#: The fold's work grows with a word's length squared, so words over so many characters are folded by a heap with the same rule where they are used.
LONGEST = 1024
#: Characters of a text that are cut into parts at once: a bound on a worker's memory.
CUT_CHARS = 250_000
#: Cost of a character that has no piece.
NO_PIECE = 1e9
#: Characters of text to a chunk, which ends with its input partition too: what a task holds is one chunk's dictionary.
CHUNK_CHARS = 8_000_000
#: Buckets of words to a shuffle partition: a word has dozens of edges, so the tasks that fold words take fewer rows than others.
BUCKETS = 8
_MODELS: dict[str, "Model"] = {}


class Model:
    """The tables of a SentencePiece model file: pieces with scores, ids of the 256 bytes, and whether paths come from merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.path, self.unknown = path, model.unk_id()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.beside = None
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) or "\n" in p for p in self.pieces):
            raise ValueError("pieces span words; the lattice is built word by word")
        self.merges = all(s <= 0 and float(s).is_integer() for _, s in self.pieces.values())  # BPE scores are the merges' ranks, unigram's are logarithms
        self.surface = np.empty(len(every), object)
        self.surface[:] = b""
        for p, (i, _) in self.pieces.items():
            self.surface[i] = p.replace(SPACE_MARK, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])

    @classmethod
    def of(cls, path: str) -> Model:
        return _MODELS.get(path) or _MODELS.setdefault(path, cls(path))

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): as many rows as the vocabulary has."""
        return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in self.pieces.items()], "piece string, id int, score double")

    def byte_ids(self, text: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in text.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def parts(self, word: str) -> list[str]:
        """The word, cut between characters that no piece has side by side: no path crosses such a place, so its parts are folded alone."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in itertools.pairwise(cuts)]

    def all_parts(self, words: list[str]) -> set[str]:
        """The distinct parts of all words, which hold no blanks."""
        return {p for word in words for p in self._split(word)}

    def _split(self, text: str) -> list[str]:
        """parts() of a text without blanks. Neighbouring characters are looked up by their numbers in one table, all at once."""
        if self.beside is None:
            chars = sorted({c for pair in self.pairs for c in pair})
            self.number = np.zeros(0x110000, "u2")
            self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
            self.beside = np.zeros((len(chars) + 1) ** 2 // 8 + 1, "u1")
            at = np.array([int(self.number[ord(a)]) * (len(chars) + 1) + int(self.number[ord(b)]) for a, b in self.pairs], "i8")
            np.bitwise_or.at(self.beside, at >> 3, (1 << (at & 7)).astype("u1"))
            self.width = len(chars) + 1
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        numbers = self.number[codes].astype("i8")
        at = numbers[:-1] * self.width + numbers[1:]
        cuts = np.flatnonzero((self.beside[at >> 3] >> (at & 7).astype("u1")) & 1 == 0) + 1
        return np.insert(codes, cuts, ord(" ")).tobytes().decode("utf-32-le", "surrogatepass").split(" ")

    def cut(self, text: str) -> Iterator[list[str]]:
        """The parts of a text in order, some at a time, with marks for its blanks and one before it. Words and lines end where parts do, as no piece
        has a mark after other characters or a line feed."""
        tail = SPACE_MARK
        for low in range(0, len(text), CUT_CHARS):
            found = self._split(tail[-1] + text[low : low + CUT_CHARS].replace(" ", SPACE_MARK))
            found[0] = tail[:-1] + found[0]
            tail = found.pop()
            yield found
        if text:
            yield [tail]

    def fold_long(self, word: str) -> list[int]:
        """The path of one word by plain Python: for words over LONGEST."""
        return self._merged(word) if self.merges else self._best(word)

    def _best(self, word: str) -> list[int]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = [(best[i][0] - self.pieces[word[i:end]][1], i) for i in range(max(0, end - self.longest), end) if word[i:end] in self.pieces]
            best.append(min(ways + [(best[end - 1][0] + NO_PIECE, end - 1)] * (word[end - 1] not in self.pieces)))
        out, end = [], len(word)
        while end:
            piece = word[best[end][1] : end]
            out.append([self.pieces[piece][0]] if piece in self.pieces else self.byte_ids(piece))
            end = best[end][1]
        return [x for ids in reversed(out) for x in ids]

    def _merged(self, word: str) -> list[int]:
        """Merges in n log n by a heap."""
        left, right, parts = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1], list(word)
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (hit := self.pieces.get(parts[i] + parts[right[i]])):
                heapq.heappush(heap, (-hit[1], i, right[i], parts[i] + parts[right[i]]))

        for i in range(len(word)):
            offer(i)
        while heap:
            _, i, j, made = heapq.heappop(heap)
            if right[i] != j or not parts[i] or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j], right[i] = made, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [x for p in parts if p for x in ([self.pieces[p][0]] if p in self.pieces else self.byte_ids(p))]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lattice(words: DataFrame, model: Model) -> DataFrame:
    """(bucket, word, edges) of distinct words (bucket, word): an edge is a piece in the word. A first edge of no length keeps words without pieces.

    Substrings meet the piece table on 64-bit hashes, and what meets is compared as text. edges are in order of cost, then from the left; ends has the
    bits of both ends, inner those strictly between. The rows are dealt by bucket already, so grouping them by word again moves nothing; the
    word's hash comes first among the keys, as what spills is sorted by it."""
    rows = words.select("bucket", F.xxhash64("word").alias("key"), "word", F.length("word").alias("n"))
    starts = rows.select("bucket", "key", "word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    lengths = F.sequence(F.when(F.col("start") == 0, 0).otherwise(1), F.least(F.lit(model.longest), F.col("n") - F.col("start")))
    spans = starts.select("bucket", "key", "word", "start", F.explode(lengths).alias("len"))
    spans = spans.withColumn("hash", F.xxhash64(F.expr("substring(word, start + 1, len)")))
    none = words.sparkSession.createDataFrame([("", None, NO_PIECE)], "piece string, id int, score double")
    pieces = model.table(words.sparkSession).unionByName(none).withColumn("hash", F.xxhash64("piece"))
    hits = spans.join(F.broadcast(pieces), "hash")  # the table is the vocabulary's size
    hits = hits.where(F.expr("substring(word, start + 1, len) = piece AND length(piece) = len"))
    start, end = F.col("start"), F.col("start") + F.col("len")
    fits = end <= MASK_CHARS
    ends, inner = F.when(fits, _bit(start) + _bit(end)), F.when(fits, _bit(end) - _bit(start + 1))
    edge = F.struct((-F.col("score")).alias("cost"), start, end.alias("end"), "id", ends.alias("ends"), inner.alias("inner"))
    made = hits.select("key", "bucket", "word", edge.alias("edge"))
    return made.groupBy("key", "bucket", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges")).select("bucket", "word", F.slice("edges", 2, F.size("edges")).alias("edges"))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _merge_fold(edges: Column, n: Column) -> Column:
    """Edges left when, again and again, the best-scored edge over exactly two neighbouring parts merges them; ties go left.

    The state has a bit per boundary in words of up to MASK_CHARS characters, else it's the boundaries' array. A word takes no more merges than it
    has characters less one, nor than it has edges of several characters."""
    rounds = lambda steps: F.sequence(F.lit(1), F.least(n - 1, F.size(steps)))

    def by_mask(steps: Column) -> Column:
        def step(mask: Column, _: Column) -> Column:
            active = F.filter(steps, lambda e: (F.bit_count(mask.bitwiseAND(e["inner"])) == 1) & (mask.bitwiseAND(e["ends"]) == e["ends"]))
            return F.coalesce(mask - mask.bitwiseAND(F.get(active, F.lit(0))["inner"]), mask)

        every = _bit(n + 1) - 1
        mask = F.when(F.size(steps) == 0, every).otherwise(F.aggregate(rounds(steps), every, step))
        return _let(mask, lambda m: F.filter(edges, lambda e: (m.bitwiseAND(e["inner"]) == 0) & (m.bitwiseAND(e["ends"]) == e["ends"])))

    def by_array(steps: Column) -> Column:
        at = lambda bounds, e: F.array_position(bounds, e["start"]).cast("int")

        def step(bounds: Column, _: Column) -> Column:
            active = F.get(F.filter(steps, lambda e: (at(bounds, e) > 0) & (F.get(bounds, at(bounds, e) + 1) == e["end"])), F.lit(0))
            return F.coalesce(F.array_remove(bounds, F.get(bounds, at(bounds, active))), bounds)

        every = F.sequence(F.lit(0), n)
        bounds = F.when(F.size(steps) == 0, every).otherwise(F.aggregate(rounds(steps), every, step))
        return _let(bounds, lambda b: _between(edges, b))

    return _let(F.filter(edges, lambda e: e["end"] - e["start"] > 1), lambda steps: F.when(n <= MASK_CHARS, by_mask(steps)).otherwise(by_array(steps)))


def _between(edges: Column, bounds: Column) -> Column:
    """The edges whose ends are neighbours in the ascending array bounds."""
    return F.filter(edges, lambda e: (F.array_position(bounds, e["start"]) > 0) & (F.get(bounds, F.array_position(bounds, e["start"]).cast("int")) == e["end"]))


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """Edges of the path with the least cost; ties take the longest last piece. The state has the best cost and the boundaries to each place.

    A character without a piece costs NO_PIECE."""
    kind = "struct<cost: double, path: array<int>>"
    begin = F.array(F.struct(F.lit(0.0), F.array(F.lit(0))).cast(kind))

    def step(best: Column, end: Column) -> Column:
        way = lambda start, cost: F.struct((F.get(best, start)["cost"] + cost).alias("cost"), start.alias("start"))
        ways = F.transform(F.filter(edges, lambda e: e["end"] == end), lambda e: way(e["start"], e["cost"]))
        least = F.array_min(F.concat(ways, F.array(way(end - 1, F.lit(NO_PIECE)))))
        return F.concat(best, F.array(F.struct(least["cost"], F.concat(F.get(best, least["start"])["path"], F.array(end))).cast(kind)))

    return _let(F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda s: F.get(s, n)["path"]), lambda bounds: _between(edges, bounds))


def _path_ids(path: Column, word: Column, model: Model) -> Column:
    """Ids of the path's edges from the left; characters that no edge covers have no piece and become their bytes' ids."""
    table = F.array(*[F.lit(model.bytes.get(b, model.unknown)) for b in range(256)])
    as_bytes = lambda c: F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda k: F.get(table, F.conv(F.substring(F.hex(c), 2 * k + 1, F.lit(2)), 16, 10).cast("int"))) if model.bytes else F.array(F.lit(model.unknown))

    def spelled(found: Column) -> Column:
        begins = lambda i: F.get(F.filter(found, lambda e: e["start"] == i), F.lit(0))["id"]
        free = lambda i: ~F.exists(found, lambda e: (e["start"] <= i) & (i < e["end"]))
        places = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.when(free(i), as_bytes(F.substring(word, i + 1, F.lit(1)))).when(begins(i).isNotNull(), F.array(begins(i))).otherwise(F.array().cast("array<int>")))
        return F.flatten(places)

    whole = lambda found: F.aggregate(found, F.lit(0), lambda s, e: s + e["end"] - e["start"]) == F.length(word)
    ordered = F.sort_array(F.transform(path, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["id"].alias("id"))))
    return _let(ordered, lambda found: F.when(whole(found), F.transform(found, lambda e: e["id"])).otherwise(spelled(found)))


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(bucket, word, ids) of distinct words (bucket, word) of 1 to LONGEST characters."""
    fold = _merge_fold if model.merges else _viterbi_fold
    ids = _let(F.col("edges"), lambda edges: _path_ids(fold(edges, F.length("word")), F.col("word"), model))
    return _lattice(words, model).select("bucket", "word", ids.alias("ids"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """A partition's rows, some at a time, with their chunk. Chunks are numbered by partition and place, so that two passes over the same files see the
    same chunks."""
    number, weight = None, 0
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        number = batch["part"][0].as_py() << 32 if number is None else number
        held = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held.append((doc_id, text))
            weight += len(text)
            if weight >= CHUNK_CHARS:
                yield number, held
                number, held, weight = number + 1, [], 0
        if held:
            yield number, held
        if batch.num_rows < 256:
            pa.default_memory_pool().release_unused()


_PART = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary())])
_PART_SQL = "chunk long, kind int, doc_ids array<long>, blob binary"
#: Kinds of those rows: a part of a chunk's dictionary, texts.
BOOK, TEXTS = 0, 1
#: Bytes of text to a row of texts.
TEXT_BYTES = 1_000_000


#: One for each level in a worker: small blobs take less time than making one.
_compressor = functools.cache(lambda level: zstandard.ZstdCompressor(level=level))
_decompressor = functools.cache(zstandard.ZstdDecompressor)


def _squeezed(data: bytes, level: int = 4) -> bytes:
    return _compressor(level).compress(data)


def _unsqueezed(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks' texts, some at a time: their lengths as 32 bits, then their bytes."""

    def row(chunk: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        blob = _squeezed(np.array([len(t) for t in texts], "<u4").tobytes() + b"".join(texts), 8)
        return pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": TEXTS, "doc_ids": ids, "blob": blob}], _PART)

    last, ids, texts, weight = None, [], [], 0
    for chunk, rows in _segments(batches):
        if ids and (chunk != last or weight >= TEXT_BYTES):
            yield row(last, ids, texts)
            ids, texts, weight = [], [], 0
        last = chunk
        for doc_id, text in rows:
            texts.append(text.encode("utf-8", "surrogatepass"))
            ids.append(doc_id)
            weight += len(texts[-1])
    if ids:
        yield row(last, ids, texts)


def _dictionaries(buckets: int, path: str):
    """Each chunk's distinct parts of words, dealt by hash, in order and by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        last, found = None, set()

        def dealt() -> pa.RecordBatch:
            found.discard("\n")
            lists: list[list[str]] = [[] for _ in range(buckets)]
            for word in found:
                if len(word) <= LONGEST:  # longer ones are folded where they are used
                    lists[zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets].append(word)
            found.clear()
            full = [(i, "\n".join(sorted(w))) for i, w in enumerate(lists) if w]
            return pa.RecordBatch.from_arrays([pa.array([last] * len(full), pa.int64()), pa.array([i for i, _ in full], pa.int32()), pa.array([w for _, w in full], pa.string())], ["chunk", "bucket", "words"])

        for chunk, rows in _segments(batches):
            if chunk != last and last is not None:
                yield dealt()
            last = chunk
            for _, text in rows:
                for parts in model.cut(text):
                    found.update(parts)
        if last is not None:
            yield dealt()

    return run


def _books(small: str):
    """For one bucket: its words' ids, and each chunk's words, to the parts of the chunks' dictionaries: words by line, an empty line, each word's
    number of ids as 16 bits, and its ids. What a task holds is one bucket's distinct words and lines."""

    def run(known: pa.Table, asked: pa.Table) -> pa.Table:
        known = known.combine_chunks()
        words, ids = known["word"].to_pylist(), known["ids"].combine_chunks()
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype(small)
        data = flat.tobytes()
        width = flat.itemsize
        at = (offsets.astype("i8") * width).tolist()
        book = {w: (data[at[i] : at[i + 1]], (at[i + 1] - at[i]) // width) for i, w in enumerate(words)}
        out = []
        for chunk, listed in zip(asked["chunk"].to_pylist(), asked["words"].to_pylist(), strict=True):
            found = [book[w] for w in listed.split("\n")]
            blob = listed.encode("utf-8", "surrogatepass") + b"\n\n" + np.array([k for _, k in found], "<u2").tobytes() + b"".join([d for d, _ in found])
            out.append({"chunk": chunk, "kind": BOOK, "doc_ids": None, "blob": _squeezed(blob)})
        return pa.Table.from_pylist(out, _PART)

    return run


def _apply(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        small = "<u2" if len(model.surface) < 1 << 16 else "<u4"
        line = np.array(model.byte_ids("\n") if "\n" not in model.pieces else [model.pieces["\n"][0]], "<i4").tobytes()
        chunk, book = None, {}

        class Book(dict):
            def __missing__(self, part: str) -> bytes:
                if len(part) <= LONGEST:
                    raise LookupError(f"chunk {chunk} has no ids of {part!r}: its texts came in another order when they were read again; write them to a table first")
                self[part] = found = np.array(model.fold_long(part), "<i4").tobytes()
                return found

        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):  # what is decoded at a time stays small
            c, kind, doc_ids, blob = (batch[x][0].as_py() for x in ("chunk", "kind", "doc_ids", "blob"))
            if c != chunk:
                chunk, book = c, Book({"\n": line})
            data = _unsqueezed(blob)
            if kind == BOOK:
                listed, _, numbers = data.partition(b"\n\n")
                words = listed.decode("utf-8", "surrogatepass").split("\n")
                ends = np.cumsum(np.frombuffer(numbers, "<u2", len(words)), dtype="i8").tolist()
                flat, at = np.frombuffer(numbers, small, offset=2 * len(words)).astype("<i4").tobytes(), 0
                for word, end in zip(words, ends, strict=True):
                    book[word] = flat[4 * at : 4 * end]
                    at = end
                continue
            sizes = np.frombuffer(data, "<u4", len(doc_ids)).tolist()
            at, out = 4 * len(doc_ids), []
            for size in sizes:
                text = data[at : at + size].decode("utf-8", "surrogatepass")
                out.append(b"".join([b"".join(map(book.__getitem__, parts)) for parts in model.cut(text)]))
                at += size
            offsets = np.cumsum([0, *(len(x) // 4 for x in out)]).astype("i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, then: Callable | None = None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """(doc_id, ids) of every row's whole text; null and empty texts have no ids, repeated rows are encoded each, an empty table gives an empty table.

    Chunks of documents send their distinct words, dealt by hash, to the lattice; a word is folded once for the corpus. The ids go back by chunk as
    a dictionary, which one task reads just before that chunk's texts, so neither words nor texts of the corpus gather anywhere. docs is read
    twice and should come in the same order each time, as files and written tables do; else a missing word is an error, never a wrong result.
    then, with its schema, is a mapInArrow function that gets those rows in the same worker, so that no second one holds them. Texts may be as long as a cell can be; columns but doc_id and text aren't read, so their names don't matter."""
    model, n = Model.of(model_path), shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS * n
    rows = docs.select("doc_id", F.spark_partition_id().cast("long").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    sent = written(rows.mapInArrow(_dictionaries(buckets, model_path), "chunk long, bucket int, words string"), "words", compression="zstd")
    sent = sent.repartition(buckets, "bucket")
    words = sent.select("bucket", "chunk", F.explode(F.split("words", "\n")).alias("word")).groupBy("bucket", "word").agg(F.min("chunk").alias("first"))
    known = encode_words(words.where("first IS NOT NULL"), model)  # both sides read all columns of sent, so that it's dealt once
    books = known.groupBy("bucket").cogroup(sent.select(F.col("bucket").alias("of"), "chunk", "words").groupBy("of")).applyInArrow(_books("<u2" if len(model.surface) < 1 << 16 else "<u4"), _PART_SQL)
    run = _apply(model_path)
    both = books.unionByName(rows.mapInArrow(_texts, _PART_SQL))
    return both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_both(run, then), schema)


def _both(first: Callable, then: Callable | None):
    return first if then is None else lambda batches: then(first(batches))


def decode_batches(path: str):
    """mapInArrow function from (doc_id, ids) to (doc_id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = [b"".join(model.surface[x.values.to_numpy()].tolist()).decode("utf-8", "replace")[1:] if x.is_valid and len(x) else "" for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts)], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, decoded): pieces joined, bytes put together, marks turned to blanks and the first blank, which encoding adds, taken off."""
    return encoded.select("doc_id", "ids").mapInArrow(decode_batches(model_path), "doc_id long, ids array<int>, decoded string")


def digest_batches(path: str):
    """mapInArrow function from (doc_id, ids) to (doc_id, n_ids, ids_crc32, decoded_sha256); it needs none of the subpackage's other modules in its worker."""
    decode = decode_batches(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode(batches):
            ids = [x.values.to_numpy().astype("<u4").tobytes() for x in batch["ids"]]
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in batch["decoded"].to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return run
