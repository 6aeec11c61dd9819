"""Near-duplicate documents by chosen-path set similarity join.

Every distinct shingle set branches, tree by tree, on some of its minwise tokens. Sets that share a token meet in a node. Small nodes are compared
exhaustively on 1-bit minwise sketches. In large nodes all sets are compared with a few pivots; those that are like one are settled with it, the others
branch again on tokens drawn for that node. What the trees join are families that hold every likely link; links are then decided exactly, on the
full shingle sets of each family. Large families meet a few pivots first, and only sets that these don't connect yet are compared in pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.components import components

#: Links need so many hundredths of the union in common.
PERCENT = 80
#: Independent trees, each with one branch at its root. A pair of similarity 0.8 misses all their first nodes with probability 0.2 ** 20.
TREES, MAX_DEPTH = 20, 6
#: Below the root one node in so many branches twice and the others once: 1 / 0.8 branches on average, at which the nodes that a pair of similarity
#: 0.8 shares neither die out quickly nor multiply with depth. Such a pair is in no common node of depth 6 in any tree with probability 2e-5.
TWICE_IN = 4
#: Minwise tokens that branching draws from; bits of a sketch; sets in a small node.
TOKENS, BITS, NODE_CAP = 64, 128, 256
#: Bits in common from which two sets join a family (similarity 0.8 gives 115 on average, with deviation 3.4), and from which a set is settled
#: with one of its node's pivots. Unrelated sets have 64, with deviation 5.7.
LIKE_BITS, SETTLED_BITS, PIVOTS = 101, 104, 3
#: Sets of a family that are compared in one task with as many others.
BLOCK = 256
#: Sets of a family of more than a block that all its sets are compared with first.
FAMILY_PIVOTS = 8
#: Tasks that a node's rows are dealt over before its size is known, and rows to a piece of a node of known size. A family's pieces have BLOCK sets.
SALTS, PIECE = 64, 4096
#: Words whose hashes a worker keeps: a bound on its memory.
CACHED_WORDS = 400_000

_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 31, BITS, dtype="u4") * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 1 << 32, BITS, dtype="u8").astype("u4")[:, None]
_SKETCH = "doc_id long, version long, n_shingles long, key binary, tokens binary, b0 long, b1 long"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = found
        return found


_HASHES = _WordHashes()


def shingle_hashes(text: str | None, size: int = 2) -> np.ndarray:
    """Distinct hashes of the text's shingles of `size` words, ascending. A-Z count as lower case; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() cuts at the six characters of SPACE
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, "u8")
    for i in range(size):
        out = (out ^ h[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minwise(hashes: np.ndarray) -> np.ndarray:
    """The BITS minwise values of a set, 32 bits each."""
    low, best = (hashes ^ (hashes >> np.uint64(32))).astype("u4"), None
    for at in range(0, len(low), 4096):
        v = low[None, at : at + 4096] * _MUL + _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        m = v.min(axis=1)
        best = m if best is None else np.minimum(best, m)
    return best


def _sketch(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, tokens, bits = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_hashes(text, shingle_words)
                sizes.append(len(s))
                if len(s):
                    values = _minwise(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    tokens.append(values[:TOKENS].tobytes())
                    bits.append(np.packbits((values >> np.uint32(4)) & np.uint32(1)).tobytes())
                else:
                    keys.append(None)
                    tokens.append(None)
                    bits.append(bytes(16))
            pair = np.frombuffer(b"".join(bits), "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["doc_id", "version", "n_shingles", "key", "tokens", "b0", "b1"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _branch(from_root: bool):
    """Rows (node, cid, b0, b1) of the nodes that each set goes to: from the root one token per tree, else one or two tokens drawn by the node's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tokens = np.frombuffer(b"".join(batch["tokens"].to_pylist()), "u4").reshape(n, TOKENS).astype("u8")
            nodes, every = [], np.arange(n)
            if from_root:
                for position in range(TREES):
                    nodes.append((every, _mixed(tokens[:, position] + (np.uint64(position + 1) << np.uint64(40)))))
            else:
                parents = batch["node"].to_numpy().view("u8")
                twice = np.flatnonzero(_mixed(parents + np.uint64(3)) % np.uint64(TWICE_IN) == 0)
                for k, rows in enumerate((every, twice)):
                    parent = parents[rows]
                    position = (_mixed(parent + np.uint64(k + 1)) % np.uint64(TOKENS)).astype("i8")
                    nodes.append((rows, _mixed(parent ^ _mixed(tokens[rows, position] + (position.astype("u8") + np.uint64(1) << np.uint64(40))))))
            cid, b0, b1 = (batch[c].to_numpy() for c in ("cid", "b0", "b1"))
            for rows, node in nodes:
                yield pa.RecordBatch.from_arrays([pa.array(node.view("i8")), pa.array(cid[rows]), pa.array(b0[rows]), pa.array(b1[rows])], ["node", "cid", "b0", "b1"])

    return run


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(root, member) pairs that connect what the boolean matrix links."""
    free = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if free[root]:
            free[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & free)
                free[front] = False
                for member in front.tolist():
                    yield root, member


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of sorted batches, one table for each value of keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pair = np.array(found, "i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair between the blocks i and j of a node on their sketches; what comes out are edges that connect the like ones."""
    found: list[tuple[int, int]] = []
    for node in _runs(batches, ["node", "i", "j"]):
        cid, b0, b1 = (node[c].to_numpy() for c in ("cid", "b0", "b1"))
        b0, b1 = b0.view("u8"), b1.view("u8")
        like = np.bitwise_count(b0[:, None] ^ b0) + np.bitwise_count(b1[:, None] ^ b1) <= BITS - LIKE_BITS
        if like.sum() > len(cid):
            found += [(int(cid[i]), int(cid[j])) for i, j in _forest(like)]
        if len(found) > 50_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def _node_blocks(met: DataFrame) -> DataFrame:
    """Rows (node, i, j, cid, b0, b1) of each two blocks of a node; nodes of up to NODE_CAP sets are one block. No group holds more than two blocks."""
    blocks = met.withColumn("of", F.ceil(F.col("n") / NODE_CAP).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid", "node"), F.col("of")).cast("int"))
    pairs = blocks.select("node", "cid", "b0", "b1", "block", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    return pairs.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "b0", "b1")


def _pieces(most: int) -> Column:
    """Pieces of up to about `most` rows, of a node or family of n rows."""
    return F.ceil(F.col("n") / most).cast("int")


def _own_piece(most: int) -> Column:
    return F.pmod(F.xxhash64("cid"), _pieces(most)).cast("int")


def _every_piece(most: int) -> Column:
    """A row for each piece, of a row that all of them need."""
    return F.explode(F.sequence(F.lit(0), _pieces(most) - 1))


def _with_sizes(entries: DataFrame) -> DataFrame:
    """The entries of nodes of two sets or more, with their node's size n. A node's rows are counted and joined in SALTS pieces, so a node that a third
    of all sets are in isn't one task's."""
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("node", "salt").agg(F.count("*").alias("some"))
    sizes = counts.select("node", "salt", F.sum("some").over(Window.partitionBy("node")).alias("n")).where("n > 1")
    return salted.join(sizes, ["node", "salt"]).drop("salt")


def _family_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) of the families. A level's large nodes go on to the next with the sets that none of their pivots settled; at MAX_DEPTH what is left
    is compared whole, in pairs of blocks."""
    entries = classes.select("cid", "tokens", "b0", "b1").mapInArrow(_branch(True), "node long, cid long, b0 long, b1 long")
    levels = []
    for depth in range(1, MAX_DEPTH + 1):
        met = written(_with_sizes(entries), "nodes")
        small = met if depth == MAX_DEPTH else met.where(F.col("n") <= NODE_CAP)
        levels.append(_node_blocks(small).repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(_compare_nodes, "a long, b long"))
        large = met.where(F.col("n") > NODE_CAP)
        if depth == MAX_DEPTH or large.isEmpty():
            break
        pivots = large.groupBy("node").agg(F.max("n").alias("n"), *[F.min_by(F.struct("cid", "b0", "b1"), F.xxhash64(F.lit(i), "node", "cid")).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = pivots.withColumn("piece", _every_piece(PIECE)).drop("n")
        common = [F.lit(BITS) - F.bit_count(F.col("b0").bitwiseXOR(F.col(f"p{i}.b0"))) - F.bit_count(F.col("b1").bitwiseXOR(F.col(f"p{i}.b1"))) for i in range(PIVOTS)]
        pivot_ids = [F.col(f"p{i}.cid").alias(f"q{i}") for i in range(PIVOTS)]
        beside = written(large.withColumn("piece", _own_piece(PIECE)).join(pivots, ["node", "piece"]).select("node", "cid", "b0", "b1", *pivot_ids, *[(c >= LIKE_BITS).alias(f"l{i}") for i, c in enumerate(common)], F.greatest(*[F.when(F.col("cid") == F.col(f"p{i}.cid"), BITS).otherwise(c) for i, c in enumerate(common)]).alias("common")), "pivots")
        first = F.coalesce(*[F.when(F.col(f"l{i}"), F.col(f"q{i}")) for i in range(PIVOTS)])
        levels.append(beside.select(F.col("cid").alias("a"), first.alias("b")).where("b IS NOT NULL AND a <> b"))
        # Pivots that some set is like at once are one family: an edge a node for each two of them.
        twos = [(i, j) for i in range(PIVOTS) for j in range(i)]
        shared = beside.groupBy("node").agg(*[F.max(F.when(F.col(f"l{i}") & F.col(f"l{j}"), F.struct(F.col(f"q{i}").alias("a"), F.col(f"q{j}").alias("b")))).alias(f"t{i}{j}") for i, j in twos])
        levels.append(shared.select(F.explode(F.array(*[F.col(f"t{i}{j}") for i, j in twos])).alias("t")).where("t.a <> t.b").select("t.a", "t.b"))
        onward = beside.where(F.col("common") < SETTLED_BITS).select("node", "cid", "b0", "b1")
        entries = onward.join(classes.select("cid", "tokens"), "cid").mapInArrow(_branch(False), "node long, cid long, b0 long, b1 long")
    edges = levels[0]
    for more in levels[1:]:
        edges = edges.unionAll(more)
    return edges


def _full_sets(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, shingle_words).tobytes() for t in batch["text"].to_pylist()]
            keep = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch["key"].to_pylist(), strict=True)]  # rows that repeat an id may have another text
            made = pa.RecordBatch.from_arrays([batch["family"], batch["n"], batch["cid"], pa.array(sets, pa.binary())], ["family", "n", "cid", "hashes"])
            yield made.filter(pa.array(keep, pa.bool_()))

    return run


def _decide(percent: int):
    """Exact links between the blocks i and j of a family; what comes out are edges that connect the linked sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["family", "i", "j"]):
            cid, block = group["cid"].to_numpy(), group["block"].to_numpy()
            sets = [np.frombuffer(x, "u8") for x in group["hashes"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = count[token] > 1
            owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
            one_block = group["i"][0] == group["j"][0]
            first = np.ones(len(sets), bool) if one_block else block == group["i"][0].as_py()
            second = first if one_block else ~first
            common = np.zeros((int(first.sum()), int(second.sum())), "f4")
            order = np.argsort(token, kind="stable")
            owner, token = owner[order], token[order]
            for low in range(0, int(token[-1]) + 1 if len(token) else 0, 8192):
                a, b = np.searchsorted(token, [low, low + 8192])
                x = np.zeros((len(sets), 8192), "f4")
                x[owner[a:b], token[a:b] - low] = 1
                common += x[first] @ x[second].T
            total = sizes[first][:, None] + sizes[second][None, :] - common
            hits = 100 * common.astype("f8") >= percent * total.astype("f8")
            linked = np.zeros((len(sets), len(sets)), bool)
            linked[np.ix_(first, second)] = hits
            linked |= linked.T
            yield _edges([(int(cid[a]), int(cid[b])) for a, b in _forest(linked)])

    return run


def _alike(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets have percent hundredths of their union in common."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    common = int((two[np.minimum(two.searchsorted(one), len(two) - 1)] == one).sum())
    return 100 * common >= percent * (len(one) + len(two) - common)


def _meet_pivots(percent: int):
    """For each set what it has exact links with among its family's pivots, which come first in its piece: a bit for each in `mask`, and their cids in
    `links`. A pivot has its own bit and is `chosen`. A task holds the pivots of one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots = None, []
        for batch in batches:
            family, piece, pivot, n, cid, hashes = (batch[c].to_pylist() for c in ("family", "piece", "pivot", "n", "cid", "hashes"))
            out = []
            for row, key in enumerate(zip(family, piece, strict=True)):
                if key != at:
                    at, pivots = key, []
                mine = np.frombuffer(hashes[row], "u8")
                if pivot[row]:
                    pivots.append((cid[row], mine))
                    continue
                like = [k for k, (other, theirs) in enumerate(pivots) if other == cid[row] or _alike(mine, theirs, percent)]
                links = [pivots[k][0] for k in like if pivots[k][0] != cid[row]]
                out.append({"family": family[row], "n": n[row], "cid": cid[row], "chosen": len(links) < len(like), "mask": sum(1 << k for k in like), "links": links})
            yield pa.RecordBatch.from_pylist(out, _MET)

    return run


_MET = pa.schema([("family", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("chosen", pa.bool_()), ("mask", pa.int32()), ("links", pa.list_(pa.int64()))])


def _parts(met: Column) -> Column:
    """The family's parts: pivots that links connect, a bit for each, of its distinct masks."""
    none = F.array().cast("array<int>")
    touches = lambda part, x: part.bitwiseAND(x["mask"]) != 0
    joined = lambda parts, x: F.aggregate(F.filter(parts, lambda p: touches(p, x)), x["mask"], lambda all_, p: all_.bitwiseOR(p))
    return F.aggregate(met, none, lambda parts, x: F.when(x["mask"] == 0, parts).otherwise(F.concat(F.filter(parts, lambda p: ~touches(p, x)), F.array(joined(parts, x)))))


def _family_pairs(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(family, i, j, block, cid, hashes): the blocks that are still to be compared, of sets (family, n, cid, hashes); and the links (a, b) found on the way.

    A family of up to BLOCK sets is one block. In a larger one all sets meet FAMILY_PIVOTS of its sets, whose links connect them in parts. Pivots are
    done then. A block holds sets of one part, or sets of none; two blocks are compared unless they are of the same part, so no link between parts is
    lost, and a family whose sets are nearly all like a pivot moves each set a few times, however many they are."""
    zero = F.lit(0)
    small = sets.where(F.col("n") <= BLOCK).select("family", zero.alias("i"), zero.alias("j"), zero.alias("block"), "cid", "hashes")
    large = sets.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return small, None
    names = [f"p{i}" for i in range(FAMILY_PIVOTS)]
    chosen = large.groupBy("family").agg(*[F.min_by("cid", F.xxhash64(F.lit(i), "cid")).alias(name) for i, name in enumerate(names)])
    chosen = written(chosen.select(F.explode(F.array_distinct(F.array(*names))).alias("cid")), "family-pivots")
    pivots = large.join(chosen, "cid").select("family", _every_piece(BLOCK).alias("piece"), F.lit(True).alias("pivot"), "n", "cid", "hashes")
    others = large.select("family", _own_piece(BLOCK).alias("piece"), F.lit(False).alias("pivot"), "n", "cid", "hashes")
    dealt = others.unionByName(pivots).repartition("family", "piece").sortWithinPartitions("family", "piece", F.desc("pivot"), "cid")
    seen = written(dealt.mapInArrow(_meet_pivots(percent), "family long, n long, cid long, chosen boolean, mask int, links array<long>"), "met-pivots")
    # A family has a row for each distinct mask, 2 ** FAMILY_PIVOTS at most.
    masks = seen.groupBy("family", "mask").agg(F.max("n").alias("n"), F.count_if(~F.col("chosen")).alias("sets"))
    met = masks.groupBy("family").agg(F.max("n").alias("n"), F.collect_list(F.struct("mask", "sets")).alias("met"))
    of_part = lambda part, mask: F.when(part == 0, mask == 0).otherwise(part.bitwiseAND(mask) != 0)
    size = lambda part: F.aggregate(F.filter("met", lambda x: of_part(part, x["mask"])), F.lit(0).cast("long"), lambda n, x: n + x["sets"])
    sized = F.transform(F.concat(F.array(zero), _parts(F.col("met"))), lambda p: F.struct(p.alias("part"), F.ceil(size(p) / BLOCK).cast("int").alias("of")))
    first = lambda i: F.aggregate(F.slice("sized", 1, i), zero, lambda n, x: n + x["of"])
    plan = met.select("family", "n", sized.alias("sized")).select("family", "n", F.transform("sized", lambda x, i: F.struct(x["part"].alias("part"), x["of"].alias("of"), first(i).alias("first"))).alias("plan"))
    rows = seen.where(~F.col("chosen")).withColumn("piece", _own_piece(BLOCK)).join(plan.select("family", _every_piece(BLOCK).alias("piece"), "plan"), ["family", "piece"])
    rows = rows.withColumn("mine", F.get(F.filter("plan", lambda p: of_part(p["part"], F.col("mask"))), zero))
    theirs = F.filter("plan", lambda p: (p["of"] > 0) & ((p["part"] != F.col("mine")["part"]) | (p["part"] == 0)))
    rows = rows.select("cid", (F.col("mine")["first"] + F.pmod(F.xxhash64("cid"), F.col("mine")["of"])).cast("int").alias("block"), F.flatten(F.transform(theirs, lambda p: F.sequence(p["first"], p["first"] + p["of"] - 1))).alias("others"))
    pairs = rows.where(F.size("others") > 0).join(large.select("family", "cid", "hashes"), "cid").select("family", "cid", "block", "hashes", F.explode("others").alias("other"))
    pairs = pairs.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "hashes")
    return small.unionByName(pairs), seen.select(F.col("cid").alias("a"), F.explode("links").alias("b"))


def near_components(docs: DataFrame, shingle_words: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, version) of every row of docs; version is the column __version of docs, or the text's hash where docs has none.

    Rows with equal sets are one class, however many they are, and classes alone are compared. component_id is the smallest doc_id of the
    component; null and empty texts, and texts without words, are components of their own. Rows without an id have no component and are kept.
    An empty table gives an empty table. A text of any length is one row of hashes, 8 bytes a distinct shingle. Other columns aren't read."""
    version = F.col("__version") if "__version" in docs.columns else F.xxhash64("text")
    docs = docs.select("doc_id", "text", version.alias("version"))
    rows = written(docs.mapInArrow(_sketch(shingle_words), _SKETCH), "sketches")
    known = rows.where("key IS NOT NULL AND doc_id IS NOT NULL")
    grouped = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("b0").alias("b0"), F.first("b1").alias("b1"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    family = components(_family_edges(classes)).select(F.col("node").alias("cid"), F.col("label").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("n"))
    members = written(family.join(sizes, "family").join(classes.select("cid", "key", "rep"), "cid"), "members")
    # A merge join at every size: the members grow with the corpus, so a broadcast that fits small inputs tells nothing about large ones.
    texts = docs.select("doc_id", "text").join(members.hint("merge"), F.col("doc_id") == F.col("rep")).select("family", "n", "cid", "key", "text")
    sets = written(texts.mapInArrow(_full_sets(shingle_words), "family long, n long, cid long, hashes binary").dropDuplicates(["cid"]), "family-sets")
    pairs, settled = _family_pairs(sets, percent)
    links = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "cid").mapInArrow(_decide(percent), "a long, b long")
    labels = components(links if settled is None else links.unionAll(settled))
    named = classes.select("cid", "key", "rep").join(labels, F.col("cid") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "cid").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    of_key = named.join(least, "label").select("key", "least")
    out = rows.select("doc_id", "version", "n_shingles", "key").join(of_key, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "version")


def keep_one_each(docs: DataFrame, shingle_words: int = 5, percent: int = PERCENT, whole: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are the smallest id of their component, with their columns as they are.

    Rows that repeat a kept id stay with it; of an id with several texts only those go that are like a smaller id's. Rows without an id stay. With
    whole (doc_id, text) a row is compared on the text there, if its id is there exactly once: what earlier stages cut doesn't hide a copy. An id that
    whole repeats doesn't say which text is whose, so its rows are compared on their own texts. Each row has one text and one verdict."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__version"))
    if whole is not None:
        repeated = whole.groupBy("doc_id").count().where("count > 1").select("doc_id")
        once = whole.select("doc_id", "text").join(repeated, "doc_id", "left_anti")
        known = once.select(F.col("doc_id").alias("__id"), F.col("text").alias("__whole"), F.lit(True).alias("__known"))
        rows = rows.join(known, F.col("doc_id") == F.col("__id"), "left").select("doc_id", F.when(F.col("__known"), F.col("__whole")).otherwise(F.col("text")).alias("text"), "__version")
    gone = near_components(rows, shingle_words, percent).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("version").alias("__gone_version")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__gone_version")), "left_anti")
