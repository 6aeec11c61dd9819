"""The trie of conversations' shared beginnings, as a minimal-perfect-hash node table.

A node is a distinct sequence of first turns. Every prefix of every conversation gets a digest of 128 bits that joins the hashes of its turns and their
places, so a prefix's digest follows from the one before. Equal digests are one node, which is checked by a third hash. Conversations are dealt to shards;
the nodes that a shard's conversations share with others get slots of a minimal perfect hash table, their counts are scattered into flat arrays by slot,
and sums go up through the array of parent slots, depth by depth. A node's own counts are put in by one shard only, so the shards' sums add up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.operators.ordering import numbered

#: Conversations of a shard; neighbours by id that stay in one shard; turns of a conversation that one window holds, as a power of 2.
SHARD_CONVERSATIONS, NEIGHBOURS, BLOCK_BITS = 4096, 128, 16
#: Keys to a bucket of the hash table, on average.
BUCKET = 4
_TURN = ["a", "b", "check", "n_chars"]
_NO_IDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, a, b, check, n_chars) of the turns of each conversation by turn, nulls first; null roles and texts are empty.

    Of the texts only hashes and their number of code points go on. Turns with one number go by their hashes. Rows without conv_id take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(i), role, text).alias(c) for i, c in enumerate(("a", "b", "check"))]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *hashes, F.length(text).cast("long").alias("n_chars"))
    return numbered(rows, "conv_id", [F.asc_nulls_first("turn"), "a", "b"]).select("conv_id", "position", *_TURN)


def _block() -> Column:
    return F.shiftright("position", BLOCK_BITS)


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations after a system prompt of their hundred: the first h turns of conversation c - c % 100, then c's own turns after its first h,
    h = crc32(c) % 6. Gives the rows as turns() does, and (conv_id) of all conversations, as some may have no turns left."""
    kept = written(rows, "turns")
    sizes = kept.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    plan = written(sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h).join(base, "base", "left"), "rebuilt")
    heads = kept.where("position < 5").withColumnRenamed("conv_id", "base").join(plan.select("conv_id", "base", "h"), "base").where("position < h")
    # A long conversation is many keys: its number and the block of its turns.
    blocks = plan.select("conv_id", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_head"), F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n") - 1, BLOCK_BITS))).alias("block"))
    own = kept.withColumn("block", _block()).join(blocks, ["conv_id", "block"]).where("position >= h")
    both = heads.select("conv_id", "position", *_TURN).unionByName(own.select("conv_id", (F.col("position") - F.col("h") + F.col("n_head")).alias("position"), *_TURN))
    return both, plan.select("conv_id")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, da, db, pa, pb, check, n_chars): digest, parent's digest and last turn of each conversation's prefixes of at least one turn."""
    mixed = rows.select("conv_id", "position", _block().alias("block"), F.xxhash64("a", "position").alias("za"), F.xxhash64("position", "b").alias("zb"), "check", "n_chars")
    upto = W.partitionBy("conv_id", "block").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    inside = mixed.withColumn("xa", F.bit_xor("za").over(upto)).withColumn("xb", F.bit_xor("zb").over(upto))
    totals = mixed.groupBy("conv_id", "block").agg(F.bit_xor("za").alias("ta"), F.bit_xor("zb").alias("tb"))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block of 2 ** BLOCK_BITS turns
    offsets = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(o) for t, o in (("ta", "oa"), ("tb", "ob"))])
    whole = inside.join(offsets, ["conv_id", "block"])
    digest = [F.col(x).bitwiseXOR(F.col(o)) for x, o in (("xa", "oa"), ("xb", "ob"))]
    parent = [d.bitwiseXOR(F.col(z)) for d, z in zip(digest, ("za", "zb"), strict=True)]
    named = [c.alias(n) for c, n in zip([*digest, *parent], ("da", "db", "pa", "pb"), strict=True)]
    return whole.select("conv_id", (F.col("position") + 1).alias("depth"), *named, "check", "n_chars")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectTable:
    """Slots 0 to n - 1 for n distinct keys of 128 bits, one each. Keys fall into buckets; each bucket has a seed that sends its keys to free slots,
    found by trying, the fullest buckets first. Buckets of one key are sent to what is left. Slots hold their keys, so a strange key is known as such."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.n_buckets = n, n // BUCKET + 1
        self.keys, self.seeds, self.direct = np.zeros((n, 2), "u8"), np.zeros(self.n_buckets, "u8"), np.full(self.n_buckets, -1, "i8")
        bucket = self._bucket(keys)
        size = np.bincount(bucket, minlength=self.n_buckets)
        free = np.ones(n, bool)
        for of in range(int(size.max(initial=0)), 1, -1):
            members = np.flatnonzero(size[bucket] == of)
            members = members[np.argsort(bucket[members], kind="stable")].reshape(-1, of)
            seed = np.uint64(0)
            while len(members):
                seed += np.uint64(1)
                slots = self._slot(keys[members.ravel()], np.full(members.size, seed)).reshape(-1, of)
                claims = np.full(n, len(members))  # of the buckets that ask for a slot, the first gets it
                np.minimum.at(claims, slots.ravel(), np.repeat(np.arange(len(members)), of))
                ordered = np.sort(slots, axis=1)
                fits = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1) & (claims[slots] == np.arange(len(members))[:, None]).all(axis=1)
                free[slots[fits]] = False
                self.keys[slots[fits].ravel()] = keys[members[fits].ravel()]
                self.seeds[bucket[members[fits, 0]]] = seed
                members = members[~fits]
        alone = np.flatnonzero(size[bucket] == 1)
        left = np.flatnonzero(free)
        if len(left) != len(alone):
            raise ValueError("keys repeat")
        self.direct[bucket[alone]], self.keys[left] = left, keys[alone]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys[:, 0] + np.uint64(1)) % np.uint64(self.n_buckets)).astype("i8")

    def _slot(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (_mixed(keys[:, 0] ^ _mixed(keys[:, 1] + seeds)) % np.uint64(max(self.n, 1))).astype("i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for keys that aren't in the table."""
        if not self.n:
            return np.full(len(keys), -1)
        bucket = self._bucket(keys)
        slots = np.where(self.direct[bucket] >= 0, self.direct[bucket], self._slot(keys, self.seeds[bucket]))
        return np.where((self.keys[slots] == keys).all(axis=1), slots, -1)


def _keys(table: pa.Table, one: str, two: str) -> np.ndarray:
    return np.stack([table[c].to_numpy().view("u8") for c in (one, two)], axis=1)


def _accumulate(rows: pa.Table) -> pa.Table:
    """One shard: sums of its shared nodes over what lies under them, and who is the parent's first member; of `first` rows the latter alone."""
    first = rows["first"].to_numpy(zero_copy_only=False)
    nodes, tails = rows.filter(pa.array(~first)), rows.filter(pa.array(first))
    table = PerfectTable(_keys(nodes, "da", "db"))
    slots = table.find(_keys(nodes, "da", "db"))
    depth, member, parent = (np.zeros(table.n, "i8") for _ in range(3))
    sums = np.zeros((table.n, 2), "i8")
    depth[slots], member[slots] = nodes["depth"].to_numpy(), nodes["conv_id"].to_numpy()
    parent[slots] = np.where(nodes["depth"].to_numpy() > 0, table.find(_keys(nodes, "pa", "pb")), -1)
    sums[slots] = np.stack([nodes["leaves"].to_numpy(), nodes["saved"].to_numpy()], axis=1)
    if ((parent < 0) & (depth > 0)).any():
        raise ValueError("a node without its parent")
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        if len(level) and depth[level[0]] > 0:
            np.add.at(sums, parent[level], sums[level])
    over = table.find(_keys(tails, "pa", "pb"))
    if (over < 0).any():
        raise ValueError("a tail without its parent")
    up = np.concatenate([parent[slots], over])
    n = len(tails)
    counted = [pa.concat_arrays([pa.array(sums[slots, i]), pa.nulls(n, pa.int64())]) for i in range(2)]
    keys = [np.concatenate([nodes[c].to_numpy(), tails[c].to_numpy()]) for c in ("da", "db")]
    member = member if table.n else np.zeros(1, "i8")
    return pa.table({"da": keys[0], "db": keys[1], "n_leaves": counted[0], "saved_tokens": counted[1], "parent_conv_id": pa.array(member[up], mask=up < 0)})


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    a, b = (batch[c].to_numpy() for c in ("da", "db"))
    cuts = (np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, batch.num_rows], strict=True)) if batch.num_rows else []


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs, ids = _runs(batch), list(map(str, batch["conv_id"].to_pylist()))
        at = pa.array([a for a, _ in runs], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["da"].take(at), batch["db"].take(at), batch["conv_id"].take(at), pa.array([",".join(ids[a:b]) for a, b in runs], pa.string())], ["da", "db", "conv_id", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        out = []
        for one, two, ids in zip(batch["da"].to_pylist(), batch["db"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if key == (one, two):
                digest.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = (one, two), hashlib.sha256(ids.encode())
        yield _digests(out)
    yield _digests([(*key, digest.hexdigest())] if key else [])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["da", "db", "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(da, db, ends_sha256). Ids are joined by range first, so of a node where many conversations end only a few long rows meet in one task, one by one."""
    parts = ends.repartitionByRange("da", "db", "conv_id").sortWithinPartitions("da", "db", "conv_id").mapInArrow(_joined_ids, "da long, db long, conv_id long, ids string")
    return parts.repartition("da", "db").sortWithinPartitions("da", "db", "conv_id").mapInArrow(_hashed_ids, "da long, db long, ends_sha256 string")


def _same(column: str) -> Column:
    return F.when(F.min(column) != F.max(column), F.raise_error(F.lit("two prefixes have one digest"))).otherwise(F.min(column)).alias(column)


def prefix_trie(rows: DataFrame, conversations: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """A row for each node of the trie: conv_id (its smallest member), depth, parent_conv_id (the parent's smallest member; null for the root), n_convs
    (members: conversations that start so), n_children, n_leaves (nodes without children under it, itself counted), saved_tokens (over the node and all
    under it: (n_convs - 1) times the code points of the last text) and ends_sha256 (of the ids of conversations that are the node, ascending, comma-joined).

    rows are turns as turns() gives them, conversations (conv_id) are all conversations, each once, those without turns too: they're members of the
    root. (conv_id, depth) names a node. Texts may be of any length, as only hashes of them move. Conversations that are alike, however many, are one
    path. An empty table has no root. A long conversation is cut into blocks, and only nodes with two members or more are in a shard's arrays. Two
    prefixes with one digest would be an error."""
    n = conversations.count()
    shard = F.pmod(F.xxhash64(F.floor(F.col("conv_id") / NEIGHBOURS)), F.lit(max(1, -(-n // shard_conversations)))).cast("int").alias("shard")
    known = written(prefixes(rows), "prefixes")
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "da", "db", "pa", "pb", "check", "n_chars")]
    same = ["depth", "pa", "pb", "check", "n_chars"]
    members = known.select("conv_id", "depth", "da", "db", "pa", "pb", "check", "n_chars").unionByName(conversations.select("conv_id", *zero))
    local = written(members.groupBy(shard, "da", "db").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *map(_same, same)), "local-nodes")
    nodes = local.groupBy("da", "db").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *map(_same, same))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("da"), F.col("pb").alias("db")).agg(F.count("*").alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("n_alone"))
    nodes = written(nodes.join(children, ["da", "db"], "left").na.fill(0, ["n_children", "n_alone"]), "nodes")
    shared = nodes.where("n_convs > 1 OR depth = 0")
    own = F.col("shard") == F.col("owner")
    leaves, saved = (F.col("n_children") == 0).cast("long") + F.col("n_alone"), (F.col("n_convs") - 1) * F.col("n_chars")
    counts = [F.when(own, c).otherwise(0).alias(name) for c, name in ((leaves, "leaves"), (saved, "saved"))]
    columns = ["shard", "da", "db", "pa", "pb", "depth", "conv_id"]
    inner = local.select("shard", "da", "db").join(shared.withColumn("owner", shard), ["da", "db"]).select(*columns, *counts, F.lit(False).alias("first"))
    # Under a node that a conversation shares with none it is alone to its end; the first of these nodes asks for its parent.
    alone = nodes.where("n_convs = 1 AND depth > 0").groupBy("conv_id").agg(F.min_by(F.struct("da", "db", "pa", "pb", "depth"), "depth").alias("t"))
    tails = alone.select(shard, "t.da", "t.db", "t.pa", "t.pb", "t.depth", "conv_id", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.lit(True).alias("first"))
    sums = inner.unionByName(tails).groupBy("shard").applyInArrow(_accumulate, "da long, db long, n_leaves long, saved_tokens long, parent_conv_id long")
    sums = sums.groupBy("da", "db").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("parent_conv_id").alias("above"))
    last = known.groupBy("conv_id").agg(F.max_by(F.struct("da", "db"), "depth").alias("e"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", F.coalesce("e.da", F.lit(0)).alias("da"), F.coalesce("e.db", F.lit(0)).alias("db"))
    found = nodes.join(sums, ["da", "db"], "left").join(_end_digests(ends), ["da", "db"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return found.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_IDS)).alias("ends_sha256")
    )
