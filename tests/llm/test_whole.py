"""What the operators must not lose, or hold at once."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_dedup, secret_scan


def test_large_nodes_are_compared_in_pairs_of_blocks(spark):
    met = spark.range(2000).select(F.lit(7).cast("long").alias("node"), F.col("id").alias("cid"), F.xxhash64("id").alias("b0"), F.xxhash64("id", F.lit(1)).alias("b1"), F.lit(2000).cast("long").alias("n"))
    rows = near_dedup._node_blocks(met).toPandas()
    groups = [set(g.cid) for _, g in rows.groupby(["node", "i", "j"])]
    assert max(map(len, groups)) < 3 * near_dedup.NODE_CAP
    assert len(groups) == 36 and sum(len(g) for g in groups) == 8 * 2000
    at = {}
    for k, g in enumerate(groups):
        for c in g:
            at.setdefault(c, set()).add(k)
    assert all(at[a] & at[b] for a in range(0, 2000, 97) for b in range(2000))


def test_a_key_after_its_name_is_found(spark):
    key = "k9Xq2LmP7vRt4ZwB8nYc3HdJ6sFgA1eU"
    rows = spark.createDataFrame([(1, f"AUTH={key}"), (2, f"?a=b&sig={key}== c"), (3, f"{key} d")], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in secret_scan.secrets(rows).select("doc_id", secret_scan.spans_text(F.col("spans")).alias("s")).collect()}
    assert got == {1: "random:5:37", 2: "random:9:43", 3: "random:0:32"}


def _family(seed: int) -> list[np.ndarray]:
    """Near copies of one set, a chain that leads away from it, and sets that are like few others."""
    rng = random.Random(seed)
    base = [rng.randrange(1 << 60) for _ in range(100)]

    def changed(of: list[int], k: int) -> list[int]:
        out = list(of)
        for at in rng.sample(range(len(of)), k):
            out[at] = rng.randrange(1 << 60)
        return out

    sets, chain = [changed(base, rng.randrange(0, 7)) for _ in range(900)], base
    for _ in range(60):
        chain = changed(chain, 9)
        sets.append(chain)
    sets += [changed(base, rng.randrange(9, 30)) for _ in range(240)]
    return [np.unique(np.array(x, "u8")) for x in sets]


def test_a_large_family_loses_no_link_and_moves_no_set_often(spark):
    sets = _family(8)
    rows = [(5, len(sets), i, bytearray(s.tobytes())) for i, s in enumerate(sets)] + [(6, 2, 10_000 + i, bytearray(s.tobytes())) for i, s in enumerate(sets[:2])]
    frame = spark.createDataFrame(rows, "family long, n long, cid long, hashes binary")
    pairs, settled = near_dedup._family_pairs(frame, 80)
    pairs = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "cid")
    groups = pairs.groupBy("family", "i", "j").count().toPandas()
    assert groups["count"].max() < 3 * near_dedup.BLOCK
    assert groups[groups.family == 5]["count"].sum() < 3 * len(sets)  # each two of its five blocks would take five moves a set
    links = pairs.mapInArrow(near_dedup._decide(80), "a long, b long").unionAll(settled)
    label = {r["node"]: r["label"] for r in near_dedup.components(links).collect()}
    want = list(range(len(sets)))

    def top(x: int) -> int:
        while want[x] != x:
            x = want[x]
        return x

    for a, one in enumerate(sets):
        for b in range(a):
            if near_dedup._alike(one, sets[b], 80):
                x, y = sorted((top(a), top(b)))
                want[y] = x
    assert {i: label.get(i, i) for i in range(len(sets))} == {i: top(i) for i in range(len(sets))}
    assert len({top(i) for i in range(len(sets))}) > 5  # some sets are like no other
    assert label[10_001] == 10_000


def test_sizes_of_a_node_that_holds_nearly_all_rows(spark):
    entries = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("node"), F.col("id").alias("cid"), F.col("id").alias("b0"), F.col("id").alias("b1"))
    got = near_dedup._with_sizes(entries)
    assert got.columns == ["node", "cid", "b0", "b1", "n"]
    assert got.agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("cid")).first() == (18_000, 18_000, 18_000, 18_000)
