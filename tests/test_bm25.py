"""The stored index against counting by hand."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import bm25


def by_hand(queries, chunks, k, k1=1.2, b=0.75):
    n, mean = len(chunks), sum(len((t or "").split()) for t in chunks.values()) / len(chunks)
    df = Counter(w for t in chunks.values() for w in set((t or "").split()))
    out = []
    for q, text in queries.items():
        scores = {}
        for c, t in chunks.items():
            words = (t or "").split()
            tf = Counter(words)
            hit = [w for w in dict.fromkeys(text.split()) if tf[w]]
            if hit:
                scores[c] = round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(words) / mean)) for w in hit), 6)
        out += [(q, r, c, s) for r, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_search_equals_counting_by_hand_and_skips_blocks(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    # A third of the chunks share one term; some chunks are equal, some are empty.
    chunks = {f"c{i:03d}": " ".join(r.choices(words, k=r.randint(2, 12))) + (" everywhere" if i % 3 == 0 else "") for i in range(300)} | {"empty": "", "null": None, "twin1": "w1 w2 w3", "twin2": "w1 w2 w3"}
    queries = {i: " ".join(r.choices([*words, "everywhere", "nowhere"], k=4)) for i in range(20)} | {20: "nowhere", 21: "everywhere", 22: "w1 w2 w3"}
    frame = spark.createDataFrame(list(chunks.items()), "chunk_id string, content string").repartition(3)
    asked = spark.createDataFrame([*queries.items(), (None, "w1")], "query_id long, query string")
    index = bm25.build_bm25(frame, block_chunks=4)
    for seeds in (1, 4, 10_000):
        got = bm25.search_bm25(spark, asked, index, 5, seeds).select("query_id", "rank", "chunk_id", "score").collect()
        assert sorted(map(tuple, got)) == by_hand(queries, chunks, 5)
    monkeypatch.setattr(bm25, "SHARD_TERMS", 20)  # several shards of queries, and ids of another type
    got = bm25.search_bm25(spark, asked.withColumn("query_id", F.col("query_id").cast("string")), index, 5, 2).select(F.col("query_id").cast("long"), "rank", "chunk_id", "score").collect()
    assert sorted(map(tuple, got)) == by_hand(queries, chunks, 5)
    assert bm25.search_bm25(spark, asked.limit(0), index, 5).count() == 0
    sizes = spark.read.parquet(f"{index.path}/postings")
    assert sizes.agg(F.max("size")).first()[0] <= 4 and sizes.where("term = 'everywhere'").count() > 20


def test_queries_read_their_terms_folders_alone(spark, capsys):
    frame = spark.createDataFrame([(f"c{i}", f"word{i} word{i + 1} common") for i in range(200)], "chunk_id string, content string")
    index = bm25.build_bm25(frame)
    bm25.search_bm25(spark, spark.createDataFrame([(1, "word7")], "query_id long, query string"), index, 3).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert bm25.build_bm25(frame.limit(0)).n == 0
