"""The grid of query blocks and row shards, deny lists, and the stored inverted file."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding, terms
from tessera.operators import ivf, search
from tessera.operators.grid import grid_search
from tessera.plans import registry
from tessera.sources import tables as R

DATA = "/root/testdata/sf0.001"


def pick(df, id_col="vec_id"):
    return sorted(map(tuple, df.select("query_id", "rank", id_col, "score").collect()))


def test_grid_equals_the_matrix_form(spark):
    queries, chunks = R.queries(spark, DATA), R.chunks(spark, DATA)
    assert pick(search.vector_search(queries, chunks, 5, most_queries=3), "chunk_id") == pick(search.vector_search(queries, chunks, 5), "chunk_id")
    rows = R.read(spark, DATA, "embeddings")
    asked = registry._vector_queries(spark, DATA)
    exact = search.vector_search_given(asked, rows, "vec_id", 10)
    assert pick(search.vector_search_given(asked, rows, "vec_id", 10, most_queries=2)) == pick(exact)
    small = grid_search(asked.withColumnRenamed("embedding", "vector"), rows.withColumnRenamed("embedding", "vector"), "vec_id", 10, block=2, shard=40)
    assert pick(search.top(small, 10, tie="vec_id")) == pick(exact)
    assert search.vector_pairs(asked, rows, "vec_id", most_queries=1).count() == asked.count() * rows.count()
    assert grid_search(asked.limit(0).withColumnRenamed("embedding", "vector"), rows.withColumnRenamed("embedding", "vector"), "vec_id", 10).count() == 0


def test_many_queries_meet_all_rows_without_a_driver_matrix(spark):
    queries = spark.range(6000).select(F.col("id").alias("query_id"), F.format_string("w%d w%d", F.col("id") % 50, F.col("id") % 7).alias("query"))
    chunks = spark.range(300).select(F.format_string("c%03d", "id").alias("chunk_id"), F.format_string("w%d w%d w%d", F.col("id") % 50, F.col("id") % 11, F.col("id") % 7).alias("content"))
    vectors = lambda df, text, key: df.mapInArrow(embedding.count_vectors(text, key), f"{key} {dict(df.dtypes)[key]}, vector array<int>")
    assert grid_search(vectors(queries, "query", "query_id"), vectors(chunks, "content", "chunk_id"), "chunk_id", None).count() == 6000 * 300
    hits = search.vector_search(queries, chunks, 3)
    alike = search.vector_search(queries.where("query_id % 60 = 0"), chunks, 3)
    assert pick(hits.where("query_id % 60 = 0"), "chunk_id") == pick(alike, "chunk_id")
    assert hits.select("query_id").distinct().count() > 5900  # words that cancel out leave a query without a vector


@pytest.mark.parametrize("most", [2048, 3])
def test_denied_chunks_make_room_for_others(spark, most):
    queries, chunks = R.queries(spark, DATA), R.chunks(spark, DATA)
    plain = search.vector_search(queries, chunks, 8)
    denied = plain.where("rank <= 3 AND query_id % 2 = 0").select("query_id", "chunk_id")
    got = search.vector_search(queries, chunks, 5, denied=denied, most_queries=most)
    want = search.top(plain.drop("rank").join(denied, ["query_id", "chunk_id"], "left_anti"), 5)
    assert pick(got, "chunk_id") == pick(want, "chunk_id")


def test_pools_over_the_limit_are_refused_when_the_plan_is_built(spark):
    with pytest.raises(ValueError, match="keyword pool"):
        search.retrieve(R.queries(spark, DATA), R.chunks(spark, DATA), terms.MAX_POOL)


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    centres = r.standard_normal((60, 16)) * 2
    return centres[r.integers(0, 60, 3000)] + 0.35 * r.standard_normal((3000, 16))


def test_all_cells_give_the_exact_result(spark, clustered):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered[:600])] + [(600, clustered[0].tolist()), (None, clustered[1].tolist()), (601, None), (602, [0.0] * 16)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ivf.build_ivf(rows, "vec_id", cells=16, parts=4)
    exact = search.vector_search_given(queries, rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL"), "vec_id", 10)
    assert pick(ivf.search_ivf(spark, queries, index, 10, probes=16)) == pick(exact)


def test_common_vectors_and_repeated_ids_give_the_exact_result(spark, clustered, monkeypatch):
    monkeypatch.setattr(ivf, "SHARD", 300)
    vectors = np.concatenate([np.repeat(clustered[:1], 1500, axis=0), clustered[:500]])
    rows = spark.createDataFrame([(i - i % 2 * (i > 1700), v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ivf.build_ivf(rows, "vec_id", cells=16, parts=4)
    assert max(index.shards) >= 5  # a cell is dealt by its own size
    assert pick(ivf.search_ivf(spark, queries, index, 10, probes=16)) == pick(search.vector_search_given(queries, rows, "vec_id", 10))


def test_a_task_holds_tiles_and_gives_k_rows_a_query():
    r = np.random.default_rng(4)
    n, dims = ivf.SHARD, 16
    vectors, centre = r.standard_normal((n, dims)), r.standard_normal((1, dims))
    vectors[n // 2 :] = vectors[0]  # one of many copies: all pairs of these tie
    queries = np.concatenate([vectors[: ivf.BLOCK // 2], np.repeat(vectors[:1], ivf.BLOCK // 2, axis=0)])
    unit = ivf._unit(vectors)
    books = np.stack([ivf._means((unit - centre)[:, p * 4 : p * 4 + 4], ivf.WORDS, 2, r, False) for p in range(4)])
    codes = ivf._encode(unit - centre, books)
    off = unit - centre - ivf._decode(codes, books)
    column = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    rows = pa.table({"row": np.arange(n), "vec_id": np.arange(n), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "off": np.sqrt((off * off).sum(axis=1)), "vector": column(vectors), **{c: pa.array(np.zeros(n, "i4")) for c in ("cell", "shard", "block")}})
    asked = pa.table({"query_id": np.arange(len(queries)), "embedding": column(queries), "least": np.full(len(queries), 0.5)})
    tracemalloc.start()
    low = ivf._first_pass("vec_id", centre, books, 10, True)(asked, rows)
    wanted = ivf._wanted(centre, books)(asked, rows)
    best = ivf._scored("vec_id", 10)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(queries) * n * 8 / 2  # half of one matrix of all pairs
    assert len(low) == 10 * len(queries) and len(wanted) <= n and len(best) <= 10 * len(queries)
    for q in (0, 1, 500, len(queries) - 1):
        score = np.round(unit @ ivf._unit(queries[q : q + 1])[0], 6)
        want = [i for i in np.lexsort((np.arange(n), -score))[:10] if score[i] >= 0.5]
        mine = best.filter(pa.compute.equal(best["query_id"], q))
        assert sorted(mine["vec_id"].to_pylist()) == sorted(want)
        bounds = low.filter(pa.compute.equal(low["query_id"], q)).to_pydict()
        assert all(lo <= score[i] <= hi for i, lo, hi in zip(bounds["vec_id"], bounds["low"], bounds["high"], strict=True))


def test_two_cells_a_vector_are_enough_for_vectors_that_have_structure(spark, clustered):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = ivf.build_ivf(rows, "vec_id", cells=32, copies=2, parts=8)
    exact = search.vector_search_given(queries, rows, "vec_id", 10)
    near = ivf.search_ivf(spark, queries, index, 10, probes=4, rescored=64)
    assert near.join(exact, ["query_id", "vec_id"]).count() >= 0.95 * exact.count()


def test_the_scan_reads_the_probed_cells_alone(spark, clustered, capsys):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered[:500])], "vec_id long, embedding array<double>")
    index = ivf.build_ivf(rows, "vec_id", cells=16, parts=4)
    ivf.search_ivf(spark, rows.limit(1).select(F.col("vec_id").alias("query_id"), "embedding"), index, 5, probes=2).explain("formatted")
    plan = capsys.readouterr().out
    filters = [x for x in plan.split("\n") if "PartitionFilters" in x and "cell" in x]
    assert filters and "IN" in filters[0]
    codes = [x for x in plan.split("\n") if "ReadSchema" in x and "code" in x]
    assert codes and "embedding" not in codes[0]


def test_recall_of_the_registered_index(spark):
    folder = "/root/testdata/sf0.1"
    exact = search.vector_search_given(registry._vector_queries(spark, folder), R.read(spark, folder, "embeddings"), "vec_id", 10)
    near = registry.vector_search_ivf(spark, folder)
    assert registry.IVF_PROBES == 16 and exact.count() == 200 and near.join(exact, ["query_id", "vec_id"]).count() >= 0.9 * 200
