"""Deletes in the store, numbered pages, feedback, grants, loaded embedders, captured errors, quotes, web pages of one url, snapshots and bounded state."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import answers, catalog, chunking, search, store
from tessera.plans import registry
from tessera.sources import scratch
from tessera.streaming import ingest

CHUNKS = "chunk_id string, doc_id long, content string"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_deletes_rewrite_only_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"{d}_{i}", d, "x") for d in range(40) for i in range(3)] + [("none", None, "y")]
    store.write_store(spark.createDataFrame(rows, CHUNKS), "doc_id", path, buckets=8)
    before = files(path)
    gone = spark.createDataFrame([(3,), (3,), (999,), (None,)], "doc_id long")
    assert store.delete_from_store(spark, path, gone, "doc_id", 8) == 1
    after = files(path)
    kept = set(before) & set(after)
    assert {f.split("/")[-2] for f in set(before) - kept} == {f.split("/")[-2] for f in set(after) - kept} and len({f.split("/")[-2] for f in set(before) - kept}) == 1
    assert all(before[f] == after[f] for f in kept)
    assert sorted(r["chunk_id"] for r in store.read_store(spark, path).collect()) == sorted(c for c, d, _ in rows if d != 3)
    assert store.delete_from_store(spark, path, gone, "doc_id", 8) == 0 and files(path) == after


def test_a_folder_that_loses_all_rows_is_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(spark.createDataFrame([("a", 1, "x"), ("b", 2, "x")], CHUNKS), "doc_id", path, buckets=4)
    store.delete_from_store(spark, path, spark.createDataFrame([(1,), (2,)], "doc_id long"), "doc_id", 4)
    assert store.read_store(spark, path).count() == 0
    store.write_store(spark.createDataFrame([], CHUNKS), "doc_id", path, buckets=4)
    assert store.read_store(spark, path).columns == ["chunk_id", "doc_id", "content"]


def test_pages_of_a_large_source_are_numbered(spark, tmp_path):
    rows = [(i, f" page {i} " if i % 9 else " \n", "en", "book" if i % 3 else None, 1) for i in range(6000)]
    spark.createDataFrame(rows, ingest.DOCUMENTS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["volume"], r["doc_id"]): r["page_number"] for r in registry.scan_page_text(spark, str(tmp_path)).collect()}
    want = {(v, i): n for v in ("book", None) for n, i in enumerate([i for i, *_, s, _ in rows if s == v], 1) if i % 9}
    assert got == want
    counts = {r["volume"]: (r["total_pages"], r["processed_pages"]) for r in registry.document_page_count(spark, str(tmp_path)).collect()}
    assert counts == {v: (sum(s == v for *_, s, _ in rows), sum(k == v for k, _ in want)) for v in ("book", None)}


def test_feedback_goes_by_words_and_by_the_sum_of_votes(spark):
    queries = spark.createDataFrame([(1, "red apple"), (2, "Apple, red!"), (3, "green apple")], "query_id long, query string")
    key = queries.where("query_id = 1").select(answers.term_key(F.col("query")).alias("k")).first()["k"]
    votes = spark.createDataFrame([(key, "a", -1), (key, "b", -1), (key, "b", 1), (key, "c", 1), (key, "d", -2), (key, "d", 1)], "term_key string, chunk_id string, vote int")
    assert sorted(map(tuple, answers.denied_by_feedback(queries, votes).collect())) == [(1, "a"), (1, "d"), (2, "a"), (2, "d")]


@pytest.mark.parametrize("most", [2048, 1])
def test_grants_hold_before_the_limit(spark, most):
    chunks = spark.createDataFrame([(f"c{i}", "red apple " + "pie " * i, "open" if i > 5 else "secret") for i in range(12)], "chunk_id string, content string, dataset string")
    queries = spark.createDataFrame([(1, "red apple", 7), (2, "red apple", 8), (3, "red apple", 9)], "query_id long, query string, user_id int")
    grants = spark.createDataFrame([(7, "open", "reader"), (7, "secret", "guest"), (8, "open", "reader"), (8, "secret", "owner")], "user_id int, dataset string, role string")
    got = search.vector_search(queries, chunks, 4, allowed=catalog.granted(queries, grants), most_queries=most).collect()
    by = {q: sorted(r["chunk_id"] for r in got if r["query_id"] == q) for q in (1, 2, 3)}
    assert by == {1: ["c6", "c7", "c8", "c9"], 2: ["c0", "c1", "c2", "c3"], 3: []}


def _counting_loader():
    """Marks each load by a file of its worker."""
    folder = os.environ.get("LOADS", "/tmp")
    with open(f"{folder}/{os.getpid()}", "a") as f:
        f.write("x")
    return lambda texts: [[float(len(t))] for t in texts] if sum(map(len, texts)) <= 60 or len(texts) == 1 else 1 / 0


def test_a_loader_runs_once_a_worker(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def loader():
        os.environ["LOADS"] = folder
        return _counting_loader()

    texts = [None if i % 7 == 0 else "x" * (i % 50 * 3) for i in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(24)
    for _ in range(2):
        got = {r["i"]: r["embedding"] for r in embedding.embed(frame, "t", loader=loader, batch_chars=60).collect()}
        assert got == {i: None if t is None else [float(len(t))] for i, t in enumerate(texts)}
    loads = [open(f).read() for f in glob.glob(f"{folder}/*")]
    assert loads and set(loads) == {"x"}  # 48 tasks, one load for each worker


def test_the_default_embedder_counts_a_batch_at_once(spark):
    texts = [None, "", "one two two", "ÀB c\x1cd", "a" * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in embedding.embed(frame, "t").collect():
        v = embedding.count_vector(texts[r["i"]])
        assert r["embedding"] == pytest.approx((v / ((v * v).sum() ** 0.5 or 1)).tolist())


def test_one_bad_row_fails_alone(spark):
    rows = [(1, '{"elements": [{"type": "text", "bbox": [1, 2, 3, 4]}]}'), (2, "no layout"), (3, None), (4, "[]"), (5, '{"elements": [{"bbox": [1]}]}'), (6, '{"elements": [{}]}'), (7, "{}")]
    got = {r["k"]: r for r in chunking.guarded(spark.createDataFrame(rows, "k int, raw string").coalesce(1), "k", "raw", chunking.checked_layout).collect()}
    assert {k for k, r in got.items() if r["error"] is None} == {1, 7} and got[1]["result"] == rows[0][1]
    assert got[2]["error"].startswith("JSONDecodeError") and got[3]["error"] == "ValueError: no reply" and got[6]["error"] == "KeyError: 'bbox'"
    outcomes = {r["k"]: r for r in catalog.outcomes(chunking.guarded(spark.createDataFrame(rows, "k int, raw string"), "k", "raw", chunking.checked_layout).withColumnRenamed("k", "doc_id")).withColumnRenamed("doc_id", "k").collect()}
    assert outcomes[7]["processing_status"] == "completed" and json.loads(outcomes[4]["metadata"]) == {"error": "ValueError: the reply is no object"}


def test_quotes_of_any_length_and_place(spark):
    docs = {1: "The quick brown fox jumps over the lazy dog and then it sleeps", 2: "a brownish\nfox", 3: None, 4: "", 5: "over the lazy dog"}
    queries = {1: "ick brown fox jumps over the lazy dog an", 2: "brown", 3: "row", 4: "n fox j", 5: "nish\nfox", 6: "over the lazy dog", 7: "not here", 8: "", 9: None, 10: "brown fox jumps over the lazy", 11: "the quick brown fox"}
    got = answers.quotes(spark.createDataFrame(list(queries.items()), "query_id long, query string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    want = sorted((q, d) for q, x in queries.items() for d, t in docs.items() if x and t and x in t)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 8


def test_pages_of_one_url_are_pages_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "one", "alpha beta"), (2, "u", "two", "alpha beta gamma"), (3, "v", "three", "alpha")], "page_id long, url string, title string, content string")
    got = answers.web_corpus_search(spark.createDataFrame([(1, "alpha beta")], "query_id long, query string"), pages).orderBy("rank").collect()
    assert [(r["title"], r["score"]) for r in got] == [("one", 1.0), ("two", 1.0), ("three", 0.5)]


def test_snapshots_and_a_restart_in_the_middle(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    put = lambda rows: spark.createDataFrame([(i, text(n), "en", "s", 1) for i, n in rows], ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.upsert_to(ingest.chunk_counts(ingest.document_stream(spark, source)), path, checkpoint)
    now = lambda: {r["doc_id"]: r["n_chunks"] for r in ingest.latest(spark, path, "doc_id").collect()}
    put([(1, 10), (2, 1500)])
    run()
    assert now() == {1: 1, 2: 2}
    upto = ingest.compact(spark, path, "doc_id")
    put([(1, 20), (3, 5)])
    run()
    assert now() == {1: 2, 2: 2, 3: 1}
    assert ingest.compact(spark, path, "doc_id") > upto and now() == {1: 2, 2: 2, 3: 1}
    plan = ingest.latest(spark, path, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_copies_inside_the_watermark_are_dropped_and_state_falls(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    put = lambda rows: spark.createDataFrame(rows, "text string, at string").select("text", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(source)
    state = []

    def run():
        stream = ingest.new_contents(spark.readStream.schema("text string, at timestamp").parquet(source), "at", "1 hour")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    put([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")])
    run()
    put([("a", "2024-01-01 00:30:00")])
    run()
    put([("c", "2024-01-01 09:00:00")])
    run()
    put([("d", "2024-01-01 09:01:00")])
    run()
    assert spark.read.parquet(out).count() == 4 and max(state) >= 2 and state[-1] <= 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch(Session, "x")
