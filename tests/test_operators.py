import math
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import embedding, terms
from tessera.functions import text as T
from tessera.operators import answers, catalog, chunking, search
from tessera.plans import registry
from tessera.plans import sql as S
from tessera.plans.registry import R, hybrid_retrieve
from tessera.sources.layout import spread

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    types = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], types).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "shown"), [(0, "0 Bytes"), (1, "1 Bytes"), (1023, "1023 Bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1048576, "1 MB"), (1073741824, "1 GB")])
def test_file_sizes(spark, n, shown):
    assert one(spark, T.format_file_size(F.col("n")), n=n) == shown


@pytest.mark.parametrize("places", [2, 6])
def test_numbers_are_printed_and_rounded_as_in_sql(spark, places):
    r = random.Random(places)
    numbers = [15.625, 40.625, 0.125, 2.675, 1.005, 0.1234565, 0.0078125, 0.0, 100.0, 1234.5, -0.375, *(r.randrange(2**20) / 2 ** r.randint(1, 20) for _ in range(500)), *(r.randrange(10**9) / 10 ** r.randint(3, 9) for _ in range(500))]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", T.printed(F.col("x"), places), T.rounded(F.col("x"), places)).collect()
    assert [(x, a) for x, a, _ in got] == [(x, f"{x:.{places}f}") for x in numbers]
    con = duckdb.connect()
    assert [tuple(row) for row in got] == con.execute(f"SELECT x, printf('%.{places}f', x), round(x, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()


def test_grades_of_a_share_on_a_half_are_those_of_sql(spark):
    words = [f"w{i}" for i in range(640)]
    rows = [(" ".join(words[:n]), " ".join(words[:common])) for common, n in ((5, 32), (13, 32), (9, 32), (1, 3), (0, 7), (1, 640))]
    got = answers.grade(spark.createDataFrame(rows, "query string, content string")).select("query", "content", "is_relevant", "confidence", "reasoning")
    con = duckdb.connect()
    con.execute("CREATE TABLE top (query TEXT, content TEXT)")
    con.executemany("INSERT INTO top VALUES (?, ?)", rows)
    want = con.execute(f"WITH {S.GRADED} SELECT query, content, is_relevant, confidence, reasoning FROM gr").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_score_details_are_those_of_sql(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(640)]
    lists = [(i, f"c{i}", r.randrange(100000, 900000) / 1e6, r.randrange(100000, 900000) / 1e6, *r.choice([(33, 0), (44, 33), (18, 18), (640, 1), (48, r.randrange(49))]), r.randrange(7)) for i in range(4000)]
    lists += [(4000, "c4000", 0.45228, 0.578739, 33, 0, 5), (4001, "c4001", 0.543645, 0.278526, 44, 33, 5), (4002, "c4002", 0.798151, 0.53843, 18, 18, 5)]
    con = duckdb.connect()
    frames = {}
    for name, columns, rows in (
        ("vt", "query_id BIGINT, chunk_id STRING, score DOUBLE, rank BIGINT", [(i, c, v, 1) for i, c, v, *_ in lists if i % 5]),
        ("kt", "query_id BIGINT, chunk_id STRING, score DOUBLE, rank BIGINT", [(i, c, k, 1) for i, c, _, k, *_ in lists if i % 5 != 1]),
        ("ch", "chunk_id STRING, doc_id BIGINT, page_number BIGINT, chunk_index BIGINT, content STRING", [(c, i, 1, at, " ".join(words[:common]) + " x") for i, c, _, _, _, common, at in lists]),
        ("q", "query_id BIGINT, query STRING", [(i, " ".join(words[:n])) for i, _, _, _, n, _, _ in lists]),
    ):
        frames[name] = spark.createDataFrame(rows, columns)
        arrow = frames[name].toArrow()
        con.register(name, arrow)
    shown = [f"'{n}=' || printf('%.6f', {n})" for n in ("keyword_score", "overlap_score", "rerank_score", "vector_score")]
    want = con.execute(f"WITH {S.fused().format(two_k=1)}, {S.RERANKED} SELECT query_id, rerank_score, concat_ws(',', {', '.join(shown)}) FROM rr").fetchall()
    hits = search.rerank(search.with_chunks(search.fuse(frames["vt"], frames["kt"]), frames["ch"], frames["q"]))
    got = hits.select("query_id", "rerank_score", search.score_details().alias("details")).collect()
    assert sorted((i, score, ",".join(f"{k}={v}" for k, v in sorted(details.items()))) for i, score, details in got) == sorted(want)


def test_a_cosine_on_a_half_is_rounded_away_from_zero(spark):
    rows = spark.createDataFrame([(1, [9.0, 127.0, 1.0, 2.0, 13.0]), (2, [-9.0, 127.0, 1.0, 2.0, 13.0])], "vec_id long, embedding array<double>")  # of length 128
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    want = duckdb.connect().execute("SELECT round(9 / 128::DOUBLE, 6), round(-9 / 128::DOUBLE, 6)").fetchone()
    assert tuple(r["score"] for r in search.vector_search_given(asked, rows, "vec_id", 2).orderBy("vec_id").collect()) == want


@pytest.mark.parametrize(("n", "pieces"), [(5, 1), (6, 2), (10, 3), (0, 1)])
def test_windows_cover_every_word(spark, n, pieces):
    text = " ".join(f"w{i}" for i in range(n))
    got = one(spark, T.chunk_words(F.col("t"), 5, 1), t=text)
    assert len(got) == pieces and {w for p in got for w in p.split()} == set(text.split())


def test_text_of_at_most_size_words_stays_as_it_is(spark):
    assert one(spark, T.chunk_words(F.col("t"), 5, 1), t="a  b\nc") == ["a  b\nc"]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="smaller"):
        T.chunk_words(F.col("t"), 5, 5)


@pytest.mark.parametrize(("query", "context", "answer"), [
    ("", "Some text.", answers.ANSWER_NONE), ("art", "", answers.ANSWER_NONE), ("art", "A part of it.", "Based on the provided context: A part of it"),
    ("a b", "a. b. a b", "Based on the provided context: a b a b These sentences seem most relevant to your question."),
])
def test_answers(spark, query, context, answer):
    assert one(spark, answers.answer(F.col("q"), F.col("c")), q=query, c=context) == answer


@pytest.mark.parametrize(("raw", "score"), [("0.2", 0.2), (" 1.7 ", 1.0), ("-3", 0.0), ("nan", 1.0), ("Fully supported", 0.1), ("unsupported", 0.1), ("partial", 0.5), ("some hallucination", 0.5), ("hallucination", 0.8), ("unsure", 0.3), (None, 0.5), ("1.0d", 0.3)])
def test_hallucination_replies(spark, raw, score):
    assert one(spark, answers.parse_hallucination(F.col("r")), r=raw) == score


def test_grade_replies(spark):
    rows = [(1, '{"is_relevant": true, "confidence": 0.9, "reasoning": "x"}'), (2, "{}"), (3, "Relevant"), (4, "Not relevant"), (5, "irrelevant"), (6, "[1]"), (7, None), (8, "```{}```")]
    got = {r["id"]: (r["is_relevant"], r["confidence"]) for r in answers.parse_grades(spark.createDataFrame(rows, "id int, raw string")).collect()}
    assert got == {1: (True, 0.9), 2: (False, 0.5), 3: (True, 0.6), 4: (False, 0.4), 5: (True, 0.6), 6: (True, 0.5), 7: (True, 0.5), 8: (False, 0.4)}


def test_search_hits_default_missing_fields(spark):
    raw = '{"results": [{"title": "t", "url": "u", "raw_content": null, "content": "c"}, {"score": 0.9}]}'
    got = answers.tavily_hits(spark.createDataFrame([(1, raw), (2, '{"results": []}')], "query_id int, raw string")).collect()
    assert [(r["title"], r["content"], r["score"]) for r in got] == [("t", "c", 0.5), ("", "", 0.9)]


@pytest.mark.parametrize(("query", "index", "expected"), [("", 0, 1.1), ("a a b", 0, 1.2), ("a", 100, 1.2), ("a", 150, 1.2)])
def test_rerank_scores(spark, query, index, expected):
    hits = spark.createDataFrame([(1, "c", query, "a x", index, 1.0)], "query_id int, chunk_id string, query string, content string, chunk_index int, score double")
    assert search.rerank(hits).first()["rerank_score"] == pytest.approx(expected)


@pytest.mark.parametrize("weight", [0.0, 0.7, 1.0])
def test_fusion(spark, weight):
    kind = "query_id int, chunk_id string, score double"
    got = {r["chunk_id"]: r["score"] for r in search.fuse(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.4)], kind), spark.createDataFrame([(1, "b", 0.2), (1, "c", 0.6)], kind), weight).collect()}
    assert got == pytest.approx({"a": 0.5 * weight, "b": 0.4 * weight + 0.2 * (1 - weight), "c": 0.6 * (1 - weight)})


def test_sources_are_shortened_only_over_200(spark):
    rows = [(1, 1, "a", "x" * 200, 0.5, None, 1), (1, 2, "b", "x" * 201, 0.5, "f.pdf", 1)]
    got = answers.sources(spark.createDataFrame(rows, "query_id int, position int, chunk_id string, content string, score double, filename string, page_number int")).orderBy("position").collect()
    assert [(len(r["content"]), r["document_name"]) for r in got] == [(200, "Unknown"), (203, "f.pdf")]


def test_filtered_searches_rank_among_allowed_documents_only(spark):
    queries, chunks = R.queries(spark, DATA), R.chunks(spark, DATA)
    allowed = registry._allowed(spark, DATA)
    forms = [search.vector_search(queries, chunks, 5, allowed=allowed, most_queries=n) for n in (2048, 3)]
    left, right = (sorted(map(tuple, f.select("query_id", "rank", "chunk_id", "score").collect())) for f in forms)
    assert left == right and len(left) > 100
    hits = forms[0].join(chunks.select("chunk_id", "doc_id"), "chunk_id").where("query_id % 4 <> 0")
    assert hits.where("doc_id % 7 <> query_id % 7").count() == 0 and hits.groupBy("query_id").count().where("count = 5").count() > 20


def test_an_empty_document_list_means_all(spark):
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, doc_id long")
    none, one = (spark.createDataFrame(rows, "doc_id long") for rows in ([], [(2,)]))
    assert catalog.of_documents(chunks, none).count() == 2 and [r["chunk_id"] for r in catalog.of_documents(chunks, one).collect()] == ["b"]


def _pool(tokens, query=()):
    rows = lambda lists: pa.table({"tokens": pa.array(lists, pa.list_(pa.string()))})
    return terms.Pool(rows(tokens), rows([list(query)]))


def test_large_vocabularies_keep_the_most_frequent_terms(monkeypatch):
    """More terms than MAX_TERMS: by total, then by text."""
    monkeypatch.setattr(terms, "MAX_TERMS", 3)
    pool = _pool([["red", "red", "plum", "kiwi", "fig"], ["red", "fig", "plum", "kiwi"], ["lime"]])
    kept = [t for t in range(len(pool.df)) if pool.kept[t]]
    assert sorted(zip(pool.texts(kept), pool.total[kept].tolist(), strict=True)) == [("fig", 2), ("kiwi", 2), ("red", 3)]


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=9) | st.none(), min_size=1, max_size=6), st.lists(st.sampled_from(["a", "b", "e"]), max_size=5))
@settings(max_examples=200, deadline=None)
def test_pool_scores_equal_counting_by_hand(tokens, query):
    """Null and empty token lists have no n-grams; repeated n-grams count; none crosses from one text to the next."""
    grams = lambda t: Counter(" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))
    counts, n = [grams(t or []) for t in tokens], len(tokens)
    df = Counter(g for c in counts for g in c)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in df.items() if 2 <= d <= 0.8 * n}
    asked = {g: tf * idf[g] for g, tf in grams(query).items() if g in idf}
    wanted = {}
    for i, c in enumerate(counts):
        weights = {g: tf * idf[g] for g, tf in c.items() if g in idf}
        if dot := sum(weights.get(g, 0) * w for g, w in asked.items()):
            wanted[i] = dot / math.sqrt(sum(w * w for w in weights.values())) / math.sqrt(sum(w * w for w in asked.values()))
    assert dict(zip(*(x.tolist() for x in _pool(tokens, query).scores()), strict=True)) == pytest.approx(wanted)


def test_a_pool_that_no_search_bounds_is_an_error(monkeypatch):
    monkeypatch.setattr(terms, "MAX_POOL", 2)
    with pytest.raises(ValueError, match="pool of 3"):
        _pool([["a"], ["b"], ["c"]])


def test_small_tables_are_dealt_over_the_cores(spark):
    """A file of one row group is several tasks; tables under a task's worth stay as they are."""
    big, small = (R.read(spark, "/root/testdata/sf0.1", n) for n in ("documents", "benchmark"))
    assert spread(big).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(small) is small
    pruned = spread(big).where("doc_id < 9").select("doc_id")
    assert pruned.count() == 9 and "ReadSchema: struct<doc_id:bigint>" in pruned._jdf.queryExecution().explainString(pruned.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_small_pools_have_no_keyword_hits(spark):
    queries = spark.createDataFrame([(1, "red apple")], "query_id long, query string")
    chunks = spark.createDataFrame([("a", "red apple"), ("b", "red apple")], "chunk_id string, content string")
    assert search.keyword_search(queries, chunks.selectExpr("1L AS query_id", "chunk_id"), chunks, 5).count() == 0


def test_empty_tables(spark):
    queries = spark.createDataFrame([], "query_id long, query string")
    chunks = R.chunks(spark, DATA).limit(0)
    assert search.retrieve(queries, chunks, 5).count() == 0
    assert chunking.strip_repeated_lines(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_large_files_are_rejected_only_with_a_limit(spark):
    files = spark.createDataFrame([("a.pdf", 5), ("b.PDF", 5), ("c.pdf", 50)], "filename string, file_size long")
    assert catalog.accepted_files(files).count() == 2 and catalog.accepted_files(files, 10).count() == 1


def test_plan_of_hybrid_retrieval(spark):
    plan = hybrid_retrieve(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan
    assert "MapInArrow" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("Scan parquet") < 12  # vector search and pool are read from their tables


def test_result_does_not_depend_on_partitions(spark):
    queries, chunks = R.queries(spark, DATA), R.chunks(spark, DATA)
    a, b = (sorted(map(tuple, search.vector_search(queries, c, 5).collect())) for c in (chunks, chunks.repartition(7)))
    assert a == b


def test_embedder_of_the_caller(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = embedding.embed(df, "t", embedder=lambda texts: [[float(len(t or ""))] for t in texts]).collect()
    assert sorted(r["embedding"][0] for r in got) == [0.0, 2.0]


def test_groundedness_of_long_conversations_equals_the_form_with_texts(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choices(["alpha", "Beta", "beta", "gamma", "delta", "x\x1cy", ""], k=r.randint(0, 6)))
    rows = [(c, t, r.choice(["user", "assistant"]), text()) for c in range(12) for t in range(r.choice([1, 5, 120]))] + [(1, 7, "assistant", "alpha new"), (2, 0, "assistant", None), (None, 1, "assistant", "alone"), (3, None, "assistant", "")]
    got = answers.groundedness_of_turns(spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")).collect()
    words = lambda x: set((x or "").lower().split())

    def score(c, t, content):
        mine, before = words(content), set().union(*[words(x) for d, u, _, x in rows if d is not None and d == c and u is not None and t is not None and u < t])
        return round(max(0, 1 - len(mine & before) / len(mine)), 6) if mine else 0.0

    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, map(tuple, got))) == sorted(key((c, t, score(c, t, x))) for c, t, role, x in rows if role == "assistant")
