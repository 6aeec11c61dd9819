"""Registered queries over the whole of their inputs, against SQL that is written apart from the registry's."""

from tessera.plans import registry as Q
from tessera.plans import sql as S
from tests.compare import check

DATA = "/root/testdata/sf0.001"
PAIRS = "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"


def test_every_hundredth_vector_is_a_query_and_meets_all(spark):
    check(spark, "query_chunk_similarity_join", Q.query_chunk_similarity_join, PAIRS, DATA)
    top = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({PAIRS})) WHERE rank <= 10 AND score >= 0.2"
    check(spark, "vector_search_topk", Q.vector_search_topk, top, DATA)
    assert {r[0] for r in Q.vector_search_ivf(spark, DATA).select("query_id").distinct().collect()} == {0, 100, 200, 300, 400}


def test_replies_hold_all_pages_with_whole_contents(spark):
    rank = "row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS rank"
    tavily = f"WITH {S.WEB} SELECT page_id // 10 AS query_id, {rank}, title, url, content, CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.5 END AS score FROM web"
    check(spark, "search_hits_tavily", Q.search_hits_tavily, tavily, DATA)
    serper = f"WITH {S.WEB} SELECT page_id // 10 AS query_id, {rank}, title, url, CASE WHEN page_id % 2 = 0 THEN content ELSE '' END AS content, 0.5 AS score FROM web"
    check(spark, "search_hits_serper", Q.search_hits_serper, serper, DATA)


ASKED = f"""{S.TURNS}, qc AS (SELECT a.conversation_id * 1000 + a.turn AS query_id, a.content AS answer, coalesce(arg_max(b.content, b.turn) FILTER (b.role = 'user'), '') AS query, coalesce(string_agg(b.content, chr(10) ORDER BY b.turn), '') AS context
FROM turns a LEFT JOIN turns b ON a.conversation_id = b.conversation_id AND b.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conversation_id, a.turn, a.content)"""


def test_assistant_turns_are_scored_against_all_earlier_turns(spark):
    score = S.hallucination("answer", "context")
    check(spark, "hallucination_heuristic", Q.hallucination_heuristic, f"WITH {ASKED} SELECT query_id, {score} AS hallucination_score FROM qc", DATA)
    check(spark, "hallucination_rate", Q.hallucination_rate, f"WITH {ASKED} SELECT round(avg(CASE WHEN {score} > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS hallucination_rate, count(*) AS n_answers FROM qc", DATA)
    check(spark, "answer_template", Q.answer_template, f"WITH {ASKED}, {S.answers()} SELECT query_id, answer FROM an", DATA)
    prompts = f"""WITH {ASKED} SELECT query_id, query_id AS chunk_id, 'Answer from the context alone.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Question: ' || query AS answer_prompt,
    'Is the document relevant to the query? Reply in JSON.' || chr(10) || 'Query: ' || query || chr(10) || 'Document: ' || substr(context, 1, 1000) || '...' AS grade_prompt,
    'How much of the answer lacks support, 0 to 1?' || chr(10) || 'Context: ' || context || chr(10) || 'Answer: ' || answer AS groundedness_prompt FROM qc"""
    check(spark, "prompt_assembly", Q.prompt_assembly, prompts, DATA)


def test_gaps_between_turns_drop_nothing(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 3, "assistant", "b"), (1, 7, "assistant", "c"), (2, 1, "assistant", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, Q._asked(spark, str(tmp_path)).collect())) == [(1003, "a", "b", "a"), (1007, "a", "c", "a\nb"), (2001, "", "d", "")]


def test_attempts_and_layouts_hold_whole_texts(spark):
    attempts = """WITH p AS (SELECT doc_id, doc_id % 4 AS m, text AS content, unnest([1, 2]) AS page_number FROM documents)
    SELECT doc_id, page_number, CASE WHEN m = 2 THEN 'text_extraction' WHEN m = 1 AND page_number = 2 THEN 'vision_fallback' ELSE 'vision' END AS method, 'ok' AS status, content FROM p WHERE m <> 3"""
    check(spark, "extraction_fallback", Q.extraction_fallback, attempts, DATA)
    layout = f"""WITH {S.ELEMENTS}, lay AS (SELECT doc_id AS page_id, element_no, element_type AS type, [0, element_no, 100, element_no + 1] AS bbox, content AS description FROM el WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 0
    UNION ALL SELECT DISTINCT doc_id, 0, 'text', [0, 0, 0, 0], 'Full page text' FROM el WHERE doc_id % 6 = 0) SELECT page_id, element_no, type, array_to_string(bbox, ',') AS bbox, description FROM lay"""
    check(spark, "layout_elements", Q.layout_elements, layout, DATA)
    check(spark, "element_type_dispatch", Q.element_type_dispatch, f"{layout} WHERE type IN ('table', 'text', 'figure')", DATA)
