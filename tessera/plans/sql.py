"""Pieces of the DuckDB twins that several queries share."""

from __future__ import annotations

from tessera.functions.text import STOP_WORDS, TOKEN, WS

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}'), lambda x_: x_ <> '')"


def word_set(x: str) -> str:
    return f"list_distinct({words(f'lower({x})')})"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}'), lambda x_: NOT list_contains({STOPS}, x_))"


def ngrams(x: str) -> str:
    """Of a column that holds tokens."""
    return f"list_concat({x}, list_concat(list_transform(range(1, len({x})), lambda i_: {x}[i_] || ' ' || {x}[i_ + 1]), list_transform(range(1, len({x}) - 1), lambda i_: {x}[i_] || ' ' || {x}[i_ + 1] || ' ' || {x}[i_ + 2])))"


def windows(x: str, content: str, size: int, overlap: int) -> str:
    return f"CASE WHEN len({x}) <= {size} THEN [{content}] ELSE list_transform(range(0, len({x}), {size - overlap}), lambda i_: array_to_string({x}[i_ + 1:i_ + {size}], ' ')) END"


PAGES = f"pt AS (SELECT doc_id, 1 AS page_number, {strip("coalesce(text, '')")} AS content FROM documents), page_text AS (SELECT * FROM pt WHERE content <> '')"
WEB = f"""web AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', ' ', 'g'),
  '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '{WS}', ' ', 'g')) AS content FROM pages)"""
QUERIES = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
FILES = "files AS (SELECT doc_id, source || '_' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.txt' ELSE '.pdf' END AS filename, source, text FROM documents)"
REGISTRY = f"{FILES}, registry AS (SELECT doc_id, filename, 'uploads/' || doc_id || '_' || filename AS file_path, strlen(text) AS file_size, sha256(text) AS content_hash, 'completed' AS upload_status, 'pending' AS processing_status, 0 AS total_pages, 0 AS processed_pages FROM files WHERE filename LIKE '%.pdf')"
TURNS = "turns AS (SELECT conv_id AS conversation_id, turn, role, text AS content, strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at FROM conversations)"
ELEMENTS = """el0 AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS parts FROM pages), el1 AS (SELECT page_id, unnest(range(0, len(parts))) AS element_no, unnest(parts) AS content FROM el0),
el AS (SELECT page_id AS doc_id, 1 AS page_number, element_no, CASE WHEN page_id % 7 = 0 THEN 'full_page' ELSE ['table', 'text', 'figure', 'header'][(page_id + element_no) % 4 + 1] END AS element_type, CASE WHEN (page_id + element_no) % 5 = 0 THEN '  ' ELSE content END AS content FROM el1)"""


def chunks(size: int = 1000, overlap: int = 200, name: str = "ch") -> str:
    split = windows("w", "content", size, overlap)
    return f"{name}0 AS (SELECT doc_id, {split} AS parts FROM (SELECT *, {words('content')} AS w FROM page_text)), {name} AS (SELECT concat_ws('_', doc_id, 1, 0, chunk_index) AS chunk_id, doc_id, 1 AS page_number, chunk_index, content FROM (SELECT doc_id, unnest(range(0, len(parts))) AS chunk_index, unnest(parts) AS content FROM {name}0))"


def vectors(rows: str, key: str, text: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, b, sum(s)::BIGINT AS v FROM (SELECT {key}, cast('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS b, 1 - 2 * (cast('0x' || substr(md5(w), 9, 2) AS BIGINT) % 2) AS s
FROM (SELECT {key}, unnest({words(f'lower({text})')}) AS w FROM {rows})) GROUP BY 1, 2), {name}_n AS (SELECT {key}, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name} GROUP BY 1)"""


def vector_top(k: int, name: str = "vt", allowed: str | None = None) -> str:
    """Ranked hits of q in ch by the default embedder; of queries that the table allowed (query_id, doc_id) names, only in their documents."""
    only = f" AND (query_id NOT IN (SELECT query_id FROM {allowed}) OR (query_id, doc_id) IN (SELECT query_id, doc_id FROM {allowed}))" if allowed else ""
    return f"""{vectors('ch', 'chunk_id', 'content', 'cv')}, {vectors('q', 'query_id', 'query', 'qv')},
dots AS (SELECT query_id, chunk_id, sum(qv.v * cv.v)::DOUBLE AS dot FROM qv JOIN cv USING (b) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
FROM (SELECT query_id, chunk_id, round(dot / (qv_n.norm * cv_n.norm), 6) AS score FROM dots JOIN qv_n USING (query_id) JOIN cv_n USING (chunk_id) JOIN (SELECT chunk_id, doc_id FROM ch) USING (chunk_id) WHERE qv_n.norm * cv_n.norm > 0 AND dot > 0{only})) WHERE rank <= {k})"""


def keyword_top(pool: str, k: int, name: str = "kt") -> str:
    """TF-IDF hits of q in the chunks of pool (query_id, chunk_id)."""
    return f"""tk AS (SELECT chunk_id, {tokens('content')} AS t FROM ch WHERE chunk_id IN (SELECT chunk_id FROM {pool})),
cg AS (SELECT chunk_id, g, count(*) AS tf FROM (SELECT chunk_id, unnest({ngrams('t')}) AS g FROM tk) GROUP BY 1, 2),
terms AS (SELECT query_id, chunk_id, g, tf FROM {pool} JOIN cg USING (chunk_id)),
pn AS (SELECT query_id, count(*) AS n FROM {pool} GROUP BY 1),
vocab AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, g) AS r FROM (SELECT query_id, g, count(*) AS df, sum(tf)::BIGINT AS total FROM terms GROUP BY 1, 2) JOIN pn USING (query_id) WHERE df >= 2 AND df <= 0.8 * n),
idf AS (SELECT query_id, g, df, n, total, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab WHERE r <= 10000),
wt AS (SELECT query_id, chunk_id, g, tf * idf AS w FROM terms JOIN idf USING (query_id, g)),
wn AS (SELECT query_id, chunk_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1, 2),
qt AS (SELECT query_id, g, count(*) AS tf FROM (SELECT query_id, unnest({ngrams('t')}) AS g FROM (SELECT query_id, {tokens('query')} AS t FROM q)) GROUP BY 1, 2),
qw AS (SELECT query_id, g, tf * idf AS qw FROM qt JOIN idf USING (query_id, g)),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY 1),
kd AS (SELECT query_id, chunk_id, sum(qw * w) AS dot FROM qw JOIN wt USING (query_id, g) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(dot / (norm * qnorm), 6) AS score FROM kd JOIN wn USING (query_id, chunk_id) JOIN qn USING (query_id)) WHERE score > 0.1) WHERE rank <= {k})"""


def fused(name: str = "fu", weight: str = "0.7::DOUBLE", rest: str = "0.30000000000000004::DOUBLE") -> str:
    return f"{name} AS (SELECT query_id, chunk_id, round({weight} * coalesce(v.score, 0) + {rest} * coalesce(k.score, 0), 9) AS score, v.score AS vector_score, k.score AS keyword_score FROM (SELECT * FROM vt WHERE rank <= {{two_k}} AND score >= 0.1) v FULL JOIN kt k USING (query_id, chunk_id))"


RERANKED = f"""rr AS (SELECT query_id, chunk_id, doc_id, page_number, chunk_index, content, query, score, vector_score, keyword_score, overlap_score, round(score * (1 + overlap_score * 0.2::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - chunk_index * 0.01::DOUBLE) * 0.1::DOUBLE), 9) AS rerank_score
FROM (SELECT *, round(CASE WHEN len({word_set('query')}) > 0 THEN len(list_intersect({word_set('query')}, {word_set('content')}))::DOUBLE / len({word_set('query')}) ELSE 0 END, 6) AS overlap_score FROM fu JOIN ch USING (chunk_id) JOIN q USING (query_id)))"""


def retrieved(k: int, name: str = "top", recall: int | None = None, allowed: str | None = None) -> str:
    """The hybrid retrieval, with everything before it."""
    each = recall or 2 * k
    pool = "pool AS (SELECT query_id, chunk_id FROM vt WHERE score >= 0.05)"
    final = f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM rr) WHERE rank <= {k})"
    cut = [] if recall is None else [f"fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS fr FROM fu) WHERE fr <= {recall})"]
    reranked = RERANKED if recall is None else RERANKED.replace("FROM fu JOIN", "FROM fc JOIN")
    return ",\n".join([PAGES, chunks(), QUERIES, vector_top(3 * each, allowed=allowed), pool, keyword_top("pool", each), fused().format(two_k=each), *cut, reranked, final])


GRADED = f"""gr AS (SELECT *, n_common / greatest(n_query, 1)::DOUBLE > 0.3 AS is_relevant, round(least(n_common::DOUBLE / greatest(n_query, 1) * 2, 1.0), 6) AS confidence, printf('Query-document word overlap: %d/%d (%.2f%%)', n_common, n_query, 100 * (n_common::DOUBLE / greatest(n_query, 1))) AS reasoning
FROM (SELECT *, len({word_set('query')}) AS n_query, len(list_intersect({word_set('query')}, {word_set('content')})) AS n_common FROM top))"""
NEEDED = "need AS (SELECT query_id, coalesce(n_hits, 0) AS n_hits, coalesce(n_relevant, 0) AS n_relevant, coalesce(n_relevant, 0) < 2 AS web_search_needed FROM q LEFT JOIN (SELECT query_id, count(*) AS n_hits, count(*) FILTER (is_relevant) AS n_relevant FROM gr GROUP BY 1) USING (query_id))"
WEB_HITS = f"""wq AS (SELECT query_id, list_distinct({tokens('query')}) AS t FROM q), wterms AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM wq),
wwords AS (SELECT DISTINCT page_id, url, unnest({tokens('content')}) AS term FROM web),
wscore AS (SELECT query_id, page_id, url, round(count(*)::DOUBLE / n, 6) AS score FROM wterms JOIN wwords USING (term) GROUP BY query_id, page_id, url, n),
wtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, page_id) AS rank FROM wscore) WHERE rank <= 5),
wh AS (SELECT query_id, rank, title, web.url, content, score FROM wtop JOIN web USING (page_id))"""
UNITED = "un AS (SELECT query_id, chunk_id, content, score, row_number() OVER (PARTITION BY query_id ORDER BY origin, rank, chunk_id) AS position FROM (SELECT query_id, chunk_id, content, rerank_score AS score, 0 AS origin, rank FROM gr WHERE is_relevant UNION ALL SELECT query_id, 'web_' || url, content, score, 1, rank FROM wh WHERE query_id IN (SELECT query_id FROM need WHERE web_search_needed)))"
CONTEXT = "cx AS (SELECT query_id, coalesce(context, '') AS context FROM q LEFT JOIN (SELECT query_id, string_agg('[Document ' || position || '] ' || content, chr(10) || chr(10) ORDER BY position) AS context FROM un WHERE position <= 5 GROUP BY 1) USING (query_id))"


def answers(source: str = "qc") -> str:
    """Answers of source (query_id, query, context): an (query_id, answer)."""
    return f"""se AS (SELECT query_id, i, s, len(list_filter(w, lambda w_: contains(lower(s), w_))) AS n FROM (SELECT query_id, w, unnest(range(0, len(ss))) AS i, unnest(ss) AS s FROM (SELECT query_id, string_split(context, '.') AS ss, {words('lower(query)')} AS w FROM {source}))),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS r FROM se WHERE n > 0),
sa AS (SELECT query_id, count(*) AS c, string_agg({strip('s')}, ' ' ORDER BY r) AS body FROM sr WHERE r <= 3 GROUP BY 1),
an AS (SELECT query_id, CASE WHEN c IS NULL THEN 'I couldn''t find relevant information in the provided context to answer your question.' WHEN c > 1 THEN 'Based on the provided context: ' || body || ' These sentences seem most relevant to your question.' ELSE 'Based on the provided context: ' || body END AS answer FROM {source} LEFT JOIN sa USING (query_id))"""


def hallucination(answer: str, context: str) -> str:
    return f"round(CASE WHEN len({word_set(answer)}) = 0 THEN 0 ELSE greatest(0.0, 1.0 - len(list_intersect({word_set(answer)}, {word_set(context)}))::DOUBLE / len({word_set(answer)})) END, 6)"
