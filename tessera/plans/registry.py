"""All registered queries and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.functions import text as T
from tessera.operators import answers, bm25, catalog, chunking, ivf, search, store
from tessera.plans import pipelines
from tessera.plans import sql as S
from tessera.sources import tables as R
from tessera.sources.scratch import scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Sources and sinks


@query(f"WITH {S.FILES} SELECT doc_id, filename, source FROM files WHERE filename LIKE '%.pdf'")
def file_type_gate(spark, d):
    return catalog.accepted_files(R.files(spark, d)).select("doc_id", "filename", "source")


@query(f"WITH {S.REGISTRY} SELECT * FROM registry")
def register_documents(spark, d):
    return R.registry(spark, d)


_VOLUMES = f"vo AS (SELECT source AS volume, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, doc_id, {S.strip("coalesce(text, '')")} AS content FROM documents)"


@query(f"WITH {_VOLUMES} SELECT volume, page_number, doc_id, content, 'text_extraction' AS method, 0.6 AS confidence FROM vo WHERE content <> ''")
def scan_page_text(spark, d):
    """The pages of whole sources; a source of any size is numbered without being one task's."""
    pages = R.volumes(spark, d)
    return chunking.scan_page_text(pages.select(F.struct("volume", "doc_id").alias("doc_id"), "page_number", "text")).select("doc_id.volume", "page_number", "doc_id.doc_id", "content", "method", "confidence")


@query(f"""WITH {S.PAGES}, {S.chunks()} SELECT regexp_replace(md5(chunk_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id, chunk_id, doc_id, page_number, chunk_index, content, '{{"chunk_index":"' || chunk_index || '"}}' AS metadata, 0.0 AS score, true AS stamped, 384 AS dim FROM ch""")
def chunk_sink(spark, d):
    path = scratch(spark, "chunks")
    pipelines.ingest(R.chunks(spark, d)).write.mode("append").parquet(path)
    rows = spark.read.parquet(path)
    stamped = F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$")
    return rows.select("id", "chunk_id", "doc_id", "page_number", "chunk_index", "content", "metadata", "score", stamped.alias("stamped"), F.size("embedding").alias("dim"))


@query(f"WITH {S.PAGES}, {S.chunks()} SELECT chunk_id, doc_id, chunk_index FROM ch WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def chunk_scan_by_document(spark, d):
    wanted = R.read(spark, d, "labels").where("quality = 1").select("doc_id")
    return catalog.of_documents(R.chunks(spark, d), wanted).select("chunk_id", "doc_id", "chunk_index")


@query(f"WITH {S.PAGES}, {S.chunks()} SELECT chunk_id, doc_id, chunk_index, content FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_document_chunks(spark, d):
    """Deletes from the stored table and reads it back."""
    path = scratch(spark, "store")
    store.write_store(R.chunks(spark, d), "doc_id", path)
    store.delete_from_store(spark, path, R.read(spark, d, "labels").where("toxic = 1"), "doc_id")
    return store.read_store(spark, path).select("chunk_id", "doc_id", "chunk_index", "content")


@query(f"""WITH {S.PAGES}, {S.chunks()}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1), off AS (SELECT conv_id FROM conversations WHERE role = 'system')
SELECT 'document' AS kind, doc_id AS id, count(chunk_id) AS n_children FROM documents LEFT JOIN ch USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY 2
UNION ALL SELECT 'conversation', conv_id, count(*) FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM off) GROUP BY 2""")
def delete_document_cascade(spark, d):
    """Documents go with their chunks, conversations with their messages; what both stores hold then, by parent."""
    paths = {name: scratch(spark, name) for name in ("documents", "chunks", "conversations", "messages")}
    turns = R.turns(spark, d)
    tables = {"documents": R.read(spark, d, "documents").select("doc_id", "source"), "chunks": R.chunks(spark, d), "conversations": catalog.conversation_table(turns), "messages": turns}
    keys = {"documents": "doc_id", "chunks": "doc_id", "conversations": "conversation_id", "messages": "conversation_id"}
    for name, rows in tables.items():
        store.write_store(rows, keys[name], paths[name])
    store.delete_cascade(spark, R.read(spark, d, "labels").where("toxic = 1"), "doc_id", paths["documents"], paths["chunks"])
    store.delete_cascade(spark, turns.where("role = 'system'"), "conversation_id", paths["conversations"], paths["messages"])
    left = {name: store.read_store(spark, path) for name, path in paths.items()}

    def counted(kind, parents, children, key):
        n = left[children].groupBy(key).agg(F.count("*").alias("n_children"))
        return left[parents].select(key).join(n, key, "left").select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))

    return counted("document", "documents", "chunks", "doc_id").unionByName(counted("conversation", "conversations", "messages", "conversation_id"))


def _requests(spark, d):
    return R.queries(spark, d).withColumn("conversation_id", F.when(F.col("query_id") % 3 != 0, F.col("query_id")))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'new_' || item_id ELSE item_id::VARCHAR END AS conversation_id, CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 50) END AS title, item_id % 3 = 0 AS is_new FROM benchmark")
def conversation_append(spark, d):
    return catalog.append_conversations(_requests(spark, d))


@query("""WITH m AS (SELECT item_id, min(doc_id) AS doc_id FROM (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY 1)
SELECT item_id AS query_id, 'user' AS role, text AS content, NULL AS metadata FROM benchmark UNION ALL
SELECT item_id, 'assistant', CASE WHEN doc_id IS NULL THEN '' ELSE text END, CASE WHEN doc_id IS NULL THEN '{"sources":[]}' ELSE '{"sources":["' || doc_id || '"]}' END FROM benchmark LEFT JOIN m USING (item_id)""")
def message_append(spark, d):
    """Two rows for every request; one whose passage no document holds has an empty answer without sources."""
    found = R.queries(spark, d).join(_quoted(spark, d).select("query_id", "doc_id"), "query_id", "left")
    known = F.col("doc_id").isNotNull()
    sources = F.when(known, F.array(F.col("doc_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    return catalog.append_messages(found.select("query_id", "query", F.when(known, F.col("query")).otherwise("").alias("answer"), sources.alias("sources")))


def _quoted(spark, d):
    """(query_id, query, doc_id) of benchmark passages with the first document that holds them."""
    q = R.queries(spark, d)
    first = answers.quotes(q, R.read(spark, d, "documents")).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return q.join(first, "query_id").select("query_id", "query", "doc_id")


def _responses(spark, d, nested: str):
    """Stored search replies: all pages, ten ids to one JSON text."""
    pages = R.web_pages(spark, d)
    item = F.struct("page_id", "title", "url", F.when(F.col("page_id") % 2 == 0, F.col("content")).alias("raw_content"), "content", F.when(F.col("page_id") % 3 == 0, 0.9).alias("score"))
    item = item if nested == "results" else F.struct("page_id", "title", F.col("url").alias("link"), F.when(F.col("page_id") % 2 == 0, F.col("content")).alias("snippet"))
    return pages.groupBy(F.floor(F.col("page_id") / 10).alias("query_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias(nested))).alias("raw"))


@query(f"WITH {S.WEB} SELECT page_id // 10 AS query_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS rank, title, url, content, CASE WHEN page_id % 3 = 0 THEN 0.9 ELSE 0.5 END AS score FROM web")
def search_hits_tavily(spark, d):
    return answers.tavily_hits(_responses(spark, d, "results"))


@query(f"WITH {S.WEB} SELECT page_id // 10 AS query_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS rank, title, url, CASE WHEN page_id % 2 = 0 THEN content ELSE '' END AS content, 0.5 AS score FROM web")
def search_hits_serper(spark, d):
    return answers.serper_hits(_responses(spark, d, "organic"))


@query(f"WITH {S.QUERIES}, {S.WEB}, {S.WEB_HITS} SELECT query_id, rank, title, url, score FROM wh")
def web_corpus_search(spark, d):
    return answers.web_corpus_search(R.queries(spark, d), R.web_pages(spark, d)).drop("content")


# Projections and filters


def _layouts(spark, d):
    """Stored layout replies: a page's elements as JSON; every fifth reply has none, every sixth isn't JSON."""
    parts = R.elements(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("element_no", F.col("element_type").alias("type"), F.array(F.lit(0), F.col("element_no"), F.lit(100), F.col("element_no") + 1).alias("bbox"), F.col("content").alias("description")))).alias("elements"))
    return parts.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("no layout here")).when(F.col("doc_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct("elements"))).alias("raw"))


_LAYOUT = f"""WITH {S.ELEMENTS}, lay AS (SELECT doc_id AS page_id, element_no, element_type AS type, [0, element_no, 100, element_no + 1] AS bbox, content AS description FROM el WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 0
UNION ALL SELECT DISTINCT doc_id, 0, 'text', [0, 0, 0, 0], 'Full page text' FROM el WHERE doc_id % 6 = 0) SELECT page_id, element_no, type, array_to_string(bbox, ',') AS bbox, description FROM lay"""


@query(_LAYOUT)
def layout_elements(spark, d):
    return chunking.layout_elements(_layouts(spark, d)).withColumn("bbox", F.array_join(F.col("bbox").cast("array<string>"), ","))


@query(_LAYOUT + " WHERE type IN ('table', 'text', 'figure')")
def element_type_dispatch(spark, d):
    return chunking.dispatched(layout_elements(spark, d))


_ELEMENT_CHUNKS = f"""WITH {S.ELEMENTS}, ec AS (SELECT doc_id, page_number, element_no, element_type, CASE WHEN element_type = 'figure' THEN 'Figure Description: ' || {S.strip('content')} ELSE {S.strip('content')} END AS content,
CASE WHEN element_type = 'full_page' THEN 'page_1' ELSE element_type || '_page_1' END AS label, CASE element_type WHEN 'table' THEN 0.95 WHEN 'text' THEN 0.9 WHEN 'figure' THEN 0.85 ELSE 0.7 END AS confidence, CASE WHEN element_type = 'full_page' THEN 'vision_fallback' ELSE 'vision' END AS method, element_type = 'figure' AS has_image
FROM el WHERE element_type <> 'header' AND (element_type = 'table' OR {S.strip('content')} <> ''))"""


@query(_ELEMENT_CHUNKS + " SELECT * FROM ec")
def element_to_chunk(spark, d):
    return chunking.element_to_chunk(R.elements(spark, d))


def _attempts(spark, d):
    """Extraction attempts of each document: as its id leaves on division by 4, all well, one page by the fallback, none by vision, nothing."""
    docs = R.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4).alias("m"), F.col("text").alias("content"))
    pages = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("page_number"), )
    rows = pages.select("*", F.explode(F.array(*map(F.lit, ("vision", "vision_fallback", "text_extraction")))).alias("method"))
    bad = ((F.col("m") == 1) & (F.col("page_number") == 2) & (F.col("method") == "vision")) | ((F.col("m") == 2) & F.col("method").isin("vision", "vision_fallback")) | (F.col("m") == 3)
    return rows.select("doc_id", "page_number", "method", F.when(bad, "failed").otherwise("ok").alias("status"), "content")


@query("""WITH p AS (SELECT doc_id, doc_id % 4 AS m, text AS content, unnest([1, 2]) AS page_number FROM documents)
SELECT doc_id, page_number, CASE WHEN m = 2 THEN 'text_extraction' WHEN m = 1 AND page_number = 2 THEN 'vision_fallback' ELSE 'vision' END AS method, 'ok' AS status, content FROM p WHERE m <> 3""")
def extraction_fallback(spark, d):
    return chunking.extraction_fallback(_attempts(spark, d))


def _corpus(spark, d):
    """The chunks as a table, as ingest leaves them for searches that read them more than once."""
    return written(R.chunks(spark, d), "chunks")


def _vector_hits(spark, d, k=10, least=None):
    return search.vector_search(R.queries(spark, d), R.chunks(spark, d), k, least)


_VT = lambda k, allowed=None: ",\n".join([S.PAGES, S.chunks(), S.QUERIES, S.vector_top(k, allowed=allowed)])


@query(f"WITH {_VT(30)} SELECT query_id, chunk_id, score FROM vt WHERE score >= 0.1")
def min_score_filter(spark, d):
    return _vector_hits(spark, d, 30, 0.1).select("query_id", "chunk_id", "score")


def _keyword_hits(spark, d, k=10):
    queries, chunks = R.queries(spark, d), _corpus(spark, d)
    pool = written(search.vector_search(queries, chunks, 3 * k, 0.05), "hits")
    return search.keyword_search(queries, pool, search.pool_chunks(pool, chunks), k)


_KT = ",\n".join([_VT(30), "pool AS (SELECT query_id, chunk_id FROM vt WHERE score >= 0.05)", S.keyword_top("pool", 10)])


@query(f"WITH {_KT} SELECT query_id, chunk_id, score FROM kt")
def keyword_threshold(spark, d):
    return _keyword_hits(spark, d).where("score > 0.1").select("query_id", "chunk_id", "score")


_GR = ",\n".join([S.retrieved(5), S.GRADED])


def _graded(spark, d):
    return pipelines.graded_hits(R.queries(spark, d), _corpus(spark, d))


@query(f"WITH {_GR} SELECT query_id, chunk_id, rank, confidence FROM gr WHERE is_relevant")
def relevant_only(spark, d):
    return _graded(spark, d).where("is_relevant").select("query_id", "chunk_id", "rank", "confidence")


def _web(spark, d):
    return answers.web_corpus_search(R.queries(spark, d), R.web_pages(spark, d))


@query(f"WITH {S.QUERIES}, {S.WEB}, {S.WEB_HITS} SELECT query_id, 'web_' || url AS chunk_id, 'web_search' AS doc_id, 0 AS page_number, 0 AS chunk_index, content, score, title, 'tavily' AS source FROM wh")
def web_result_to_chunk(spark, d):
    return answers.web_chunks(_web(spark, d)).select("query_id", "chunk_id", "doc_id", "page_number", "chunk_index", "content", "score", F.col("metadata")["title"].alias("title"), F.col("metadata")["source"].alias("source"))


def _top_with_files(spark, d):
    hits = search.retrieve(R.queries(spark, d), _corpus(spark, d), 5).withColumnRenamed("rank", "position")
    return hits.join(R.registry(spark, d).select("doc_id", "filename"), "doc_id", "left")


_SRC = f"WITH {S.REGISTRY}, {S.retrieved(5)}, sr AS (SELECT query_id, rank AS position, chunk_id, content, score, filename, page_number FROM top LEFT JOIN registry USING (doc_id))"


@query(_SRC + " SELECT query_id, position, chunk_id, CASE WHEN len(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content, score, coalesce(filename, 'Unknown') AS document_name, page_number FROM sr WHERE position <= 3")
def source_projection(spark, d):
    return answers.sources(_top_with_files(spark, d))


@query(_SRC + " SELECT query_id, position, chunk_id, content, score, NULL::VARCHAR AS document_name, page_number FROM sr")
def source_projection_full(spark, d):
    return answers.sources(_top_with_files(spark, d), None)


@query(_SRC + " SELECT query_id, position, printf('[%d] %s (p. %d)', position, coalesce(filename, 'Unknown'), page_number) AS label FROM sr WHERE position <= 3")
def citation_labels(spark, d):
    return answers.sources(_top_with_files(spark, d)).select("query_id", "position", F.format_string("[%d] %s (p. %d)", "position", "document_name", "page_number").alias("label"))


# Joins


_PAIRS = "SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0"
_TOP_VECTORS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_PAIRS})) WHERE rank <= 10"


@query(_PAIRS)
def query_chunk_similarity_join(spark, d):
    return search.vector_pairs(_vector_queries(spark, d), R.read(spark, d, "embeddings"), "vec_id")


_FU = ",\n".join([_VT(30), "pool AS (SELECT query_id, chunk_id FROM vt WHERE score >= 0.05)", S.keyword_top("pool", 10), S.fused().format(two_k=10)])


def _fused(spark, d):
    queries, chunks = R.queries(spark, d), _corpus(spark, d)
    wide = written(search.vector_search(queries, chunks, 30), "hits")
    pool = wide.where("score >= 0.05")
    return search.fuse(wide.where("rank <= 10 AND score >= 0.1"), search.keyword_search(queries, pool, search.pool_chunks(pool, chunks), 10))


@query(f"WITH {_FU} SELECT query_id, chunk_id, score, vector_score, keyword_score FROM fu")
def hybrid_fusion(spark, d):
    return _fused(spark, d)


_ALLOWED = "al AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON item_id % 4 <> 0 AND doc_id % 7 = item_id % 7)"


def _allowed(spark, d):
    """(query_id, doc_id): a query's documents are those whose id leaves the same on division by 7; every fourth query has no list, so it has all."""
    docs = R.read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7).alias("m"))
    return R.queries(spark, d).where("query_id % 4 <> 0").select("query_id", (F.col("query_id") % 7).alias("m")).join(docs, "m").select("query_id", "doc_id")


@query(f"WITH {_VT(30, 'al')} SELECT query_id, chunk_id, score, rank FROM vt".replace("WITH ", f"WITH {_ALLOWED}, "))
def document_semi_join(spark, d):
    return search.vector_search(R.queries(spark, d), R.chunks(spark, d), 30, allowed=_allowed(spark, d))


@query(f"WITH {_VT(3)} SELECT q.query_id, chunk_id, score FROM q LEFT JOIN (SELECT * FROM vt WHERE score >= 0.3) USING (query_id)")
def queries_left_hits(spark, d):
    return R.queries(spark, d).select("query_id").join(_vector_hits(spark, d, 3, 0.3), "query_id", "left").select("query_id", "chunk_id", "score")


@query(f"WITH {S.TURNS} SELECT conversation_id, turn, role, content, created_at FROM turns WHERE conversation_id IN (SELECT item_id FROM benchmark)")
def messages_of_conversation(spark, d):
    wanted = R.queries(spark, d).select(F.col("query_id").alias("conversation_id"))
    return catalog.only(R.turns(spark, d), wanted, "conversation_id").select("conversation_id", "turn", "role", "content", "created_at")


@query("SELECT DISTINCT item_id AS conversation_id FROM benchmark WHERE item_id NOT IN (SELECT conv_id FROM conversations)")
def unknown_conversations(spark, d):
    """The ids that messages_of_conversation() is asked for and doesn't know."""
    return catalog.without(R.queries(spark, d).select(F.col("query_id").alias("conversation_id")), R.turns(spark, d), "conversation_id").distinct()


# Aggregations

_CH = f"WITH {S.PAGES}, {S.chunks()}"


@query(f"WITH {_VOLUMES} SELECT volume, count(*) AS total_pages, count(*) FILTER (content <> '') AS processed_pages FROM vo GROUP BY 1")
def document_page_count(spark, d):
    """Pages of each source, and those that have text, counted on the numbered pages."""
    pages = R.volumes(spark, d)
    kept = chunking.scan_page_text(pages.select(F.col("volume").alias("doc_id"), "page_number", "text"))
    done = kept.groupBy("doc_id").agg(F.count_distinct("page_number").alias("processed_pages"))
    every = pages.groupBy("volume").agg(F.max("page_number").alias("total_pages"))
    return every.join(done, F.col("volume").eqNullSafe(F.col("doc_id")), "left").select("volume", "total_pages", F.coalesce("processed_pages", F.lit(0)).cast("long").alias("processed_pages"))


@query(_CH + " SELECT doc_id, count(chunk_id) AS n_chunks FROM documents LEFT JOIN ch USING (doc_id) GROUP BY 1")
def document_chunk_count(spark, d):
    return catalog.chunk_counts(R.read(spark, d, "documents"), R.chunks(spark, d))


@query(f"WITH {S.REGISTRY}, {S.PAGES}, {S.chunks()} SELECT doc_id, filename, file_size, CASE WHEN count(chunk_id) > 0 THEN 'completed' ELSE 'pending' END AS status, count(DISTINCT c.page_number) AS processed_pages, count(DISTINCT c.page_number) AS total_pages, count(chunk_id) AS n_chunks FROM registry LEFT JOIN ch c USING (doc_id) GROUP BY 1, 2, 3")
def document_status(spark, d):
    return catalog.document_status(R.registry(spark, d), R.chunks(spark, d))


_SIZE = """CASE WHEN n = 0 THEN '0 Bytes' WHEN n < 1024 THEN n || ' Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(CASE WHEN n < 1048576 THEN n / 1024.0::DOUBLE WHEN n < 1073741824 THEN n / 1048576.0::DOUBLE ELSE n / 1073741824.0::DOUBLE END, 2)), '0+$', ''), '\\.$', '')
|| CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END END"""


@query(f"WITH {S.REGISTRY}, {S.PAGES}, {S.chunks()}, s AS (SELECT doc_id, filename, file_size AS n, count(chunk_id) AS c, count(DISTINCT c.page_number) AS pages FROM registry LEFT JOIN ch c USING (doc_id) GROUP BY 1, 2, 3) SELECT doc_id, filename, CASE WHEN c > 0 THEN 'completed' ELSE 'pending' END AS status, pages AS processed_pages, pages AS total_pages, {_SIZE} AS size FROM s")
def document_list(spark, d):
    return catalog.document_status(R.registry(spark, d), R.chunks(spark, d)).select("doc_id", "filename", "status", "processed_pages", "total_pages", T.format_file_size(F.col("file_size")).alias("size"))


@query("""WITH p AS (SELECT page_id AS doc_id, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS n FROM pages)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'failed' ELSE 'completed' END AS processing_status, doc_id % 6 <> 0 AS has_processed_at,
CASE WHEN doc_id % 6 = 0 THEN '{"error":"JSONDecodeError: Expecting value: line 1 column 1 (char 0)"}' END AS metadata FROM p WHERE n > 0""")
def processing_outcome(spark, d):
    """Each stored layout reply is read for itself: what fails says why, and the rows beside it are done."""
    read = chunking.guarded(_layouts(spark, d).withColumnRenamed("page_id", "doc_id"), "doc_id", "raw", chunking.checked_layout)
    made = catalog.outcomes(read)
    return made.select("doc_id", "processing_status", F.col("processed_at").isNotNull().alias("has_processed_at"), "metadata")


@query(_CH + " SELECT collection, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, 384 AS dimension, 'COSINE' AS metric FROM (SELECT ch.*, source AS collection FROM ch JOIN documents USING (doc_id)) GROUP BY ROLLUP (collection)")
def collection_stats(spark, d):
    own = R.read(spark, d, "documents").select("doc_id", F.col("source").alias("collection"))
    return catalog.collection_stats(written(embedding.embed(R.chunks(spark, d), "content"), "vectors").join(own, "doc_id"))


@query(f"WITH {S.TURNS} SELECT conversation_id, substr(arg_min(content, turn) FILTER (role = 'user'), 1, 50) AS title, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_messages FROM turns GROUP BY 1")
def conversation_list(spark, d):
    return catalog.conversation_table(R.turns(spark, d)).orderBy(F.desc("updated_at"), "conversation_id")


@query(f"WITH {_GR}, {S.NEEDED} SELECT query_id, n_hits, n_relevant, web_search_needed FROM need")
def web_search_needed(spark, d):
    return answers.web_search_needed(R.queries(spark, d), _graded(spark, d))


def _positioned(spark, d):
    return search.retrieve(R.queries(spark, d), _corpus(spark, d), 5).withColumnRenamed("rank", "position")


@query(f"WITH {S.retrieved(5)} SELECT query_id, coalesce(string_agg('[Document ' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank), '') AS context FROM q LEFT JOIN top USING (query_id) GROUP BY 1")
def build_context(spark, d):
    return answers.build_context(R.queries(spark, d), _positioned(spark, d))


@query(f"WITH {S.retrieved(5)}, c AS (SELECT q.query_id, q.query, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY rank), '') AS context FROM q LEFT JOIN top USING (query_id) GROUP BY 1, 2) SELECT query_id, 'You asked: ' || query || chr(10) || chr(10) || 'Context length: ' || len(context) AS answer FROM c")
def build_context_plain(spark, d):
    context = answers.build_context(R.queries(spark, d), _positioned(spark, d), most=0, labelled=False)
    return R.queries(spark, d).join(context, "query_id").select("query_id", F.format_string("You asked: %s\n\nContext length: %d", "query", F.length("context")).alias("answer"))


@query(f"WITH {_KT} SELECT query_id, g AS term, df, n, total FROM idf")
def tfidf_document_frequency(spark, d):
    pool = written(search.vector_search(R.queries(spark, d), chunks := _corpus(spark, d), 30, 0.05), "hits")
    return search.vocabulary(pool, search.pool_chunks(pool, chunks))


# Ranking


def _vector_queries(spark, d):
    """Every hundredth vector: the set grows with the table."""
    return R.read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"SELECT * FROM ({_TOP_VECTORS}) WHERE score >= 0.2")
def vector_search_topk(spark, d):
    return search.vector_search_given(_vector_queries(spark, d), R.read(spark, d, "embeddings"), "vec_id", 10, 0.2)


#: Cells of 128 that a query looks into, cells that a vector is in, and rows of a query that are scored on their vectors. See the README for recall.
IVF_PROBES, IVF_COPIES, IVF_RESCORED = 16, 6, 128


@query()
def vector_search_ivf(spark, d):
    """Builds the stored index and searches it; recall against the exact search is in the tests."""
    index = ivf.build_ivf(R.read(spark, d, "embeddings"), "vec_id", copies=IVF_COPIES)
    return ivf.search_ivf(spark, _vector_queries(spark, d), index, 10, IVF_PROBES, IVF_RESCORED)


@query(_TOP_VECTORS)
def vector_search_ivf_all_cells(spark, d):
    """The same search over all cells, rows in two cells each, and no limit to what is scored on its vector: the exact result."""
    index = ivf.build_ivf(R.read(spark, d, "embeddings"), "vec_id")
    return ivf.search_ivf(spark, _vector_queries(spark, d), index, 10, len(index.centres))


@query(f"WITH {_VT(60)} SELECT query_id, chunk_id, score, rank FROM vt WHERE score >= 0.05")
def keyword_candidates(spark, d):
    return _vector_hits(spark, d, 60, 0.05)


@query(f"WITH {_FU} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu")
def fused_sort(spark, d):
    return search.ranked(_fused(spark, d)).select("query_id", "chunk_id", "score", "rank")


_RR = ",\n".join([_FU, S.RERANKED])


def _reranked(spark, d):
    return search.rerank(search.with_chunks(_fused(spark, d), R.chunks(spark, d), R.queries(spark, d)))


@query(f"WITH {_RR} SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(rerank_score, 0), score) DESC, chunk_id) AS rank FROM rr")
def rerank(spark, d):
    hits = _reranked(spark, d).withColumn("by", F.coalesce(F.nullif("rerank_score", F.lit(0.0)), "score"))
    return search.ranked(hits, "by").select("query_id", "chunk_id", "rerank_score", "rank")


@query(f"WITH {_RR} SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM rr) WHERE rank <= 1 + query_id % 5")
def final_topk(spark, d):
    ranked = search.ranked(_reranked(spark, d), "rerank_score")
    return ranked.where(F.col("rank") <= 1 + F.col("query_id") % 5).select("query_id", "chunk_id", "rank")


@query(f"WITH {S.retrieved(5)} SELECT query_id, rank, chunk_id, doc_id, score, rerank_score FROM top")
def hybrid_retrieve(spark, d):
    return search.retrieve(R.queries(spark, d), _corpus(spark, d), 5).select("query_id", "rank", "chunk_id", "doc_id", "score", "rerank_score")


@query(_CH + " SELECT chunk_id, doc_id, chunk_index FROM ch")
def chunk_position(spark, d):
    return R.chunks(spark, d).select("chunk_id", "doc_id", "chunk_index")


# Set operations

_UN = ",\n".join([_GR, S.NEEDED, S.WEB, S.WEB_HITS, S.UNITED])


@query(f"WITH {_UN} SELECT query_id, position, chunk_id, score FROM un")
def web_fallback_union(spark, d):
    return pipelines.united(R.queries(spark, d), _graded(spark, d), _web(spark, d)).select("query_id", "position", "chunk_id", "score")


@query(f"WITH {_GR}, {S.NEEDED} SELECT query_id, CASE WHEN web_search_needed THEN 'web_search' ELSE 'generate' END AS branch FROM need")
def route_after_grade(spark, d):
    needed = answers.web_search_needed(R.queries(spark, d), _graded(spark, d))
    return needed.select("query_id", F.when(F.col("web_search_needed"), "web_search").otherwise("generate").alias("branch"))


@query(f"WITH {_KT} SELECT query_id, chunk_id FROM vt WHERE rank <= 10 AND score >= 0.1 UNION SELECT query_id, chunk_id FROM kt")
def candidate_id_union(spark, d):
    return _vector_hits(spark, d, 10, 0.1).select("query_id", "chunk_id").union(_keyword_hits(spark, d).select("query_id", "chunk_id")).distinct()


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return catalog.first_of_content(R.read(spark, d, "documents"))


# Scalar functions

_CHUNK_SQL = lambda size, overlap: f"WITH {S.PAGES}, {S.chunks(size, overlap)} SELECT chunk_id, doc_id, page_number, chunk_index, content FROM ch"


@query(_CHUNK_SQL(1000, 200))
def chunk_words(spark, d):
    return R.chunks(spark, d)


@query(f"""{_ELEMENT_CHUNKS}, ew AS (SELECT *, {S.words('content')} AS w FROM ec), es AS (SELECT doc_id, page_number, element_no, element_type, confidence, CASE WHEN element_type = 'table' THEN [content] ELSE {S.windows('w', 'content', 40, 10)} END AS parts FROM ew)
SELECT doc_id || '_' || element_no || '_' || chunk_index AS chunk_id, doc_id, page_number, element_type, chunk_index, content, confidence::DOUBLE::VARCHAR AS confidence FROM (SELECT doc_id, page_number, element_no, element_type, confidence, unnest(range(0, len(parts))) AS chunk_index, unnest(parts) AS content FROM es)""")
def chunk_by_type(spark, d):
    made = chunking.element_to_chunk(R.elements(spark, d)).withColumn("element_id", F.concat_ws("_", "doc_id", "element_no"))
    made = made.withColumn("metadata", F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("chunk_index"), F.lit("0")))
    return chunking.chunk_by_type(made, 40, 10).select("chunk_id", "doc_id", "page_number", "element_type", "chunk_index", "content", F.col("metadata")["confidence"].alias("confidence"))


@query(f"SELECT doc_id, len({S.word_set('text')}) AS n_distinct, list_min({S.word_set('text')}) AS first_word FROM documents")
def word_set(spark, d):
    return R.read(spark, d, "documents").select("doc_id", T.let(T.word_set(F.col("text")), lambda s: F.struct(F.size(s).alias("n"), F.array_min(s).alias("m"))).alias("s")).select("doc_id", F.col("s.n").alias("n_distinct"), F.col("s.m").alias("first_word"))


@query(f"WITH {_RR} SELECT query_id, chunk_id, overlap_score, rerank_score FROM rr")
def rerank_score(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "overlap_score", "rerank_score")


@query(f"WITH {_KT} SELECT query_id, chunk_id, score, rank FROM kt")
def keyword_search_tfidf(spark, d):
    return _keyword_hits(spark, d)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_similarity(spark, d):
    rows = R.read(spark, d, "embeddings")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return rows.join(following, "vec_id").select("vec_id", F.round(embedding.cosine(F.col("embedding"), F.col("b")), 6).alias("score"))


@query(f"WITH {_GR} SELECT query_id, chunk_id, is_relevant, confidence, reasoning FROM gr")
def grade_heuristic(spark, d):
    return _graded(spark, d).select("query_id", "chunk_id", "is_relevant", "confidence", "reasoning")


def _asked(spark, d):
    """Assistant turns as answers, with the last user turn before as query and all earlier turns, line by line, as context; '' for what isn't there."""
    earlier = W.partitionBy("conversation_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(earlier)
    t = R.turns(spark, d).withColumn("query", F.coalesce(asked, F.lit(""))).withColumn("earlier", F.collect_list("content").over(earlier))
    return t.where("role = 'assistant'").select((F.col("conversation_id") * 1000 + F.col("turn")).alias("query_id"), "query", F.col("content").alias("answer"), F.array_join("earlier", "\n").alias("context"))


_QC = f"""{S.TURNS}, qc AS (SELECT a.conversation_id * 1000 + a.turn AS query_id, a.content AS answer, coalesce(arg_max(b.content, b.turn) FILTER (b.role = 'user'), '') AS query, coalesce(string_agg(b.content, chr(10) ORDER BY b.turn), '') AS context
FROM turns a LEFT JOIN turns b ON a.conversation_id = b.conversation_id AND b.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conversation_id, a.turn, a.content)"""


@query(f"WITH {_QC}, {S.answers()} SELECT query_id, answer FROM an")
def answer_template(spark, d):
    return _asked(spark, d).select("query_id", answers.answer(F.col("query"), F.col("context")).alias("answer"))


@query(f"WITH {_QC} SELECT query_id, {S.hallucination('answer', 'context')} AS hallucination_score FROM qc")
def hallucination_heuristic(spark, d):
    scored = answers.groundedness_of_turns(R.turns(spark, d))
    return scored.select((F.col("conversation_id") * 1000 + F.col("turn")).alias("query_id"), "hallucination_score")


def _replies(spark, d):
    """Stored replies to grades: by the document's id an object, one without fields, plain words, a list, or null."""
    docs, m = R.read(spark, d, "documents"), F.col("doc_id") % 8
    full = F.to_json(F.struct((F.col("n_chars") > 1000).alias("is_relevant"), F.lit(0.75).alias("confidence"), F.col("lang").alias("reasoning")))
    raw = F.when(m == 0, full).when(m == 1, "{}").when(m == 2, "Relevant").when(m == 3, "Not relevant at all").when(m == 4, "irrelevant").when(m == 5, "[1]").when(m == 6, F.col("source"))
    return docs.select("doc_id", raw.alias("raw"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN n_chars > 1000 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false ELSE true END AS is_relevant,
CASE doc_id % 8 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.6 WHEN 5 THEN 0.5 WHEN 6 THEN 0.4 ELSE 0.5 END AS confidence,
CASE doc_id % 8 WHEN 0 THEN lang WHEN 1 THEN 'No reasoning provided' WHEN 5 THEN 'Grading failed, assuming relevant' WHEN 7 THEN 'Grading failed, assuming relevant' ELSE 'Parsed from text response' END AS reasoning FROM documents""")
def parse_grade_response(spark, d):
    return answers.parse_grades(_replies(spark, d)).drop("raw")


@query("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN least(1.0, n_chars / 1000.0::DOUBLE) WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.1 WHEN 5 THEN 0.1 WHEN 6 THEN 0.8 WHEN 7 THEN 0.3 ELSE 0.5 END::DOUBLE AS score FROM documents""")
def parse_hallucination_response(spark, d):
    m = F.col("doc_id") % 9
    raw = F.when(m == 0, (F.col("n_chars") / 1000.0).cast("string")).when(m == 1, " 1.7 ").when(m == 2, "-3").when(m == 3, "nan").when(m == 4, "Fully supported").when(m == 5, "unsupported").when(m == 6, "a hallucination").when(m == 7, F.col("source"))
    return R.read(spark, d, "documents").select("doc_id", answers.parse_hallucination(raw).alias("score"))


@query(f"""WITH {_QC} SELECT query_id, query_id AS chunk_id, 'Answer from the context alone.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Question: ' || query AS answer_prompt,
'Is the document relevant to the query? Reply in JSON.' || chr(10) || 'Query: ' || query || chr(10) || 'Document: ' || substr(context, 1, 1000) || '...' AS grade_prompt,
'How much of the answer lacks support, 0 to 1?' || chr(10) || 'Context: ' || context || chr(10) || 'Answer: ' || answer AS groundedness_prompt FROM qc""")
def prompt_assembly(spark, d):
    rows = _asked(spark, d).select("query_id", F.col("query_id").alias("chunk_id"), "query", "context", F.col("context").alias("content"), "answer")
    return answers.prompts(rows)


@query(f"WITH {_RR} SELECT query_id, chunk_id, concat_ws(',', 'keyword_score=' || printf('%.6f', keyword_score), 'overlap_score=' || printf('%.6f', overlap_score), 'rerank_score=' || printf('%.6f', rerank_score), 'vector_score=' || printf('%.6f', vector_score)) AS metadata FROM rr")
def metadata_merge(spark, d):
    rows = _reranked(spark, d).withColumn("metadata", search.score_details())
    return rows.select("query_id", "chunk_id", F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query(f"SELECT doc_id, {_SIZE} AS size FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1024 WHEN 2 THEN n_chars * 1048576 ELSE 0 END AS n FROM documents)")
def format_file_size(spark, d):
    m, n = F.col("doc_id") % 4, F.col("n_chars")
    return R.read(spark, d, "documents").select("doc_id", T.format_file_size(F.when(m == 0, n).when(m == 1, n * 1024).when(m == 2, n * 1048576).otherwise(0)).alias("size"))


# Pipelines


@query(f"WITH {S.REGISTRY}, {S.PAGES}, {S.chunks()} SELECT doc_id, filename, file_size, CASE WHEN count(chunk_id) > 0 THEN 'completed' ELSE 'pending' END AS status, count(DISTINCT c.page_number) AS processed_pages, count(DISTINCT c.page_number) AS total_pages, count(chunk_id) AS n_chunks FROM registry LEFT JOIN ch c USING (doc_id) GROUP BY 1, 2, 3")
def ingest_pipeline(spark, d):
    path = scratch(spark, "ingest")
    made = chunking.element_to_chunk(R.page_text(spark, d).withColumn("element_type", F.lit("text_extraction")))
    pipelines.ingest(chunking.chunk_pages(made)).write.parquet(path)
    return catalog.document_status(R.registry(spark, d), spark.read.parquet(path))


@query(f"WITH {_UN},\n{S.CONTEXT}, qc AS (SELECT query_id, query, context FROM q JOIN cx USING (query_id)),\n{S.answers()}, ns AS (SELECT query_id, count(*) AS n_sources FROM un WHERE position <= 3 GROUP BY 1) SELECT query_id, answer, web_search_needed, {S.hallucination('answer', 'context')} AS hallucination_score, coalesce(n_sources, 0) AS n_sources FROM qc JOIN an USING (query_id) JOIN need USING (query_id) LEFT JOIN ns USING (query_id)")
def rag_pipeline(spark, d):
    return pipelines.rag(R.queries(spark, d), _corpus(spark, d), R.web_pages(spark, d))


# Streams


def _stream(spark, d):
    from tessera.streaming import ingest

    folder, name = d.rstrip("/"), "documents.parquet"
    return ingest.document_stream(spark, f"{folder}/{name}*", "*.parquet")


@query(_CHUNK_SQL(1000, 200))
def stream_ingest_chunks(spark, d):
    from tessera.streaming import ingest

    path = scratch(spark, "stream")
    ingest.append_to(ingest.chunked(_stream(spark, d)), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


@query(_CH + " SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY 1")
def stream_document_status(spark, d):
    from tessera.streaming import ingest

    path = scratch(spark, "stream")
    ingest.upsert_to(ingest.chunk_counts(_stream(spark, d)), f"{path}/rows", f"{path}/checkpoint")
    ingest.compact(spark, f"{path}/rows", "doc_id")
    return ingest.latest(spark, f"{path}/rows", "doc_id")


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def stream_content_dedup(spark, d):
    from tessera.streaming import ingest

    path = scratch(spark, "stream")
    ingest.append_to(ingest.new_contents(_stream(spark, d)), f"{path}/rows", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/rows")


# Embedders


@query(f"WITH {S.PAGES}, {S.chunks()}, {S.vectors('ch', 'chunk_id', 'content', 'cv')} SELECT chunk_id, b AS bucket, round(v / norm, 6) AS weight FROM cv JOIN cv_n USING (chunk_id) WHERE v <> 0")
def embed_text(spark, d):
    rows = embedding.embed(R.chunks(spark, d), "content").select("chunk_id", F.posexplode("embedding").alias("bucket", "weight"))
    return rows.where("weight <> 0").select("chunk_id", "bucket", F.round("weight", 6).alias("weight"))


def _toy_model():
    """Loads a model: a function from texts to vectors."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query(f"WITH {S.PAGES}, {S.chunks()} SELECT chunk_id, [len(content)::DOUBLE, (len(content) - len(replace(content, ' ', '')))::DOUBLE, 1.0::DOUBLE] AS embedding FROM ch")
def embedder_plugin(spark, d):
    return embedding.embed(R.chunks(spark, d), "content", loader=_toy_model).select("chunk_id", "embedding")


# Further specified operations


@query(f"WITH {S.WEB} SELECT page_id, title, content FROM web")
def html_page_text(spark, d):
    return R.web_pages(spark, d).select("page_id", "title", "content")


_BM = f"""{S.PAGES}, {S.chunks()}, {S.QUERIES}, bt AS (SELECT chunk_id, {S.tokens('content')} AS t FROM ch), bn AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM bt),
bp AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM bt) GROUP BY 1, 2, 3), bd AS (SELECT term, count(*) AS df FROM bp GROUP BY 1),
bq AS (SELECT query_id, unnest(list_distinct({S.tokens('query')})) AS term FROM q),
bs AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM bq JOIN bp USING (term) JOIN bd USING (term), bn GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 10)"""


@query(f"WITH {_BM} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_search(spark, d):
    return bm25.search_bm25(spark, R.queries(spark, d), bm25.build_bm25(R.chunks(spark, d)), 10)


@query(f"WITH {_GR}, ir AS (SELECT query_id, round(avg(CASE WHEN is_relevant THEN 0.0 ELSE 1.0 END), 6) AS irrelevant_ratio FROM gr GROUP BY 1) SELECT query_id, irrelevant_ratio, CASE WHEN coalesce(irrelevant_ratio, 1) > 0.7 THEN 'web_search' ELSE 'generate' END AS route FROM q LEFT JOIN ir USING (query_id)")
def irrelevant_ratio_route(spark, d):
    return answers.irrelevant_ratio_route(R.queries(spark, d), _graded(spark, d))


@query(f"WITH {S.retrieved(10, recall=100)} SELECT query_id, chunk_id, rerank_score, rank FROM top")
def rerank_cascade(spark, d):
    """Hybrid recall of 100, reranked, cut to 10."""
    return search.retrieve(R.queries(spark, d), _corpus(spark, d), 10, recall=100).select("query_id", "chunk_id", "rerank_score", "rank")


@query(f"WITH {S.retrieved(5, allowed='al')} SELECT query_id, rank, chunk_id, doc_id, rerank_score FROM top".replace("WITH ", f"WITH {_ALLOWED}, ", 1))
def filtered_retrieve(spark, d):
    """hybrid_retrieve with each query's own documents, filtered before every limit."""
    hits = search.retrieve(R.queries(spark, d), _corpus(spark, d), 5, allowed=_allowed(spark, d))
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "rerank_score")


@query("SELECT doc_id, i - 1 AS piece, substr(text, 1 + (i - 1) * 500, 500) AS content FROM (SELECT doc_id, text, unnest(range(1, 2 + (len(text) - 1) // 500)) AS i FROM documents WHERE len(text) > 0)")
def chunk_fixed_chars(spark, d):
    return R.read(spark, d, "documents").select("doc_id", F.posexplode(T.chunk_chars(F.col("text"), 500)).alias("piece", "content"))


@query(f"WITH {S.PAGES}, {S.chunks(400, 0, 'pa')}, cw AS (SELECT chunk_id AS parent_id, doc_id, content, {S.words('content')} AS w FROM pa), cc AS (SELECT doc_id, parent_id, {S.windows('w', 'content', 100, 20)} AS parts FROM cw) SELECT doc_id, parent_id, parent_id || '_' || i AS child_id, child FROM (SELECT doc_id, parent_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS child FROM cc)")
def chunk_parent_child(spark, d):
    return chunking.chunk_parent_child(R.page_text(spark, d))


_CHILDREN = f"{S.PAGES}, {S.chunks(400, 0, 'pa')}, cw AS (SELECT chunk_id AS parent_id, doc_id, content, {S.words('content')} AS w FROM pa), cc AS (SELECT doc_id, parent_id, {S.windows('w', 'content', 100, 20)} AS parts FROM cw), ch AS (SELECT doc_id, parent_id, parent_id || '_' || i AS chunk_id, content FROM (SELECT doc_id, parent_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS content FROM cc))"


@query(f"WITH {_CHILDREN}, {S.QUERIES}, {S.vector_top(20)}, pm AS (SELECT query_id, parent_id, max(score) AS score FROM vt JOIN ch USING (chunk_id) GROUP BY 1, 2), pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM pm) SELECT query_id, parent_id, score, rank, content FROM pr JOIN (SELECT chunk_id AS parent_id, content FROM pa) USING (parent_id) WHERE rank <= 5")
def parent_retrieve(spark, d):
    """The parents of chunk_parent_child(), found by their best child."""
    pages = R.page_text(spark, d)
    return search.parent_search(R.queries(spark, d), chunking.chunk_parent_child(pages), chunking.chunk_pages(pages, 400, 0))


@query("""WITH l AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY 1),
o AS (SELECT source, line FROM l JOIN n USING (source) WHERE line <> '' GROUP BY source, line, n_docs HAVING count(*) >= 2 AND count(*) > 0.02 * n_docs),
x AS (SELECT doc_id, source, i, lines[i] AS line FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents)))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.line IS NULL), '') AS text FROM (SELECT x.*, o.line AS hit FROM x LEFT JOIN o USING (source, line)) y LEFT JOIN o ON false GROUP BY doc_id""".replace("FILTER (o.line IS NULL)", "FILTER (hit IS NULL)").replace(" LEFT JOIN o ON false", ""))
def strip_repeated_lines(spark, d):
    return chunking.strip_repeated_lines(R.read(spark, d, "documents").select("doc_id", "source", "text"), 0.02)


_MASK = "regexp_replace(regexp_replace(regexp_replace({}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), '\\b\\d{{15,18}}\\b', '[ID]', 'g'), '\\+?\\d{{0,3}}[ -]?\\(?\\d{{3}}\\)?[ -]\\d{{3}}-?\\d{{4}}', '[PHONE]', 'g')"


@query(f"SELECT doc_id, {_MASK.format('text')} AS text, len(regexp_extract_all({_MASK.format('text')}, '\\[(EMAIL|ID|PHONE)\\]')) AS n_masked FROM documents")
def pii_mask(spark, d):
    masked = R.read(spark, d, "documents").select("doc_id", T.mask_pii(F.col("text")).alias("text"))
    return masked.select("doc_id", "text", F.size(F.regexp_extract_all("text", F.lit(r"\[(EMAIL|ID|PHONE)\]"), F.lit(0))).alias("n_masked"))


@query(f"WITH {S.TURNS} SELECT role, sum(len({S.words('content')}))::BIGINT AS n_words, count(*) AS n_messages FROM turns GROUP BY ROLLUP (role)")
def token_usage(spark, d):
    return catalog.token_usage(R.turns(spark, d))


@query(f"WITH {S.TURNS} SELECT conversation_id, role, sum(len({S.words('content')}))::BIGINT AS n_words, count(*) AS n_messages FROM turns GROUP BY ROLLUP (conversation_id, role)")
def token_usage_by_conversation(spark, d):
    return catalog.token_usage(R.turns(spark, d), "conversation_id", "role")


@query(f"WITH {S.TURNS} SELECT term, count(*) AS n FROM (SELECT unnest({S.tokens('content')}) AS term FROM turns WHERE role = 'user') GROUP BY 1 ORDER BY n DESC, term LIMIT 20")
def hot_terms(spark, d):
    return catalog.hot_terms(R.turns(spark, d))


@query(f"WITH {_VT(12)}, again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vt WHERE NOT (query_id % 2 = 0 AND rank <= 2)) SELECT query_id, chunk_id, score, r AS rank FROM again WHERE r <= 10")
def negative_pool(spark, d):
    """The first two hits of every second query are voted down; then the queries are asked again and have ten hits without these."""
    queries, chunks = R.queries(spark, d), _corpus(spark, d)
    votes = search.vector_search(queries, chunks, 2).where("query_id % 2 = 0").join(queries, "query_id").select(answers.term_key(F.col("query")).alias("term_key"), "chunk_id", F.lit(-1).alias("vote"))
    denied = written(answers.denied_by_feedback(queries, votes), "denied")
    return search.vector_search(queries, chunks, 10, denied=denied).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_VT(10)}, truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT q.query_id, coalesce(max(CASE WHEN t.doc_id IS NOT NULL THEN 1 ELSE 0 END), 0) AS hit FROM q LEFT JOIN vt USING (query_id) LEFT JOIN ch USING (chunk_id) LEFT JOIN (SELECT query_id, min(doc_id) AS doc_id FROM truth GROUP BY 1) t ON t.query_id = q.query_id AND t.doc_id = ch.doc_id GROUP BY 1) SELECT round(avg(hit), 6) AS hit_rate, count(*) AS n_queries FROM h")
def hit_rate_at_k(spark, d):
    truth = _quoted(spark, d).select("query_id", "doc_id", F.lit(1).alias("hit"))
    hits = _vector_hits(spark, d).join(R.chunks(spark, d).select("chunk_id", "doc_id"), "chunk_id").join(truth, ["query_id", "doc_id"]).groupBy("query_id").agg(F.max("hit").alias("hit"))
    return R.queries(spark, d).join(hits, "query_id", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"), F.count("*").alias("n_queries"))


@query(f"WITH {_QC} SELECT round(avg(CASE WHEN {S.hallucination('answer', 'context')} > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS hallucination_rate, count(*) AS n_answers FROM qc")
def hallucination_rate(spark, d):
    scored = answers.groundedness_of_turns(R.turns(spark, d))
    return scored.agg(F.round(F.avg((F.col("hallucination_score") > 0.5).cast("double")), 6).alias("hallucination_rate"), F.count("*").alias("n_answers"))


@query(f"WITH {S.TURNS} SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS r FROM turns) WHERE r <= 4 GROUP BY 1")
def history_window(spark, d):
    return catalog.history(R.turns(spark, d))


_RIGHTS = "gr AS (SELECT DISTINCT u.user_id, source AS dataset FROM documents, (SELECT unnest([0, 1, 2, 3]) AS user_id) u WHERE (len(source) + u.user_id) % 2 = 0 AND u.user_id < 3), al AS (SELECT item_id AS query_id, documents.doc_id FROM benchmark LEFT JOIN gr ON gr.user_id = item_id % 4 LEFT JOIN documents ON source = dataset)"


@query(f"WITH {_VT(10, 'al')} SELECT query_id, chunk_id, score, rank FROM vt".replace("WITH ", f"WITH {_RIGHTS}, "))
def access_filter(spark, d):
    """Each query is some user's; users may read the datasets that they have a grant for, user 3 none. Rights hold before the limit."""
    docs = R.read(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"))
    users = F.explode(F.array(*map(F.lit, range(4)))).alias("user_id")
    may = ((F.length("dataset") + F.col("user_id")) % 2 == 0) & (F.col("user_id") < 3)
    grants = docs.select("dataset").distinct().select("dataset", users).select("user_id", "dataset", F.when(may, "reader").otherwise("none").alias("role"))
    queries = R.queries(spark, d).withColumn("user_id", (F.col("query_id") % 4).cast("int"))
    return search.vector_search(queries, R.chunks(spark, d).join(docs, "doc_id"), 10, allowed=catalog.granted(queries, grants)).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {S.ELEMENTS} SELECT doc_id, page_number, string_agg(content, chr(10) ORDER BY element_no % 3, element_no, content) AS content FROM el GROUP BY 1, 2")
def page_reassembly(spark, d):
    regions = R.elements(spark, d).select("doc_id", "page_number", (F.col("element_no") % 3).alias("y1"), F.col("element_no").alias("x1"), "content")
    return chunking.page_reassembly(regions)
