"""Grading, routing, context, answers and groundedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

# The texts of extractive answers and of grades.
ANSWER_START = "Based on the provided context: "
ANSWER_MORE = " These sentences seem most relevant to your question."
ANSWER_NONE = "I couldn't find relevant information in the provided context to answer your question."
GRADE_OVERLAP = "Query-document word overlap: %d/%d (%s%%)"
GRADE_NO_REASON = "No reasoning provided"
GRADE_FROM_TEXT = "Parsed from text response"
GRADE_FAILED = "Grading failed, assuming relevant"


def grade(hits: DataFrame, over: float = 0.3) -> DataFrame:
    """hits with query and content get is_relevant, confidence and reasoning, by the share of the query's words that the content has."""

    def graded(q: Column, c: Column) -> Column:
        common, share = F.size(F.array_intersect(q, c)), T.overlap_share(q, c)
        reasoning = F.format_string(GRADE_OVERLAP, common, F.size(q), T.printed(100 * share, 2))
        return F.struct((share > over).alias("is_relevant"), F.least(share * 2, F.lit(1.0)).alias("confidence"), reasoning.alias("reasoning"))

    g = T.let(T.word_set(F.col("query")), lambda q: T.let(T.word_set(F.col("content")), lambda c: graded(q, c)))
    return hits.withColumn("g", g).select("*", "g.is_relevant", T.rounded(F.col("g.confidence"), 6).alias("confidence"), "g.reasoning").drop("g")


def web_search_needed(queries: DataFrame, graded: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, n_hits, n_relevant, web_search_needed) of every query, those without hits too."""
    counts = graded.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.sum(F.col("is_relevant").cast("long")).alias("n_relevant"))
    out = queries.select("query_id").join(counts, "query_id", "left").na.fill(0, ["n_hits", "n_relevant"])
    return out.withColumn("web_search_needed", F.col("n_relevant") < least)


def irrelevant_ratio_route(queries: DataFrame, graded: DataFrame, over: float = 0.7) -> DataFrame:
    """(query_id, irrelevant_ratio, route): to the web if more than `over` of the hits are irrelevant, or there are none."""
    share = graded.groupBy("query_id").agg(F.round(F.avg((~F.col("is_relevant")).cast("double")), 6).alias("irrelevant_ratio"))
    return queries.select("query_id").join(share, "query_id", "left").withColumn("route", F.when(F.coalesce("irrelevant_ratio", F.lit(1.0)) > over, "web_search").otherwise("generate"))


def web_chunks(hits: DataFrame, source: str = "tavily") -> DataFrame:
    """Search hits (query_id, title, url, content, score, rank) as chunks."""
    meta = F.create_map(F.lit("source"), F.lit(source), F.lit("url"), F.col("url"), F.lit("title"), F.col("title"))
    return hits.select("query_id", F.concat(F.lit("web_"), F.col("url")).alias("chunk_id"), F.lit("web_search").alias("doc_id"), F.lit(0).alias("page_number"), F.lit(0).alias("chunk_index"), "content", "score", "rank", meta.alias("metadata"))


def with_web_fallback(relevant: DataFrame, web: DataFrame, needed: DataFrame) -> DataFrame:
    """Relevant chunks, then the web chunks of the queries that need them: (query_id, chunk_id, content, score, position). No new sort, no dedup."""
    flagged = web.join(needed.where("web_search_needed").select("query_id"), "query_id", "left_semi")
    both = relevant.select("query_id", "chunk_id", "content", "score", F.lit(0).alias("origin"), "rank").unionByName(flagged.select("query_id", "chunk_id", "content", "score", F.lit(1).alias("origin"), "rank"))
    from pyspark.sql import Window as W

    return both.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("origin", "rank", "chunk_id"))).drop("origin", "rank")


def build_context(queries: DataFrame, chunks: DataFrame, most: int = 5, labelled: bool = True) -> DataFrame:
    """(query_id, context): the first `most` chunks by position, numbered, with a blank line between; '' for queries without chunks."""
    text = F.format_string("[Document %d] %s", F.col("position"), F.col("content")) if labelled else F.col("content")
    kept = chunks.where(F.col("position") <= most) if most else chunks
    parts = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", text.alias("t")))).alias("parts"))
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n"), F.lit("")).alias("context"))


def answer(query: Column, context: Column) -> Column:
    """The three sentences of the context that contain most of the query's words, as text; words that repeat count again."""

    def scored(words: Column) -> Column:
        hits = lambda s: F.size(F.filter(words, lambda w: F.contains(F.lower(s), w)))
        found = F.transform(F.split(context, "[.]"), lambda s, i: F.struct((-hits(s)).alias("score"), i.alias("i"), T.strip(s).alias("s")))
        return F.slice(F.array_sort(F.filter(found, lambda x: x["score"] < 0)), 1, 3)

    def told(best: Column) -> Column:
        body = F.concat(F.lit(ANSWER_START), F.array_join(F.transform(best, lambda x: x["s"]), " "))
        return F.when(F.size(best) == 0, ANSWER_NONE).when(F.size(best) > 1, F.concat(body, F.lit(ANSWER_MORE))).otherwise(body)

    return T.let(T.let(T.words(F.lower(query)), scored), told)


def hallucination(answered: Column, context: Column) -> Column:
    """1 less the share of the answer's words that the context has; 0 without words."""
    score = lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - T.overlap_share(a, T.word_set(context))))
    return F.round(T.let(T.word_set(answered), score), 6)


def groundedness_of_turns(turns: DataFrame) -> DataFrame:
    """(conversation_id, turn, hallucination_score) of each assistant turn, against all earlier turns of its conversation.

    A word is supported if the conversation's first turn that has it is earlier. So each turn's words move once, and no turn carries the texts before it:
    a conversation's work grows with its length, not with the square. Turns without a conversation or a number have nothing before them."""
    named = turns.select("conversation_id", "turn", "role", F.xxhash64("content").alias("h"), T.word_set(F.col("content")).alias("words"))
    words = named.select("conversation_id", "turn", "role", "h", F.explode("words").alias("word"))
    first = words.groupBy("conversation_id", "word").agg(F.min("turn").alias("first"))
    said = words.where("role = 'assistant'").drop("role").distinct().join(first, ["conversation_id", "word"])
    supported = said.groupBy("conversation_id", "turn", "h").agg(F.count(F.when(F.col("first") < F.col("turn"), 1)).alias("common"))
    rows = named.where("role = 'assistant'").join(supported, ["conversation_id", "turn", "h"], "left")
    share = F.coalesce("common", F.lit(0)) / F.size("words")
    return rows.select("conversation_id", "turn", F.round(F.when(F.size("words") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - share)), 6).alias("hallucination_score"))


def sources(chunks: DataFrame, most: int | None = 3, chars: int = 200) -> DataFrame:
    """(query_id, position, chunk_id, content, score, document_name, page_number): the first chunks, content shortened; most=None: all, whole and without name."""
    if most is None:
        return chunks.select("query_id", "position", "chunk_id", "content", "score", F.lit(None).cast("string").alias("document_name"), "page_number")
    name = F.coalesce("filename", F.lit("Unknown"))
    return chunks.where(F.col("position") <= most).select("query_id", "position", "chunk_id", T.shortened(F.col("content"), chars).alias("content"), "score", name.alias("document_name"), "page_number")


def parse_grades(replies: DataFrame) -> DataFrame:
    """raw model replies to is_relevant, confidence, reasoning: JSON objects with defaults, other text by its words, anything else counts as relevant."""
    parsed = F.try_parse_json("raw")
    is_object = F.from_json("raw", "struct<is_relevant: boolean, confidence: double, reasoning: string>")
    kind = F.schema_of_variant(parsed)
    low = F.lower("raw")
    by_text = F.contains(low, F.lit("relevant")) & ~F.contains(low, F.lit("not relevant"))
    state = F.when(F.col("raw").isNull(), "failed").when(parsed.isNull(), "text").when(kind.startswith("OBJECT"), "object").otherwise("failed")
    out = replies.withColumn("__s", state).withColumn("__o", is_object)
    pick = lambda o, t, f: F.when(F.col("__s") == "object", o).when(F.col("__s") == "text", t).otherwise(f)
    return out.select(
        *replies.columns,
        pick(F.coalesce("__o.is_relevant", F.lit(False)), by_text, F.lit(True)).alias("is_relevant"),
        pick(F.coalesce("__o.confidence", F.lit(0.5)), F.when(by_text, 0.6).otherwise(0.4), F.lit(0.5)).alias("confidence"),
        pick(F.coalesce("__o.reasoning", F.lit(GRADE_NO_REASON)), F.lit(GRADE_FROM_TEXT), F.lit(GRADE_FAILED)).alias("reasoning"),
    )


def parse_hallucination(raw: Column) -> Column:
    """A number, kept in 0 to 1 (NaN counts as 1); else by words; 0.5 for null."""
    low, bare = F.lower(raw), T.strip(raw)
    number = F.when(bare.rlike(r"^(?i)[+-]?(nan|inf(inity)?|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"), bare.try_cast("double"))
    by_text = F.when(F.contains(low, F.lit("no hallucination")) | F.contains(low, F.lit("supported")), 0.1).when(F.contains(low, F.lit("some hallucination")) | F.contains(low, F.lit("partial")), 0.5).when(F.contains(low, F.lit("hallucination")), 0.8).otherwise(0.3)
    clamped = F.when(F.isnan(number), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return F.when(raw.isNull(), 0.5).when(number.isNotNull(), clamped).otherwise(by_text)


def prompts(hits: DataFrame) -> DataFrame:
    """hits with query, content, context and answer get prompt texts for a model that runs in batch; a graded document is cut to 1,000 characters."""
    return hits.select(
        "query_id", "chunk_id",
        F.concat(F.lit("Answer from the context alone.\nContext:\n"), F.col("context"), F.lit("\nQuestion: "), F.col("query")).alias("answer_prompt"),
        F.concat(F.lit("Is the document relevant to the query? Reply in JSON.\nQuery: "), F.col("query"), F.lit("\nDocument: "), F.substring("content", 1, 1000), F.lit("...")).alias("grade_prompt"),
        F.concat(F.lit("How much of the answer lacks support, 0 to 1?\nContext: "), F.col("context"), F.lit("\nAnswer: "), F.col("answer")).alias("groundedness_prompt"),
    )


def tavily_hits(responses: DataFrame) -> DataFrame:
    """(query_id, raw) to (query_id, rank, title, url, content, score); content is raw_content, else content, else ''."""
    kind = "struct<results: array<struct<title: string, url: string, raw_content: string, content: string, score: double>>>"
    rows = responses.select("query_id", F.posexplode(F.from_json("raw", kind)["results"]).alias("rank", "r"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.url", F.lit("")).alias("url"), F.coalesce("r.raw_content", "r.content", F.lit("")).alias("content"), F.coalesce("r.score", F.lit(0.5)).alias("score"))


def serper_hits(responses: DataFrame) -> DataFrame:
    kind = "struct<organic: array<struct<title: string, link: string, snippet: string>>>"
    rows = responses.select("query_id", F.posexplode(F.from_json("raw", kind)["organic"]).alias("rank", "r"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.link", F.lit("")).alias("url"), F.coalesce("r.snippet", F.lit("")).alias("content"), F.lit(0.5).alias("score"))


def web_corpus_search(queries: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, rank, title, url, content, score) from a page table (page_id, url, title, content): the pages with the largest share of the query's
    distinct tokens, ties by url, then page_id. Pages that share a url are pages of their own.

    The join is on tokens; a page's text is joined to the few rows that are left."""
    q = queries.select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("t"))
    terms = q.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    words = pages.select("page_id", "url", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    scored = terms.join(words, "term").groupBy("query_id", "page_id", "url", "n").agg(F.count("*").alias("c")).select("query_id", "page_id", "url", F.round(F.col("c") / F.col("n"), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "url", "page_id"))).where(F.col("rank") <= most)
    return ranked.drop("url").join(pages.select("page_id", "title", "url", "content"), "page_id").select("query_id", "rank", "title", "url", "content", "score")


def term_key(query: Column) -> Column:
    """A hash of the query's set of tokens: questions of the same words in any order have one key."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(T.tokens(query))), " "), 256)


def denied_by_feedback(queries: DataFrame, votes: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks that were voted down for a query's words: votes has (term_key, chunk_id, vote), a vote under 0 is a no.

    The sum of a pair's votes counts, so a chunk comes back when as many find it good."""
    against = votes.groupBy("term_key", "chunk_id").agg(F.sum("vote").alias("vote")).where("vote < 0")
    return queries.select("query_id", term_key(F.col("query")).alias("term_key")).join(against, "term_key").select("query_id", "chunk_id")


def _run(words: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(words, at, size), " "))


def _runs(text_col: str, size: int) -> Column:
    """Hashes of all runs of so many words."""
    return T.let(F.split(text_col, "[ \n]"), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: _run(w, i, F.lit(size)))))


def quotes(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of each document (doc_id, text) that holds a query's text, wherever it starts or ends.

    All words of a query but its first and last stand whole in such a document. Up to six of them in a row, hashed, are met by those of the documents and
    the text is looked for where they meet. Queries of one or two words have no such run: they are looked for in all documents, as a set that is stated."""
    inner = F.expr("slice(w, 2, greatest(size(w) - 2, 0))")
    q = queries.select("query_id", "query", F.split("query", "[ \n]").alias("w")).where("query <> ''").withColumn("w", inner)
    sizes = F.when(F.size("w") >= 6, 6).when(F.size("w") >= 3, 3).when(F.size("w") >= 1, 1).otherwise(0)
    q = q.withColumn("size", sizes).withColumn("h", F.when(F.col("size") > 0, _run(F.col("w"), F.lit(1), F.col("size")))).drop("w")
    wanted = sorted(r[0] for r in q.select("size").distinct().collect() if r[0])  # 1, 3, 6
    out = q.where("size = 0").join(docs.select("doc_id", "text"), F.contains("text", "query")).select("query_id", "doc_id")
    for size in wanted:
        some = q.where(F.col("size") == size).select("query_id", "query", "h")
        at = docs.select("doc_id", F.explode(F.array_distinct(_runs("text", size))).alias("h")).join(some, "h").select("doc_id", "query_id", "query")
        out = out.unionByName(at.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "query")).select("query_id", "doc_id"))
    return out.distinct()
