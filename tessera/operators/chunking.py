"""Pages, layout elements and chunks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Element type, confidence, method of the chunks made from it.
ELEMENT_KINDS = (("table", 0.95, "vision"), ("text", 0.90, "vision"), ("figure", 0.85, "vision"), ("full_page", 0.70, "vision_fallback"), ("text_extraction", 0.60, "text_extraction"))


def scan_page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) to stripped text rows; blank pages are dropped."""
    return pages.withColumn("content", T.strip(F.coalesce("text", F.lit("")))).where("content <> ''").select("doc_id", "page_number", "content", F.lit("text_extraction").alias("method"), F.lit(0.6).alias("confidence"))


def chunk_pages(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """chunks of (doc_id, page_number, element_no, content): chunk_id is doc, page, element and place joined by _."""
    rows = pages.select("doc_id", "page_number", "element_no", F.posexplode(T.chunk_words(F.col("content"), size, overlap)).alias("chunk_index", "content"))
    return rows.select(F.concat_ws("_", "doc_id", "page_number", "element_no", "chunk_index").alias("chunk_id"), "doc_id", "page_number", "chunk_index", "content")


def chunk_by_type(elements: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Tables stay whole, other elements go through word windows; metadata gets chunk_index, an own one of the element is replaced."""
    parts = F.when(F.col("element_type") == "table", F.array("content")).otherwise(T.chunk_words(F.col("content"), size, overlap))
    rows = elements.select("*", F.posexplode(parts).alias("chunk_index", "part"))
    metadata = F.map_concat(F.map_filter("metadata", lambda k, _: k != "chunk_index"), F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    return rows.select(F.concat_ws("_", "element_id", "chunk_index").alias("chunk_id"), "doc_id", "page_number", "element_type", "chunk_index", F.col("part").alias("content"), metadata.alias("metadata"))


def layout_elements(responses: DataFrame) -> DataFrame:
    """(page_id, raw JSON) to one row per element. No `elements`: no rows. Not JSON: one text element for the whole page."""
    kind = "struct<elements: array<struct<type: string, bbox: array<int>, description: string>>>"
    whole = F.array(F.struct(F.lit("text").alias("type"), F.array(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("bbox"), F.lit("Full page text").alias("description")))
    is_json = F.try_parse_json("raw").isNotNull()
    elements = F.when(is_json, F.coalesce(F.from_json("raw", kind)["elements"], F.array().cast("array<struct<type: string, bbox: array<int>, description: string>>"))).otherwise(whole)
    return responses.select("page_id", F.posexplode(elements).alias("element_no", "e")).select("page_id", "element_no", F.col("e.type").alias("type"), F.col("e.bbox").alias("bbox"), F.col("e.description").alias("description"))


def dispatched(elements: DataFrame, type_col: str = "type") -> DataFrame:
    """Only tables, texts and figures go on."""
    return elements.where(F.col(type_col).isin("table", "text", "figure"))


def element_to_chunk(elements: DataFrame) -> DataFrame:
    """Elements to chunks with their kind's confidence and method. Blank elements are dropped, but for tables; figures get a prefix and has_image."""
    kind = F.col("element_type")
    pick = lambda i: F.coalesce(*[F.when(kind == k[0], F.lit(k[i])) for k in ELEMENT_KINDS])
    content = T.strip(F.coalesce("content", F.lit("")))
    body = F.when(kind == "figure", F.concat(F.lit("Figure Description: "), content)).otherwise(content)
    label = F.when(kind == "full_page", F.concat(F.lit("page_"), F.col("page_number").cast("string"))).otherwise(F.concat(kind, F.lit("_page_"), F.col("page_number").cast("string")))
    known = elements.where(kind.isin(*[k[0] for k in ELEMENT_KINDS]) & ((kind == "table") | (content != "")))
    return known.select("doc_id", "page_number", "element_no", kind.alias("element_type"), body.alias("content"), label.alias("label"), pick(1).alias("confidence"), pick(2).alias("method"), (kind == "figure").alias("has_image"))


def extraction_fallback(attempts: DataFrame) -> DataFrame:
    """Attempts (doc_id, page_number, method, status, content) to the rows that stand.

    A document whose vision worked anywhere keeps vision rows, and the whole-page row for pages where no element worked; others keep their
    text-extraction rows. Two windows on the document's own rows, no join."""
    ok = F.col("status") == "ok"
    by_doc, by_page = W.partitionBy("doc_id"), W.partitionBy("doc_id", "page_number")
    flags = attempts.withColumn("doc_vision", F.max(F.col("method").isin("vision", "vision_fallback") & ok).over(by_doc)).withColumn("page_vision", F.max((F.col("method") == "vision") & ok).over(by_page))
    stands = F.when(F.col("doc_vision"), F.when(F.col("page_vision"), F.col("method") == "vision").otherwise(F.col("method") == "vision_fallback")).otherwise(F.col("method") == "text_extraction")
    return flags.where(ok & stands).drop("doc_vision", "page_vision")


def page_reassembly(regions: DataFrame) -> DataFrame:
    """Regions (doc_id, page_number, y1, x1, content) to one text per page, from top to bottom, then left to right."""
    parts = F.array_sort(F.collect_list(F.struct("y1", "x1", "content")))
    return regions.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def strip_repeated_lines(docs: DataFrame, share: float = 0.05, least: int = 2) -> DataFrame:
    """(doc_id, source, text) without the lines that stand in more than `share` of a source's documents (and in `least` at least).

    A line's count is pre-aggregated before its shuffle; only the lines' hashes meet, and each document gets its dropped lines as a set."""
    lines = docs.select("doc_id", "source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("line <> ''").select("doc_id", "source", F.xxhash64("line").alias("h"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    often = lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(sizes, "source").where(F.col("n") > share * F.col("n_docs")).select("source", "h")
    gone = lines.join(often, ["source", "h"]).groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.col("gone").isNull() | ~F.array_contains("gone", F.xxhash64(x)))
    return docs.select("doc_id", "source", "text").join(gone, "doc_id", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))


def chunk_parent_child(pages: DataFrame, parent: tuple[int, int] = (400, 0), child: tuple[int, int] = (100, 20)) -> DataFrame:
    """(parent_id, child_id, child): parents by large word windows, children by small windows of each parent."""
    parents = chunk_pages(pages, *parent).select(F.col("chunk_id").alias("parent_id"), "doc_id", "content")
    return parents.select("parent_id", "doc_id", F.posexplode(T.chunk_words(F.col("content"), *child)).alias("i", "child")).select("doc_id", "parent_id", F.concat_ws("_", "parent_id", "i").alias("child_id"), "child")


def guarded(rows: DataFrame, key: str, column: str, function, to: str = "result") -> DataFrame:
    """(key, result, error): function of each value of a string column, a string each. A row on which it fails has no result and the error's text; the
    other rows of its batch go on, and the job doesn't fail."""

    def run(batches):
        for batch in batches:
            results, errors = [], []
            for value in batch[column].to_pylist():
                try:
                    results.append(function(value))
                    errors.append(None)
                except Exception as e:  # whatever the function raises is the row's outcome
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(results, pa.string()), pa.array(errors, pa.string())], [key, to, "error"])

    return rows.select(key, column).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {to} string, error string")


def checked_layout(raw: str | None) -> str:
    """A layout reply as it is, if its elements can be read: an object whose elements are objects with four whole numbers as bbox."""
    reply = json.loads(raw) if raw is not None else None
    if not isinstance(reply, dict):
        raise ValueError("no reply" if reply is None else "the reply is no object")
    for i, element in enumerate(reply.get("elements", [])):
        box = element["bbox"]
        if len(box) != 4 or not all(isinstance(x, int) for x in box):
            raise ValueError(f"element {i} has no bbox of four whole numbers")
    return raw
