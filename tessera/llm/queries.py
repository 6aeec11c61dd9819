"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, line_dedup, merkle, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, secret_scan, sentencepiece_lattice, token_counts, url_filter, warc
from tessera.llm.common import new_path, table, written

#: The rules of op8: action, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=2).drop("version")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = quality_classifier.fit(docs, labels.where(~quality_classifier.held_out(F.col("doc_id")))).score(docs)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality_classifier.KEEP_FROM, 1).otherwise(0).alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload"))), path)
    columns = ["record_id", "record_type", "concurrent_to", "refers_to", "header_digest", F.when(F.col("record_type") == "metadata", F.col("block")).alias("block"), "payload_bytes", "payload_digest"]
    captures = warc.assemble(written(warc.read_warc(spark, path, with_payload=False).select(*columns), "records"))  # the archives are parsed once
    field = lambda name: F.regexp_extract("metadata.block", rf"(?m)^{name}: (-?\d+)", 1)
    is_revisit = F.col("response.record_type") == "revisit"
    return captures.select(
        F.expr("try_cast(nullif(" + "regexp_extract(metadata.block, '(?m)^page-id: (-?\\\\d+)', 1)" + ", '') AS bigint)").alias("page_id"),
        F.when(is_revisit, field("payload-length").cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(is_revisit, F.substring_index("response.header_digest", ":", -1)).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.expr("try_cast(nullif(" + "regexp_extract(metadata.block, '(?m)^refers-to-page: (-?\\\\d+)', 1)" + ", '') AS bigint)").alias("refers_to"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(p[0]) for p in secret_scan.PATTERNS], F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), secret_scan.spans_text(F.col("spans")).alias("spans"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, digests = [], [], []
        for text, bitmap in zip(batch["text"].to_pylist(), batch["keep_bitmap"].to_pylist(), strict=True):
            lines = (text or "").split("\n")
            kept = line_dedup.kept_lines(lines, bitmap)
            counts.append(len(lines))
            gone.append(len(lines) - len(kept))
            digests.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "text", "keep_bitmap").mapInArrow(_line_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return sentencepiece_lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, sentencepiece_lattice.digest_batches(path), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.quantized(F.col("embedding")).alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


_ALL = (
    op1_document_fingerprints, op2_quality_rules, op3_minhash_near_dedup, op4_quality_classifier, op5_warc, op6_best_fit_packing, op7_secret_scans, op8_url_filters, op9_line_dedup, op10_sentencepiece,
    op11_token_counts, op12_hard_negatives, op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}
