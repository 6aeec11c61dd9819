"""Merkle fingerprints of documents: sections over paragraphs over runs of words; equal roots mean equal texts, differing branches locate edits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.llm.common import shuffle_partitions

#: A leaf is at most so many words (with the white space after them), and ends after a sentence's end once it has LEAF_MIN.
LEAF_WORDS, LEAF_MIN = 12, 3
#: Paragraphs to a section: it closes at an empty line, or after a paragraph whose digest begins with a 0 of 8, or at SECTION_MAX.
SECTION_MAX = 32
_WORD = re.compile(r"\s*\S+|\s+$")


def _digest(data: bytes, size: int = 8) -> str:
    return blake2b(data, digest_size=size).hexdigest()


def _leaves(paragraph: str) -> list[str]:
    """Pieces of the paragraph that join to it again; a cut depends on what is before it in the paragraph alone, so an edit leaves earlier leaves as they were."""
    words = _WORD.findall(paragraph)
    out, held = [], []
    for w in words:
        held.append(w)
        if len(held) >= LEAF_WORDS or (len(held) >= LEAF_MIN and w[-1] in ".!?"):
            out.append("".join(held))
            held = []
    if held:
        out.append("".join(held))
    return out or [paragraph]


def tree(text: str | None) -> list[list[list[tuple[str, int]]]]:
    """Sections, each a list of paragraphs (lines), each a list of leaves (digest, code points). Null and empty texts have one empty leaf."""
    sections, open_section = [], []
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        whole = line + "\n" * (i < len(lines) - 1)
        open_section.append([(_digest(x.encode("utf-8", "surrogatepass")), len(x)) for x in _leaves(whole)])
        if not line.strip() or len(open_section) >= SECTION_MAX or _branch(open_section[-1])[0] in "01":
            sections.append(open_section)
            open_section = []
    if open_section:
        sections.append(open_section)
    return sections


def _branch(leaves: list[tuple[str, int]]) -> str:
    return _digest("".join(h for h, _ in leaves).encode())


def encode(sections: list[list[list[tuple[str, int]]]]) -> str:
    """root/section;section... with section = digest(paragraph,paragraph...) and paragraph = leaf-length joined by +."""
    parts, roots = [], []
    for section in sections:
        branch = _digest("".join(_branch(p) for p in section).encode())
        roots.append(branch)
        parts.append(f"{branch}({','.join('+'.join(f'{h}-{n:x}' for h, n in p) for p in section)})")
    return f"{_digest(''.join(roots).encode(), 16)}/{';'.join(parts)}"


def _sections(fingerprint: str) -> list[tuple[str, str]]:
    return [(x[:16], x[17:-1]) for x in fingerprint.partition("/")[2].split(";")]


def _weights(paragraphs: str) -> list[tuple[str, int]]:
    return [(x[:16], int(x[17:], 16)) for p in paragraphs.split(",") for x in p.split("+")]


def likeness(a: str, b: str) -> float:
    """Share of code points in common leaves: 2 * common / (both). 1 if the roots are equal; sections with equal digests aren't opened."""
    if a[:32] == b[:32]:
        return 1.0
    left, right = _sections(a), _sections(b)
    same = Counter(s for s, _ in left) & Counter(s for s, _ in right)
    common, total, rest = 0, 0, []
    for side in (left, right):
        open_leaves, skip = Counter(), same.copy()
        for digest, body in side:
            leaves = _weights(body)
            total += (n := sum(w for _, w in leaves))
            if skip[digest] > 0:
                skip[digest] -= 1
                common += n
            else:
                open_leaves.update(leaves)
        rest.append(open_leaves)
    common += 2 * sum(n * k for (_, n), k in (rest[0] & rest[1]).items())
    return common / total if total else 1.0


def differing_spans(a: str, b: str) -> list[tuple[int, int]]:
    """Code-point spans [start, end) of the first text whose leaves the second lacks, neighbours joined: where the edits are."""
    theirs = Counter(x for _, body in _sections(b) for x in _weights(body))
    spans, at = [], 0
    for _, body in _sections(a):
        for leaf in _weights(body):
            if theirs[leaf] > 0:
                theirs[leaf] -= 1
            elif leaf[1]:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + leaf[1])
                else:
                    spans.append((at, at + leaf[1]))
            at += leaf[1]
    return spans


def fingerprint_documents(docs: DataFrame, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; null counts as empty. A column of docs that bears the name `to` is replaced; an empty table gives an
    empty table; a text's tree is built in one task, whatever its length."""
    make = F.pandas_udf(lambda s: s.map(lambda t: encode(tree(t))), "string")
    return docs.withColumn(to, make(text_col))


def with_next(docs: DataFrame, prepare: Callable, pair: Callable, schema: str) -> DataFrame:
    """pair((doc_id, prepare(text)), the same of the next row) for all rows in ascending doc_id; after the last comes the first.

    doc_id is cut into ranges at its percentiles. Every range also gets the first row of the next one, so that no row needs a global
    order; what reaches the driver is one number per range. Null ids come first, and rows with equal ids are in order of their text."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype="i8"))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        values = ids.fillna(np.iinfo("i8").min).astype("i8") if ids.isna().any() else ids
        return pd.Series(np.searchsorted(bounds, values.to_numpy("i8"), side="right").astype("i4"))

    starts = rows.select("doc_id", place("doc_id").alias("at")).groupBy("at").agg(F.min(F.coalesce("doc_id", F.lit(int(np.iinfo("i8").min)))).alias("low")).orderBy("at").collect()
    lows, order = {r["at"]: r["low"] for r in starts}, [r["at"] for r in starts]
    before = {at: order[i - 1] for i, at in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        values = (ids.fillna(np.iinfo("i8").min).astype("i8") if ids.isna().any() else ids).to_numpy("i8")
        own = np.searchsorted(bounds, values, side="right")
        return pd.Series([[a, before[a] + (len(bounds) + 1 if a == order[0] else 0)] if lows[a] == v else [a] for a, v in zip(own.tolist(), values.tolist(), strict=True)])

    # A copy that a range has of the next one's first row bears that range's number and the mark 1; the first range's copy goes to the last.
    size = len(bounds) + 1
    at = F.when(F.col("at") >= size, F.col("at") - size).otherwise(F.col("at"))
    spread = rows.select("doc_id", "text", F.posexplode(places("doc_id")).alias("copy", "at")).select("doc_id", "text", "copy", at.alias("at"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for at, copy, doc_id, text in zip(*(batch[c].to_pylist() for c in ("at", "copy", "doc_id", "text")), strict=True):
                if held is not None and held[0] == at and held[1]:
                    continue  # a second copy: rows that tie with the next range's first
                row = (at, copy, doc_id, prepare(text))
                if held is not None and held[0] == at:
                    out.append(pair(held[2:], row[2:]))
                held = row
            if out:
                yield pa.RecordBatch.from_pylist(out, to_arrow_schema(kind))

    kind = _parse_datatype_string(schema)
    return spread.repartitionById(len(bounds) + 1, "at").sortWithinPartitions("at", "copy", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).mapInArrow(stream, schema)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of every document and of its edited text, whose last floor(n / 4) code points are the first ones of the next document.

    Null texts count as empty and are like each other; repeated rows give repeated results; a table of one row has itself as next, an empty table
    gives an empty table; a task holds two texts and their trees, however long they are; columns but doc_id and text aren't read, so clashing
    names don't matter."""

    def pair(row, following):
        (doc_id, (text, own)), (_, (after, other)) = row, following
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        changed = encode(tree(edited))
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own,
            "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, other),
        }

    return with_next(docs, lambda t: (t or "", encode(tree(t))), pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
