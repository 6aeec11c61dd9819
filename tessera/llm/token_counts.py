"""Token counts of whole texts by a whole-token shortcut.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each of them alone. For every string of the vocabulary it is proven once, on the driver,
whether the merges take it to one token; a pre-token that is such a string counts as one and isn't merged. Only the rest goes through the merges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens over which a document is over the limit.
LIMIT = 1024
#: Runs between blanks whose counts a worker keeps: a bound on its memory. Other runs are counted each time.
CACHED_RUNS = 300_000
#: White space of the tokenizer's pattern: the Unicode property of that name.
_SPACE = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: In texts without these, the pattern cuts at every blank, so they may be cut there first.
_MIXED = rf" [{_SPACE}]|[{_SPACE}] |\A[{_SPACE}]|[{_SPACE}]\Z"
_COUNTERS: dict[str, "_Counter"] = {}


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def _read(path: str) -> dict:
    """The tokenizer file, if this operator counts as it does: byte-level BPE without a normalizer, added tokens that are cut out as they stand."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    pre, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE" and not file.get("normalizer") and not model.get("dropout")
    if not plain or any(t[k] for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer can be counted")
    return file


def proven_tokens(path: str) -> frozenset[str]:
    """The texts that the tokenizer's own merges take to one token, of all vocabulary strings that are texts. As many as the vocabulary at most."""
    from tokenizers import Tokenizer

    vocab, model, chars = _read(path)["model"]["vocab"], Tokenizer.from_file(path).model, _alphabet()
    found = set()
    for token, number in vocab.items():
        alone = model.tokenize(token) if all(c in chars for c in token) else []
        if len(alone) == 1 and alone[0].id == number:
            try:
                found.add(bytes(chars[c] for c in token).decode())
            except UnicodeDecodeError:  # part of a character: no pre-token
                continue
    return frozenset(found)


class _Counter(dict):
    """Tokens of a run of text, with the number of those that were counted without merging times 2**40."""

    def __init__(self, path: str, whole: frozenset[str]):
        import public_tokenizers
        import regex
        import tiktoken

        file, chars = _read(path), _alphabet()
        self.added = sorted((t["content"] for t in file.get("added_tokens", ())), key=len, reverse=True)
        ranks = {bytes(chars[c] for c in token): rank for token, rank in file["model"]["vocab"].items() if all(c in chars for c in token) and token not in self.added}
        self.whole, self.merges = whole, tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pre_tokens, self.mixed = regex.compile(_PATTERN).findall, regex.compile(_MIXED).search
        self.marks = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")

    def _run(self, text: str) -> int:
        direct = merged = 0
        for token in self.pre_tokens(text):
            if token in self.whole:
                direct += 1
            else:
                merged += len(self.merges.encode_ordinary(token))
        return (direct << 40) + direct + merged

    def __missing__(self, run: str) -> int:
        found = self._run(run)
        if len(self) < CACHED_RUNS:
            self[run] = found
        return found

    def _plain(self, text: str) -> int:
        if self.mixed(text):
            return self._run(text)
        first, *rest = text.split(" ")
        return self[first] + sum(map(self.__getitem__, [" " + run for run in rest]))

    def count(self, text: str) -> int:
        if not any(mark in text for mark in self.added):
            return self._plain(text) if text else 0
        parts = self.marks.split(text)
        return len(parts) - 1 + sum(self._plain(part) for part in parts if part)


def _counter(path: str, whole) -> _Counter:
    # A function of the module: workers import it, so all their tasks see one dictionary. A nested one would bring its own copy.
    if path not in _COUNTERS:
        _COUNTERS[path] = _Counter(path, whole.value)
    return _COUNTERS[path]


def _count(path: str, whole):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, whole)
        for batch in batches:
            found = [counter.count(text) if text else 0 for text in batch["text"].to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            columns = [batch["doc_id"], n_bytes, pa.array([x & (1 << 40) - 1 for x in found], pa.int64()), pa.array([x >> 40 for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "n_direct"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_direct) of every row of docs, whole texts: tokens as the file's library counts them without begin, end
    or added special tokens; an added token's string inside a text is that token. n_direct says how many were counted without merging.

    One narrow pass without a shuffle; what every worker holds is the proven part of the vocabulary. Null and empty texts have no bytes and no tokens,
    null ids stay, repeated rows are counted each, an empty table gives an empty one, a text of any length is counted whole, other columns of docs
    aren't read. A file of another kind than byte-level BPE is a ValueError when the plan is built."""
    whole = docs.sparkSession.sparkContext.broadcast(proven_tokens(tokenizer_path))
    counted = docs.select("doc_id", "text").mapInArrow(_count(tokenizer_path, whole), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, n_direct long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
