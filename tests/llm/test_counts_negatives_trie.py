"""Token counts, hard negatives and the prefix trie against brute force: nulls, ties, repeated and hot rows, empty tables, clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import hard_negatives, prefix_trie, token_counts
from tessera.operators.ordering import numbered

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, n_bytes string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_counts_of_odd_texts(spark, tokenizer):
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext", " ", "\n", "\x1c", "\x85", "　", " ", "  ", "ab", "'s", "'LL", "é", "12", "!?", "\t", "word", "𐀀", "​"]
    texts = ["".join(r.choice(parts) for _ in range(30)) for _ in range(500)]
    texts += [None, "", " ", "x" * 50_000, "na" * 30_000 + " end", "<|endoftext|>" * 3, "a " * 20_000, texts[0], texts[0]]
    docs = spark.createDataFrame([(i if i else None, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"] or 0: r for r in token_counts.count_tokens(docs, BPE).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["n_bytes"]) == (len(tokenizer.encode(t or "", add_special_tokens=False).ids), len((t or "").encode()))
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 1024)
    assert token_counts.count_tokens(docs.where("false"), BPE).count() == 0


def test_pre_tokens_of_every_character(tokenizer):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}1{c}{c} b" for c in every[i : i + 2000]) for i in range(0, len(every), 2000)]
    counter = token_counts._Counter(BPE, token_counts.proven_tokens(BPE))
    assert [counter.count(t) & (1 << 40) - 1 for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_only_proven_strings_are_counted_directly(tokenizer, tmp_path):
    proven = token_counts.proven_tokens(BPE)
    assert len(proven) > 49_000 and all(len(tokenizer.encode(t, add_special_tokens=False).ids) == 1 for t in list(proven)[::50] if not t.isspace())
    import json

    file = json.load(open(BPE, encoding="utf-8"))
    file["model"]["merges"] = [m for m in file["model"]["merges"] if (m if isinstance(m, str) else " ".join(m)) != "t h"]
    broken = tmp_path / "broken.json"
    broken.write_text(json.dumps(file), encoding="utf-8")
    assert "th" in proven and "th" not in token_counts.proven_tokens(str(broken))  # in the vocabulary, but no merge makes it
    with pytest.raises(ValueError, match="only byte-level"):
        token_counts.proven_tokens(public_tokenizers.path("word_bpe_49k.json"))


def _brute(rows, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v)})
    width = max((len(v) for *_, v in rows), default=0)
    m = np.array([[*v, *[0] * (width - len(v))] for *_, v in rows], "i8").reshape(len(rows), width)
    out = []
    for a, (own_id, own, _) in enumerate(rows):
        if own_id % 100:
            continue
        score = (m @ m[a]).tolist()
        order = sorted(range(len(rows)), key=lambda x: (-score[x], rows[x][0]))
        for p in [x for x in order if rows[x][1] == own and x != a][:positives]:
            held = [x for x in order if rows[x][1] != own and low * score[p] <= 100 * score[x] <= high * score[p]][:negatives]
            out += [(own_id, rows[p][0], k, rows[x][0], score[p], score[x]) for k, x in enumerate(held, 1)]
    return sorted(out)


def _mined(spark, rows, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>").withColumns({"rank": F.lit("x"), "block": F.lit(1)})
    got = hard_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, **sizes).collect()
    assert [f.dataType.simpleString() for f in hard_negatives.hard_negatives(frame.limit(0), F.lit(True)).schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, got))


@pytest.mark.parametrize("kind", ["spread", "ties", "hot"])
def test_negatives_equal_brute_force(spark, kind):
    r = np.random.default_rng(5)
    n = 700
    wide = {"spread": 40, "ties": 2, "hot": 9}[kind]
    vectors = r.integers(-wide, wide + 1, (n, 6))
    if kind == "hot":
        vectors[r.random(n) < 0.4] = vectors[0]
    rows = [(i, int(r.integers(0, 3)), v.tolist()) for i, v in enumerate(vectors)]
    got = _mined(spark, rows, shard_rows=64, block_anchors=2)
    assert got == _brute(rows) and len(got) > 50


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [3, 1]), (0, 1, [3, 1]), (0, 1, [2, 5]), (1, 1, [3]), (2, 1, [3, 1]), (3, 2, [1, 1]), (4, 2, [2]), (5, None, [2, 1]), (None, 2, [2, 1]), (6, 2, None), (7, 2, [0, 0]), (100, 3, [1, 1]), (200, 1, [0, 0]), (8, 2, [1, 0]), (9, 2, [-1, 2])]
    # Ids that repeat with another vector are rows of their own; their order among equal scores is by id, so compare where it's decided.
    assert _mined(spark, rows) == _brute(rows)
    assert _mined(spark, [(100, 1, [1]), (1, 2, [1])]) == []
    quantized = spark.createDataFrame([(0, [0.5, -0.001]), (1, [1.0, None]), (2, None), (3, [float("nan")]), (4, [float("inf")]), (5, [])], "i int, v array<float>").select("i", hard_negatives.quantized(F.col("v")).alias("v")).orderBy("i").collect()
    assert [q["v"] for q in quantized] == [[128, -1], None, None, None, None, []]


def test_sorted_access_stops_early():
    r = np.random.default_rng(2)
    shard = hard_negatives.Shard((r.standard_normal((2000, 4)) * 100).astype("i8"))
    anchor = np.array([50, -3, 0, 1])
    rows, scores = shard.search(anchor, lambda at, s, threshold: len(s) >= 5 and threshold < np.sort(s)[-5])
    whole = shard.vectors.astype("i8") @ anchor
    assert len(rows) < 1000 and sorted(scores)[-5:] == sorted(whole)[-5:]


def _trie(conversations):
    members, ends, up, size = defaultdict(list), defaultdict(list), {(): None}, {(): 0}
    for c, turns in sorted(conversations.items()):
        key = ()
        members[key].append(c)
        for role, text in turns:
            up[(*key, (role, text))] = key
            key = (*key, (role, text))
            size[key] = len(text)
            members[key].append(c)
        ends[key].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key, parent in up.items():
        children[parent] += 1
    for key in up:
        at = key
        while at is not None:
            leaves[at] += key not in children
            saved[at] += (len(members[key]) - 1) * size[key]
            at = up[at]
    return sorted((members[k][0], len(k), -1 if up[k] is None else members[up[k]][0], len(members[k]), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in up) if conversations else []


def _built(frame, **options):
    rows = prefix_trie.turns(frame)
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefix_trie.prefix_trie(rows, frame.where("conv_id IS NOT NULL").select(F.col("conv_id")).distinct(), **options).collect())


def test_trie_of_odd_conversations(spark):
    rows = [(7, None, "user", "first"), (7, 0, None, "x"), (7, 1, "user", None), (9, 5, "user", "first"), (9, 6, "", "x"), (-3, 0, "user", "first"), (None, 0, "user", "lost"), (12, 0, "user", "é𐀀"), (12, 1, "assistant", ""), (13, 0, "usé", "r"), (14, 0, "us", "ér")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "shard": F.lit("y")})
    held = defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1])):
        held[c].append((role or "", text or ""))
    assert _built(frame) == _trie(held)
    assert _built(frame.where("false")) == []


def test_trie_with_hot_beginnings_copies_and_a_long_conversation(spark, monkeypatch):
    r = random.Random(4)
    held = {c: [("user", "hello")] * (r.random() < 0.7) + [(r.choice(["user", "assistant"]), r.choice("abc") * r.randint(0, 3)) for _ in range(r.randint(0, 6))] for c in range(400)}
    held |= {c: [("user", "hello"), ("assistant", "copy"), ("user", "bye")] for c in range(400, 700)}
    held |= {c: [("user", f"turn {i % 50}") for i in range(150 + c % 2)] for c in (700, 701, 702)}
    rows = [(c, i, *t) for c, turns in held.items() for i, t in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 4)
    ids = spark.createDataFrame([(c,) for c in held], "conv_id long")
    got = prefix_trie.prefix_trie(prefix_trie.turns(frame), ids, shard_conversations=50).collect()
    assert sorted(tuple(-1 if x is None else x for x in g) for g in got) == _trie(held)


def test_rebuilt_blocks(spark, monkeypatch):
    rows = [(c, i, "user", f"{c}.{i}") for c in (100, 101, 102, 205, 207) for i in range(40 if c == 101 else 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = [r.asDict() for r in prefix_trie.rebuilt(prefix_trie.turns(frame))[0].collect()]
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    blocks = [r.asDict() for r in prefix_trie.rebuilt(prefix_trie.turns(frame))[0].collect()]
    key = lambda r: (r["conv_id"], r["position"], r["a"])
    assert sorted(plain, key=key) == sorted(blocks, key=key)
    for c in (100, 101, 102, 205, 207):
        assert sorted(r["position"] for r in plain if r["conv_id"] == c) == list(range(sum(r["conv_id"] == c for r in plain)))


def test_perfect_table():
    for n in (0, 1, 2, 3, 50, 5000):
        keys = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), dtype="u8")
        table = prefix_trie.PerfectTable(keys)
        assert sorted(table.find(keys).tolist()) == list(range(n))
        assert (table.find(keys + np.uint64(1)) == -1).all()


def test_numbered_over_ranges(spark):
    rows = [(None if g == 2 else g, (i * 7) % 900, "x") for g, n in ((0, 900), (1, 3), (2, 40)) for i in range(n)]
    frame = spark.createDataFrame(rows, "g int, at int, more string").repartition(5)
    got = numbered(frame, "g", ["at"]).collect()
    for g in (0, 1, None):
        held = sorted((r["position"], r["at"]) for r in got if r["g"] == g)
        assert [p for p, _ in held] == list(range(len(held))) and [a for _, a in held] == sorted(a for _, a in held)
