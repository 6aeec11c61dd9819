"""The stages of the pipeline: odd inputs, what they catch, and the whole against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import line_dedup, near_dedup

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    prose = "\n".join(f"Line {i} of a text that says nothing much, but says it at length." for i in range(9))
    rows = [(1, prose), (1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t"), (None, prose), (6, "password: hunter2x " * 3)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).withColumn("version", F.lit("mine")).withColumn("spans", F.lit(3))


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns_and_take_odd_rows(spark, odd, name):
    got = STAGES[name](spark, odd, DATA)
    assert got.columns == odd.columns and got.count() <= odd.count()
    assert STAGES[name](spark, odd.limit(0), DATA).count() == 0


def test_last_stage(spark, odd):
    got = STAGES["packing"](spark, odd, DATA)
    assert got.where("doc_id IN (3, 4)").count() == 2 and STAGES["packing"](spark, odd.limit(0), DATA).count() == 0


def test_near_copies_are_caught_after_their_lines_are_cut(spark, tmp_path):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    first = [line() for _ in range(30)]
    copies = [[*first[:k], line(), *first[k + 1 :]] for k in (3, 9, 27)]
    rows = [(i, "\n".join(lines)) for i, lines in enumerate([first, *copies, [line() for _ in range(30)]])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KIND)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    cut = line_dedup.drop_repeated_lines(docs)
    assert cut.where("doc_id = 2").first()["text"] == copies[1][9]
    kept = STAGES["near-dedup"](spark, cut, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 4]


def test_line_dedup_decides_what_near_dedup_sees(spark, tmp_path):
    """Ids 2 and 3 hold one article, wrapped otherwise, among the lines of 0 and of 1: whole they differ, cut they are copies. Id 4 is like a row that goes."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    wrapped = lambda text, width: [" ".join(text[i : i + width]) for i in range(0, len(text), width)]
    one, two, article = wrapped(words(300), 10), wrapped(words(300), 10), words(120)
    changed = [*one[:2], " ".join(words(10)), *one[3:]]
    rows = [(0, one), (1, two), (2, one + wrapped(article, 12)), (3, two + wrapped(article, 7)), (4, changed), (5, wrapped(words(200), 9))]
    docs = spark.createDataFrame([(i, "\n".join(lines), "en", "s", 0) for i, lines in rows], KIND)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda frame: sorted(r["doc_id"] for r in STAGES["near-dedup"](spark, frame, str(tmp_path)).collect())
    assert ids(docs) == [0, 1, 2, 3, 5]
    assert ids(STAGES["line dedup"](spark, docs, str(tmp_path))) == [0, 1, 2, 5]


def test_repeated_ids_lose_no_distinct_text(spark, tmp_path):
    """(1, A), (2, B), (2, A) with B unlike A: what goes is the copy of A alone, in whatever stage, and no row is multiplied."""
    rng = random.Random(5)
    a, b, c = ("\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)) for _ in range(3))
    rows = [(1, a), (2, b), (2, a), (3, c), (3, c), (4, c), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], KIND)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for whole in (None, docs):
        got = near_dedup.keep_one_each(docs, whole=whole).collect()
        assert sorted(((r["doc_id"] or 0, r["text"]) for r in got)) == sorted([(1, a), (2, b), (3, c), (3, c), (0, b)])
    cut = STAGES["line dedup"](spark, docs, str(tmp_path))
    assert cut.count() == len(rows)
    left = STAGES["near-dedup"](spark, cut, str(tmp_path))
    whole_texts = {(r["doc_id"] or 0, r["text"]) for r in left.collect()}
    assert {(1, a), (2, b), (3, c)} <= whole_texts
    assert STAGES["secret scan"](spark, left, str(tmp_path)).count() == left.count()
    assert STAGES["packing"](spark, left, str(tmp_path)).select("doc_id").distinct().count() == 4


def test_whole_pipeline_against_its_stages_by_hand(spark):
    """Rows, order of decisions and texts: what packing gets is what plain Python makes of what the classifier kept."""
    source = corpus_pipeline.table(spark, DATA, "documents")
    kept = {r["doc_id"]: r["text"] for r in STAGES["quality classifier"](spark, source, DATA).collect()}
    assert 0 < len(kept) < source.count()
    holder = {}
    strip = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i in sorted(kept):
        for x in kept[i].split("\n"):
            if len(strip(x)) >= 10:
                holder.setdefault(strip(x), i)
    cut = {i: "\n".join(x for x in t.split("\n") if len(strip(x)) < 10 or holder[strip(x)] == i) for i, t in kept.items()}
    sets = {}
    for i, t in kept.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    left = [i for i in ids if find(i) == i]
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted(set(got.doc_id)) == left and len(left) < len(ids)
    docs = spark.createDataFrame([(i, cut[i]) for i in left], "doc_id long, text string")
    want = STAGES["packing"](spark, corpus_pipeline.secret_scan.redact(docs), DATA).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[columns].values)) == sorted(map(tuple, want[columns].values))
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and len(fill) == want.sequence_id.nunique()
