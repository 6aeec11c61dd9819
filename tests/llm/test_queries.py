"""The queries with SQL twins against DuckDB, the others against brute force, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import quality_classifier
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES
from tests.compare import check

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, name, QUERIES[name], ORACLES[name], DATA)


def test_fingerprints(spark, texts):
    got = QUERIES["op1_document_fingerprints"](spark, DATA).toPandas().set_index("doc_id")
    ids = sorted(texts)
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        text = texts[i]
        edited = text[: len(text) - len(text) // 4] + texts[following][: len(text) // 4]
        row = got.loc[i]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint == row.edited_fingerprint) == (text == edited)
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
    assert len(set(texts.values())) == got.fingerprint.nunique()
    assert got.near_edited.median() > 0.6 > 0.2 > got.near_next.median()


def test_near_components(spark, texts):
    got = QUERIES["op3_minhash_near_dedup"](spark, DATA).toPandas().set_index("doc_id")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = set(zip(w, w[1:], strict=False)) or ({tuple(w)} if w else set())
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
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == {i: find(i) for i in ids}
    assert (got.kept == (got.index == got.component_id)).all()


def test_classifier_on_held_out_rows(spark):
    got = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.9


def test_packing(spark, texts):
    got = QUERIES["op6_best_fit_packing"](spark, DATA).toPandas().sort_values(["doc_id", "piece"])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, rows in got.groupby("doc_id"):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        lengths = rows.length.tolist()
        assert sum(lengths) == len(ids) and all(n == 1024 for n in lengths[1:]) and lengths[0] == (len(ids) - 1) % 1024 + 1
        assert rows.start.tolist() == np.cumsum([0, *lengths[:-1]]).tolist()
        for r in rows.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert got.doc_id.nunique() == len(texts)
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all()
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and len(fill) <= 1.02 * -(-got.length.sum() // 1024)


def test_secrets(spark, texts):
    got = QUERIES["op7_secret_scans"](spark, DATA).toPandas().set_index("doc_id")
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for i, t in texts.items():
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        shown = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got.loc[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert not Counter(shown.split(",") if shown else []) - Counter(got.loc[i].spans.split(","))


def test_sentencepiece(spark, texts):
    got = QUERIES["op10_sentencepiece"](spark, DATA).toPandas().set_index("doc_id")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in texts.items():
        ids = model.encode(t)
        assert (got.loc[i].n_ids, got.loc[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got.loc[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_token_counts(spark, texts):
    got = QUERIES["op11_token_counts"](spark, DATA).toPandas().set_index("doc_id")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got.n_tokens.to_dict() == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got.n_bytes.to_dict() == {i: len(t.encode()) for i, t in texts.items()}
    assert (got.over_limit == (got.n_tokens > 1024)).all() and got.over_limit.any()
    assert 0 < got.n_direct.sum() < got.n_tokens.sum()


def test_classifier_equals_plain_numpy_on_one_partition(spark):
    """Ridge scores by one least-squares problem, calibration by the min-max formula of isotonic regression."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id", "quality")
    model = quality_classifier.fit(docs, labels, features=40)
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", F.xxhash64("doc_id", F.lit(quality_classifier.SEED)).alias("draw")).toPandas()
    stats = np.array([quality_classifier.statistics(t) for t in rows.text])
    mean, scale = stats.mean(axis=0), stats.std(axis=0)
    scale[scale <= 1e-9] = 1
    rng = np.random.default_rng(quality_classifier.SEED)
    directions = rng.normal(size=(stats.shape[1], 40)) * np.sqrt(1 / stats.shape[1])
    phases = rng.uniform(0, 2 * np.pi, 40)
    mapped = lambda s: np.hstack([np.sqrt(2 / 40) * np.cos(np.clip((s - mean) / scale, -8, 8) @ directions + phases), np.ones((len(s), 1))])
    z, y, held = mapped(stats), rows.quality.to_numpy(float), rows.draw.to_numpy() % 4 == 0
    penalty = np.sqrt(quality_classifier.RIDGE * 1e-2 * (~held).sum()) * np.eye(41)
    weights = np.linalg.lstsq(np.vstack([z[~held], penalty]), np.concatenate([y[~held], np.zeros(41)]), rcond=None)[0]
    raw = z @ weights
    order = np.lexsort((y[held], raw[held]))
    x, v = raw[held][order], y[held][order]
    sums = np.concatenate([[0], np.cumsum(v)])
    fitted = np.array([max(min((sums[b + 1] - sums[a]) / (b + 1 - a) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))])
    blocks = [np.flatnonzero(np.isclose(fitted, level)) for level in np.unique(fitted.round(12))]
    want = np.clip(np.interp(raw, [x[b].mean() for b in blocks], [fitted[b].mean() for b in blocks]), 0, 1)
    got = model.score(docs).toPandas().set_index("doc_id").score
    assert held.sum() > 50 and np.allclose(got.loc[rows.doc_id].to_numpy(), want, atol=1e-5)
