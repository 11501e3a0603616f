"""The language model against brute force, and held-out accuracy of the quality classifier."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from siftwell.llm import language_model as L
from siftwell.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, base double"


def small_model(rng, states=3, classes=7):
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return L.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(m, text):
    for z in product(range(len(m.start)), repeat=len(text)):
        p = m.start[z[0]] * m.emit[text[0], z[0]]
        for a, b, x in zip(z, z[1:], text[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        yield z, p


def test_forward_and_expected_counts():
    rng = np.random.default_rng(0)
    m = small_model(rng)
    texts = [rng.integers(0, 7, n).astype(np.uint16) for n in (1, 2, 5, 5, 6)]
    counts = np.zeros((7 + 3 + 2, 3))
    want = np.zeros_like(counts)
    for places, block in L.blocks(texts, 8):
        score = L.forward(m, block)[0]
        L.expected_counts(m, block, counts)
        for place, s in zip(places, score):
            text, total = texts[place], sum(p for _, p in paths(m, texts[place]))
            assert s == pytest.approx(math.log10(total))
            for z, p in paths(m, text):
                want[10, z[0]] += p / total
                for a, b in zip(z, z[1:]):
                    want[7 + a, b] += p / total
                for x, a in zip(text, z):
                    want[x, a] += p / total
    assert np.allclose(counts[:11], want[:11])


def test_scores_against_plain_counts(spark):
    rows = [(i, t, "en", "s", 0.0) for i, t in enumerate(["The cat sat"] * 12 + ["dog\x0bran the", "", None, "zebra Quagga the", "É é É"] * 5)]
    got = {r["doc_id"]: r for r in L.score_texts(spark.createDataFrame(rows, SCHEMA), states=2, rounds=2).collect()}
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter()
    words = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    for i in words:
        if i not in out:
            c.update(words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in out, len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r["score"] < 0


def test_each_round_fits_better_and_held_out_text_gains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = docs.where(~L.held_out("doc_id")).select("text")
    v = L.Vocabulary(L.word_counts(training), training.count())
    encoded = docs.select("doc_id", L.held_out("doc_id").alias("held_out"), "text").mapInArrow(L._encode(spark.sparkContext.broadcast(v)), L._ENCODED)
    _, history = L.baum_welch(encoded, v, rounds=3)
    assert history == sorted(history)
    rows = [r for r in L.score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_scores_of_no_documents(spark):
    assert L.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in Q.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == y for r, y in held) > 0.93 * len(held)
    assert sum(not r["kept"] for r, y in held if y) <= 0.03 * len(held)


def test_quality_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None, 1.0), (None, None, None, None, None), (1, "a b", "en", None, 1.0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in Q.score_quality(docs, labels).collect()] == [0.5] * 3
    assert Q.score_quality(docs.limit(0), labels).collect() == []


def test_shapes():
    assert Q.shape(b"Hello%%%") == b"Aa%" and Q.shape("ÉTÉ!!12".encode()) == b"A!0"
