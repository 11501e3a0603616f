"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import xxhash

from siftwell.llm import embedding_dedup as E
from siftwell.llm import simhash_dedup as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_roots(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return [*texts, None, "", " \t\n", "one", "One", "a b c", "a\vb c", texts[0], texts[0]]


def test_fingerprints_and_components(spark):
    rows = [(i, t, "en", None, 1) for i, t in enumerate(corpus())]
    got = {r["doc_id"]: r for r in S.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {r[0]: brute_print(r[1]) for r in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(linked) > 100
    assert {i: r["component_id"] for i, r in got.items()} == brute_roots(ids, linked)


def test_index_finds_every_pair_within_four_bits():
    rng = random.Random(1)
    for refined in (False, True):
        kept = S.masks(4, refined)
        assert len(kept) == (320 if refined else 64)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                b ^= 1 << bit
            keys = S.index_keys(np.array([a, b], np.uint64), kept)
            assert (keys[0] == keys[1]).any()


def test_refined_index_gives_the_same(spark):
    rows = [(i, t, "en", None, 1) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(S.simhash_components(docs).collect())
    assert want == sorted(S.simhash_components(docs, popular=1).collect())
    assert want == sorted(S.simhash_components(docs, popular=0, block=2).collect())


def test_popular_values(spark):
    prints = [(i << 40) | 5 for i in range(6)] + [7]
    got = S.popular_values(spark.createDataFrame([(x,) for x in prints], "print long"), 4, 3)
    first, second, third = S.segments(4)
    assert [np.flatnonzero(x).tolist() for x in got] == [[5], [], [0]] and len(first) == 22 and len(second) == len(third) == 21


def test_empty_null_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_components(empty).collect() == []
    odd = spark.createDataFrame([(None, None, 1), (3, "x y", 2), (3, "x y", 2)], "doc_id long, text string, print long")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in S.simhash_components(odd).collect()) == [(-1, None), (3, 3), (3, 3)]


def vectors(rng):
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            base = rng.standard_normal(16)
            for _ in range(rng.integers(1, 6)):
                v = base + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.06, 0.12])
                rows.append((k, [float(x) for x in v.astype(np.float32)], label))
                k += 1
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(k + i, v, 1) for i, v in enumerate(bad)]
    return rows


def brute_links(rows, threshold=0.98):
    ok = []
    for i, v, label in rows:
        if label is None or not v or any(x is None for x in v):
            continue
        a = np.array(v, float)
        if np.isfinite(a).all() and a.any():
            ok.append((i, a / np.sqrt(a @ a), label))
    return {(a, b) for a, x, s in ok for b, y, t in ok if a < b and s == t and len(x) == len(y) and x @ y >= threshold}


def test_embedding_links(spark):
    rows = vectors(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows)
    for block in (4096, 3):
        got = {r["vec_id"]: r for r in E.embedding_dedup(df, block=block, recall=0.9999).collect()}
        assert len(got) == len(rows)
        degree = {i: sum(i in p for p in want) for i, _, _ in rows}
        assert {i: r["n_links"] for i, r in got.items()} == degree
        assert {i: r["component_id"] for i, r in got.items()} == brute_roots([r[0] for r in rows], want)
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_embedding_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sum(r["n_links"] for r in E.embedding_dedup(table).collect()) / 2
    want = brute_links([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    assert 0.9 * len(want) <= got <= len(want)


def test_vectors_of_any_size_link(spark):
    a = [1.0, 2.0, -3.0]
    rows = [(1, [1e-200 * x for x in a], 1), (2, [1e-200 * x for x in a], 1), (3, [1e200 * x for x in a], 1), (4, [5e-324, 0.0, 0.0], 1), (5, [1.7e308, 0.0, 0.0], 1), (6, [0.0, 1.0, 0.0], 1), (7, a, 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_embedding_clashing_columns_long_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    long = rng.standard_normal(5000).tolist()
    rows = [(i, long, 1, 1, "x", 2) for i in range(5)] + [(5, rng.standard_normal(5000).tolist(), 1, 1, "x", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int, key string, copies int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.embedding_dedup(df).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 5: (0, 5)}


def test_embedding_empty(spark):
    assert E.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
