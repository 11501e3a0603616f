"""Packing, mixing and exact deduplication against brute force, and their odd rows."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import exact_dedup as D
from siftwell.llm import mixing as M
from siftwell.llm import packing as P

SCHEMA = "doc_id long, text string, source string, size string, key string, length string"
ODD = ["<|endoftext|> a", "ΣΑΣ Σ", "it's I'LL don'T «É» a b … 12½ İx", "\x1cq\x85z", "naïve café é", "x<|y", "", "  ", None]


def docs(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, source(i), "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


# -- packing


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
@settings(max_examples=80)
def test_patterns_hold_every_piece_once(histogram):
    patterns = P.pack_histogram(histogram, 32)
    counted = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 32
        for size in pattern:
            counted[size] += n
    assert counted == Counter(histogram)
    slots = P.slots(patterns)
    assert len(slots["size"]) == sum(len(p) for p, _ in patterns)


def test_pieces_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["Alpha", "beta,", "gamma!!", "délta", "42"]) for _ in range(rng.randint(0, 300))) for _ in range(30))]
    texts += [texts[12], texts[12]]
    rows = P.pack(docs(spark, texts), length=64, with_ids=True).collect()
    whole = Tokenizer.from_file(P.tokenizer_path())
    got = defaultdict(dict)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes())
        got[r["row_id"], r["doc_id"]][r["start"]] = r["ids"]
    assert len(got) == len(texts)
    for (_, doc), parts in got.items():
        want = whole.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        assert sum((parts[k] for k in sorted(parts)), []) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 64
    assert sum(r["length"] for r in rows) > 0.9 * 64 * len(used)


def test_packing_an_empty_table(spark):
    assert P.pack(docs(spark, []).limit(0)).collect() == []


# -- mixing


def test_targets():
    assert M.targets([("a", 10), ("b", 10), ("c", 1000)]) == [("a", 10, 30.0), ("b", 10, 30.0), ("c", 1000, 960.0)]
    got = M.targets([(None, 5), ("b", 100), ("a", 100)])
    assert [x[0] for x in got] == ["a", "b", None] and sum(x[2] for x in got) == pytest.approx(205)
    assert M.targets([("a", 0)]) == [("a", 0, 0.0)] and M.targets([]) == []


def test_planned_targets_equal_the_plain_ones(spark, monkeypatch):
    rng = random.Random(3)
    for k in (0, 1, 2, 40):
        sizes = [(None if i == 7 else f"s{i}", rng.choice([0, 1, 10, 500, 20_000])) for i in range(k)]
        got = {r["source"]: (r["source_size"], r["target"]) for r in M.planned(spark.createDataFrame(sizes, "source string, n long")).collect()}
        want = {s: (n, t) for s, n, t in M.targets(sizes)}
        assert got.keys() == want.keys() and all(got[s] == (pytest.approx(want[s][0]), pytest.approx(want[s][1])) for s in want)
    df = docs(spark, [f"a{i} b c" for i in range(90)], lambda i: f"s{i % 30}")
    want = sorted(map(tuple, M.mix(df).collect()))
    monkeypatch.setattr(M, "MOST_SENT", 3)
    assert sorted(map(tuple, M.mix(df).collect())) == want


def test_quality_sees_every_word():
    words = [b"w%d" % i for i in range(1000)]
    assert M.quality(words) == 1.25 and M.quality([b"a"] * 1000) == pytest.approx(0.255) and M.quality([]) == 0.25
    assert M.quality(words[:999] + [b"w998"]) < M.quality(words)


def test_no_bin_of_keys_is_large(spark):
    rows = [(rng_key,) for q in (0.25, 0.5, 1.25) for rng_key in (M.sample_key(i, q, 1) for i in range(20_000))]
    df = spark.createDataFrame(rows, "key double").withColumn("bin", M._bin(M.F.col("key"), M.F.lit(256)))
    assert max(r["count"] for r in df.groupBy("bin").count().collect()) < 8 * len(rows) / 256


def test_mix_takes_prefixes_of_keys(spark):
    rng = random.Random(7)
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(400)] + [None]
    df = docs(spark, texts, lambda i: None if i % 50 == 0 else f"s{(i % 7) // 2}")
    rows = M.mix(df).collect()
    again = sorted(map(tuple, M.mix(df.repartition(5)).collect()), key=repr)
    assert sorted(map(tuple, rows), key=repr) == again and len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert sum(g[0]["target"] for g in by.values()) == pytest.approx(total)
    for own in by.values():
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1) and own[0]["source_size"] == sum(r["size"] for r in own)
        # brute force: the same documents, in order of their keys
        words = [(M.sample_key(r["doc_id"], M.quality((texts[r["doc_id"]] or "").encode().split()), 42), r) for r in own]
        epochs = int(own[0]["target"] / own[0]["source_size"] + 1e-12)
        left = own[0]["target"] - epochs * own[0]["source_size"]
        for _, r in sorted(words, key=lambda x: (x[0], x[1]["doc_id"])):
            extra = min(r["size"], max(0.0, left))
            assert r["taken"] == pytest.approx(epochs * r["size"] + extra, abs=1)
            left -= extra


def test_mixed_documents_are_whole(spark):
    texts = [f"a{i} " * (i % 9 + 1) for i in range(60)]
    df = docs(spark, texts)
    out = M.mixed_documents(df)
    assert out.columns == df.columns and all(texts[r["doc_id"]] == r["text"] for r in out.collect())
    taken = {r["doc_id"]: r["copies"] for r in M.mix(df).collect()}
    counted = Counter(r["doc_id"] for r in out.collect())
    assert all(counted[i] in (n, n + 1) for i, n in taken.items())
    clash = df.selectExpr("*", "1 as __id", "2 as __text", "3 as `__size`", "4 as __key", "5 as s", "6 as copies", "7 as bins", "map(1, 2) as words")
    again = M.mixed_documents(clash)
    assert again.columns == clash.columns and Counter(r["doc_id"] for r in again.collect()) == counted
    assert M.mixed_documents(df.limit(0)).collect() == [] and M.mix(df.limit(0)).collect() == []


# -- exact deduplication


def test_cuckoo_filter_and_index():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    index = D.CuckooIndex(4)
    for k in keys:
        assert index.find(k) is None
        index.insert(k, [1])
    assert index.resizes > 0 and all(index.find(k) for k in keys)
    for k in keys[::2]:
        assert index.delete(k) == [1]
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys)) and index.filter.size == len(index) == 2500
    index.insert(keys[1], [7], 99)  # as if another text had the digest
    assert index.find(keys[1]) == [1] and index.find(keys[1], 99) == [7] and index.find(keys[1], 98) is None
    assert index.delete(keys[0]) is None


def test_exact_groups(spark):
    rng = random.Random(2)
    base = ["a b", "ab", "a b", "", None, " \t", "Ab", "ünï cödé", "x" * 50]
    texts = base + ["".join(c + rng.choice(["", " ", "\n", "\x0b"]) for c in rng.choice(base) or "") for _ in range(200)]
    df = docs(spark, texts).union(docs(spark, texts[:3]))
    for most_live in (100_000, 4):
        rows = D.exact_dedup(df, most_live).collect()
        assert len(rows) == len(texts) + 3
        groups = defaultdict(list)
        for i, t in [*enumerate(texts), *enumerate(texts[:3])]:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
        of = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in rows:
            own = of[r["text_sha256"]]
            assert r["group_size"] == len(own) and r["keep_id"] == min(own)[1]
        assert sum(r["kept"] for r in rows) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    assert D.exact_dedup(df.limit(0)).collect() == []


def test_index_changes(spark):
    d = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    frame = lambda rows, s: spark.createDataFrame([(bytearray(x), *r) for x, *r in rows], s)
    index = frame([(d[0], 2), (d[1], 1)], "digest binary, members long")
    out = D.apply_changes(index, frame([(d[1],), (d[2],)], "digest binary"), frame([(d[0],), (d[0],), (d[4],), (d[1],)], "digest binary"))
    assert {bytes(r["digest"]): r["members"] for r in out.collect()} == {d[1]: 1, d[2]: 1}
