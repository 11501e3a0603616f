"""The pipeline's stages on the smallest table, against brute force on what each one got."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as C
from siftwell.llm.common import staged

SF = "/root/testdata/sf0.001"


def near(a, b):
    return (a ^ b).bit_count() <= 4


def test_stages(spark):
    from siftwell.llm.simhash_dedup import fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    frames = []
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        frames.append(docs)
        if name != "packing":
            assert docs.columns == columns
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["toxic"]}
    clean = {r["doc_id"]: r["text"] for r in frames[0].collect()}
    assert len(set(start) - set(clean)) > 0 and len(set(start) - set(clean) - toxic) <= 0.05 * len(start)
    exact = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    keys = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).digest() for i, t in clean.items()}
    assert len(exact) == len(set(keys.values())) == frames[1].count() and {keys[i] for i in exact} == set(keys.values())
    prints = {i: fingerprint(t.encode()) for i, t in exact.items()}
    kept = {r["doc_id"] for r in frames[2].collect()}
    groups = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in groups:
            for j in groups:
                if near(prints[i], prints[j]) and groups[j] < groups[i]:
                    groups[i], changed = groups[j], True
    assert kept == set(groups.values())
    mixed = Counter(r["doc_id"] for r in frames[3].collect())
    assert set(mixed) <= kept and max(mixed.values()) <= 3
    pieces = frames[4].collect()
    per = Counter()
    for r in pieces:
        per[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert all(per[i] == tokens[i] * n for i, n in mixed.items()) and set(per) == set(mixed)


def test_repeats_nulls_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x y", "en", "s", 3), (3, "", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in C.STAGES:
            docs = staged(stage(spark, docs, SF), name)
            if name == "exact_dedup":
                assert docs.count() == (3 if data else 0)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Null and repeated ids: no distinct text is lost, and of copies the row stays that op8 keeps."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(8)]
    rows = [(None, texts[i], "en", "s", 1) for i in range(4)] + [(7, texts[i], "en", "s", 1) for i in range(4, 8)]
    rows += [(3, texts[0], "en", "s", 1), (7, texts[1] + " ", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    exact = staged(C.drop_copies(spark, docs, SF), "exact")
    assert exact.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in exact.collect())
    assert got == sorted([(0, texts[0]), (7, texts[1] + " "), (0, texts[2]), (0, texts[3]), *((7, t) for t in texts[4:])])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in C.drop_near_copies(spark, exact, SF).collect()) == got
    near = {(r["doc_id"], r["text"].strip()) for r in C.drop_near_copies(spark, docs, SF).collect()}
    assert near == {(3, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), *((7, t) for t in texts[4:])}


def test_clashing_and_nested_columns_and_long_texts(spark):
    """Columns named like the operators' own pass through every stage, and so do maps and a very long text."""
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)] + [" ".join(f"long{k}" for k in range(60_000))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["__id", "__text", "__size", "__key", "__toxicity", "row_id", "keep_row", "score", "print", "ids", "digest", "length", "copies", "s", "number", "__at"]
    docs = docs.selectExpr("*", *[f"cast(doc_id as string) as `{n}`" for n in names], "map('a', 1) as m", "array(struct(1 as x)) as nested")
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and docs.where("`__id` <> doc_id or row_id <> doc_id or `__key` <> doc_id").count() == 0
        if name in ("exact_dedup", "simhash_dedup"):
            assert docs.count() == 7
    assert docs.count() >= 7


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """Every stage bounds the bytes of the batches that JVM and worker both hold; 10,000 rows are no bound. A lower bound stays."""
    import pyarrow as pa

    from siftwell.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id as string), 2000) as text")
    assert texts.selectExpr("sum(length(text))").first()[0] > 4 * common.BATCH_BYTES
    before = spark.conf.get(key)
    try:
        for _, stage in C.STAGES:
            spark.conf.set(key, "64m")
            stage(spark, docs, SF)
            got = texts.mapInArrow(sizes, "rows long, size long").collect()
            assert sum(r["rows"] for r in got) == 3000 and max(r["size"] for r in got) <= common.BATCH_BYTES + (64 << 10)
        spark.conf.set(key, "1m")
        C.pack_sequences(spark, docs, SF)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_packing_encodes_little_at_a_time(monkeypatch):
    """What a worker expands to ids at once is bounded, and its pieces are those of the whole batch."""
    import zlib

    import numpy as np
    import pyarrow as pa

    from siftwell.llm import packing

    seen = []

    class Encode:
        def batch(self, column):
            seen.append(sum(map(len, column.to_pylist())))
            ids = [np.frombuffer(x.encode(), np.uint8).astype(np.uint32) for x in column.to_pylist()]
            return np.concatenate(ids), np.cumsum([len(x) for x in ids])

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(packing, "encoder", lambda path: Encode())
    monkeypatch.setattr(packing, "TaskContext", Task)
    texts = [chr(97 + i % 26) * 5000 for i in range(1400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run, _ = packing._cut("none", 4096, 2, False)
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert sum(seen) == 7_000_000 and max(seen) <= 2 << 20
    assert [(r["row_id"] - (3 << 33), r["doc_id"], r["start"], r["length"]) for r in rows] == [(i, i, s, n) for i in range(1400) for s, n in ((0, 4096), (4096, 905))]
    whole = np.append(np.frombuffer(texts[9].encode(), np.uint8).astype("<u4"), np.uint32(2))
    assert [r["ids_crc32"] for r in rows[18:20]] == [zlib.crc32(whole[:4096].tobytes()), zlib.crc32(whole[4096:].tobytes())]


def test_no_stage_starts_python_rdds(spark, monkeypatch):
    """Rows sent as a Python list start a second daemon with workers in every executor, beside those of the stages."""
    from pyspark import SparkContext

    def refuse(*_, **__):
        raise AssertionError("a Python RDD")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for rows in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            rows = staged(stage(spark, rows, SF), name)
        assert (rows.count() > 0) == (rows.agg({"length": "sum"}).first()[0] is not None)


def test_workers_keep_nothing_for_other_stages(spark):
    """A worker's cache lives through its stage and is gone when the next stage's task begins."""
    import pyarrow as pa

    from siftwell.llm import common

    def keep(batches):
        from siftwell.llm import common

        for b in batches:
            made = [common.worker_cache("kept", lambda: bytearray(1000)) for _ in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([int(made[0] is made[1])])], names=["n"])

    def look(batches):
        from siftwell.llm import common

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._kept)])], names=["n"])

    rows = spark.range(0, 400, 1, 16)
    assert {r["n"] for r in common.map_texts(rows, keep, "n long").collect()} == {1}
    assert {r["n"] for r in common.map_texts(rows, look, "n long").collect()} == {0}
