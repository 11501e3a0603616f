"""The engine, sources, sinks and streams end to end on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siftwell.errors import CollectionNotFound, SourceError
from siftwell.operators import bm25
from siftwell.operators.store import Store
from siftwell.plans.engine import Engine, project
from siftwell.sources import pages, sinks, tabular
from siftwell.sources.items import Registry


def embed(text):
    words = ["rust", "python", "async", "error"]
    return [0.1 + text.lower().count(w) for w in words]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    files = {
        "rust-intro.md": "# Rust Intro\n\nRust is a language. It has ownership.\n[async](rust-async.md)\n",
        "rust-async.md": "# Rust Async\n\nAsync rust uses futures and error handling.\n",
        "python-intro.md": "# Python Intro\n\nPython is dynamic. Python is slow.\n",
        "node_modules/x.md": "# no\n",
        ".hidden.md": "# no\n",
        "notes.txt": "plain",
    }
    for name, text in files.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("store"))), embedder=embed)
    e.collection_add("docs", folder)
    assert {r["action"] for r in e.collection_update("docs").collect()} == {"insert"}
    return e


def test_ingest(engine, folder):
    assert sorted(r["path"] for r in engine.ls("docs/").collect()) == ["python-intro.md", "rust-async.md", "rust-intro.md"]
    with open(os.path.join(folder, "rust-intro.md"), "a") as f:
        f.write("More about errors.\n")
    assert sorted((r["path"], r["action"]) for r in engine.update("docs").collect()) == [("python-intro.md", "skip"), ("rust-async.md", "skip"), ("rust-intro.md", "update")]
    assert engine.cleanup()["content"] == 1
    assert engine.collection_list().first()["documents"] == 3
    with pytest.raises(CollectionNotFound):
        engine.update("nothing")


def test_search(engine):
    page = engine.search_bm25("rust", mode="relevance")
    assert [r["path"] for r in page.collect()][0].startswith("rust") and page.count() == 2
    vectors = engine.documents().select("hash", F.lit(0).alias("seq"), "body").collect()
    rows = engine.spark.createDataFrame([(r["hash"], 0, embed(r["body"])) for r in vectors], "hash string, seq int, embedding array<double>")
    engine.tables.write("embeddings", rows)
    near = engine.search_vector("python", 2).collect()
    assert near[0]["path"] == "python-intro.md" and near[0]["score"] == pytest.approx(100)
    assert engine.search_hybrid("rust error", 3).count() >= 1
    assert engine.search("what is python", 5).first()["path"] == "python-intro.md"
    out = engine.snippets(engine.search_bm25("futures"), "futures").first()
    assert "futures" in out["snippet"]
    batch = engine.spark.createDataFrame([(1, "rust"), (2, "python")], "query_id long, query string")
    assert engine.batch_search(batch).count() == 3
    first = engine.explore("rust", "s1")
    top = first["results"].orderBy("ord").first()
    again = engine.explore("rust", "s1")["results"].where(F.col("hash") == top["hash"]).first()
    assert again["score"] == pytest.approx(0.3 * top["score"]) and engine.session_history("s1").count() == 2


def test_metadata_and_lookup(engine):
    docid = engine.get("python-intro.md").first()["hash"][:6]
    engine.metadata_add(docid, {"level": 3, "tags": ["a"]})
    assert engine.metadata_query("level:gt=2").first()["path"] == "python-intro.md"
    engine.metadata_remove(docid, "level")
    assert json.loads(engine.metadata_get(docid).first()["user_metadata"]).keys() == {"tags"}
    engine.metadata_clear(docid)
    assert engine.metadata_get(docid).first()["user_metadata"] is None
    assert engine.get("docs/rust-async.md", 1, 1).first()["body"] == "# Rust Async"
    assert engine.multi_get("rust-*.md").count() == 2 and engine.multi_get("RUST", fuzzy=True).count() == 2
    assert dict((r["path"], round(r["importance"], 2)) for r in engine.importance().collect())["rust-async.md"] == 0.78
    engine.context_add("docs", "about")
    assert engine.context_list().count() == 1 and engine.context_check().count() == 0
    assert engine.browse_directory("docs").first()["file_count"] == 3 and engine.search_directories("docs").count() == 1


def test_sessions(engine):
    engine.session_start("t", 60)
    engine.session_set("t", "k", "v")
    assert engine.session_get("t").first()["context"] == {"k": "v"}
    engine.session_end("t")
    assert engine.session_get("t").count() == 0


def test_embedding_pipeline(engine):
    made = engine.embed(lambda texts: [[float(len(t)), 1.0, 2.0, 3.0] for t in texts], "m", force=True)
    assert made.count() == 3 and len(made.first()["embedding"]) == 4


def test_projection(spark):
    page = spark.createDataFrame([("One. Two.", "body", ["k"], "snip")], "summary string, body string, keywords array<string>, snippet string")
    assert tuple(project(page, "L0").first()) == ("One.", None, None, None)
    assert tuple(project(page, "L1").first()) == ("One. Two.", None, ["k"], "snip")
    assert tuple(project(page, "L2").first()) == ("One. Two.", "body", ["k"], None)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\nx,"a, b"\ny,c\n')
    rows = tabular.load_csv(spark, {"path": str(tmp_path / "a.csv")}).orderBy("uri").collect()
    assert [(r["uri"], r["title"], r["content"]) for r in rows] == [("csv://a.csv/row_1", "a.csv - Row 1", "name: x\nnote: a, b"), ("csv://a.csv/row_2", "a.csv - Row 2", "name: y\nnote: c")]
    (tmp_path / "b.json").write_text('[{"title": "T", "v": 1}, {"id": "i2"}, 5]')
    items = tabular.load_json(spark, {"path": str(tmp_path / "b.json")}).orderBy("uri").collect()
    assert [r["title"] for r in items] == ["T", "i2", "Item 2"]
    (tmp_path / "c.json").write_text('{"k": {"a": 1}, "l": 2}')
    keys = tabular.load_json(spark, {"path": str(tmp_path / "c.json"), "index_mode": "object"}).orderBy("uri").collect()
    assert [r["uri"] for r in keys] == ["json://c.json/key_k", "json://c.json/key_l"]
    assert tabular.load_json(spark, {"path": str(tmp_path / "c.json"), "index_mode": "full"}).count() == 1
    parts = spark.range(1).select(pages.repository_parts(F.lit("https://github.com/o/r/blob/main/docs/x.md")).alias("p")).first()["p"]
    assert tuple(parts) == ("o", "r", "blob", "main", "docs/x.md")
    registry = Registry.with_defaults()
    assert len(registry.loaders) == 7
    with pytest.raises(SourceError):
        registry.get("nothing")
    assert registry.fetch_item(spark, "csv", {"path": str(tmp_path / "a.csv")}, "csv://a.csv/row_2").count() == 1


def test_sinks(spark, tmp_path):
    page = spark.createDataFrame([("a.md", 'T "x"', 0.456, "abcdef", 0)], "path string, title string, score double, docid string, ord int")
    line = lambda form: sinks.lines(page, form).first()["line"]
    assert json.loads(line("json"))["score"] == 0.46 and line("csv") == '0.46,a.md,"T ""x""",abcdef' and line("files") == "#abcdef,0.46,a.md"
    assert line("xml").startswith("<result><docid>abcdef") and "**Path:** `a.md`" in line("md") and line("cli").startswith("46% a.md")
    for form in ("json", "csv", "xml", "md"):
        sinks.write(page, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_streams(spark, tmp_path):
    from siftwell.streaming import index, sessions

    source = str(tmp_path / "in")
    schema = "id long, collection string, path string, hash string, title string, body string, modified_at timestamp"
    make = lambda rows: spark.createDataFrame(rows, "id long, collection string, path string, hash string, title string, body string").withColumn("modified_at", F.current_timestamp())
    make([(1, "c", "a", "h1", "A", "rust"), (2, "c", "b", "h2", "B", "go")]).coalesce(1).write.mode("append").parquet(source)
    tables = Store(spark, str(tmp_path / "tables"))
    weights = {"title": 10.0, "body": 5.0}

    def drain():
        q = index.start_ingest(spark.readStream.schema(schema).parquet(source), tables, str(tmp_path / "ck"), weights)
        q.processAllAvailable()
        q.stop()

    drain()
    make([(1, "c", "a", "h9", "A", "python rust"), (3, "c", "d", "h3", "D", "rust")]).coalesce(1).write.mode("append").parquet(source)
    drain()
    docs = tables.read("documents")
    assert sorted((r["path"], r["hash"]) for r in docs.collect()) == [("a", "h9"), ("b", "h2"), ("d", "h3")]
    built = bm25.Index.build(docs, weights)
    assert sorted(map(tuple, tables.read("postings").select("id", "field", "term", "tf").collect())) == sorted(map(tuple, built.postings.collect()))

    events = str(tmp_path / "events")
    rows = [("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 50)] + [("z", "2024-01-01 03:00:00")]
    spark.createDataFrame(rows, "session string, t string").select("session", F.col("t").cast("timestamp").alias("created_at")).coalesce(1).write.parquet(events)
    stream = spark.readStream.schema("session string, created_at timestamp").parquet(events)
    q = sessions.session_windows(stream, 1800, watermark="1 minute").writeStream.format("memory").queryName("sess").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("select session, n from sess").collect()) == [("u", 1), ("u", 2)]
    q = sessions.session_state(spark.readStream.schema("session string, created_at timestamp").parquet(events)).writeStream.format("memory").queryName("state").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["session"], r["expired"]): r["n"] for r in spark.sql("select * from state").collect()}
    assert got[("u", False)] == 3 and got.get(("u", True), 3) == 3


# -- the kept index, chunks, memories


@pytest.fixture(scope="module")
def kept(spark, folder, tmp_path_factory):
    e = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("kept"))), embedder=embed, expander=lambda q: ["ownership", ("semantic", "python"), ("hyde", "async rust")])
    e.collection_add("docs", folder)
    e.update("docs")
    return e


def test_the_index_is_kept_and_follows_updates(kept, folder):
    assert kept.index() is not None
    plain = {r["id"]: r["relevance"] for r in bm25.search(kept.documents(), "rust", bm25.DOCUMENT_WEIGHTS).collect()}
    assert {r["id"]: r["relevance"] for r in kept.index().search("rust").collect()} == pytest.approx(plain) and len(plain) == 2
    path = os.path.join(folder, "late.md")
    with open(path, "w") as f:
        f.write("# Late\n\nRust comes late here, rust and zebra.\n")
    kept.update("docs")
    assert kept.search_bm25("zebra").first()["path"] == "late.md" and kept.search_bm25("rust").count() == 3
    with open(path, "w") as f:
        f.write("# Late\n\nOnly giraffes now.\n")
    kept.update("docs")
    assert kept.search_bm25("zebra").count() == 0 and kept.search_bm25("giraffes").count() == 1
    os.remove(path)
    kept.update("docs")
    assert kept.search_bm25("giraffes").count() == 0 and kept.search_bm25("rust").count() == 2
    before = {r["id"]: r["relevance"] for r in kept.index().search("rust").collect()}
    kept.index().compact()
    assert {r["id"]: r["relevance"] for r in kept.index().search("rust").collect()} == pytest.approx(before) and before == pytest.approx(plain)
    assert kept.tables.read("index_dead").count() == 0


def test_chunks_vectors_and_expansions(kept):
    assert kept.cleanup()["chunks"] == 2  # of the two texts that went
    assert kept.table("chunks").count() == 3 and kept.table("chunks").where("summary is not null").count() == 3
    made = kept.embed(lambda texts: [[0.1 + t.lower().count(w) for w in ("rust", "python", "async", "error")] for t in texts], "m")
    assert made.count() == 3 and kept.table("embeddings").count() == 3 and kept.embed(lambda texts: 1 / 0, "m").count() == 0
    again = kept.embed(lambda texts: 1 / 0, "m", force=True)
    assert again.count() == 3 and again.where("cached").count() == 3
    best = kept.search_chunks_vector("python", 2).first()
    assert best["path"] == "python-intro.md" and best["chunk_hash"] and kept.search_chunks_vector("python", 2, collection="none").count() == 0
    assert kept.chunk_documents_of(kept.search_chunks("ownership")).first()["path"] == "rust-intro.md"
    assert kept.get_chunk(label=("type", "text")).count() == 3
    assert kept.search_hybrid("what is rust", 5).count() >= 2 and kept.search_hybrid_plain("rust", 5).count() == 3
    assert kept.smart("rust in the last 2 weeks", 5).count() >= 1 and kept.smart("rust before 2 weeks ago", 5).count() == 0
    kept.describe()
    assert kept.search_bm25("describes").count() == 3 and kept.table("concept_chunks").count() > 0
    page = kept.search_bm25("rust")
    assert kept.post_filtered(page, category="TUTOR").count() >= 1 and kept.post_filtered(page, concept="RUS").count() == 2 and kept.post_filtered(page, difficulty="Advanced").count() == 0
    kept.store_importance()
    assert kept.documents().where("importance > 0.7").count() == 1 and kept.table("document_links").count() == 1
    kept.migrate()
    assert kept.cleanup()["chunks"] == 0


def test_memories(kept):
    rows = [("a", "fact", "one", 0.5, 1), ("b", "entity", "two", 0.6, 2), ("c", "decision", "three", 0.6, 3), ("d", "fact", "four", 1.5, 4), ("e", "fact", "", 0.5, 5), ("f", "pattern", "one", 0.9, 6)]
    frame = lambda r: kept.spark.createDataFrame(r, "id string, category string, content string, confidence double, ord long")
    kept.memory_store(frame(rows))
    got = {r["content"]: (r["id"], r["category"], r["confidence"], r["access_count"]) for r in kept.memory_list().collect()}
    assert got == {"one": ("a", "fact", 0.9, 1), "two": ("b", "entity", 0.6, 0)}
    kept.memory_store(frame([("z", "fact", "two", 0.1, 1)]))
    assert kept.memory_list(1).first()["id"] == "b" and kept.memory_list().where("content = 'two'").first()["access_count"] == 1
    kept.explore("rust", "m1")
    kept.memory_extract("m1", lambda queries: f'Here: [{{"category": "preference", "content": "likes {queries[0]}", "confidence": 0.8}}, {{"category": "x", "content": "y", "confidence": 1}}] done')
    assert kept.memory_search("likes").first()["content"] == "likes rust" and kept.memory_list(category="preference").count() == 1
    kept.memory_extract("m1", lambda queries: "nothing")
    assert kept.memory_get("a").first()["access_count"] == 2 and kept.table("memories").count() == 3


def test_a_stopped_write_changes_nothing(spark, tmp_path, monkeypatch):
    tables = Store(spark, str(tmp_path))
    tables.write("contexts", spark.createDataFrame([("a", "1")], "path string, context string"))
    monkeypatch.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        tables.write("contexts", spark.createDataFrame([("b", "2")], "path string, context string"))
    assert tables.read("contexts").first()["path"] == "a"
    monkeypatch.undo()
    tables.write("contexts", spark.createDataFrame([("b", "2")], "path string, context string"))
    tables.append("contexts", spark.createDataFrame([("c", "3")], "path string, context string"))
    assert sorted(r["path"] for r in tables.read("contexts").collect()) == ["b", "c"]
