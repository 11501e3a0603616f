"""Operators on literal rows."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.config import Config
from siftwell.errors import InvalidInput
from siftwell.operators import bm25, chunking, context, filters, fusion, graph, rollups, sessions, store, vector


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_bm25_closed_form(spark):
    docs = spark.createDataFrame([(1, "rust rust rust", "a b"), (2, "other", "rust is rust"), (3, "x", "y z")], "id long, title string, body string")
    got = dict(rows(bm25.search(docs, "Rust", {"title": 10.0, "body": 5.0}), "id", "relevance"))
    lengths, n, df = {1: 5, 2: 4, 3: 3}, 3, 2
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
    for i, f in ((1, 30.0), (2, 10.0)):
        assert got[i] == pytest.approx(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[i] / 4)))
    index = bm25.Index.build(docs, {"title": 10.0, "body": 5.0})
    queries = spark.createDataFrame([(7, "rust"), (8, "rust other"), (9, "nothing")], "query_id long, query string")
    scored = sorted(rows(index.score(bm25.query_terms(queries)), "query_id", "id"))
    assert scored == [(7, 1), (7, 2), (8, 2)]
    fielded = bm25.query_terms(queries.limit(1)).withColumn("field", F.lit("body"))
    assert rows(index.score(fielded), "id") == [(2,)]
    assert bm25.search(docs, " ", {"title": 1.0}).count() == 0


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"w{i % 3} common") for i in range(20)], "id long, title string, body string")
    index = bm25.Index.build(docs, {"title": 10.0, "body": 5.0})
    index.write(str(tmp_path), 4)
    again = bm25.Index.read(spark, str(tmp_path), index.weights)
    q = bm25.query_terms(spark.createDataFrame([(1, "w1 common")], "query_id long, query string"))
    assert sorted(rows(index.score(q), "id", "relevance")) == sorted(rows(again.score(q), "id", "relevance"))
    assert sorted(rows(again.search("W1 common"), "id", "relevance")) == sorted(rows(index.score(q), "id", "relevance")) and again.search("?").count() == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([1.0, 1.0], [-1.0, -1.0])], "a array<double>, b array<double>")
    assert [pytest.approx(x[0]) for x in rows(df.select(vector.cosine(F.col("a"), F.col("b")).alias("x")), "x")] == [1, 0, 0, -1]


def test_boost_stops_at_the_path(spark):
    df = spark.createDataFrame([(1.0, 1.0, "docs", "a/mcp.md", "about rust")], "s double, i double, c string, p string, t string")
    boost = lambda q: df.select(vector.boosted(F.col("s"), F.col("i"), F.col("c"), F.col("p"), F.col("t"), q).alias("x")).first()["x"]
    assert boost("rust mcp about") == pytest.approx(1.5 * 4 * 10) and boost("zz") == pytest.approx(1.5)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, rank int")
    got = dict(rows(fusion.rrf(a, b), "id", "score"))
    assert got[2] == pytest.approx(2 / 62 + 0.05 + 1 / 61 + 0.05) and got[1] == pytest.approx(2 / 61 + 0.05)
    assert [r[0] for r in sorted(rows(fusion.merge_append([a, b]), "id", "ord"), key=lambda r: r[1])] == [1, 2, 3]
    assert [r[0] for r in sorted(rows(fusion.merge_interleave([a, b], round_robin=True), "id", "ord"), key=lambda r: r[1])] == [1, 2, 3]
    page = spark.createDataFrame([(0.9,), (0.7,)], "score double")
    assert fusion.strong_signal(page).first()["strong"] and not fusion.strong_signal(page.where("score < 0.8")).first()["strong"]
    assert not fusion.strong_signal(page.limit(0)).first()["strong"]


def test_sessions(spark):
    page = spark.createDataFrame([(1, "a", 0.9, "x/1", 0), (2, "b", 0.5, "x/2", 1), (3, "c", 0.5, "y/1", 2), (4, "d", 0.5, "x/9", 3)], "id long, hash string, score double, path string, ord int")
    seen = spark.createDataFrame([("a",)], "h string")
    demoted = rows(sessions.demote_seen(page, seen), "hash", "score")
    assert demoted[-1] == ("a", pytest.approx(0.27)) and demoted[0][0] == "b"
    assert dict(rows(sessions.directory_boost(page), "id", "score"))[4] == pytest.approx(0.575)
    assert sessions.refinements("login flow", ["auth", "login"]) == ["login flow auth"]
    log = sessions.log_row(page, "s", "q").first()
    assert (log["result_count"], log["top_results"]) == (4, ["a", "b", "c", "d"])
    marked = sessions.mark_seen(spark.createDataFrame([], "session_id string, document_hash string, seen_at timestamp"), page, "s")
    assert marked.count() == 4
    facts = spark.createDataFrame([("m1", "fact", "x", 0.2, 1), ("m2", "preference", "x", 0.9, 2), ("m3", "zzz", "y", 0.5, 3)], "id string, category string, content string, confidence double, ord long")
    kept = sessions.upsert_memories(sessions.valid_memories(facts)).collect()
    assert len(kept) == 1 and (kept[0]["id"], kept[0]["confidence"], kept[0]["access_count"]) == ("m1", 0.9, 1)


def test_metadata():
    M = filters.Metadata
    a = M().text("author", "Alice").integer("version", 1)
    merged = a.merge(M().text("author", "Bob").tags("labels", ["rust"]))
    assert merged.get("author")["value"] == "Bob" and "version" in merged and "labels" in merged
    assert M.from_json(merged.to_json()).fields == merged.fields
    with pytest.raises(InvalidInput):
        M().enum("e", "x", ["a"])
    assert filters.formatted(M.parse_argument("quantitative", "size=3:kg").get("size")) == "3 kg"
    assert M.coerce({"a": 1, "b": True, "c": "x", "d": ["y"]}).get("b")["type"] == "Boolean"


def test_predicates(spark):
    M, P = filters.Metadata, filters.Predicate
    made = M().text("author", "Alice").integer("v", 3).float("s", 0.5).boolean("p", True).datetime("t", "2024-01-02T00:00:00Z").tags("l", ["a", "b"]).enum("e", "x", ["x", "y"])
    df = spark.createDataFrame([(made.to_json(),), (None,)], "m string")
    check = lambda p: [r["x"] for r in df.select(p.column(F.col("m")).alias("x")).collect()]
    true = ["v:eq=3", "v:gt=2", "s:lt=0.7", "author:contains=lic", "t:after=2024-01-01", "t:before=2024-02-01", "l:has=a", "e:eq=x", "author:exists", "p:eq=true"]
    for text in true:
        assert check(filters.parse_predicate(text)) == [True, False], text
    for text in ("v:eq=4", "author:eq=x", "zz:exists", "l:has=c", "t:after=2025-01-01"):
        assert check(filters.parse_predicate(text)) == [False, False], text
    p, q = P("tags_all", "l", ["a", "b"]), P("tags_any", "l", ["z"])
    assert check(p & ~q) == [True, False] and check(~(p & q)) == check(~p | ~q)
    with pytest.raises(InvalidInput):
        filters.parse_predicate("nonsense")
    merged = df.select(filters.merged(F.col("m"), F.lit('{"author":{"type":"Text","value":"Bob"}}')).alias("x")).first()["x"]
    assert M.from_json(merged).get("author")["value"] == "Bob" and M.from_json(merged).get("v")["value"] == 3
    assert "author" not in M.from_json(df.select(filters.without(F.col("m"), "author").alias("x")).first()["x"])


def test_guard_and_time(spark):
    df = spark.createDataFrame([(i, "code" if i == 0 else "docs", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) if i else None) for i in range(20)], "id long, category string, modified_at timestamp")
    assert filters.guarded(df, filters.metadata_step(category="CODE")).count() == 20
    assert filters.guarded(df, filters.metadata_step(category="docs")).count() == 19
    assert filters.guarded(df.limit(0), F.lit(True)).count() == 0
    inside = filters.temporal(df, dt.datetime(2024, 1, 1, 3), dt.datetime(2024, 1, 1, 5))
    assert sorted(r[0] for r in rows(inside, "id")) == [0, 3, 4, 5]


def test_store_and_diff(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    old = spark.createDataFrame([("c", "a", "1", True), ("c", "b", "2", True), ("c", "d", "4", False)], "collection string, path string, hash string, active boolean")
    new = spark.createDataFrame([("c", "a", "1"), ("c", "b", "9"), ("c", "e", "5"), ("c", "d", "4")], "collection string, path string, hash string")
    s.write("documents", old)
    changes = store.diff(s.read("documents"), new)
    assert dict(rows(changes, "path", "action")) == {"a": "skip", "b": "update", "e": "insert", "d": "reactivate"}
    s.write("documents", store.apply_diff(s.read("documents"), new, changes))
    assert dict(rows(s.read("documents"), "path", "hash")) == {"a": "1", "b": "9", "d": "4", "e": "5"}
    s.vacuum("documents")
    assert s.read("documents").where("active").count() == 4 and s.read("concepts").count() == 0
    gone = store.diff(old, new.where("path = 'a'"))
    assert dict(rows(gone, "path", "action")) == {"a": "skip", "b": "delete", "d": "skip"}
    updated = store.update_columns(old, spark.createDataFrame([("a", "77")], "path string, hash string"), "path", ["hash"])
    assert dict(rows(updated, "path", "hash"))["a"] == "77"


def test_graph(spark):
    docs = spark.createDataFrame(
        [(1, "c", "docs/a.md", "[b](b.md) [web](https://x) [r](../README.md#top) [again](./b.md)"), (2, "c", "docs/b.md", ""), (3, "c", "README.md", "[a](docs/a.md)"), (4, "c", "src/lib.rs", "mod x;\npub mod y;"), (5, "c", "src/x.rs", ""), (6, "c", "m.py", "from pkg.sub import z"), (7, "c", "pkg/sub.py", "")],
        "id long, collection string, path string, body string",
    )
    edges = graph.link_edges(graph.links(docs), docs)
    assert sorted(rows(edges, "source_id", "target_id")) == [(1, 2), (1, 3), (3, 1), (4, 5), (6, 7)]
    scores = dict(rows(graph.importance(docs, edges), "id", "importance"))
    assert scores[3] == pytest.approx(2.0 * 1.3) and scores[2] == pytest.approx(1.8 * 1.3) and scores[4] == 1.0


def test_directories(spark):
    docs = spark.createDataFrame([("c", "src/auth/login.rs", True, "code", ["x"]), ("c", "src/auth/jwt.rs", True, "code", ["y"]), ("c", "src/db/query.py", True, None, []), ("c", "src/lib.rs", True, "doc", []), ("c", "old/x.rs", False, None, [])], "collection string, path string, active boolean, category string, concepts array<string>")
    got = {r["path"]: r for r in rollups.directories(docs).collect()}
    assert set(got) == {"c/src/auth", "c/src/db", "c/src"} and got["c/src"]["child_dir_count"] == 2 and got["c/src/auth"]["file_count"] == 2
    assert got["c/src/auth"]["concepts"] == ["x", "y"] and got["c/src/db"]["dominant_language"] == "py" and got["c/src/db"]["dominant_category"] is None


def test_contexts(spark):
    paths = spark.createDataFrame([("a/b/c",), ("z",)], "path string")
    contexts = spark.createDataFrame([("a", "A"), ("a/b", "AB"), ("q", "Q")], "path string, context string")
    assert dict(rows(context.longest_prefix(paths, contexts), "path", "context")) == {"a/b/c": "AB", "z": None}
    assert dict(rows(context.inherited(paths, contexts, global_context="G"), "path", "context")) == {"a/b/c": "G\n\nA\n\nAB", "z": "G"}
    assert context.missing_context(paths.withColumnRenamed("path", "name"), contexts.union(spark.createDataFrame([("/", "all")], "path string, context string"))).count() == 0


@given(st.text(alphabet="ab é\n.", max_size=600), st.integers(20, 80))
@settings(max_examples=60)
def test_windows_cover_the_text(text, size):
    chunks = chunking.windows(text, size, size // 4)
    raw, at = text.encode(), 0
    for c in chunks:
        assert c.pos <= at and raw[c.pos : c.pos + len(c.text.encode())] == c.text.encode()
        at = max(at, c.pos + len(c.text.encode()))
    assert at == len(raw)


def test_source_chunks():
    rust = "use x;\n\n/// Adds.\npub fn add(a: i32) -> i32 {\n    a + 1 // }\n}\n\nimpl Foo {\n    fn bar(&self) { }\n}\nstruct P { x: i32 }\n"
    got = [(c.kind, c.breadcrumb) for c in chunking.cut(rust, "a.rs")]
    assert got == [("function", "add"), ("impl", "Foo"), ("method", "Foo::bar"), ("struct", "P")]
    assert chunking.cut(rust, "a.rs")[0].leading == "/// Adds."
    py = "@d\ndef f():\n    pass\n\nclass A:\n    def g(self):\n        return 1\n"
    assert [(c.kind, c.breadcrumb, c.start_line) for c in chunking.cut(py, "a.py")] == [("function", "f", 1), ("class", "A", 5), ("method", "A::g", 6)]
    js = "export function foo() { return '}'; }\nclass B { m() {} }\nconst go = (x) => { return x; };\ninterface I { a: string }\n"
    assert [(c.kind, c.breadcrumb) for c in chunking.cut(js, "a.ts")] == [("function", "foo"), ("class", "B"), ("function", "go"), ("interface", "I")]
    go = "package p\nfunc F() {}\nfunc (r *Recv) M() {}\ntype S struct { a int }\ntype I interface { M() }\n"
    assert [(c.kind, c.breadcrumb) for c in chunking.cut(go, "a.go")] == [("function", "F"), ("method", "Recv::M"), ("struct", "S"), ("interface", "I")]
    assert [c.kind for c in chunking.cut("def broken(:", "a.py")] == ["text"]
    big = "fn big() {\n" + "    let x = 1;\n" * 600 + "}\n"
    pieces = chunking.cut(big, "b.rs")
    assert len(pieces) > 1 and pieces[0].breadcrumb == "big[0]" and pieces[-1].end_line >= 600


def test_config(tmp_path):
    path = str(tmp_path / "c.yml")
    Config(limit=7, contexts={"a": "A", "a/b": "AB"}, global_context="G").save(path)
    c = Config.load(path, {"SIFTWELL_MIN_SCORE": "0.5"})
    assert c.limit == 7 and c.min_score == 0.5 and c.context_for("a/b/x") == "G\n\nA\n\nAB"


def test_rows_of_large_tables_are_numbered_once_in_order(spark, tmp_path):
    from siftwell.sources.tabular import row_documents

    n = 200_000
    table = spark.range(0, n, numPartitions=8).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    table.write.parquet(str(tmp_path / "t"))
    got = row_documents(spark.read.parquet(str(tmp_path / "t")), "a.csv", order="k").select(F.col("metadata")["k"].cast("long").alias("k"), F.regexp_extract("title", r"(\d+)$", 1).cast("long").alias("n"), "content")
    assert got.agg(F.count("*"), F.count_if(F.expr("n = k + 1")), F.min(F.length("content"))).first()[:] == (n, n, 72)
    few = spark.createDataFrame([(None, "b"), ("x", "b"), ("x", "a"), ("w", "c"), ("x", "a")], "k string, t string")
    found = sorted((int(r["title"].split()[-1]), r["metadata"]["k"]) for r in row_documents(few, "a", order="k").collect())
    assert found == [(1, ""), (2, "w"), (3, "x"), (4, "x"), (5, "x")]
    assert row_documents(few.limit(0), "a", order="k").collect() == []


def test_a_buckets_postings_are_written_by_size(spark, tmp_path):
    from siftwell.operators.search_index import SearchIndex

    docs = spark.range(0, 2000, numPartitions=8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("title"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 30).cast("array<string>")).alias("body"))
    name, kept = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set(name, "16k")
    try:
        index = SearchIndex(store.Store(spark, f"file://{tmp_path}"), {"title": 10.0, "body": 5.0}, buckets=1, parts=1).build(docs)
    finally:
        spark.conf.set(name, kept)
    assert len(index.tables.read("index_postings").inputFiles()) > 4
    assert sorted(r["id"] for r in index.search("40 50").collect()) == list(range(20, 41))


def test_many_queries_are_scored_like_each_alone(spark):
    words = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 6)), f"common w{i % 3} w{i % 3}") for i in range(60)] + [(60, None, "")]
    docs = spark.createDataFrame(words, "id long, title string, body string")
    weights = {"title": 10.0, "body": 5.0}
    entries = bm25.entries(docs, list(weights))
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    flat = {(r["id"], f, r["term"], n) for r in entries.collect() for f, n in zip(weights, r["hits"]) if n}
    assert flat == set(map(tuple, bm25.postings(docs, weights).collect()))
    queries = [(1, "common w1"), (2, "w2 w4 w6"), (3, "common absent"), (4, "common"), (5, "w0 w0 common"), (6, "")]
    index = bm25.Index.build(docs, weights)
    got = {(r["query_id"], r["id"]): r["relevance"] for r in index.score(bm25.query_terms(spark.createDataFrame(queries, "query_id long, query string"))).collect()}
    want = {(q, r["id"]): r["relevance"] for q, text in queries for r in bm25.search(docs, text, weights).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    fielded = spark.createDataFrame([(1, "w1", 2, "title"), (1, "w1", 2, None)], "query_id long, term string, n_terms int, field string")
    assert {r["id"] for r in index.score(fielded).collect()} == {i for i, t, _ in words if t and "w1" in t.split()}
