"""Query cleaning, titles, sentences, snippets, globs, strategies."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.errors import InvalidInput
from siftwell.functions import snippets
from siftwell.functions import text as X
from siftwell.operators import filters
from siftwell.plans import strategy, workflow


def test_inline_filters():
    assert X.parse_filters("just a regular query") == ("just regular query", [])
    assert X.parse_filters("error handling category:code difficulty:beginner") == ("error handling", [("category", "code"), ("difficulty", "beginner")])
    assert X.parse_filters("http://example.com test") == ("http://example.com test", [])
    assert X.sanitise_query("What is (this)?") == "" and X.sanitise_query("  ") == "  "


@given(st.text(alphabet="abc the?!()[]: ", max_size=40))
def test_sanitise_is_idempotent(q):
    assert X.sanitise_query(X.sanitise_query(q)) == X.sanitise_query(q)


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_columns(spark):
    assert one(spark, X.sanitised(F.lit("How does a map work?"))) == "map work"
    assert one(spark, X.first_sentence(F.lit("Hello world. More text."))) == "Hello world."
    assert one(spark, X.first_sentence(F.lit("x" * 150 + " " + "y" * 100))) == "x" * 150 + "..."
    assert one(spark, X.heading_title(F.lit("# Notes\n\n## Real title\n"), F.lit("a/b.md"))) == "Real title"
    assert one(spark, X.heading_title(F.lit("text"), F.lit("a/my-file_name.md"))) == "my file name"
    assert one(spark, X.slug(F.lit("Docs/My File___x.MD"))) == "docs/my-file/x.md"
    assert one(spark, X.parent_dir(F.lit("a/b/c"))) == "a/b" and one(spark, X.parent_dir(F.lit("c"))) == "."
    assert one(spark, X.csv_field(F.lit('a "b",c'))) == '"a ""b"",c"'
    assert one(spark, X.xml_text(F.lit("<a & 'b'>"))) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, X.language_of(F.lit("src/x.tsx"))) == "tsx"
    assert one(spark, X.inline_filters(F.lit("a Category:X tag:y z:1"))) == ["category:X", "tag:y"]
    assert one(spark, X.code_query(F.lit("a::b->c<d>"))) == "a b c d "
    assert one(spark, X.token_estimate(F.lit("abcdefgh"))) == 2
    assert one(spark, X.page_title(F.lit("https://x.org/a/b?q=1"), F.lit("<p>no</p>"))) == "b"


def test_globs():
    import re

    match = lambda g, p: bool(re.match(X.glob_regex(g), p))
    assert match("**/*.md", "a.md") and match("**/*.md", "a/b.md") and match("*.md", "a/b.md") and not match("*.md", "a.mdx")
    assert match("src/{a,b}?.py", "src/a1.py") and not match("src/{a,b}.py", "src/c.py") and match("[!x]*.rs", "ab.rs")


def test_snippets():
    text = "word " * 100 + "needle here " + "tail " * 100
    out, start, end = snippets.snippet(text, "NEEDLE")
    assert "needle" in out and out.startswith("...") and out.endswith("...") and end - start <= 520
    assert snippets.snippet("short", "x") == ("short", 0, 5)
    assert snippets.match_position("Straße zum needle", "needle zz") == len("Straße zum ".encode())
    assert len(snippets.truncated("x" * 9000)) <= 8000 and snippets.truncated("ab") == "ab"


@given(st.text(max_size=400), st.text(max_size=5))
@settings(max_examples=60)
def test_snippet_never_breaks(text, query):
    out, start, end = snippets.snippet(text, query, 50)
    assert 0 <= start <= end <= len(text.encode())


def test_times():
    now = dt.datetime(2024, 3, 31, 12)
    assert filters.parse_time("1 month ago", now) == dt.datetime(2024, 2, 29, 12)
    assert filters.parse_time("2 weeks ago", now) == now - dt.timedelta(days=14)
    assert filters.parse_time("4 years ago", now) == now - dt.timedelta(days=4 * 365 + 1)
    assert filters.parse_time("2024-01-01", now) == dt.datetime(2024, 1, 1) and filters.parse_time("2024-01-01T02:00:00+02:00", now) == dt.datetime(2024, 1, 1)
    assert filters.parse_time("soon", now) is None and filters.parse_time("some days ago", now) is None and filters.parse_time("", now) is None


def test_strategies(spark):
    cases = {"how to parse json": ("vector", "document"), "std::vec": ("hybrid", "chunk"), "plain words": ("hybrid", "both"), "HttpClient retry": ("hybrid", "chunk")}
    for q, want in cases.items():
        got = strategy.heuristic_strategy(q, True)
        assert (got.strategy, got.granularity) == want
        s, g = strategy.strategy_columns(F.lit(q))
        assert (one(spark, s), one(spark, g)) == want
    assert strategy.heuristic_strategy("x", False).strategy == "bm25"
    kinds = lambda q, e: [s.kind for s in workflow.fallback_workflow(q, e).steps]
    assert kinds("getString", False) == ["bm25_chunk_search"] and kinds("words", False) == ["bm25_search"] and kinds("what now", True) == ["vector_search"]
    assert kinds("fn main", True) == ["bm25_chunk_search", "bm25_search", "merge", "deduplicate", "limit"] and kinds("words", True) == ["hybrid_search"]


def test_planner_answers():
    w = workflow.parse_workflow('Sure: {"steps": [{"step": "bm25_search", "query": "x"}, {"step": "limit", "count": 3}], "reasoning": "r"}')
    assert [s.kind for s in w.steps] == ["bm25_search", "limit"] and w.reasoning == "r"
    with pytest.raises(InvalidInput):
        workflow.parse_workflow("none")
    assert workflow.plan("words", False, lambda q: "no json").steps[0].kind == "bm25_search"
