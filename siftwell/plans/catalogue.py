"""The engine's queries over the driver's tables, and the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators import bm25, context, filters, fusion, glossary, graph, rollups, sessions, store, vector
from siftwell.operators.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FIELDS = {"title": 10.0, "body": 5.0}
#: Words that the driver's tables hold, and a vector of them to look for.
QUERY, RARE, VECTOR_ID = "this with", "thnt", 7


def query(oracle: str | None = None, views: bool = True):
    def register(f: Callable[[Views], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = (SQL + oracle) if views else oracle
        return f

    return register


def r6(c):
    return F.round(c, 6)


# -- scans, lookups, listings -----------------------------------------------------------------------


@query("select id, collection, path, docs.hash, length(doc) as n_chars from docs join content on docs.hash = content.hash where active")
def scan_documents_active(v: Views) -> DataFrame:
    return v.active().drop("body", "n_chars").join(v.content(), "hash").select("id", "collection", "path", "hash", F.length("doc").cast("long").alias("n_chars"))


@query("select hash, length(doc) as n_chars from content")
def content_dedup(v: Views) -> DataFrame:
    return v.content().select("hash", F.length("doc").cast("long").alias("n_chars"))


@query("select id, substring(hash, 1, 6) as docid, hash from docs")
def hash_docid(v: Views) -> DataFrame:
    return v.documents().select("id", X.docid(F.col("hash")).alias("docid"), "hash")


@query("select id, path from docs where active and hash like (select substring(hash, 1, 6) from docs where id = 11) || '%' order by id limit 1")
def docid_lookup(v: Views) -> DataFrame:
    # the docid is what a user types; here it is taken from document 11
    wanted = v.documents().where("id = 11").select(X.docid(F.col("hash")).alias("d"))
    return v.active().join(F.broadcast(wanted), F.col("hash").startswith(F.col("d"))).orderBy("id").limit(1).select("id", "path")


@query("select id, collection || '/' || path as full_path from docs where active and (collection || '/' || path) like 'src3/en/%'")
def prefix_listing(v: Views) -> DataFrame:
    return context.by_prefix(v.documents(), "src3/en/").select("id", "full_path")


@query("select id, path from docs where active and (regexp_matches(path, '^(en|fr)/d[12]/.*[.]md$') or regexp_matches(collection || '/' || path, '^src5/.*[.]md$'))")
def glob_multi_get(v: Views) -> DataFrame:
    return context.by_pattern(v.documents(), "{en,fr}/d[12]/*.md, src5/**/*.md").select("id", "path")


@query("select id, path from docs where active and (lower(path) like '%d3/1%' or lower(title) like '%d3/1%') order by length(path), id limit 10")
def fuzzy_find(v: Views) -> DataFrame:
    return context.fuzzy(v.documents(), "D3/1", 10).select("id", "path")


@query("select id, path, 2 as way from docs where active and path = 'en/d1/1.md' limit 1")
def lookup_chain(v: Views) -> DataFrame:
    return context.lookup(v.documents(), "en/d1/1.md").select("id", "path", "way")


@query("select id, array_to_string(list_slice(string_split(body, chr(10)), 2, 4), chr(10)) as body from docs where active and octet_length(encode(body)) <= 4000")
def line_slice(v: Views) -> DataFrame:
    return context.line_slice(v.active(), 2, 3, most_bytes=4000).select("id", "body")


@query("select id, 'doc://' || collection || '/' || path as uri, collection as coll_back, path as path_back from docs")
def virtual_paths(v: Views) -> DataFrame:
    built = v.documents().select("id", X.virtual_path(F.col("collection"), F.col("path")).alias("uri"))
    coll, path = X.split_virtual_path(F.col("uri"))
    return built.select("id", "uri", coll.alias("coll_back"), path.alias("path_back"))


@query("select id, path, 'md' as ext, regexp_replace(path, '/[^/]*$', '') as dir, collection || '-' || lang as slugged from docs")
def path_functions(v: Views) -> DataFrame:
    return v.documents().select("id", "path", X.extension(F.col("path")).alias("ext"), X.parent_dir(F.col("path")).alias("dir"), X.slug(F.concat("collection", F.lit("?"), F.upper("lang"))).alias("slugged"))


@query(
    r"""select id, case when trim(regexp_extract(m, '(?m)^##?[ \t]+(.+)$', 1)) <> '' then trim(regexp_extract(m, '(?m)^##?[ \t]+(.+)$', 1)) else regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '[-_]', ' ', 'g') end as title
    from (select id, path, case when id % 3 = 0 then '## ' || title || chr(10) || 'text' else title end as m from docs)"""
)
def title_extract(v: Views) -> DataFrame:
    marked = v.documents().withColumn("m", F.when(F.col("id") % 3 == 0, F.concat(F.lit("## "), "title", F.lit("\ntext"))).otherwise(F.col("title")))
    return marked.select("id", X.heading_title(F.col("m"), F.col("path")).alias("title"))


@query("select page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), url) as title from pages", views=False)
def url_titles(v: Views) -> DataFrame:
    from siftwell.sources.pages import load_pages

    return load_pages(v.table("pages")).select(F.col("id").alias("page_id"), "title")


@query("select c_custkey as id, 'customer.csv - Row ' || row_number() over (order by c_custkey) as title, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment as content from customer", views=False)
def csv_rows_as_documents(v: Views) -> DataFrame:
    from siftwell.sources.tabular import row_documents

    rows = v.table("customer").select("c_custkey", "c_name", "c_mktsegment")
    items = row_documents(rows, "customer.csv", order="c_custkey")
    return items.select(F.col("metadata")["c_custkey"].cast("long").alias("id"), "title", "content")


@query("select p_partkey as id, p_name as title, p_type as content, sha256(p_type) as hash from part where trim(p_type) <> '' and p_size > 10", views=False)
def sql_rows_as_documents(v: Views) -> DataFrame:
    from siftwell.sources.tabular import query_documents

    v.table("part").createOrReplaceTempView("siftwell_part")
    items = query_documents(v.spark, "select P_PARTKEY, p_name, p_type from siftwell_part where p_size > 10", {"id_column": "p_partkey", "title_column": "p_name", "content_column": "p_type"})
    return items.select(F.col("uri").cast("long").alias("id"), "title", "content", "hash")


@query("select event_id as id, 'Item ' || event_id as title, cast(json_extract(props, '$.k') as bigint) as k from events", views=False)
def json_props_as_documents(v: Views) -> DataFrame:
    from siftwell.sources.tabular import json_documents

    rows = v.table("events").select(F.col("event_id").alias("id"), F.col("props").alias("json"))
    return json_documents(rows).select("id", "title", F.get_json_object("content", "$.k").cast("long").alias("k"))


# -- maintenance ------------------------------------------------------------------------------------

_INCOMING = """, incoming as (
    select collection, path, case when id % 5 = 0 then sha256(body || '!') else hash end as hash from docs where id % 11 <> 3
    union all select 'src0', 'new/' || id || '.md', hash from docs where id % 50 = 1
)
"""


def _incoming(v: Views) -> DataFrame:
    d = v.documents()
    changed = F.when(F.col("id") % 5 == 0, F.sha2(F.concat("body", F.lit("!")), 256)).otherwise(F.col("hash"))
    new = d.where("id % 50 = 1").select(F.lit("src0").alias("collection"), F.concat(F.lit("new/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), "hash")
    return d.where("id % 11 <> 3").select("collection", "path", changed.alias("hash")).unionByName(new)


@query(
    _INCOMING
    + """select collection, path, case when d.hash is null then 'insert' when i.hash is null then case when active then 'delete' else 'skip' end
         when not active then 'reactivate' when d.hash <> i.hash then 'update' else 'skip' end as action
    from docs d full outer join incoming i using (collection, path)"""
)
def cdc_reindex_actions(v: Views) -> DataFrame:
    return store.diff(v.documents(), _incoming(v)).select("collection", "path", "action")


@query("select hash from content where hash not in (select hash from docs where active and id % 4 <> 0)")
def soft_delete_gc(v: Views) -> DataFrame:
    live = store.soft_delete(v.documents(), F.col("id") % 4 == 0)
    return store.orphans(v.content().select("hash"), store.hard_delete(live))


@query("select hash, min(path) as path from docs where active and hash not in (select hash from docs join embeddings on id = vec_id) group by hash")
def needs_embedding_anti(v: Views) -> DataFrame:
    embedded = v.documents().join(v.vectors().select("id"), "id", "left_semi").select("hash")
    return store.needs_embedding(v.documents(), embedded)


@query("select count(*) as n, count(*) filter (where e.hash is not null) as hits, round(count(*) filter (where e.hash is not null) / count(*), 6) as hit_rate from (select distinct hash from docs) d left join (select distinct hash from docs join embeddings on id = vec_id) e using (hash)")
def embedding_cache_hits(v: Views) -> DataFrame:
    requests = v.documents().select("hash").distinct()
    cache = v.documents().join(v.vectors(), "id").select("hash", F.lit(1).alias("vector")).dropDuplicates(["hash"])
    hits, misses = store.cache_split(requests, cache, ["hash"], "vector")
    both = hits.select("hash", F.lit(True).alias("cached")).unionByName(misses.select("hash", F.lit(False).alias("cached")))
    stats = store.embed_stats(both)
    return stats.select(F.col("chunks").alias("n"), F.col("cached_chunks").alias("hits"), r6(F.col("hit_rate") / 100).alias("hit_rate"))


@query(_INCOMING + "select distinct hash from incoming where hash not in (select hash from content)")
def ingest_new_content(v: Views) -> DataFrame:
    return store.new_content(_incoming(v).select("hash"), v.content())


@query(_INCOMING + "select collection, path, coalesce(i.hash, d.hash) as hash, i.hash is not null as active from docs d full outer join incoming i using (collection, path)")
def ingest_apply_diff(v: Views) -> DataFrame:
    current, incoming = v.documents().select("collection", "path", "hash", "active"), _incoming(v)
    return store.apply_diff(current, incoming, store.diff(current, incoming)).select("collection", "path", "hash", "active")


@query("select id, case when collection = 'src0' then 'renamed' else collection end as collection, active and not coalesce(collection = 'src1', false) as active from docs")
def collection_rename_remove(v: Views) -> DataFrame:
    return store.rename_collection(store.remove_collection(v.documents(), "src1"), "src0", "renamed").select("id", "collection", "active")


@query("select id, case when id % 3 = 0 then 'set by ' || lang else difficulty end as difficulty from docs")
def update_columns_by_key(v: Views) -> DataFrame:
    docs = v.documents().select("id", "difficulty", "lang")
    changes = docs.where("id % 3 = 0").select("id", F.concat(F.lit("set by "), "lang").alias("difficulty"))
    return store.update_columns(docs, changes, "id", ["difficulty"]).select("id", "difficulty")


@query("select document as document_hash, seq, chunk_id as hash from chunks where document % 5 <> 0 union all select distinct document, seq, 'n' || chunk_id from chunks where document % 5 = 0")
def chunk_replace(v: Views) -> DataFrame:
    stored = v.chunks().select(F.col("document").alias("document_hash"), "seq", F.col("chunk_id").alias("hash"))
    again = stored.where("document_hash % 5 = 0")
    incoming = again.withColumn("hash", F.concat(F.lit("a"), "hash")).unionByName(again.withColumn("hash", F.concat(F.lit("n"), "hash")))
    return store.chunk_upsert(stored, incoming).select("document_hash", "seq", "hash")


@query("select chunk_id as chunk_hash, 'type' as key, chunk_type as value from chunks union all select chunk_id, 'parity', cast(seq % 2 as varchar) from chunks")
def chunk_label_rows(v: Views) -> DataFrame:
    labels = F.create_map(F.lit("type"), "chunk_type", F.lit("parity"), (F.col("seq") % 2).cast("string"))
    return store.label_table(v.chunks().select(F.col("chunk_id").alias("hash"), labels.alias("labels")))


@query("select distinct cast(label as varchar) as model, cast(64 + label % 2 as int) as dimensions from embeddings where label = 3 and 64 + label % 2 <> 64", views=False)
def incompatible_models(v: Views) -> DataFrame:
    models = v.vectors().select(F.col("label").cast("string").alias("model"), (64 + F.col("label") % 2).cast("int").alias("dimensions")).distinct()
    return store.incompatible_models(models, "3", 64)


# -- texts of queries and documents -------------------------------------------------------------------


@query("select item_id, case item_id % 3 when 0 then 'category:Ref' when 1 then 'tag:x|keyword:Y:z' else '' end as filters, regexp_replace('std::' || text || '->f<T>', '::|->|<|>', ' ', 'g') as plain from benchmark", views=False)
def query_filters_and_code(v: Views) -> DataFrame:
    rest, m = F.col("text"), F.col("item_id") % 3
    q = F.when(m == 0, F.concat(F.lit("Category:Ref "), rest)).when(m == 1, F.concat(F.lit("tag:x "), rest, F.lit(" KEYWORD:Y:z"))).otherwise(rest)
    code = F.concat(F.lit("std::"), rest, F.lit("->f<T>"))
    return v.table("benchmark").select("item_id", F.array_join(X.inline_filters(q), "|").alias("filters"), X.code_query(code).alias("plain"))


@query("select id, octet_length(encode(body)) // 4 as tokens, 'title: ' || title || ' | text: ' || path as embedded, case id % 4 when 0 then 'rust' when 1 then 'tsx' when 2 then 'python' end as language from docs")
def text_estimates(v: Views) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["src/a.RS", "b.tsx", "x/c.pyi", "d.md"])), (F.col("id") % 4 + 1).cast("int"))
    return v.documents().select("id", X.token_estimate(F.col("body")).alias("tokens"), X.embedding_text(F.col("title"), F.col("path")).alias("embedded"), X.language_of(name).alias("language"))


# -- counts -----------------------------------------------------------------------------------------


@query(
    """, e as (select distinct hash from docs join embeddings on id = vec_id) select (select count(*) from collections) as collections, count(*) filter (where active) as documents, count(*) filter (where not active) as inactive,
    (select count(*) from content) as content, (select count(distinct hash) from docs where active and hash in (select hash from e)) as embedded,
    count(distinct hash) filter (where active) - (select count(distinct hash) from docs where active and hash in (select hash from e)) as pending from docs"""
)
def index_stats(v: Views) -> DataFrame:
    d = v.documents()
    return rollups.index_stats(d, v.content(), v.collections(), d.join(v.vectors().select("id"), "id", "left_semi"))


@query("select provider_type, count(distinct name) as collections, cast(count(d.id) as bigint) as documents from collections left join docs d on d.collection = name and d.active group by provider_type")
def provider_rollup(v: Views) -> DataFrame:
    return rollups.provider_rollup(v.collections(), v.documents())


@query("select name, provider_type, (select count(*) from docs where collection = name and active) as documents from collections")
def collection_counts_scalar_subquery(v: Views) -> DataFrame:
    return rollups.collection_counts(v.collections(), v.documents())


@query("""select count(*) as searches, count(*) filter (where event_id % 3 = 0) as bm25, count(*) filter (where event_id % 3 = 1) as vector, count(*) filter (where event_id % 3 = 2) as hybrid,
    round(avg(value), 6) as mean_micros, round(count(*) filter (where event_id % 7 = 0) / count(*), 6) as hit_rate from events""", views=False)
def search_stats_rollup(v: Views) -> DataFrame:
    kind = F.element_at(F.array(F.lit("bm25"), F.lit("vector"), F.lit("hybrid")), (F.col("event_id") % 3 + 1).cast("int"))
    log = v.session_queries().select(kind.alias("kind"), F.col("value").alias("micros"), (F.col("event_id") % 7 == 0).alias("cache_hit"))
    return rollups.search_stats(log).withColumns({"mean_micros": r6("mean_micros"), "hit_rate": r6("hit_rate")})


@query("select count(*) as requests, count(*) filter (where event_id % 11 = 0) as errors, count(*) filter (where event_id % 7 = 0) as hits, count(*) filter (where event_id % 7 <> 0) as misses, round(count(*) filter (where event_id % 7 = 0) * 100.0 / count(*), 6) as hit_rate, round(sum(value) / count(*), 6) as mean_millis from events", views=False)
def api_metrics(v: Views) -> DataFrame:
    log = v.session_queries().select((F.col("event_id") % 11 != 0).alias("ok"), (F.col("event_id") % 7 == 0).alias("cache_hit"), F.col("value").alias("millis"))
    return rollups.api_metrics(log).withColumns({"hit_rate": r6("hit_rate"), "mean_millis": r6("mean_millis")})


@query("select label as model, count(*) as n from (select cast(label as varchar) as label from embeddings) group by label", views=False)
def count_by_model(v: Views) -> DataFrame:
    return store.count_by_model(v.vectors().select(F.col("label").cast("string").alias("model")))


@query("select count(*) as cached from embeddings where label = 3", views=False)
def count_cached_embeddings(v: Views) -> DataFrame:
    return store.count_cached(v.vectors().select(F.col("label").cast("string").alias("model")), "3")


# -- inverted index and BM25 --------------------------------------------------------------------------

_TOKENS = r"""list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"""
_INDEX = (
    ", tok as (select id, 'title' as field, unnest(" + _TOKENS.format("title") + ") as term from docs where active union all select id, 'body', unnest(" + _TOKENS.format("body") + ") from docs where active)"
    ", lens as (select id, len(" + _TOKENS.format("title") + ") + len(" + _TOKENS.format("body") + ") as len from docs where active)"
    ", stats as (select count(*) as n_rows, avg(len) as avgdl from lens)\n"
)


def _bm25_sql(terms: list[str], weight: str = "case field when 'title' then 10.0 else 5.0 end") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return _INDEX + f""", f as (select id, term, sum({weight}) as f from tok where term in ({listed}) group by id, term)
    , df as (select term, count(*) as df from f group by term)
    , rel as (select f.id, count(*) as held, sum(
        case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))) as relevance
      from f join df using (term) join lens using (id) cross join stats group by f.id)
    """


@query(_INDEX + "select id, field, term, count(*) as tf from tok group by id, field, term")
def postings_build(v: Views) -> DataFrame:
    return bm25.postings(v.active(), FIELDS)


@query(_INDEX + "select term, count(distinct id) as df from tok group by term")
def term_df(v: Views) -> DataFrame:
    return bm25.document_frequency(bm25.postings(v.active(), FIELDS))


@query(_INDEX + "select id, len, n_rows, round(avgdl, 6) as avgdl from lens cross join stats")
def field_lengths(v: Views) -> DataFrame:
    own = bm25.lengths(v.active(), FIELDS)
    return own.crossJoin(F.broadcast(bm25.statistics(own))).select("id", "len", "n_rows", r6("avgdl").alias("avgdl"))


@query(_bm25_sql([RARE]) + f"select id, round(relevance, 6) as relevance from rel where held = 1 order by relevance desc, id limit 20")
def bm25_topk(v: Views) -> DataFrame:
    return bm25.top(bm25.search(v.active(), RARE, FIELDS), 20, F.desc("relevance"), F.col("id")).select("id", r6("relevance").alias("relevance"))


@query(_bm25_sql(["this", "with"]) + "select id, round(relevance, 6) as relevance from rel where held = 2")
def bm25_and_terms(v: Views) -> DataFrame:
    return bm25.search(v.active(), QUERY, FIELDS).select("id", r6("relevance").alias("relevance"))


@query(_bm25_sql(["this"], "case field when 'title' then 1.0 else 0.25 end") + "select id, round(relevance, 6) as relevance from rel order by relevance desc, id limit 50")
def bm25_weighted_fields(v: Views) -> DataFrame:
    found = bm25.search(v.active(), "this", {"title": 1.0, "body": 0.25})
    return bm25.top(found, 50, F.desc("relevance"), F.col("id")).select("id", r6("relevance").alias("relevance"))


_FILTERED = "select rel.id, round(1 / (1 + relevance), 6) as score from rel join labelled d on d.id = rel.id where held = 2 and d.collection in ('src1', 'src2', 'src7') and d.category = 'reference' and d.difficulty = 'intermediate' order by 1 / (1 + relevance) desc, rel.id limit 20"


@query(_bm25_sql(["this", "with"]) + _FILTERED)
def bm25_filters(v: Views) -> DataFrame:
    # the index covers all active documents; filters apply to what it finds
    found = bm25.search(v.active(), QUERY, FIELDS)
    rows = filters.by_collection(v.labelled(), "src1", "src2", "src7").where("category = 'reference' and difficulty = 'intermediate'").select("id")
    scored = found.join(rows, "id").withColumn("score", bm25.score_of(F.col("relevance"), F.lit(1.0)))
    return bm25.top(scored, 20, F.desc("score"), F.col("id")).select("id", r6("score").alias("score"))


@query(_bm25_sql([RARE]) + "select id, round(score, 6) as score from (select id, 1 / (1 + relevance) as score from rel where held = 1 order by round(score, 9) desc, id limit 50) where score >= 0.2")
def bm25_min_score_after_limit(v: Views) -> DataFrame:
    scored = bm25.search(v.active(), RARE, FIELDS).select("id", bm25.score_of(F.col("relevance"), F.lit(1.0)).alias("score"))
    return bm25.top(scored, 50, F.desc(F.round("score", 9)), F.col("id")).where("score >= 0.2").select("id", r6("score").alias("score"))


_IMPORTANCE = "(case when d.id % 13 = 0 then 2.0 when d.id % 7 = 0 then 1.8 else 1.0 end)"


def _with_importance(v: Views) -> DataFrame:
    return v.active().select("id", "hash", "collection", "path", "title", "lang", F.when(F.col("id") % 13 == 0, 2.0).when(F.col("id") % 7 == 0, 1.8).otherwise(1.0).alias("importance"))


@query(_bm25_sql(["this", "with"]) + f"select d.id, round({_IMPORTANCE} / (1 + relevance), 6) as score, round({_IMPORTANCE} * relevance / (1 + relevance), 6) as useful from rel join docs d using (id) where held = 2")
def bm25_importance(v: Views) -> DataFrame:
    joined = bm25.search(v.active(), QUERY, FIELDS).join(_with_importance(v), "id")
    return joined.select("id", r6(bm25.score_of(F.col("relevance"), F.col("importance"))).alias("score"), r6(bm25.score_of(F.col("relevance"), F.col("importance"), "relevance")).alias("useful"))


@query(_bm25_sql(["this", "with"]) + f"select d.id, d.path, round({_IMPORTANCE} / (1 + relevance), 6) as score from rel join docs d using (id) where held = 2 order by {_IMPORTANCE} / (1 + relevance) desc, d.id limit 20")
def bm25_reference_score(v: Views) -> DataFrame:
    joined = bm25.search(v.active(), QUERY, FIELDS).join(_with_importance(v), "id").withColumn("score", bm25.score_of(F.col("relevance"), F.col("importance")))
    return bm25.top(joined, 20, F.desc("score"), F.col("id")).select("id", "path", r6("score").alias("score"))


_BATCH = (
    _INDEX
    + """, qt as (select distinct item_id as query_id, unnest(w) as term, len(list_distinct(w)) as n_terms from (select item_id, """
    + _TOKENS.format("text")
    + """ as w from benchmark)), f as (select id, term, sum(case field when 'title' then 10.0 else 5.0 end) as f from tok where term in (select term from qt) group by id, term)
    , df as (select term, count(*) as df from f group by term)
    , parts as (select f.id, term, case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl)) as part
      from f join df using (term) join lens using (id) cross join stats)
    , rel as (select query_id, id, sum(part) as relevance from parts join qt using (term) group by query_id, id having count(*) = max(n_terms))
    , ranked as (select query_id, id, relevance, row_number() over (partition by query_id order by round(relevance, 9) desc, id) - 1 as rank from rel)
    , pages as (select * from ranked where rank < 5)
    """
)


def _batch(v: Views, per_query: int = 5) -> DataFrame:
    """The first five documents of each benchmark text, whole: one plan for all queries."""
    queries = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = bm25.Index.build(v.active(), FIELDS)
    scored = index.score(bm25.query_terms(queries))
    return bm25.top_per_query(scored, per_query, F.desc(F.round("relevance", 9)), F.col("id"))


@query(_BATCH + "select query_id, id, rank, round(relevance, 6) as relevance from (select *, row_number() over (partition by id order by query_id, rank) as nth from pages) where nth = 1")
def batch_search_bm25(v: Views) -> DataFrame:
    w = Window.partitionBy("id").orderBy("query_id", "rank")
    once = _batch(v).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return once.select("query_id", "id", F.col("rank").cast("long").alias("rank"), r6("relevance").alias("relevance"))


@query(_BATCH + ", expected as (select item_id as query_id, d.id from benchmark b join docs d on d.active and d.id % 40 = b.item_id % 40) select query_id, round(avg(case when p.id is null then 0.0 else 1.0 end), 6) as recall from expected e left join pages p using (query_id, id) group by query_id")
def recall_at_k(v: Views) -> DataFrame:
    bench = v.table("benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m"))
    expected = v.active().select("id", (F.col("id") % 40).alias("m")).join(F.broadcast(bench), "m").select("query_id", "id")
    return rollups.recall_at_k(_batch(v), expected, 5).select("query_id", r6("recall").alias("recall"))


_TEN = (
    ", d10 as (select d.id, d.title, d.body, concat('doc://', collection, '/', path) as filepath, coalesce(category, '') as summary, title as llm_title, difficulty as keywords, lang as intent, collection as concepts, concat('k', d.id % 50) as user_metadata, 'x' as modified_at from labelled d where active)"
    ", tok as ("
    + " union all ".join(f"select id, '{f}' as field, unnest(" + _TOKENS.format(f) + ") as term from d10" for f in bm25.DOCUMENT_WEIGHTS)
    + "), lens as (select id, "
    + " + ".join("len(" + _TOKENS.format(f) + ")" for f in bm25.DOCUMENT_WEIGHTS)
    + " as len from d10), stats as (select count(*) as n_rows, avg(len) as avgdl from lens)"
    + ", w as (select * from (values "
    + ", ".join(f"('{f}', {w})" for f, w in bm25.DOCUMENT_WEIGHTS.items())
    + ") t(field, w)), f as (select id, term, sum(w) as f from tok join w using (field) where term in ('this', 'src3', 'k7') group by id, term)"
    + ", df as (select term, count(*) as df from f group by term)"
    + ", parts as (select f.id, term, case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl)) as part from f join df using (term) join lens using (id) cross join stats)"
)


def _ten_fields(v: Views) -> DataFrame:
    """Documents with all ten searched fields."""
    return v.labelled().select(
        "id", "title", "body", X.virtual_path(F.col("collection"), F.col("path")).alias("filepath"), F.coalesce("category", F.lit("")).alias("summary"), F.col("title").alias("llm_title"), F.col("difficulty").alias("keywords"),
        F.col("lang").alias("intent"), F.col("collection").alias("concepts"), F.concat(F.lit("k"), (F.col("id") % 50).cast("string")).alias("user_metadata"), F.lit("x").alias("modified_at"), "active",
    )


_TEN_PAGE = "select id, round(cast(sum(part) as double), 6) as relevance from parts group by id having count(*) = 2"


@query(_TEN.replace("'this', 'src3', 'k7'", "'src3', 'k7'") + _TEN_PAGE)
def bm25_ten_fields(v: Views) -> DataFrame:
    return bm25.search(_ten_fields(v).where("active"), "src3 k7", bm25.DOCUMENT_WEIGHTS).select("id", r6("relevance").alias("relevance"))


def _kept_index(v: Views, rows: DataFrame):
    """A kept index in the shared folder; one for each call, as the tables may change between calls."""
    import tempfile
    import uuid

    from siftwell.operators.search_index import SearchIndex

    root = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and not v.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
    index = SearchIndex(store.Store(v.spark, f"{root}/siftwell-index/{uuid.uuid4().hex}"), buckets=8, parts=1)
    return index.build(rows)


@query(_TEN.replace("'this', 'src3', 'k7'", "'src3', 'k7'") + _TEN_PAGE)
def bm25_stored_index(v: Views) -> DataFrame:
    return _kept_index(v, _ten_fields(v).where("active")).search("src3 k7").select("id", r6("relevance").alias("relevance"))


@query(_TEN.replace("where active)", "where active and d.id % 4 <> 1)").replace("'this', 'src3', 'k7'", "'src3', 'k7'") + _TEN_PAGE)
def index_incremental(v: Views) -> DataFrame:
    # built over half of the documents with other texts, then updated to the final state
    rows = _ten_fields(v)
    index = _kept_index(v, rows.where("active and id % 2 = 1").withColumn("body", F.lit("src3 k7 stale")))
    changed = rows.withColumn("active", F.col("active") & (F.col("id") % 4 != 1))
    return index.update(changed).search("src3 k7").select("id", r6("relevance").alias("relevance"))


@query(_BATCH + "select query_id, id, round(relevance, 6) as relevance from rel")
def batch_search_stored_index(v: Views) -> DataFrame:
    from siftwell.operators.search_index import SearchIndex

    built = _kept_index(v, v.active().select("id", "title", "body", *[F.lit("").alias(f) for f in bm25.DOCUMENT_WEIGHTS if f not in FIELDS]))
    index = SearchIndex(built.tables, bm25.DOCUMENT_WEIGHTS, buckets=8, parts=1)
    queries = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.score(bm25.query_terms(queries)).select("query_id", "id", r6("relevance").alias("relevance"))


# -- vectors ----------------------------------------------------------------------------------------

_Q = f"(select cast(embedding as double[]) from embeddings where vec_id = {VECTOR_ID})"
_COS = f"list_cosine_similarity(cast(embedding as double[]), {_Q})"


def _probe(v: Views) -> DataFrame:
    return v.vectors().where(F.col("id") == VECTOR_ID).select(F.col("embedding").alias("q"))


@query(f"select vec_id as id, round({_COS}, 6) as score from embeddings order by {_COS} desc, vec_id limit 20", views=False)
def cosine_topk(v: Views) -> DataFrame:
    return vector.top_k(vector.similarities(v.vectors(), _probe(v)), 20).select("id", r6("score").alias("score"))


@query(f"select vec_id as id, round({_COS}, 6) as score from embeddings where label = 3 order by {_COS} desc, vec_id limit 10", views=False)
def cosine_collection_filter(v: Views) -> DataFrame:
    return vector.top_k(vector.similarities(v.vectors().where("label = 3"), _probe(v)), 10).select("id", r6("score").alias("score"))


_NEAR = f", near as (select vec_id as id, {_COS} as score from embeddings order by score desc, vec_id limit 60)"
_VEC = _NEAR + ", hydrated as (select d.hash, min(n.id) as id, max(score) as score from near n join docs d on d.id = n.id where active group by d.hash)"


@query(_VEC + ", best as (select * from hydrated order by score desc, hash limit 20) select hash, round(score, 6) as score from best")
def vector_overfetch_best_per_document(v: Views) -> DataFrame:
    near = vector.similarities(v.vectors(), _probe(v)).orderBy(F.desc("score"), "id").limit(60)
    rows = F.broadcast(near.select("id", "score")).join(v.active().select("id", "hash"), "id")
    return vector.best_per_document(rows, "hash", "id").orderBy(F.desc("score"), "hash").limit(20).select("hash", r6("score").alias("score"))


_BOOSTED = (
    _NEAR
    + f""", boosted as (select d.id, score * {_IMPORTANCE} * case when d.collection = 'src7' then 1.5 else 1.0 end
    * case when d.path like '%d3%' then 10.0 when d.title like '%THE%' or lower(d.title) like '%the%' then case when d.path like '%/9%' then 40.0 else 4.0 end when d.path like '%/9%' then 10.0 else 1.0 end as score from near n join docs d on d.id = n.id where active)"""
)


@query(_BOOSTED + "select id, round(score, 6) as score from boosted")
def vector_boosts(v: Views) -> DataFrame:
    near = vector.similarities(v.vectors(), _probe(v)).orderBy(F.desc("score"), "id").limit(60).select("id", "score")
    rows = F.broadcast(near).join(_with_importance(v), "id")
    score = vector.boosted(F.col("score"), F.col("importance"), F.col("collection"), F.col("path"), F.col("title"), "d3 the /9", {"src7": 1.5})
    return rows.select("id", r6(score).alias("score"))


@query(_VEC + ", best as (select * from hydrated order by score desc, hash limit 20) select hash, round(score / (select max(score) from best) * 100, 6) as score from best")
def vector_normalized(v: Views) -> DataFrame:
    near = vector.similarities(v.vectors(), _probe(v)).orderBy(F.desc("score"), "id").limit(60)
    rows = F.broadcast(near.select("id", "score")).join(v.active().select("id", "hash"), "id")
    page = vector.best_per_document(rows, "hash", "id").orderBy(F.desc("score"), "hash").limit(20)
    return vector.to_percent(page).select("hash", r6("score").alias("score"))


@query()
def ann_lsh_topk(v: Views) -> DataFrame:
    vectors = v.vectors()
    return vector.LshIndex(vectors, exact_below=100).nearest(vectors.where(F.col("id") == VECTOR_ID).first()["embedding"], 10)


# -- fusion -----------------------------------------------------------------------------------------

_LISTS = (
    _bm25_sql(["this", "with"])
    + f""", b as (select id, row_number() over (order by round(1 / (1 + relevance), 9) desc, id) - 1 as rank, 1 / (1 + relevance) as score from rel where held = 2 qualify rank < 60)
    , w as (select vec_id as id, row_number() over (order by round({_COS}, 9) desc, vec_id) - 1 as rank, {_COS} as score from embeddings where vec_id in (select id from docs where active) qualify rank < 60)
    """
)


def _lists(v: Views) -> tuple[DataFrame, DataFrame]:
    found = bm25.search(v.active(), QUERY, FIELDS).select("id", bm25.score_of(F.col("relevance"), F.lit(1.0)).alias("score"))
    b = fusion.ranked(bm25.top(found, 60, F.desc(F.round("score", 9)), F.col("id")), F.desc(F.round("score", 9)), F.col("id"))
    near = vector.similarities(v.vectors().join(v.active().select("id"), "id", "left_semi"), _probe(v)).select("id", "score")
    w = fusion.ranked(bm25.top(near, 60, F.desc(F.round("score", 9)), F.col("id")), F.desc(F.round("score", 9)), F.col("id"))
    return b, w


_RRF = """, parts as (select id, 2.0 / (61 + rank) + case when rank < 3 then 0.05 when rank < 10 then 0.02 else 0 end as s from b union all select id, 1.0 / (61 + rank) + case when rank < 3 then 0.05 when rank < 10 then 0.02 else 0 end from w)
    , fused as (select id, sum(s) as score from parts group by id)
    """


@query(_LISTS + _RRF + "select id, round(score, 6) as score from fused")
def rrf_fusion(v: Views) -> DataFrame:
    return fusion.rrf(*_lists(v)).select("id", r6("score").alias("score"))


_CAT = ", cat as (select id, row_number() over (order by step, rank) - 1 as ord, rank, step from (select 0 as step, id, rank from b union all select 1, id, rank from w))"


@query(_LISTS + _CAT + "select id, round(sum(1.0 / (ord + 60)), 6) as score, min(ord) as first from cat group by id")
def workflow_rrf_merge(v: Views) -> DataFrame:
    return fusion.workflow_rrf(_lists(v)).select("id", r6("score").alias("score"), F.col("first").cast("long").alias("first"))


@query(_LISTS + _CAT + "select id, min(ord) as ord from cat group by id")
def merge_append(v: Views) -> DataFrame:
    return fusion.merge_append(_lists(v)).select("id", F.col("ord").cast("long").alias("ord"))


@query(_LISTS + _CAT + ", rr as (select id, row_number() over (order by rank, step) - 1 as ord from cat) select id, min(ord) as ord from rr group by id")
def merge_interleave(v: Views) -> DataFrame:
    return fusion.merge_interleave(_lists(v), round_robin=True).select("id", F.col("ord").cast("long").alias("ord"))


@query("select hash, min(id) as id from docs group by hash")
def deduplicate_first(v: Views) -> DataFrame:
    return fusion.keep_first(v.documents().select("hash", "id"), "hash", "id").select("hash", "id")


_BLEND = """, top as (select id, score, row_number() over (order by round(score, 9) desc, id) as rank from fused order by rank limit 10)
    select id, rank, round((case when rank <= 3 then 0.75 when rank <= 10 then 0.6 else 0.4 end) * score + (1 - case when rank <= 3 then 0.75 when rank <= 10 then 0.6 else 0.4 end) * ((id % 10) / 10.0), 6) as score from top"""


@query(_LISTS + _RRF + _BLEND)
def blend_rank_bands(v: Views) -> DataFrame:
    fused = bm25.top(fusion.rrf(*_lists(v)), 10, F.desc(F.round("score", 9)), F.col("id"))
    rows = fusion.ranked(fused, F.desc(F.round("score", 9)), F.col("id")).withColumn("rank", F.col("rank") + 1)
    return rows.select("id", F.col("rank").cast("long").alias("rank"), r6(fusion.blend(F.col("score"), (F.col("id") % 10) / 10.0, F.col("rank"))).alias("score"))


@query(_LISTS + "select round(max(score), 6) as top, round(max(score) - min(score), 6) as gap, max(score) >= 0.85 and max(score) - min(score) >= 0.15 as strong from (select score from b order by rank limit 2)")
def strong_signal(v: Views) -> DataFrame:
    return fusion.strong_signal(_lists(v)[0]).select(r6("top").alias("top"), r6("gap").alias("gap"), "strong")


@query(_LISTS + _RRF + _BLEND.replace("select id, rank, round(", "select id, round("))
def hybrid_pipeline(v: Views) -> DataFrame:
    from siftwell.plans.hybrid import fuse_and_rerank

    b, w = _lists(v)
    scorer = lambda rows: rows.select("id", ((F.col("id") % 10) / 10.0).alias("rerank"))
    return fuse_and_rerank(b, w, scorer, tie=9).select("id", r6("score").alias("score"))


# -- filters ----------------------------------------------------------------------------------------


@query("select id, category from (select *, avg(case when category = 'draft' then 1.0 else 0.0 end) over () as share, count(*) over () as n from labelled where active) where category = 'draft' or (n >= 5 and 1 - share > 0.9)")
def filter_metadata_guard(v: Views) -> DataFrame:
    return filters.guarded(v.labelled().where("active"), filters.metadata_step(category="Draft")).select("id", "category")


@query("select id, modified_at from docs where modified_at >= timestamp '2024-01-01 01:00:00' and modified_at <= timestamp '2024-01-01 05:00:00'")
def filter_temporal(v: Views) -> DataFrame:
    import datetime as dt

    now = dt.datetime(2024, 1, 8, 5)
    after, before = filters.parse_time("2024-01-01T01:00:00Z", now), filters.parse_time("1 week ago", now)
    return filters.temporal(v.documents(), after, before).select("id", "modified_at")


@query("select id, collection from docs where collection in ('src1', 'src4')")
def filter_collection(v: Views) -> DataFrame:
    return filters.by_collection(v.documents(), "src1", "src4").select("id", "collection")


def _typed(v: Views) -> DataFrame:
    """Typed metadata of events: an integer from props, a flag, tags and a quantity."""
    k = F.get_json_object("props", "$.k")
    meta = F.concat(
        F.lit('{"k":{"type":"Integer","value":'), F.coalesce(k, F.lit("null")), F.lit('},"hot":{"type":"Boolean","value":'), (F.col("value") > 50).cast("string"),
        F.lit('},"labels":{"type":"Tags","value":["'), F.col("query"), F.lit('","e'), (F.col("event_id") % 3).cast("string"), F.lit('"]}}'),
    )
    return v.session_queries().select(F.col("event_id").alias("id"), meta.alias("user_metadata"))


@query("select event_id as id from events where (cast(json_extract(props, '$.k') as int) > 50 and event_type = 'click') or not coalesce(value > 50, false) and cast(json_extract(props, '$.k') as int) between 10 and 20", views=False)
def typed_metadata_and_or_not(v: Views) -> DataFrame:
    P = filters.Predicate
    tree = (P("integer_gt", "k", 50) & P("tags_contain", "labels", "click")) | (~P("boolean_eq", "hot", True) & P("integer_range", "k", (10, 20)))
    return _typed(v).where(tree.column(F.col("user_metadata"))).select("id")


@query("select event_id as id, event_type = 'click' and event_id % 3 = 1 as all_of, event_type = 'view' or event_id % 3 = 2 as any_of from events", views=False)
def tags_contain_all_any(v: Views) -> DataFrame:
    P = filters.Predicate
    m = F.col("user_metadata")
    return _typed(v).select("id", P("tags_all", "labels", ["click", "e1"]).column(m).alias("all_of"), P("tags_any", "labels", ["view", "e2"]).column(m).alias("any_of"))


@query("select id from (select event_id as id, props, value from events order by event_id limit 100) where cast(json_extract(props, '$.k') as int) > 50", views=False)
def limit_before_filter(v: Views) -> DataFrame:
    return filters.find_by_metadata(_typed(v), filters.parse_predicate("k:gt=50"), 100).select("id")


@query("select id, path from docs where active and id in (select doc_id from labels where quality = 1 and toxic = 0)")
def label_semi_join(v: Views) -> DataFrame:
    labels = v.table("labels").where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("id"))
    return v.active().join(labels, "id", "left_semi").select("id", "path")


@query("select item_id, trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' and not list_contains(" + str(X.STOP_WORDS) + ", lower(w))), ' '), '[?!^()\\[\\]{}]', '', 'g')) as cleaned from benchmark", views=False)
def query_sanitise(v: Views) -> DataFrame:
    return v.table("benchmark").select("item_id", X.sanitised(F.col("text")).alias("cleaned"))


# -- contexts, graph, directories ---------------------------------------------------------------------


@query("select d.id, arg_max(c.context, length(c.path)) as context from docs d left join contexts c on starts_with(d.path, c.path) group by d.id")
def longest_prefix_context(v: Views) -> DataFrame:
    return context.longest_prefix(v.documents().select("id", "path"), v.contexts()).select("id", "context")


@query("select d.id, 'all' || coalesce(string_agg(chr(10) || chr(10) || c.context, '' order by length(c.path)), '') as context from docs d left join contexts c on starts_with(d.path, c.path) group by d.id")
def inherited_context(v: Views) -> DataFrame:
    return context.inherited(v.documents().select("id", "path"), v.contexts(), global_context="all").select("id", "context")


@query("select name from collections where not exists (select 1 from (select 'src1' as path union all select 'src2') c where c.path = name or c.path = '/')")
def missing_context_anti(v: Views) -> DataFrame:
    known = v.collections().where(F.col("name").isin("src1", "src2")).select(F.col("name").alias("path"))
    return context.missing_context(v.collections(), known).select("name")


_LINKED = """, linked as (select id, collection, path, '[next](../d' || ((id + 20) % 7) || '/' || (id + 20) || '.md) and [up](./../d' || ((id + 40) % 7) || '/' || (id + 40) || '.md#top) or [web](https://x.org) [top](#a)' as body from docs where active)
, links as (select id, collection, split_part(path, '/', 1) || '/d' || (k % 7) || '/' || k || '.md' as target_path from (select id, collection, path, unnest([id + 20, id + 40]) as k from linked))
, edges as (select distinct l.id as source_id, d.id as target_id from links l join docs d on d.collection = l.collection and d.path = l.target_path and d.active)
"""


def _linked(v: Views) -> DataFrame:
    part = lambda k, text, lead, tail: F.concat(F.lit(f"[{text}]({lead}../d"), ((F.col("id") + k) % 7).cast("string"), F.lit("/"), (F.col("id") + k).cast("string"), F.lit(f".md{tail})"))
    body = F.concat(part(20, "next", "", ""), F.lit(" and "), part(40, "up", "./", "#top"), F.lit(" or [web](https://x.org) [top](#a)"))
    return v.active().select("id", "collection", "path", body.alias("body"))


@query(_LINKED + "select id, target_path from links")
def markdown_links(v: Views) -> DataFrame:
    return graph.links(_linked(v)).select("id", "target_path")


@query(_LINKED + "select target_id as id, count(*) as in_links from edges group by target_id")
def link_graph_indegree(v: Views) -> DataFrame:
    docs = _linked(v)
    return graph.in_degree(graph.link_edges(graph.links(docs), docs))


_SCORES = _LINKED + ", scores as (select d.id, 0.6 * (1 + least(0.3 * coalesce(n, 0), 2.0)) as importance from linked d left join (select target_id as id, count(*) as n from edges group by target_id) using (id))"


@query(_SCORES + "select id, round(cast(importance as double), 6) as importance from scores")
def importance_scores(v: Views) -> DataFrame:
    docs = _linked(v)
    return graph.importance(docs, graph.link_edges(graph.links(docs), docs)).select("id", r6("importance").alias("importance"))


@query(_SCORES + "select id, round(cast(importance as double), 6) as importance from scores order by scores.importance desc, id limit 10")
def importance_top10(v: Views) -> DataFrame:
    docs = _linked(v)
    return graph.importance(docs, graph.link_edges(graph.links(docs), docs)).orderBy(F.desc("importance"), "id").limit(10).select("id", r6("importance").alias("importance"))


def _for_directories(v: Views) -> DataFrame:
    return v.labelled().withColumn("concepts", F.array(F.concat(F.lit("c"), (F.col("id") % 30).cast("string"))))


_DIRS = """, rows as (select *, regexp_replace(path, '/[^/]*$', '') as dir, 'c' || (id % 30) as concept from labelled where active)
, sizes as (select collection, dir, count(*) as file_count from rows group by all)
, cats as (select collection, dir, category from (select collection, dir, category, row_number() over (partition by collection, dir order by count(*) desc, category) as nth from rows where category is not null group by collection, dir, category) where nth = 1)
, cons as (select collection, dir, string_agg(concept, ',' order by concept) as concepts from (select distinct collection, dir, concept, dense_rank() over (partition by collection, dir order by concept) as nth from rows) where nth <= 20 group by all)
"""


@query(_DIRS + "select collection || '/' || dir as path, 1 as depth, file_count, 0 as child_dir_count, 'md' as dominant_language, category as dominant_category, concepts from sizes left join cats using (collection, dir) left join cons using (collection, dir)")
def directory_rollup(v: Views) -> DataFrame:
    d = rollups.directories(_for_directories(v))
    return d.select("path", F.col("depth").cast("int").alias("depth"), "file_count", F.col("child_dir_count").cast("int").alias("child_dir_count"), "dominant_language", "dominant_category", F.array_join("concepts", ",").alias("concepts"))


@query(", p as (select collection, lang || '/i.md' as path from docs where active union all select collection, path from docs where active), s as (select distinct collection, regexp_replace(path, '/[^/]*$', '') as dir from p) select collection || '/' || a.dir as path, (select count(*) from s b where b.collection = a.collection and regexp_replace(b.dir, '/[^/]*$', '') = a.dir and b.dir <> a.dir) as child_dir_count from s a")
def child_dir_count(v: Views) -> DataFrame:
    rows = _for_directories(v)
    inner = rows.select("collection", F.concat("lang", F.lit("/i.md")).alias("path"), "active", "category", "concepts")
    return rollups.directories(rows.select(*inner.columns).unionByName(inner)).select("path", "child_dir_count")


@query("select lang as language from docs where active group by lang order by count(*) desc, lang limit 1")
def dominant_language(v: Views) -> DataFrame:
    per = v.active().groupBy(F.col("lang").alias("language"), "collection").agg(F.count("*").alias("document_count"))
    return rollups.dominant_language(per)


@query(_DIRS + "select collection || '/' || dir as path, file_count from sizes where collection = 'src2' and dir like 'en%'")
def list_directories_depth(v: Views) -> DataFrame:
    return rollups.list_directories(rollups.directories(_for_directories(v)), "src2", "src2/en", 1).select("path", "file_count")


@query(_DIRS + ", best as (select collection, dir, file_count from sizes where strpos(lower(collection || ' ' || dir), 'src2') > 0) select collection || '/' || dir as path, file_count from best where collection = 'src2'")
def search_directories(v: Views) -> DataFrame:
    dirs = rollups.directories(_for_directories(v))
    found = bm25.search(dirs, "src2", {"path": 1.0}, "path")
    return dirs.join(found, "path").select("path", "file_count")


# -- glossary ---------------------------------------------------------------------------------------

_CONCEPTS = (
    ", terms as (select item_id * 1000000 + i as ord, w[i] as term from (select item_id, w0 as w, unnest(range(1, len(w0) + 1)) as i from (select item_id, " + _TOKENS.format("text") + " as w0 from benchmark)) where w[i] is not null)"
    ", concepts as (select replace(lower(term), ' ', '_') as normalized, arg_min(term, ord) as term from terms group by 1)"
    ", bridge as (select distinct c.normalized, d.hash from concepts c join (select hash, unnest(" + _TOKENS.format("title") + ") as t from docs where active) d on d.t = c.normalized)\n"
)


def _terms(v: Views) -> DataFrame:
    words = X.tokens(F.col("text"))
    return v.table("benchmark").select("item_id", F.posexplode(words).alias("i", "term")).select((F.col("item_id") * 1_000_000 + F.col("i") + 1).alias("ord"), "term")


def _bridge(v: Views, concepts: DataFrame) -> DataFrame:
    """Concepts and the documents whose titles hold them, each document being one chunk."""
    found = v.active().select("hash", F.explode(X.tokens(F.col("title"))).alias("term")).distinct()
    extracted = found.join(concepts.select(F.col("normalized").alias("term")), "term", "left_semi").select(F.col("hash").alias("document_hash"), "term", F.lit("").alias("snippet"))
    chunks = v.active().select("hash", F.col("hash").alias("document_hash")).distinct()
    return glossary.link_concepts(concepts, extracted, chunks)


@query(_CONCEPTS + "select normalized, term from concepts")
def concept_upsert(v: Views) -> DataFrame:
    return glossary.upsert_concepts(_terms(v))


@query(_CONCEPTS + "select normalized, count(distinct hash) as chunk_count from bridge group by normalized")
def concept_chunk_counts(v: Views) -> DataFrame:
    return glossary.chunk_counts(_bridge(v, glossary.upsert_concepts(_terms(v))))


@query(_CONCEPTS + "select min(id) as id, hash, cast(0.8 as double) as score from docs where active and hash in (select hash from bridge where normalized = 'the') group by hash order by min(id) limit 20")
def glossary_search(v: Views) -> DataFrame:
    concepts = glossary.upsert_concepts(_terms(v))
    return glossary.glossary_search(concepts, _bridge(v, concepts), v.documents(), "the", 20)


# -- sessions and memories ----------------------------------------------------------------------------


@query("select user_id as session, string_agg(event_type, ',' order by nth) as queries from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as nth from events) where nth <= 5 group by user_id", views=False)
def session_log_top5(v: Views) -> DataFrame:
    return sessions.top_queries(v.session_queries()).select("session", F.array_join("queries", ",").alias("queries"))


@query("select id, round(score * case when id % 3 = 0 then 0.3 else 1 end, 6) as score, id % 3 = 0 as seen from (select id, n_chars / 100000.0 as score from docs where active order by score desc, id limit 50)")
def session_seen_demote(v: Views) -> DataFrame:
    page = v.active().select("id", (F.col("n_chars") / 100000.0).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    seen = v.active().where("id % 3 = 0").select("id")
    return sessions.demote_seen(page, seen, "id").select("id", r6("score").alias("score"), "seen")


@query("select user_id as id from events group by user_id having max(ts) + to_seconds(3600) < (select max(ts) from events)", views=False)
def session_ttl_expiry(v: Views) -> DataFrame:
    log = v.session_queries()
    state = log.groupBy(F.col("session").alias("id")).agg(F.max("created_at").alias("last_active_at")).withColumn("ttl_seconds", F.lit(3600))
    now = log.agg(F.max("created_at").alias("now"))
    return sessions.expired(state.crossJoin(F.broadcast(now)), F.col("now")).select("id")


@query(
    """select user_id as session, min(ts) as started, max(ts) as last_event, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from
    (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as fresh from events)) group by user_id, g""",
    views=False,
)
def session_windows(v: Views) -> DataFrame:
    from siftwell.streaming.sessions import session_windows as windows

    return windows(v.session_queries(), 3600).select("session", "started", "last_event", "n")


_MEMORIES = """with facts as (select conv_id * 1000 + turn as ord, 'm' || conv_id || '-' || turn as id, case when role = 'user' then 'preference' else 'fact' end as category, string_split(text, ' ')[1] as content, (turn % 10) / 10.0 as confidence from conversations)
, memories as (select sha256(content) as content_hash, arg_min(id, ord) as id, arg_min(category, ord) as category, max(confidence) as confidence, count(*) - 1 as access_count, max(ord) as updated from facts group by content)
"""


def _facts(v: Views) -> DataFrame:
    facts = v.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.when(F.col("role") == "user", "preference").otherwise("fact").alias("category"), F.substring_index("text", " ", 1).alias("content"), ((F.col("turn") % 10) / 10.0).alias("confidence"),
    )
    return facts


def _memories(v: Views) -> DataFrame:
    return sessions.upsert_memories(_facts(v))


@query(_MEMORIES + "select content_hash, id, category, round(confidence, 6) as confidence, access_count from memories", views=False)
def memory_upsert_dedup(v: Views) -> DataFrame:
    return _memories(v).select("content_hash", "id", "category", r6("confidence").alias("confidence"), "access_count")


@query(_MEMORIES + "select coalesce(category, 'total') as category, count(*) as n, round(coalesce(avg(confidence), 0), 6) as mean_confidence from memories group by rollup (category)", views=False)
def memory_stats(v: Views) -> DataFrame:
    return sessions.memory_stats(_memories(v)).select("category", "n", r6("mean_confidence").alias("mean_confidence"))


@query(_MEMORIES + "select id, updated from memories order by updated desc, id limit 10 offset 5", views=False)
def memory_page(v: Views) -> DataFrame:
    return sessions.memory_page(_memories(v), 10, 5).select("id", "updated")


_PAGE = ", page as (select id, hash, path, 'doc://' || collection || '/' || path as filepath, n_chars / 100000.0 as score, row_number() over (order by n_chars desc, id) - 1 as ord from docs where active qualify ord < 20)"


def _page(v: Views) -> DataFrame:
    rows = v.active().select("id", "hash", "path", X.virtual_path(F.col("collection"), F.col("path")).alias("filepath"), (F.col("n_chars") / 100000.0).alias("score"), "n_chars")
    return fusion.ranked(rows.orderBy(F.desc("n_chars"), "id").limit(20), F.desc("n_chars"), F.col("id")).withColumnRenamed("rank", "ord").drop("n_chars")


@query(_PAGE + "select regexp_replace(filepath, '/[^/]*$', '') as dir, min(ord) as first from page group by 1 order by first limit 5")
def suggestions_related(v: Views) -> DataFrame:
    return sessions.related_directories(_page(v)).select("dir", F.col("first").cast("long").alias("first"))


@query(
    _PAGE
    + """, dirs as (select substring(regexp_replace(filepath, '/[^/]*$', ''), 7) as dir, min(ord) as first from page group by 1 order by first limit 5)
    select count(*) as unseen_related from docs d join dirs on starts_with(d.collection || '/' || d.path, dirs.dir) where d.active and d.hash not in (select hash from page)"""
)
def suggestions_unseen(v: Views) -> DataFrame:
    page = _page(v)
    return sessions.unseen_related(v.documents(), sessions.related_directories(page), page.select("hash"))


@query(_PAGE + ", top as (select distinct regexp_replace(path, '/[^/]*$', '') as dir from page where ord < 3) select id, round(case when ord >= 3 and regexp_replace(path, '/[^/]*$', '') in (select dir from top) then least(score * 1.15, 1.0) else score end, 6) as score from page")
def directory_boost(v: Views) -> DataFrame:
    return sessions.directory_boost(_page(v)).select("id", r6("score").alias("score"))


@query(_MEMORIES + """, facts2 as (select id || 'n' as id, 'entity' as category, content, least(confidence + 0.1, 1.0) as confidence, ord from facts where ord % 2 = 0 union all select id || 'o', 'fact', content || '!', 0.5, ord from facts where ord % 3 = 0)
, m2 as (select sha256(content) as content_hash, arg_min(id, ord) as id, arg_min(category, ord) as category, max(confidence) as confidence, count(*) - 1 as access_count from facts2 group by content)
select coalesce(a.content_hash, b.content_hash) as content_hash, coalesce(a.id, b.id) as id, coalesce(a.category, b.category) as category, round(greatest(a.confidence, b.confidence), 6) as confidence,
case when a.id is not null and b.id is not null then a.access_count + b.access_count + 1 else coalesce(a.access_count, b.access_count) end as access_count from memories a full join m2 b using (content_hash)""", views=False)
def memory_merge(v: Views) -> DataFrame:
    stored = _memories(v)
    facts = _facts(v)
    again = facts.where("ord % 2 = 0").select(F.concat("id", F.lit("n")).alias("id"), F.lit("entity").alias("category"), "content", F.least(F.col("confidence") + 0.1, F.lit(1.0)).alias("confidence"), "ord")
    other = facts.where("ord % 3 = 0").select(F.concat("id", F.lit("o")).alias("id"), F.lit("fact").alias("category"), F.concat("content", F.lit("!")).alias("content"), F.lit(0.5).alias("confidence"), "ord")
    merged = sessions.merge_memories(stored, again.unionByName(other))
    return merged.select("content_hash", "id", "category", r6("confidence").alias("confidence"), "access_count")


@query("select event_id as id, ['preference', 'entity', 'pattern', 'fact', 'decision'][event_id % 5 + 1] as category, cast(event_id % 13 as double) / 10 as confidence from events where event_id % 5 <> 4 and event_id % 13 <= 10", views=False)
def memory_validate(v: Views) -> DataFrame:
    category = F.element_at(F.array(*map(F.lit, ["preference", "entity", "pattern", "fact", "decision"])), (F.col("event_id") % 5 + 1).cast("int"))
    fact = F.struct(category.alias("category"), F.lit("x").alias("content"), ((F.col("event_id") % 13).cast("double") / 10).alias("confidence"))
    answers = v.session_queries().select(F.col("event_id").alias("id"), F.concat(F.lit("so: "), F.to_json(F.array(fact)), F.lit(" .")).alias("response"))
    return sessions.parse_memories(answers).select("id", "category", "confidence")


# -- chunks -----------------------------------------------------------------------------------------


@query()
def chunk_chars(v: Views) -> DataFrame:
    from siftwell.operators.chunking import chunk_documents

    return chunk_documents(v.active().select("hash", "path", "body")).select("document_hash", "seq", "pos", F.length("content").alias("n_chars"), "hash")


@query("select document, seq, lag(chunk_id) over (partition by document order by seq) as previous, lead(chunk_id) over (partition by document order by seq) as next from chunks")
def chunk_navigation_prev_next(v: Views) -> DataFrame:
    from siftwell.operators.chunking import with_neighbours

    return with_neighbours(v.chunks(), "document", "chunk_id").select("document", "seq", "previous", "next")


_CHUNK_BM25 = (
    ", tok as (select chunk_id as id, unnest(" + _TOKENS.format("content") + ") as term from chunks), lens as (select chunk_id as id, len(" + _TOKENS.format("content") + ") as len from chunks), stats as (select count(*) as n_rows, avg(len) as avgdl from lens)"
    ", f as (select id, term, count(*) * 1.0 as f from tok where term = 'the' group by id, term), df as (select term, count(*) as df from f group by term)"
    " select f.id, round(1 / (1 + case when ln((n_rows - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_rows - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) as score from f join df using (term) join lens using (id) cross join stats"
)


@query(_CHUNK_BM25)
def chunk_bm25(v: Views) -> DataFrame:
    from siftwell.operators.chunking import search_chunks

    rows = v.chunks().select(F.col("chunk_id").alias("id"), "content", F.lit("").alias("breadcrumb"), F.lit("").alias("summary"), F.lit("").alias("purpose"))
    return search_chunks(rows, "the", None).select("id", r6("score").alias("score"))


@query("select chunk_id as id, cast(0.5 as double) as score from chunks order by chunk_id limit 25")
def chunk_empty_query(v: Views) -> DataFrame:
    from siftwell.operators.chunking import search_chunks

    rows = v.chunks().select(F.col("chunk_id").alias("id"), "content", F.lit("").alias("breadcrumb"), F.lit("").alias("summary"), F.lit("").alias("purpose"))
    return search_chunks(rows, "  ", 25).select("id", "score")


# -- planning, projections, sinks -----------------------------------------------------------------------


@query(
    "select item_id, case when nl and not tech then 'vector' else 'hybrid' end as strategy, case when tech then 'chunk' when nl then 'document' else 'both' end as granularity from "
    "(select item_id, contains(lower(q), 'how to') or contains(lower(q), 'example') as nl, contains(q, '::') or contains(q, '_') as tech from (select item_id, case item_id % 4 when 0 then 'how to ' || lower(text) when 1 then 'std::' || lower(text) when 2 then 'example a_b ' || lower(text) else lower(text) end as q from benchmark))",
    views=False,
)
def heuristic_strategy_case(v: Views) -> DataFrame:
    from siftwell.plans.strategy import strategy_columns

    low, m = F.lower("text"), F.col("item_id") % 4
    q = F.when(m == 0, F.concat(F.lit("how to "), low)).when(m == 1, F.concat(F.lit("std::"), low)).when(m == 2, F.concat(F.lit("example a_b "), low)).otherwise(low)
    strategy, granularity = strategy_columns(q)
    return v.table("benchmark").select("item_id", strategy.alias("strategy"), granularity.alias("granularity"))


@query("select id, path, substring(trim(body), 1, strpos(trim(body), '. ')) as summary, cast(null as varchar) as body from docs where strpos(trim(body), '. ') > 0")
def detail_l0(v: Views) -> DataFrame:
    from siftwell.plans.engine import project

    rows = v.documents().select("id", "path", "body", F.col("body").alias("summary")).where(F.instr(F.trim("body"), ". ") > 0)
    return project(rows, "L0").select("id", "path", "summary", "body")


@query()
def snippet_window(v: Views) -> DataFrame:
    from siftwell.functions.snippets import with_snippet

    return with_snippet(v.active().select("id", "body"), "with").select("id", "snippet", "start_pos", "end_pos")


@query("select id, case when contains(title, ',') or contains(title, '\"') then '\"' || replace(title, '\"', '\"\"') || '\"' else title end || ',' || n_chars as line from docs")
def sink_csv_rows(v: Views) -> DataFrame:
    return v.documents().select("id", F.concat(X.csv_field(F.col("title")), F.lit(","), F.col("n_chars").cast("string")).alias("line"))


@query("select id, '## ' || title || chr(10) || chr(10) || '**Path:** `' || path || '`' as md, '<path>' || replace(path, '&', '&amp;') || '</path>' as xml from docs")
def sink_markdown_rows(v: Views) -> DataFrame:
    from siftwell.sources.sinks import markdown_row, xml_element

    return v.documents().select("id", markdown_row(F.col("title"), F.col("path")).alias("md"), xml_element("path", F.col("path")).alias("xml"))


# -- chunks with vectors and documents ------------------------------------------------------------------

_CHUNK_VECTORS = """, ch as (select hash, min(id) as doc, substring(hash, 1, 32) as chunk_hash from docs where active group by hash), cv as (select chunk_hash, hash, cast(embedding as double[]) as e from ch join embeddings on doc = vec_id)
"""


def _chunk_vectors(v: Views) -> tuple[DataFrame, DataFrame]:
    """Each active text as one chunk, and the vector of its first document."""
    chunks = v.active().groupBy("hash").agg(F.min("id").alias("doc")).select(F.substring("hash", 1, 32).alias("hash"), F.col("hash").alias("document_hash"), "doc")
    vectors = chunks.join(v.vectors(), F.col("doc") == F.col("id")).select(F.col("hash").alias("chunk_hash"), "embedding")
    return chunks.drop("doc"), vectors


@query(_CHUNK_VECTORS + f", q as (select cast(embedding as double[]) as q from embeddings where vec_id = {VECTOR_ID}), near as (select chunk_hash, hash, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) as score from cv cross join q order by score desc, chunk_hash limit 15) select chunk_hash, min(d.id) as id, round(max(score), 6) as score from near n join docs d on d.hash = n.hash and d.active where score >= 0.05 group by chunk_hash")
def vector_chunk_topk(v: Views) -> DataFrame:
    chunks, vectors = _chunk_vectors(v)
    wanted = v.vectors().where(F.col("id") == VECTOR_ID).select(F.col("embedding").alias("q"))
    return vector.search_chunks(vectors, chunks, v.active().select("id", "hash"), wanted, 15, 0.05).select("chunk_hash", "id", r6("score").alias("score"))


@query(_CHUNK_VECTORS + "select chunk_hash, d.id, cast(0.5 as double) as score from (select * from ch order by chunk_hash limit 200) c join docs d on d.hash = c.hash and d.active")
def chunk_document_fanout(v: Views) -> DataFrame:
    from siftwell.operators.chunking import fan_out

    chunks, _ = _chunk_vectors(v)
    found = chunks.orderBy("hash").limit(200).select("hash", F.lit(0.5).alias("score"))
    return fan_out(found, chunks, v.documents()).select("chunk_hash", "id", "score")


@query(_CONCEPTS + "select (select count(*) from concepts) as concepts, (select count(*) from bridge) as links")
def glossary_totals(v: Views) -> DataFrame:
    concepts = glossary.upsert_concepts(_terms(v))
    return rollups.glossary_totals(concepts, _bridge(v, concepts))


@query("select document, seq, coalesce(right(lag(content) over (partition by document order by seq), 200), '') || chr(10) || coalesce(left(lead(content) over (partition by document order by seq), 200), '') as context from chunks")
def chunk_context(v: Views) -> DataFrame:
    from siftwell.operators.chunking import with_context

    return with_context(v.chunks(), "document").select("document", "seq", "context")


@query("select id from labelled where active and contains(category, 'ref') and difficulty = 'beginner'")
def tool_post_filters(v: Views) -> DataFrame:
    from siftwell.plans.engine import Engine

    page = v.labelled().where("active").withColumn("keywords", F.array(F.lit("Rust Language")))
    return Engine(v.spark, {}).post_filtered(page, "REF", "Beginner", "rust").select("id")
