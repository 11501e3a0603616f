"""The engine: commands and tools as methods that return DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.config import Config
from siftwell.errors import CollectionNotFound, InvalidInput
from siftwell.functions import text as X
from siftwell.functions.snippets import with_snippet
from siftwell.operators import bm25, chunking, context, describe, filters, fusion, glossary, graph, rollups, sessions, store, vector
from siftwell.operators.search_index import SearchIndex
from siftwell.plans import hybrid, strategy, workflow
from siftwell.sources.items import Registry

DETAILS = ("L0", "L1", "L2")
_DOC_COLUMNS = {"category": "string", "difficulty": "string", "keywords": "array<string>", "concepts": "array<string>", "summary": "string", "llm_title": "string", "intent": "string", "importance": "double", "user_metadata": "string", "modified_at": "timestamp", "provider_type": "string"}


def project(page: DataFrame, detail: str = "L1") -> DataFrame:
    """A page at a level of detail: L0 first sentences only, L1 without bodies, L2 with bodies, without snippets."""
    level = detail.upper() if detail.upper() in DETAILS else "L1"
    types = dict(page.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    drop = {"L0": {"body", "snippet", "keywords", "purpose", "chunk_concepts"}, "L1": {"body"}, "L2": {"snippet"}}[level]
    short = {"summary", "chunk_summary"} if level == "L0" else set()
    return page.select(*[none(c) if c in drop else X.first_sentence(F.col(c)).alias(c) if c in short else F.col(c) for c in page.columns])


class Engine:
    """Documents, chunks and vectors of a :class:`~siftwell.operators.store.Store`, or given as DataFrames.

    ``embedder`` maps a text to a list of floats; ``reranker`` a query and page to ``id, rerank``;
    ``expander`` a query to further queries; ``planner`` a query to a workflow as JSON.
    """

    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, DataFrame] | store.Store,
        config: Config | None = None,
        registry: Registry | None = None,
        embedder: Callable[[str], Sequence[float]] | None = None,
        reranker: Callable[[str, DataFrame], DataFrame] | None = None,
        expander: Callable[[str], Sequence[str]] | None = None,
        planner: Callable[[str], str] | None = None,
        now: dt.datetime | None = None,
    ):
        self.spark, self.tables, self.config = spark, tables, config or Config()
        self.registry = registry or Registry.with_defaults()
        self.embedder, self.reranker, self.expander, self.planner, self.now = embedder, reranker, expander, planner, now

    # -- tables

    def table(self, name: str) -> DataFrame:
        if isinstance(self.tables, dict):
            if name in self.tables:
                return self.tables[name]
            from siftwell.schemas import schema

            return self.spark.createDataFrame([], schema(name))
        return self.tables.read(name)

    def _save(self, name: str, rows: DataFrame) -> DataFrame:
        if isinstance(self.tables, dict):
            self.tables[name] = rows
            return rows
        return self.tables.write(name, rows)

    def documents(self) -> DataFrame:
        docs = self.table("documents")
        if "body" not in docs.columns:
            docs = docs.join(self.table("content").select("hash", F.col("doc").alias("body")), "hash")
        if "importance" not in docs.columns:
            docs = docs.withColumn("importance", F.coalesce("importance_score", F.lit(1.0)) if "importance_score" in docs.columns else F.lit(1.0))
        for name, kind in _DOC_COLUMNS.items():
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind))
        if "filepath" not in docs.columns:
            docs = docs.withColumn("filepath", X.virtual_path(F.col("collection"), F.col("path")))
        return docs.where("active")

    # -- the kept index

    def index(self) -> SearchIndex | None:
        """The kept index of documents, if the tables are a store that has one."""
        found = SearchIndex(self.tables) if isinstance(self.tables, store.Store) else None
        return found if found is not None and found.exists() else None

    def reindex(self) -> SearchIndex:
        """Index all documents anew."""
        if not isinstance(self.tables, store.Store):
            raise InvalidInput("an index is kept in a store")
        return SearchIndex(self.tables).build(self.documents())

    def _index_changes(self, changed: DataFrame) -> None:
        """Bring the kept index up to date with documents (id) that came, changed or went."""
        if not isinstance(self.tables, store.Store):
            return
        fields = list(bm25.DOCUMENT_WEIGHTS)
        live = self.documents().select("id", *fields)
        rows = changed.select("id").distinct().join(live.withColumn("active", F.lit(True)), "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
        SearchIndex(self.tables).update(rows)

    def _relevance(self, query: str, docs: DataFrame, weights: dict | None) -> DataFrame:
        """``id, relevance`` from the kept index, or computed from the documents where there is none."""
        kept = self.index() if weights is None else None
        return kept.search(query) if kept else bm25.search(docs, query, weights or bm25.DOCUMENT_WEIGHTS)

    def has_vectors(self) -> bool:
        return self.embedder is not None and bool(self.table("embeddings").take(1))

    # -- collections

    def collection_add(self, name: str, path: str, pattern: str = "**/*.md", provider_type: str = "file", options: dict | None = None) -> DataFrame:
        row = self.spark.createDataFrame([(name, path, pattern, provider_type, options or {})], "name string, path string, pattern string, provider_type string, provider_config map<string,string>")
        row = row.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
        return self._save("collections", store.upsert(self.table("collections"), row, ["name"]))

    def collection_list(self) -> DataFrame:
        return rollups.collection_counts(self.table("collections"), self.table("documents")).orderBy("name")

    def collection_remove(self, name: str) -> None:
        self._require(name)
        self._save("documents", store.remove_collection(self.table("documents"), name))
        self._save("collections", self.table("collections").where(F.col("name") != name))

    def collection_rename(self, old: str, new: str) -> None:
        self._require(old)
        self._save("documents", store.rename_collection(self.table("documents"), old, new))
        self._save("collections", store.rename_collection(self.table("collections"), old, new, "name"))

    def _require(self, name: str) -> dict:
        found = self.table("collections").where(F.col("name") == name).take(1)
        if not found:
            raise CollectionNotFound(name)
        return found[0].asDict()

    def collection_update(self, name: str) -> DataFrame:
        """Read a collection's source and apply its difference; returns ``path, action``."""
        c = self._require(name)
        options = {"path": c["path"], "pattern": c["pattern"], **(c["provider_config"] or {})}
        items = self.registry.list_items(self.spark, c["provider_type"], options)
        rows = items.select(
            F.xxhash64(F.lit(name), "uri").alias("id"), F.lit(name).alias("collection"), F.coalesce(F.col("metadata")["path"], F.col("uri")).alias("path"), "title", "hash",
            F.current_timestamp().alias("created_at"), F.current_timestamp().alias("modified_at"), "source_type", F.col("uri").alias("source_uri"), F.col("content").alias("doc"),
        ).persist()
        current = self.table("documents").where(F.col("collection") == name)
        changes = store.diff(current, rows)
        merged = store.apply_diff(current, rows.drop("doc"), changes)
        others = self.table("documents").where(F.col("collection") != name)
        ids = merged.select("collection", "path", "id").join(changes.where("action <> 'skip'").select("collection", "path", "action"), ["collection", "path"])
        out = changes.select("path", "action").persist()
        touched = ids.select("id").persist()
        out.count(), touched.count()
        fresh = store.new_content(rows.select("hash", "doc", "created_at"), self.table("content"))
        if isinstance(self.tables, store.Store):
            self.tables.append("content", fresh)
        else:
            self._save("content", self.table("content").unionByName(fresh))
        self._save("documents", others.unionByName(merged, allowMissingColumns=True))
        self._store_chunks(out)
        self._index_changes(touched)
        rows.unpersist()
        return out

    def _store_chunks(self, changes: DataFrame) -> None:
        """Chunk the texts that have no chunks yet, and describe the chunks."""
        if not changes.where("action in ('insert', 'update', 'reactivate')").take(1):
            return
        todo = self.documents().join(self.table("chunks").select(F.col("document_hash").alias("hash")).distinct(), "hash", "left_anti")
        made = chunking.chunk_documents(todo.select("hash", "path", "body"))
        made = made.join(describe.describe_chunks(made), "hash")
        self._save("chunks", store.chunk_upsert(self.table("chunks"), made))

    def describe(self, collection: str | None = None, force: bool = False, responses: DataFrame | None = None) -> DataFrame:
        """Metadata of documents that have none, or of all with ``force``: from a model's ``responses`` (hash,
        response) or the offline generator. Concepts are linked to the documents' chunks. The hashes described."""
        docs = self.documents() if collection is None else self.documents().where(F.col("collection") == collection)
        todo = docs if force else docs.where("summary is null")
        made = describe.describe_documents(todo) if responses is None else describe.parse_response(responses).join(todo.select("hash").distinct(), "hash", "left_semi")
        made = made.persist()
        fields = [f.split()[0] for f in describe.FIELDS.split(", ")]
        stored = store.with_columns_of(self.table("documents"), "documents")
        self._save("documents", store.update_columns(stored, made, "hash", fields))
        terms = made.select("hash", F.posexplode("concepts").alias("ord", "term"))
        fresh = glossary.upsert_concepts(terms)
        known = self.table("concepts")
        new = fresh.join(known.select("normalized"), "normalized", "left_anti").select(F.xxhash64("normalized").alias("id"), "term", "normalized", F.lit(0).cast("long").alias("chunk_count"))
        concepts = self._save("concepts", known.unionByName(new))
        extracted = terms.select(F.col("hash").alias("document_hash"), "term", F.lit("").alias("snippet"))
        links = glossary.link_concepts(concepts.select("normalized"), extracted, self.table("chunks"))
        links = links.join(concepts.select("normalized", F.col("id").alias("concept_id")), "normalized").select("concept_id", "chunk_hash", "document_hash", "snippet")
        self._save("concept_chunks", store.upsert(self.table("concept_chunks"), links, ["concept_id", "chunk_hash"]))
        out = made.select("hash")
        self._index_changes(self.documents().join(out, "hash", "left_semi"))
        return out

    update = collection_update

    def embed(self, embed_batch: Callable[[Sequence[str]], Sequence[Sequence[float]]], model: str, force: bool = False) -> DataFrame:
        """Embed what has no vector yet (everything with ``force``): chunks, cache, misses in batches of 32.

        Vectors and the cache are stored; returns the new vectors ``hash, seq, chunk_hash, embedding, model, cached``.
        """
        import pandas as pd

        docs = self.documents()
        done = self.table("embeddings").select("hash").distinct()
        todo = docs if force else docs.join(done, "hash", "left_anti")
        chunks = chunking.chunk_documents(todo.select("hash", "path", "body"))
        cache = self.table("chunk_embeddings").where(F.col("model") == model)
        hits, misses = store.cache_split(chunks.select(F.col("document_hash").alias("hash"), "seq", F.col("hash").alias("chunk_hash"), "content"), cache, ["chunk_hash"], "embedding")

        def run(batches):
            for b in batches:
                for at in range(0, len(b), 32):
                    part = b.iloc[at : at + 32]
                    yield pd.DataFrame({"chunk_hash": part["chunk_hash"], "embedding": [list(map(float, v)) for v in embed_batch(list(part["content"]))]})

        fresh = misses.dropDuplicates(["chunk_hash"]).select("chunk_hash", "content").mapInPandas(run, "chunk_hash string, embedding array<float>")
        columns = ["hash", "seq", "chunk_hash", "embedding"]
        made = misses.join(fresh, "chunk_hash").select(*columns, F.lit(False).alias("cached")).unionByName(hits.select(*columns, F.lit(True).alias("cached")))
        made = made.withColumn("model", F.lit(model)).persist()
        vectors = made.select("hash", "seq", "model", "embedding")
        self._save("embeddings", store.upsert(store.with_columns_of(self.table("embeddings"), "embeddings"), vectors, ["hash", "seq", "model"]))
        new = made.where("not cached").dropDuplicates(["chunk_hash"]).select("chunk_hash", "model", "embedding")
        self._save("chunk_embeddings", store.upsert(self.table("chunk_embeddings"), new, ["chunk_hash", "model"]))
        first = made.select(F.size("embedding").alias("n")).first()
        if first:
            self._save("model_metadata", store.register_model(self.table("model_metadata"), model, first["n"]))
        return made

    def cleanup(self) -> dict[str, int]:
        """Drop content, vectors and chunks of no active document, and concepts of no chunk; counts of what went."""
        live, out = self.table("documents").where("active"), {}

        def keep(name: str, kept: DataFrame) -> None:
            out[name] = self.table(name).count() - kept.count()
            self._save(name, kept)

        for name, key in (("content", "hash"), ("embeddings", "hash"), ("chunks", "document_hash")):
            keep(name, store.live_only(self.table(name), live.select(F.col("hash").alias(key)), key))
        keep("concept_chunks", store.live_only(self.table("concept_chunks"), self.table("chunks").select(F.col("hash").alias("chunk_hash")), "chunk_hash"))
        keep("concepts", store.live_only(self.table("concepts"), self.table("concept_chunks").select(F.col("concept_id").alias("id")), "id"))
        return out

    def migrate(self) -> None:
        """Bring stored tables of earlier versions to today's columns."""
        for name in ("documents", "chunks", "memories", "embeddings"):
            self._save(name, store.with_columns_of(self.table(name), name))

    # -- contexts, lookups

    def context_add(self, path: str, text: str) -> DataFrame:
        row = self.spark.createDataFrame([(path, text)], "path string, context string").withColumn("created_at", F.current_timestamp())
        return self._save("contexts", store.upsert(self.table("contexts"), row, ["path"]))

    def context_remove(self, path: str) -> DataFrame:
        return self._save("contexts", self.table("contexts").where(F.col("path") != path))

    def context_list(self) -> DataFrame:
        return self.table("contexts").orderBy("path")

    def context_check(self) -> DataFrame:
        return context.missing_context(self.table("collections"), self.table("contexts"))

    def ls(self, prefix: str = "") -> DataFrame:
        return self.collection_list() if not prefix else context.by_prefix(self.documents(), prefix.removeprefix(X.SCHEME))

    def get(self, reference: str, first: int = 1, count: int | None = None) -> DataFrame:
        return context.line_slice(context.lookup(self.documents(), reference), first, count)

    def multi_get(self, patterns: str, most_bytes: int | None = None, fuzzy: bool = False) -> DataFrame:
        found = context.fuzzy(self.documents(), patterns, 10) if fuzzy else context.by_pattern(self.documents(), patterns)
        return context.line_slice(found, most_bytes=most_bytes)

    def status(self) -> DataFrame:
        return rollups.index_stats(self.table("documents"), self.table("content"), self.table("collections"), self.table("embeddings"))

    def providers(self) -> DataFrame:
        return rollups.provider_rollup(self.table("collections"), self.table("documents"))

    # -- search

    def _filtered(self, docs: DataFrame, pairs: Sequence[tuple[str, str]], collection: str | None, provider: str | None) -> DataFrame:
        if collection:
            docs = docs.where(F.col("collection") == collection)
        if provider:
            docs = docs.where(F.col("provider_type") == provider)
        for name, value in pairs:
            docs = docs.where(F.lower(name) == value.lower()) if name in ("category", "difficulty") else filters.by_keyword(docs, value)
        return docs

    def search_bm25(self, query: str, limit: int | None = 20, collection: str | None = None, provider: str | None = None, min_score: float = 0.0, mode: str | None = None, weights: dict | None = None) -> DataFrame:
        """Keyword search; inline filters apply, ``min_score`` after the limit."""
        clean, pairs = X.parse_filters(query)
        docs = self.documents()
        found = self._relevance(clean, docs, weights)
        rows = self._filtered(docs, pairs, collection, provider).drop("body")
        scored = found.join(rows, "id").withColumn("score", bm25.score_of(F.col("relevance"), F.col("importance"), mode or self.config.score_mode)).drop("relevance")
        return bm25.top(scored, limit, F.desc("score"), F.col("id")).where(F.col("score") >= min_score)

    def search_vector(self, query: str, limit: int = 20, collection: str | None = None, min_score: float = 0.0) -> DataFrame:
        if self.embedder is None:
            raise InvalidInput("vector search needs an embedder")
        clean, pairs = X.parse_filters(query)
        docs = self._filtered(self.documents(), pairs, collection, None).drop("body")
        return vector.search_documents(self.table("embeddings"), docs, list(self.embedder("search_query: " + clean)), clean, limit, min_score)

    def search_hybrid(self, query: str, limit: int = 20, collection: str | None = None, min_score: float = 0.0, use_expansion: bool = True, use_reranking: bool = True) -> DataFrame:
        """Keyword and vector search fused; a strong keyword signal skips the rest."""
        keyword = self.search_bm25(query, 3 * limit, collection)
        signal = fusion.strong_signal(keyword).first()
        if signal and signal["strong"] or not self.has_vectors():
            return bm25.top(keyword, limit, F.desc("score"), F.col("id")).where(F.col("score") >= min_score)
        near = self.search_vector(query, 3 * limit, collection)
        if use_expansion and self.expander:
            for kind, q in self._expansions(query):
                if kind == "lexical":
                    keyword = keyword.unionByName(self.search_bm25(q, limit, collection))
                else:
                    near = near.unionByName(self.search_vector(q, limit, collection))
        lists = [fusion.ranked(fusion.keep_first(fusion.ranked(p, F.desc("score"), F.col("id")), "id", "rank").drop("rank"), F.desc("score"), F.col("id")) for p in (keyword, near)]
        rerank = None
        if use_reranking and self.reranker:
            docs = self.documents()
            text = hybrid.rerank_text(F.col("title"), F.col("category"), F.col("difficulty"), F.col("summary"), F.col("keywords"), F.col("body"))
            rerank = lambda rows: self.reranker(query, rows.join(docs.select("id", text.alias("text")), "id"))
        fused = hybrid.fuse_and_rerank(lists[0], lists[1], rerank, min_score=min_score, limit=limit)
        return F.broadcast(fused).join(self.documents().drop("body"), "id").orderBy(F.desc("score"), "id")

    def _expansions(self, query: str) -> list[tuple[str, str]]:
        """The expander's further queries with their kind: lexical ones go to keyword search, semantic and hyde
        ones to vector search. Plain strings are lexical."""
        out = []
        for x in self.expander(query):
            kind, text = ("lexical", x) if isinstance(x, str) else x
            if kind not in ("lexical", "semantic", "hyde"):
                raise InvalidInput(f"unknown kind of expansion: {kind}")
            if text.strip() and text != query:
                out.append((kind, text))
        return out

    def search_hybrid_plain(self, query: str, limit: int = 20, collection: str | None = None) -> DataFrame:
        """Both lists fused by rank alone, without expansion, reranking or a shortcut."""
        lists = [fusion.ranked(p, F.desc("score"), F.col("id")) for p in (self.search_bm25(query, 3 * limit, collection), self.search_vector(query, 3 * limit, collection))]
        fused = hybrid.fuse_and_rerank(lists[0], lists[1], None, limit=limit)
        return F.broadcast(fused).join(self.documents().drop("body"), "id").orderBy(F.desc("score"), "id")

    def search_chunks(self, query: str, limit: int | None = 20, labels: dict[str, str] | None = None) -> DataFrame:
        """Chunk search; ``label:name=value`` words in the query are label filters too."""
        wanted, words = dict(labels or {}), []
        for w in query.split():
            name, eq, value = w.removeprefix("label:").partition("=")
            if w.startswith("label:") and eq:
                wanted[name] = value
            else:
                words.append(w)
        chunks = self.table("chunks").withColumn("id", F.col("hash"))
        found = chunking.search_chunks(chunks, X.sanitise_query(" ".join(words)), limit, "id", store.label_table(self.table("chunks")) if wanted else None, wanted)
        return found.join(chunks, "id").drop("id").orderBy(F.desc("score"), "hash")

    def search_chunks_vector(self, query: str, limit: int = 20, collection: str | None = None, min_score: float = 0.0, model: str | None = None) -> DataFrame:
        """Chunk search by raw cosine over the chunks' vectors."""
        if self.embedder is None:
            raise InvalidInput("vector search needs an embedder")
        vectors, docs = self.table("chunk_embeddings"), self.documents().drop("body", "summary", "concepts")
        if model:
            vectors = vectors.where(F.col("model") == model)
        if collection:
            docs = docs.where(F.col("collection") == collection)
            own = self.table("chunks").join(docs.select(F.col("hash").alias("document_hash")), "document_hash", "left_semi")
            vectors = vectors.join(own.select(F.col("hash").alias("chunk_hash")), "chunk_hash", "left_semi")
        return vector.search_chunks(vectors, self.table("chunks"), docs, list(self.embedder("search_query: " + query)), limit, min_score)

    def chunk_documents_of(self, found: DataFrame) -> DataFrame:
        """Hits of :meth:`search_chunks` with every active document that has the chunk's text."""
        return chunking.fan_out(found.select("hash", "score"), self.table("chunks"), self.documents().withColumn("active", F.lit(True)).drop("body", "summary", "concepts"))

    def get_chunk(self, chunk_hash: str | None = None, label: tuple[str, str] | None = None) -> DataFrame:
        """A chunk with its neighbours, or all chunks with a label."""
        if label is not None:
            return chunking.by_label(self.table("chunks"), store.label_table(self.table("chunks")), *label)
        return chunking.surrounding(self.table("chunks"), chunk_hash)

    navigate_chunks = get_chunk

    def glossary(self, query: str, limit: int = 20) -> DataFrame:
        links = self.table("concept_chunks").join(self.table("concepts").select(F.col("id").alias("concept_id"), "normalized"), "concept_id")
        return glossary.glossary_search(self.table("concepts").select("normalized", "term"), links, self.documents(), query, limit)

    def searchers(self) -> workflow.Searchers:
        chunk = lambda q, n, a: self.search_chunks(q, n).withColumn("id", F.xxhash64("hash"))
        return workflow.Searchers(
            {
                "bm25_search": lambda q, n, a: self.search_bm25(q, n),
                "vector_search": lambda q, n, a: self.search_vector(q, n),
                "hybrid_search": lambda q, n, a: self.search_hybrid(q, n, use_expansion=a.get("use_expansion", True), use_reranking=a.get("use_reranking", True)),
                "bm25_chunk_search": chunk,
                "vector_chunk_search": lambda q, n, a: self.search_chunks_vector(q, n).withColumn("id", F.xxhash64("chunk_hash")).withColumnRenamed("document_hash", "hash"),
                "glossary_search": lambda q, n, a: self.glossary(q, n),
            },
            self.reranker,
            self.expander,
            self.now,
        )

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Planned search: a planner's workflow, or the heuristic one."""
        clean, _ = X.parse_filters(query)
        plan = workflow.plan(clean or query, self.has_vectors(), self.planner)
        page, _ = workflow.run(plan, self.searchers(), limit)
        return page.orderBy("ord")

    def unified(self, query: str, limit: int = 20, after: str | None = None, before: str | None = None, metadata: Sequence[str] = ()) -> DataFrame:
        """Search by the heuristic strategy, then time and metadata filters; where it asks for chunks, documents of
        the best chunks come in as well."""
        choice = strategy.heuristic_strategy(query, self.has_vectors())
        page = {"bm25": self.search_bm25, "vector": self.search_vector, "hybrid": self.search_hybrid}[choice.strategy](query, limit)
        if choice.granularity in ("chunk", "both") and self.table("chunks").take(1):
            hits = self.chunk_documents_of(self.search_chunks(query, limit)).groupBy("id").agg(F.max("score").alias("score"))
            more = hits.join(self.documents().drop("body"), "id").join(page.select("id"), "id", "left_anti")
            page = page.unionByName(more.select(*page.columns) if set(page.columns) <= set(more.columns) else more, allowMissingColumns=True)
        now = self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        page = filters.temporal(page, filters.parse_time(after, now), filters.parse_time(before, now))
        for text in metadata:
            page = page.where(filters.parse_predicate(text).column(F.col("user_metadata")))
        return page

    def smart(self, query: str, limit: int = 20, metadata: Sequence[str] = ()) -> DataFrame:
        """:meth:`unified` of a query in words: what it says of time ("last week", "since 2 days ago") filters by
        time and isn't searched for."""
        words, after, before = strategy.time_in(query)
        return self.unified(words or query, limit, after, before, metadata)

    def post_filtered(self, page: DataFrame, category: str | None = None, difficulty: str | None = None, concept: str | None = None) -> DataFrame:
        """A page's rows whose category contains a text, whose difficulty is one, or that have a keyword that
        contains a concept; letter case doesn't count."""
        if category:
            page = page.where(F.lower("category").contains(category.lower()))
        if difficulty:
            page = page.where(F.lower("difficulty") == difficulty.lower())
        if concept:
            page = page.where(F.exists("keywords", lambda k: F.lower(k).contains(concept.lower())))
        return page

    def snippets(self, page: DataFrame, query: str) -> DataFrame:
        """A page with snippets: bodies are fetched for its rows only."""
        bodies = self.documents().select("id", "body")
        return with_snippet(F.broadcast(page).join(bodies, "id"), query)

    def batch_search(self, queries: DataFrame, limit: int = 5, weights: dict | None = None) -> DataFrame:
        """``query_id, id, rank, relevance`` of many queries (query_id, query) in one plan, each document once."""
        kept = self.index() if weights is None else None
        index = kept or bm25.Index.build(self.documents(), weights or bm25.DOCUMENT_WEIGHTS)
        pages = bm25.top_per_query(index.score(bm25.query_terms(queries)), limit, F.desc("relevance"), F.col("id"))
        return context.first_of(pages, "id", "query_id", "rank")

    def explore(self, query: str, session: str, limit: int = 10, detail: str = "L1") -> dict[str, DataFrame]:
        """A page with seen rows demoted, and suggestions; the page is logged and marked seen."""
        page = workflow.in_order(sessions.demote_seen(self.unified(query, limit), self._seen(session), "hash"), F.desc("score"), F.col("id"))
        page = page.withColumn("filepath", X.virtual_path(F.col("collection"), F.col("path")))
        dirs = sessions.related_directories(page)
        out = {"results": project(page, detail), "directories": dirs, "concepts": sessions.related_concepts(page), "unseen": sessions.unseen_related(self.documents(), dirs, self._seen(session))}
        self._save("session_queries", self.table("session_queries").unionByName(sessions.log_row(page, session, query).withColumn("created_at", F.current_timestamp()), allowMissingColumns=True))
        self._save("session_seen", sessions.mark_seen(self.table("session_seen"), page, session))
        return out

    def _seen(self, session: str) -> DataFrame:
        return self.table("session_seen").where(F.col("session_id") == session).select("document_hash")

    # -- sessions

    def session_start(self, session: str, ttl_seconds: int = sessions.TTL_SECONDS) -> DataFrame:
        """A new session; expired ones go."""
        gone = sessions.expired(self.table("sessions"), F.current_timestamp()).select("id")
        row = self.spark.createDataFrame([(session, ttl_seconds, {})], "id string, ttl_seconds long, context map<string,string>").withColumns({"created_at": F.current_timestamp(), "last_active_at": F.current_timestamp()})
        return self._save("sessions", store.upsert(self.table("sessions").join(gone, "id", "left_anti"), row, ["id"]))

    def session_get(self, session: str) -> DataFrame:
        return self.table("sessions").where(F.col("id") == session)

    def session_history(self, session: str) -> DataFrame:
        return self.table("session_queries").where(F.col("session_id") == session).orderBy("created_at")

    def session_set(self, session: str, key: str, value: str) -> DataFrame:
        own = F.col("id") == session
        old = F.coalesce("context", F.expr("cast(map() as map<string,string>)"))
        merged = F.map_concat(F.map_filter(old, lambda k, v: k != key), F.create_map(F.lit(key), F.lit(value)))
        return self._save("sessions", self.table("sessions").withColumns({"context": F.when(own, merged).otherwise(F.col("context")), "last_active_at": F.when(own, F.current_timestamp()).otherwise(F.col("last_active_at"))}))

    def session_end(self, session: str) -> None:
        self._save("sessions", self.table("sessions").where(F.col("id") != session))
        for name in ("session_queries", "session_seen"):
            self._save(name, self.table(name).where(F.col("session_id") != session))

    # -- metadata

    def metadata_add(self, docid: str, values: dict) -> DataFrame:
        made = filters.Metadata.coerce(values).to_json()
        own = F.col("hash").startswith(docid)
        docs = self.table("documents")
        return self._save("documents", docs.withColumn("user_metadata", F.when(own, filters.merged(F.col("user_metadata"), F.lit(made))).otherwise(F.col("user_metadata"))))

    def metadata_get(self, docid: str) -> DataFrame:
        return self.table("documents").where(F.col("hash").startswith(docid)).select("id", "path", "user_metadata")

    def metadata_remove(self, docid: str, *names: str) -> DataFrame:
        own = F.col("hash").startswith(docid)
        docs = self.table("documents")
        return self._save("documents", docs.withColumn("user_metadata", F.when(own, filters.without(F.col("user_metadata"), *names)).otherwise(F.col("user_metadata"))))

    def metadata_clear(self, docid: str) -> DataFrame:
        docs = self.table("documents")
        return self._save("documents", docs.withColumn("user_metadata", F.when(~F.col("hash").startswith(docid), F.col("user_metadata"))))

    def metadata_query(self, text: str, limit: int | None = 20) -> DataFrame:
        return filters.find_by_metadata(self.documents(), filters.parse_predicate(text), limit)

    # -- graph, directories, memories

    def importance(self) -> DataFrame:
        docs = self.documents()
        return graph.importance(docs, graph.link_edges(graph.links(docs), docs))

    def store_importance(self) -> DataFrame:
        """Rebuild the link table and write each document's importance back to it."""
        docs = self.documents()
        edges = graph.link_edges(graph.links(docs), docs)
        self._save("document_links", edges.withColumn("link_type", F.lit("link")))
        scores = graph.importance(docs, edges).select("id", F.col("importance").alias("importance_score"))
        stored = store.with_columns_of(self.table("documents"), "documents")
        return self._save("documents", store.update_columns(stored, scores, "id", ["importance_score"]))

    def directories(self) -> DataFrame:
        return rollups.directories(self.documents().withColumn("concepts", F.coalesce("concepts", F.expr("cast(array() as array<string>)"))).withColumn("active", F.lit(True)))

    def browse_directory(self, collection: str | None = None, path: str | None = None, max_depth: int = 2) -> DataFrame:
        return rollups.list_directories(self.directories(), collection, path, max_depth)

    def search_directories(self, query: str, limit: int = 10) -> DataFrame:
        dirs = self.directories().withColumn("words", F.concat_ws(" ", "path", F.array_join("concepts", " ")))
        found = bm25.search(dirs, X.sanitise_query(query), {"words": 1.0}, "path")
        return dirs.join(found, "path").orderBy(F.desc("relevance"), "path").limit(limit).drop("words")

    _MEMORY = ("id", "category", "content", "content_hash", "confidence", "source", "access_count", "created_at", "updated_at", "last_accessed_at")

    def memory_store(self, facts: DataFrame) -> DataFrame:
        """Facts (id, category, content, confidence, ord) merged by content with the stored memories; invalid ones are left out."""
        stored = self.table("memories")
        merged = sessions.merge_memories(stored.withColumn("updated", F.lit(None).cast("long")), sessions.valid_memories(facts).withColumn("ord", F.col("ord").cast("long")))
        old = stored.select("content_hash", "source", "created_at", "last_accessed_at", F.col("updated_at").alias("was_updated"))
        joined = merged.join(old, "content_hash", "left")
        rows = joined.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).withColumn("updated_at", F.when(F.col("updated").isNull(), F.col("was_updated")).otherwise(F.current_timestamp()))
        return self._save("memories", rows.select(*self._MEMORY))

    def memory_list(self, limit: int = 20, offset: int = 0, category: str | None = None) -> DataFrame:
        """A page of memories, the latest updated first."""
        return sessions.memory_page(self.table("memories").withColumn("updated", F.col("updated_at")), limit, offset, category).drop("updated")

    def memory_extract(self, session: str, extractor: Callable[[Sequence[str]], str]) -> DataFrame:
        """Memories of a session: ``extractor`` gets its last 50 queries and answers with a JSON list of
        ``category, content, confidence``; the valid ones are stored."""
        log = self.session_history(session).orderBy(F.desc("created_at")).limit(sessions.MOST_LOGGED).select("query").collect()
        if not log:
            return self.table("memories").limit(0)
        answer = self.spark.createDataFrame([(extractor([r["query"] for r in reversed(log)]),)], "response string")
        facts = sessions.parse_memories(answer).select(F.concat(F.lit("mem-"), F.expr("uuid()")).alias("id"), "*", F.monotonically_increasing_id().alias("ord"))
        return self.memory_store(facts)

    def memory_get(self, memory_id: str) -> DataFrame:
        """A memory; that it was read is counted."""
        own = F.col("id") == memory_id
        rows = self.table("memories")
        self._save("memories", rows.withColumns({"access_count": F.when(own, F.col("access_count") + 1).otherwise(F.col("access_count")), "last_accessed_at": F.when(own, F.current_timestamp()).otherwise(F.col("last_accessed_at"))}))
        return self.table("memories").where(own)

    def memory_search(self, query: str, limit: int = 10, category: str | None = None) -> DataFrame:
        rows = self.table("memories")
        if category:
            rows = rows.where(F.col("category") == category)
        return rows.join(bm25.search(rows, X.sanitise_query(query), {"content": 1.0}), "id").orderBy(F.desc("relevance"), "id").limit(limit)

    def memory_delete(self, memory_id: str) -> DataFrame:
        return self._save("memories", self.table("memories").where(F.col("id") != memory_id))
