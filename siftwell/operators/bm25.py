"""Weighted multi-field BM25 over an inverted index held as DataFrames.

With N rows, avgdl mean tokens of a row, n rows holding a term and f the weighted hits of a term:

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6
    R   = sum over terms of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len / avgdl))

A row matches only if it holds every term of the query. In ``reference`` mode its score is
importance / (1 + R), in ``relevance`` mode importance * R / (1 + R).

Many queries are one plan: query terms are a table that is joined to the postings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weights of a document's fields and of a chunk's.
DOCUMENT_WEIGHTS = {"filepath": 1.0, "title": 10.0, "body": 5.0, "summary": 8.0, "llm_title": 10.0, "keywords": 15.0, "intent": 7.0, "concepts": 12.0, "user_metadata": 20.0, "modified_at": 0.1}
CHUNK_WEIGHTS = {"content": 1.0, "breadcrumb": 5.0, "summary": 8.0, "purpose": 7.0}


def field_tokens(rows: DataFrame, fields: Sequence[str], key: str = "id", analyse=X.tokens) -> DataFrame:
    """``key``, and for each field an array column ``__field`` of its tokens."""
    return rows.select(key, *[analyse(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"__{f}") for f in fields])


def _placed(field: str, at: int) -> Column:
    """The tokens of a field as structs with the field's place."""
    return F.transform(F.col(f"__{field}"), lambda x: F.struct(x.alias("term"), F.lit(at).alias("at")))


def entries(rows: DataFrame, fields: Sequence[str], key: str = "id", analyse=X.tokens) -> DataFrame:
    """``key, len, term, hits``: each row's distinct terms with their hits in every field, counted inside the row by
    runs of its sorted tokens, so nothing is shuffled. A key stands for one row."""
    arrays = field_tokens(rows, fields, key, analyse)
    size = sum((F.size(f"__{f}") for f in fields), F.lit(0)).cast("int")
    placed = F.sort_array(F.flatten(F.array(*[_placed(f, i) for i, f in enumerate(fields)])))
    tokens = arrays.select(key, size.alias("len"), placed.alias("__t"))
    starts = F.transform("__t", lambda x, i: F.when((i == 0) | (x["term"] != F.get("__t", i - 1)["term"]), i))
    marked = tokens.select(key, "len", "__t", F.filter(starts, lambda i: i.isNotNull()).alias("__s"))
    runs = F.transform("__s", lambda s, i: F.slice("__t", s + 1, F.coalesce(F.get("__s", i + 1), F.size("__t")) - s))

    def hits(run: Column, at: int) -> Column:
        return F.size(F.filter(run, lambda x: x["at"] == at))

    each = marked.select(key, "len", F.explode(F.transform(runs, lambda r: F.struct(F.get(r, F.lit(0))["term"].alias("term"), F.array(*[hits(r, at) for at in range(len(fields))]).alias("hits")))).alias("p"))
    return each.select(key, "len", F.col("p.term").alias("term"), F.col("p.hits").alias("hits"))


def _named(field: str) -> Column:
    """The tokens of a field as structs with the field's name."""
    return F.transform(F.col(f"__{field}"), lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))


def _occurrences(field: str, term: str) -> Column:
    return F.size(F.filter(F.col(f"__{field}"), lambda x: x == F.lit(term)))


def postings(rows: DataFrame, weights: Mapping[str, float], key: str = "id", terms: Sequence[str] | None = None, analyse=X.tokens) -> DataFrame:
    """``key, field, term, tf``; only of ``terms`` if given, which are sifted before tokens become rows."""
    arrays = field_tokens(rows, list(weights), key, analyse)
    if terms is not None:
        wanted = F.array(*map(F.lit, terms))
        arrays = arrays.select(key, *[F.filter(f"__{f}", lambda x: F.array_contains(wanted, x)).alias(f"__{f}") for f in weights])
    pairs = F.flatten(F.array(*[_named(f) for f in weights]))
    return arrays.select(key, F.explode(pairs).alias("p")).groupBy(key, F.col("p.field").alias("field"), F.col("p.term").alias("term")).agg(F.count("*").alias("tf"))


def lengths(rows: DataFrame, weights: Mapping[str, float], key: str = "id", analyse=X.tokens) -> DataFrame:
    """``key, len``: tokens of each row over all fields."""
    arrays = field_tokens(rows, list(weights), key, analyse)
    return arrays.select(key, sum((F.size(f"__{f}") for f in weights), F.lit(0)).cast("long").alias("len"))


def statistics(row_lengths: DataFrame) -> DataFrame:
    """One row: ``n_rows, avgdl``."""
    return row_lengths.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avgdl"))


def document_frequency(post: DataFrame, key: str = "id") -> DataFrame:
    return post.groupBy("term").agg(F.countDistinct(key).alias("df"))


def idf(n_rows: Column, df: Column) -> Column:
    raw = F.log((n_rows - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def query_terms(queries: DataFrame, query: str = "query", qid: str = "query_id", analyse=X.tokens) -> DataFrame:
    """``qid, term, n_terms`` of each query's distinct terms."""
    arrays = queries.select(qid, F.array_distinct(analyse(F.col(query))).alias("terms"))
    return arrays.select(qid, F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


MOST_BROADCAST = 200_000  # terms of all queries that are sent to every executor; more are joined by shuffles


def is_small(terms: DataFrame) -> bool:
    return terms.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def relevance(hits: DataFrame, terms: DataFrame, stats: DataFrame, small: bool, key: str = "id", qid: str = "query_id") -> DataFrame:
    """``qid, key, relevance`` of every row that holds all of a query's terms.

    ``hits`` are ``key, len, term, f`` of the asked terms, ``terms`` the queries' ``qid, term, n_terms``, ``stats`` one row
    of ``n_rows, avgdl``. Hits are shuffled once, by row. A row that lacks a query's rarest term can't match it, so only rows
    that hold it meet the query's other terms.
    """
    sent = F.broadcast if small else lambda x: x
    by_row = hits.select(key, "len", "term", "f").repartition(key)
    # every column is used in both branches: their shuffle is then the same one and is done once
    df = by_row.groupBy(F.col("term").alias("__of")).agg(F.count_if(F.col("f") + F.col("len") + F.hash(key) * 0.0 >= 0).alias("df"))
    asked = df.join(sent(terms.select(qid, "term", "n_terms")), F.col("__of") == F.col("term")).select(F.col(qid).alias("__q"), "term", "n_terms", "df").crossJoin(F.broadcast(stats))
    found = asked.groupBy("__q").agg(F.min(F.struct("df", "term")).alias("m"), F.count("*").alias("n"), F.first("n_terms").alias("n_terms"))
    leads = found.where("n = n_terms").groupBy(F.col("m.term").alias("__lead")).agg(F.collect_list("__q").alias("__qs"))
    led = by_row.join(sent(leads), F.col("term") == F.col("__lead"), "left")
    queries = F.flatten(F.collect_list("__qs").over(Window.partitionBy(key)))
    met = led.withColumn("__qs", queries).select(key, "len", F.col("term").alias("__term"), "f", F.explode("__qs").alias(qid))
    joined = met.join(sent(asked), (F.col("__term") == F.col("term")) & (F.col(qid) == F.col("__q")))
    part = idf(F.col("n_rows"), F.col("df")) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return joined.groupBy(qid, key).agg(F.sum(part).alias("relevance"), F.count("*").alias("held"), F.first("n_terms").alias("n_terms")).where("held = n_terms").select(qid, key, "relevance")


class Index:
    """Postings with what scoring needs; keep it by :meth:`write`, or use it lazily."""

    def __init__(self, post: DataFrame, row_lengths: DataFrame, weights: Mapping[str, float], key: str = "id", own: DataFrame | None = None):
        self.postings, self.lengths, self.weights, self.key, self.entries = post, row_lengths, dict(weights), key, own

    @classmethod
    def build(cls, rows: DataFrame, weights: Mapping[str, float], key: str = "id", analyse=X.tokens) -> "Index":
        return cls(postings(rows, weights, key, analyse=analyse), lengths(rows, weights, key, analyse), weights, key, entries(rows, list(weights), key, analyse))

    def write(self, path: str, buckets: int = 64) -> None:
        """Postings by hash of their term, sorted, so that a query's terms prune row groups."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str, weights: Mapping[str, float], key: str = "id") -> "Index":
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), weights, key)

    def score(self, terms: DataFrame, qid: str = "query_id") -> DataFrame:
        """``qid, key, relevance`` (R) of every row that holds all of a query's terms.

        ``terms`` is what :func:`query_terms` gives. A term limited to a field has a ``field``
        column; null means any field.
        """
        fielded = "field" in terms.columns
        wanted = terms.withColumnRenamed("field", "only") if fielded else terms.withColumn("only", F.lit(None).cast("string"))
        # no token holds a zero character, so a term with its field is a term of its own
        named = F.when(F.col("only").isNull(), F.col("term")).otherwise(F.concat("only", F.lit("\0"), "term"))
        distinct, small = wanted.select("term", "only").distinct(), is_small(terms)
        distinct = F.broadcast(distinct) if small else distinct
        if self.entries is not None:
            held = self.entries.join(distinct, "term")
            in_field = [F.when(F.col("only").isNull() | (F.col("only") == f), F.col("hits")[i]).otherwise(0) for i, f in enumerate(self.weights)]
            f = sum((F.lit(float(w)) * n for w, n in zip(self.weights.values(), in_field)), F.lit(0.0))
            hits = held.where(sum(in_field, F.lit(0)) > 0).select(self.key, "len", named.alias("term"), f.alias("f"))
        else:
            weight = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])
            held = self.postings.join(distinct, "term").where(F.col("only").isNull() | (F.col("field") == F.col("only")))
            per = held.groupBy("term", "only", self.key).agg(F.sum(weight[F.col("field")] * F.col("tf")).alias("f"))
            hits = per.join(self.lengths, self.key).select(self.key, "len", named.alias("term"), "f")
        return relevance(hits, wanted.select(qid, named.alias("term"), "n_terms"), statistics(self.lengths), small, self.key, qid)

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """``key, relevance`` of one query, best first; its terms are pushed to the postings' scan."""
        terms = sorted(set(_driver_tokens(query)))
        spark = self.postings.sparkSession
        asked = spark.createDataFrame([(0, t, len(terms)) for t in terms], "query_id long, term string, n_terms int").coalesce(1)
        own = Index(self.postings.where(F.col("term").isin(terms)), self.lengths, self.weights, self.key)
        return top(own.score(asked).select(self.key, "relevance"), limit, F.desc("relevance"), F.col(self.key))


def score_of(relevance: Column, importance: Column, mode: str = "reference") -> Column:
    """The score shown for a relevance R."""
    if mode == "reference":
        return importance / (1 + relevance)
    if mode == "relevance":
        return importance * relevance / (1 + relevance)
    raise ValueError(mode)


def top(scored: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """First ``n`` rows in an order; all of them for None or 0."""
    out = scored.orderBy(*order)
    return out.limit(n) if n else out


def top_per_query(scored: DataFrame, n: int, *order: Column, qid: str = "query_id") -> DataFrame:
    """First ``n`` rows of each query with ``rank`` from 0."""
    w = Window.partitionBy(qid).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)


def search(rows: DataFrame, query: str, weights: Mapping[str, float], key: str = "id") -> DataFrame:
    """One query over rows not indexed yet: only its terms' postings are built. ``key, relevance``."""
    terms = sorted(set(_driver_tokens(query)))
    if not terms:
        return rows.limit(0).select(key).withColumn("relevance", F.lit(0.0))
    arrays = field_tokens(rows, list(weights), key)
    size = sum((F.size(f"__{f}") for f in weights), F.lit(0)).cast("double")
    counts = [sum((F.lit(w) * _occurrences(f, t) for f, w in weights.items()), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(terms)]
    flat = arrays.select(key, size.alias("len"), *counts)
    stats = flat.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    held = flat.where(" and ".join(f"f{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    r = sum(
        (idf(F.col("n_rows"), F.col(f"df{i}")) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))) for i in range(len(terms))),
        F.lit(0.0),
    )
    return held.select(key, r.alias("relevance"))


def _driver_tokens(query: str) -> list[str]:
    import regex

    return [t for t in regex.split(X.TOKEN_SPLIT, query.lower()) if t]
