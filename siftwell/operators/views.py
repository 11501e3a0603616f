"""The retrieval model's views over the driver's tables: documents, content, chunks, collections, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X


class Views:
    """Lazy DataFrames; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("collection"),
            F.concat("lang", F.lit("/d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
            F.substring_index("text", "\n", 1).alias("title"),
            X.content_hash(F.col("text")).alias("hash"),
            F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, doc_id, 0)").alias("modified_at"),
            (F.col("doc_id") % 10 != 9).alias("active"),
            F.col("text").alias("body"),
            F.when(F.col("n_chars") < 500, "beginner").when(F.col("n_chars") < 2000, "intermediate").otherwise("advanced").alias("difficulty"),
            "lang",
            "n_chars",
        )

    def labelled(self) -> DataFrame:
        """Documents with a category from their quality label, null where there is none."""
        labels = self.table("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "reference").when(F.col("quality") == 0, "draft").alias("category"), "toxic")
        return self.documents().join(labels, "id", "left")

    def active(self) -> DataFrame:
        return self.documents().where("active")

    def content(self) -> DataFrame:
        return self.documents().groupBy("hash").agg(F.min_by("body", "id").alias("doc"))

    def collections(self) -> DataFrame:
        kind = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, "file").otherwise("url")
        return self.table("documents").select(F.col("source").alias("name"), kind.alias("provider_type")).distinct()

    def vectors(self) -> DataFrame:
        """Embeddings as doubles, joined to documents by id: hash, seq, embedding, label."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")

    def chunks(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("document"), F.col("turn").alias("seq"), F.col("text").alias("content"), F.col("role").alias("chunk_type"), F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("chunk_id")
        )

    def session_queries(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("query"), F.col("ts").alias("created_at"), "value", "props")

    def contexts(self) -> DataFrame:
        """A description for each language folder and for some of its subfolders."""
        langs = self.table("documents").select("lang").distinct()
        deep = langs.select(F.concat("lang", F.lit("/d3")).alias("path"))
        return langs.select(F.col("lang").alias("path")).union(deep).select("path", F.concat(F.lit("about "), F.col("path")).alias("context"))


#: The same views for DuckDB, to put before a query.
SQL = r"""
with docs as (
    select doc_id as id, source as collection, concat(lang, '/d', doc_id % 7, '/', doc_id, '.md') as path,
           split_part(text, chr(10), 1) as title, sha256(text) as hash,
           timestamp '2024-01-01' + to_minutes(doc_id) as modified_at, doc_id % 10 <> 9 as active, text as body,
           case when n_chars < 500 then 'beginner' when n_chars < 2000 then 'intermediate' else 'advanced' end as difficulty,
           lang, n_chars
    from documents
), labelled as (
    select d.*, case when l.quality = 1 then 'reference' when l.quality = 0 then 'draft' end as category, l.toxic
    from docs d left join labels l on d.id = l.doc_id
), content as (
    select hash, arg_min(body, id) as doc from docs group by hash
), collections as (
    select distinct source as name, case when cast(regexp_extract(source, '(\d+)$', 1) as int) % 2 = 0 then 'file' else 'url' end as provider_type from documents
), chunks as (
    select conv_id as document, turn as seq, text as content, role as chunk_type, concat(conv_id, '_', turn) as chunk_id from conversations
), contexts as (
    select path, concat('about ', path) as context from (select distinct lang as path from documents union all select distinct concat(lang, '/d3') from documents)
)
"""
