"""CSV, JSON and SQL sources: rows and elements as documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.errors import InvalidInput
from siftwell.sources.items import item_columns


BINS, SAMPLED = 64, 8192  # ranges of an ordered table, and rows whose keys place their bounds


def _bin_of(key: Column, cuts: list[Column]) -> Column:
    """How many of the sorted ``cuts`` a key isn't below, by a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _ordered(rows: DataFrame, order: str, tie: Column) -> DataFrame:
    """``rows`` with their ``__row`` in order of a column. A row's range depends on nothing but its values and on
    bounds that are literals, so the count of the ranges and the rows agree however each is partitioned; bounds are
    sampled, which moves no row's number."""
    keyed = rows.withColumn("__tie", tie)
    key = F.struct(F.col(order).alias("k"), F.col("__tie").alias("t"))
    sample = keyed.where(F.col(order).isNotNull()).select(order, "__tie").orderBy(F.rand(7)).limit(SAMPLED).orderBy(order, "__tie").collect()
    step = max(1, -(-len(sample) // BINS))
    kind = rows.schema[order].dataType
    cuts = [F.struct(F.lit(r[0]).cast(kind).alias("k"), F.lit(r[1]).alias("t")) for r in sample[step::step]]
    binned = keyed.withColumn("__bin", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(_bin_of(key, cuts)))
    sizes = binned.groupBy(F.col("__bin").alias("__of")).agg(F.count("*").alias("__n"))
    shifts = sizes.select("__of", F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = binned.withColumn("__nth", F.row_number().over(Window.partitionBy("__bin").orderBy(order, "__tie")))
    return within.join(F.broadcast(shifts), F.col("__bin") == F.col("__of")).withColumn("__row", F.col("__nth") + F.col("__before"))


def _as_read(rows: DataFrame) -> DataFrame:
    """``rows``, a scan of files, with their ``__row`` as they are read: counted by the scan's partitions, then shifted."""
    marked = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    shifts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return marked.join(F.broadcast(shifts), "__part").withColumn("__row", F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33) + F.col("__before") + 1)


def row_documents(rows: DataFrame, name: str, order: str | None = None, source_type: str = "csv") -> DataFrame:
    """One document for each row: ``column: value`` lines, title ``name - Row n``, values as metadata.

    Rows are numbered from 1 in order of ``order``, nulls first and ties by their values' hash, or as a scan of files
    reads them. Numbers are counted by range or partition and then shifted, so no task gets all rows.
    """
    columns = rows.columns
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    numbered = _as_read(rows) if order is None else _ordered(rows, order, F.xxhash64(*text.values()))
    content = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), text[c]) for c in columns])
    meta = F.create_map(*[x for c in columns for x in (F.lit(c), text[c])])
    number = F.col("__row").cast("string")
    return numbered.select(*item_columns(F.concat(F.lit(f"{source_type}://{name}/row_"), number), F.concat(F.lit(f"{name} - Row "), number), content, source_type, meta))


def load_csv(spark: SparkSession, options: dict) -> DataFrame:
    """Options path, delimiter, has_headers; without headers columns are ``column_1`` and on."""
    headers = str(options.get("has_headers", "true")).lower() == "true"
    rows = spark.read.option("header", headers).option("sep", options.get("delimiter", ",")).option("escape", '"').csv(options["path"])
    if not headers:
        rows = rows.toDF(*[f"column_{i + 1}" for i in range(len(rows.columns))])
    return row_documents(rows, options["path"].rstrip("/").rsplit("/", 1)[-1])


def json_documents(rows: DataFrame, name: str = "json") -> DataFrame:
    """Documents of ``id, json`` rows, one for each; title from title, name or id members, else ``Item id``."""
    members = F.from_json("json", "map<string,string>")
    title = F.coalesce(*[members[k] for k in ("title", "name", "id")], F.concat(F.lit("Item "), F.col("id").cast("string")))
    uri = F.concat(F.lit(f"json://{name}/item_"), F.col("id").cast("string"))
    return rows.select("id", *item_columns(uri, title, F.col("json"), "json", members))


def load_json(spark: SparkSession, options: dict) -> DataFrame:
    """Options path and index_mode: array (one document for each element), object (for each key), full."""
    name = options["path"].rstrip("/").rsplit("/", 1)[-1]
    whole = spark.read.option("wholetext", "true").text(options["path"]).select(F.col("value").alias("json"))
    mode = options.get("index_mode", "array")
    if mode == "full":
        return whole.select(*item_columns(F.lit(f"json://{name}"), F.lit(name), F.col("json"), "json"))
    parsed = whole.select(F.try_parse_json("json").alias("v"))
    if mode == "object":
        pairs = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        return pairs.where("key is not null").select(*item_columns(F.concat(F.lit(f"json://{name}/key_"), "key"), F.col("key"), F.to_json("value"), "json"))
    if mode != "array":
        raise InvalidInput(f"no index mode {mode!r}")
    elements = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where("key is null")
    rows = elements.select(F.col("pos").cast("long").alias("id"), F.to_json("value").alias("json"))
    return json_documents(rows, name).drop("id")


def query_documents(spark: SparkSession, query: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Documents of a query's rows; names are matched ignoring case, rows without content are dropped."""
    mapping = mapping or {}
    rows = spark.sql(query)
    by_name = {c.lower(): c for c in rows.columns}

    def column(option: str, default: str, needed: bool = True):
        name = by_name.get(mapping.get(option, default).lower())
        if name is None and needed:
            raise InvalidInput(f"the query has no column {mapping.get(option, default)!r}; it has {rows.columns}")
        return None if name is None else F.col(f"`{name}`").cast("string")

    id_, content = column("id_column", "id"), column("content_column", "content")
    title = column("title_column", "title", needed="title_column" in mapping)
    title = id_ if title is None else F.coalesce(title, id_)
    return rows.where(F.trim(content) != "").select(*item_columns(id_, title, content, "sql"))


def load_sql(spark: SparkSession, options: dict) -> DataFrame:
    """Options query or table, and id_column, title_column, content_column; or jdbc url with query."""
    if "url" in options:
        rows = spark.read.format("jdbc").option("url", options["url"]).option("query", options.get("query", f"select * from {options.get('table')}")).load()
        rows.createOrReplaceTempView("siftwell_jdbc")
        return query_documents(spark, "select * from siftwell_jdbc", options)
    if "query" not in options and "table" not in options:
        raise InvalidInput("a query or a table is needed")
    return query_documents(spark, options.get("query", f"select * from {options.get('table')}"), options)
