"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, ``-ln(u) / quality``, where ``u`` is a hash of its id and
``quality`` a weight of its text; in the order of these keys, a prefix is a weighted sample without
replacement. A source whose target is e times its size and a bit takes every document e times
(complete epochs) and then the prefix of keys that fills the rest of its budget; the document at the
prefix's end is taken in part.

The prefix is found without sorting a source: keys are counted in quantile bins of each source, the
bins are prefix-summed, and only the one bin that a budget ends in is ordered by row. Sources may be any
number: their targets are found by aggregations, and tables of more than ``MOST_SENT`` of them are joined
without a broadcast. What follows
is a cut for each source, so the choice of a document depends on its own row and that cut alone.

Defined results: null text has size 0; null source is a source, last in order; rows that repeat a
doc_id get the same key; a source of size 0 takes nothing; an empty table gives an empty result;
further columns are ignored. Reruns agree, as keys depend on ids alone and ties go by doc_id.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import binary_texts, free_name, map_texts, row_numbers, slices, staged

#: The weights that sources get in turn, and the most epochs of a source.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
MOST_SENT = 100_000  # rows of a table of sources that is broadcast
WINDOW = 200  # words


def quality(words: list[bytes]) -> float:
    """Weight of a text in [0.25, 1.25]: the mean share of distinct words in its windows of 200 words, by their sizes."""
    if not words:
        return 0.25
    return 0.25 + sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / len(words)


def sample_key(doc_id: int | None, weight: float, seed: int) -> float:
    """Exponential variate of rate ``weight``, from the id alone."""
    raw = b"null" if doc_id is None else struct.pack("<q", doc_id)
    u = (xxhash.xxh64_intdigest(raw, seed) + 0.5) / 2.0**64
    return -math.log(u) / weight


def _keys(seed: int, size: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 1)):
            sizes, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), binary_texts(b.column(1))):
                words = text.split()
                sizes.append(len(words))
                keys.append(sample_key(doc, quality(words), seed))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.float64())], names=[*b.schema.names, size, key])

    return run


def with_keys(docs: DataFrame, seed: int, size: str, key: str) -> DataFrame:
    """``docs``, whose first two columns are an id (long) and a text, with columns ``size`` and ``key``."""
    import pyspark.sql.types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(size, T.LongType()), T.StructField(key, T.DoubleType())])
    return map_texts(docs, _keys(seed, size, key), schema)


def targets(sizes: list[tuple], weights: Sequence[float] = WEIGHTS, most_epochs: float = MOST_EPOCHS) -> list[tuple]:
    """(source, size, target) of each source: shares by weight of all sizes, stopped at ``most_epochs``
    times the source's size, the excess shared again by weight among the others until none is above.

    >>> targets([("a", 10), ("b", 10), ("c", 1000)])
    [('a', 10, 30.0), ('b', 10, 30.0), ('c', 1000, 960.0)]
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    total = float(sum(n for _, n in order))
    share = {i: float(weights[i % len(weights)]) for i in range(len(order))}
    got: dict[int, float] = {}
    left, free = total, set(share)
    while free:
        w = sum(share[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * share[i] / w > most_epochs * order[i][1]]
        if not over:
            got |= {i: left * share[i] / w for i in free}
            break
        for i in over:
            got[i] = float(most_epochs * order[i][1])
        left -= sum(got[i] for i in over)
        free -= set(over)
    return [(s, n, got[i]) for i, (s, n) in enumerate(order)]


def _bin(key: Column, bins: Column) -> Column:
    """Quantile bin of an exponential key of a rate in [0.25, 1.25]: no bin has more than five times its share."""
    return F.least(F.floor((1 - F.exp(-key / 4)) * bins), bins - 1).cast("long")


def planned(sums: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target, epochs, budget`` of ``sums`` (source, n), for any number of sources.

    As :func:`targets`, by rounds of one aggregation: with level L, sources get L times their weight,
    those that would get more than ``most_epochs`` times their size that much; L grows until no more do.
    """
    ranked = staged(row_numbers(sums, F.asc_nulls_last("source"), name="place").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    capped, level = (-1, -1), 0.0
    while True:
        full = F.lit(level) * F.col("weight") > most_epochs * F.col("n")
        r = ranked.agg(F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("weight"))).alias("w"), F.count(F.when(full, 1)).alias("k")).first()
        now = (r["n"] or 0, r["k"])
        if now == capped or not r["w"]:
            break
        capped, level = now, (total - most_epochs * now[0]) / r["w"]
    full = F.lit(level) * F.col("weight") > most_epochs * F.col("n")
    target = F.when(full, (most_epochs * F.col("n")).cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    epochs = F.when(F.col("n") > 0, F.least(F.lit(most_epochs), F.floor(F.col("target") / F.col("n") + 1e-12))).otherwise(0).cast("long")
    out = ranked.select("source", F.col("n").alias("source_size"), target.alias("target"), "n").withColumn("epochs", epochs)
    return out.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("n"))).drop("n")


def _join_sources(rows: DataFrame, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """``rows`` with what ``table`` (of n rows, keyed by s) has on their source: broadcast if it is small, else a
    join whose large keys can be split at run time."""
    return rows.join(F.broadcast(table) if n <= MOST_SENT else table, F.col("source").eqNullSafe(F.col("s")), how)


def cuts(keyed: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, bins: int | None = None) -> tuple[DataFrame, int]:
    """``source, source_size, target, epochs, cut_key, cut_id, ...``: one row for each source, staged, and their number.

    ``keyed`` has doc_id, source, size, key. A document is in the fractional part when its
    (key, doc_id) is at most (cut_key, cut_id); a null cut_key takes none. ``bins`` defaults to a
    count that grows with the rows, so that the one bin of each source that is ordered by row stays small.
    """
    sums = staged(keyed.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")), "sums")
    seen = sums.agg(F.count("*").alias("n"), F.max("rows").alias("rows")).first()
    n = seen["n"]
    bins = bins or max(1024, (seen["rows"] or 0) // 256)
    sources = staged(planned(sums.select("source", "n"), weights, most_epochs), "plan")
    binned = keyed.withColumn("bin", _bin(F.col("key"), F.lit(bins)))
    each = binned.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = (
        _join_sources(each.withColumn("before", before), sources.withColumnRenamed("source", "s"), n)
        .where("n > 0 and budget > 0 and before < budget and budget <= before + n")
        .select("s", F.col("bin").alias("cut_bin"), "before", "budget")
    )
    there = staged(there, "bins")
    within = _join_sources(binned, there, n).where("bin = cut_bin")
    w = Window.partitionBy("s").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = within.withColumn("sum", F.col("before") + F.sum("size").over(w)).where("sum >= budget and size > 0")
    cut = upto.groupBy("s").agg(
        F.min_by(F.struct("key", "doc_id", (F.col("budget") - F.col("sum") + F.col("size")).alias("words")), "sum").alias("b"),
        F.min("bin").alias("cut_bin"),
    )
    out = sources.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", F.col("b.key").alias("cut_key"), F.col("b.doc_id").alias("cut_id"), F.round("b.words").cast("long").alias("cut_words"), "cut_bin", F.lit(bins).alias("bins")
    )
    return staged(out, "cuts"), n


def with_taken(keyed: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """``keyed`` (source, size, key, doc_id and more) with ``copies``, how often the mix takes the whole
    document, and ``words``, how many words of it the mix takes once more at its source's cut."""
    joined = _join_sources(keyed, cut.withColumnRenamed("source", "s"), n)
    own = _bin(F.col("key"), F.col("bins"))
    id_before = F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNull() & F.col("cut_id").isNotNull())
    before = (own < F.col("cut_bin")) | (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & id_before)
    at = (F.col("key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id"))
    joined = joined.withColumn("copies", F.col("epochs") + F.when(F.col("cut_key").isNotNull() & before, 1).otherwise(0))
    joined = joined.withColumn("words", F.when(F.col("cut_key").isNotNull() & at, F.least("cut_words", "size")).otherwise(0))
    return joined.drop("s", "epochs", "cut_key", "cut_id", "cut_words", "cut_bin", "bins")


def keyed_table(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, key`` for each document, staged."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return staged(with_keys(chosen, seed, "size", "key").drop("text"), "keys")


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken`` and ``source, copies, words``.

    The one document that a source's budget ends in gives only the words that are left, so a source
    meets its target to the word.
    """
    keyed = keyed_table(docs, seed)
    out = with_taken(keyed, *cuts(keyed))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies") + F.col("words")).alias("taken"), "source", "copies", "words")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it; columns as in ``docs``.

    Documents stay whole: the one that a budget ends in comes once more if at least half of it fits.
    Keys are recomputed beside the full rows, so texts are neither shuffled nor staged; the cuts of
    the sources are the only thing joined in.
    """
    cut, n = cuts(keyed_table(docs, seed))
    doc, text, size, key = (free_name(docs, x) for x in ("__id", "__text", "__size", "__key"))
    chosen = docs.select(F.col("doc_id").cast("long").alias(doc), F.col("text").alias(text), *[c for c in docs.columns if c.lower() != "text"])
    full = with_keys(chosen, seed, size, key)
    row = F.struct(*[F.col(text if c.lower() == "text" else c).alias(c) for c in docs.columns])
    short = full.select(row.alias("row"), F.col(doc).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(size).alias("size"), F.col(key).alias("key"))
    copies = F.col("copies") + F.when((F.col("words") > 0) & (F.col("words") * 2 >= F.col("size")), 1).otherwise(0)
    taken = with_taken(short, cut, n).withColumn("copies", copies).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)"))).select("row.*")
