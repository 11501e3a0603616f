"""What the training-data operators share: staged tables, Arrow plumbing, connected components.

Nothing here collects rows of a corpus to the driver, and nothing writes outside the folder that
``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the operators' contracts, as a Java and Python character class.
ASCII_SPACE = r"[\x20\x09-\x0D]"

_roots: "weakref.WeakKeyDictionary[object, str]" = weakref.WeakKeyDictionary()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local session without one gets its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc not in _roots:
        _roots[sc] = tempfile.mkdtemp(prefix="siftwell-")
    return f"file://{_roots[sc]}"


def _folder(spark: SparkSession) -> str:
    """This application's folder of staged tables."""
    return f"{checkpoint_root(spark)}/siftwell/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses don't compute it again,
    its lineage is cut, and a lost executor costs no more than a re-read."""
    return _staged_at(df, name)[0]


def _staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application; its results that were not written yet are lost."""
    _delete(spark, _folder(spark))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def small_table(spark: SparkSession, columns: dict[str, list[int]]) -> DataFrame:
    """Whole numbers of the driver as a table of one partition. It goes through Arrow: a list of rows is an RDD of
    Python's, for which every executor starts a second daemon with workers of its own."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})).coalesce(1)


def row_numbers(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """``df`` with a gapless ``name`` from 0 in the given order, staged: rows are dealt by ranges, numbered in
    each, and shifted by the sizes of the ranges before, of which the driver gets one row each."""
    spark = df.sparkSession
    at = free_name(df, "__at")
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(at, 33).alias("part")
    before, shifts = 0, {"__part": [], "__shift": []}
    for r in sorted(dealt.groupBy(part).agg(F.count("*").alias("n")).collect()):
        shifts["__part"].append(r["part"])
        shifts["__shift"].append(before)
        before += r["n"]
    shift = small_table(spark, shifts)
    joined = dealt.join(F.broadcast(shift), F.shiftright(at, 33) == F.col("__part"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__shift") + (F.col(at).bitwiseAND((1 << 33) - 1))).alias(name))


_kept: list = []


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def worker_cache(key: object, make):
    """What a Python worker keeps between tasks of a stage: one object, so an operator's cache goes when another's comes."""
    key = (_stage(), key)
    if not _kept or _kept[0] != key:
        _kept.clear()
        _kept[:] = [key, make()]
    return _kept[1]


def _drop_others() -> None:
    """Forget what tasks of another stage kept: workers outlive stages, and that stage won't come back."""
    if _kept and _kept[0][0] != _stage():
        _kept.clear()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batches_of(schema: pa.Schema, rows: Iterator[tuple], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``; all of them if they are no more.

    Hashes above what twice as many rows would have are dropped first, so each task hands on its share
    of the sample and not ``most`` rows of its own.
    """
    n, top = rows.count(), 1 << 40
    hashed = rows.withColumn("__hash", F.pmod(F.xxhash64(key), F.lit(top)))
    if n > 2 * most:
        hashed = hashed.where(F.col("__hash") < int(top * 2 * most / n))
    return hashed.orderBy("__hash", key).limit(most).drop("__hash")


def _join_split(rows: DataFrame, per_key: DataFrame, part: int) -> DataFrame:
    """``rows`` (hi, lo) with ``m`` of ``per_key`` (hi, m, n), n being how many rows a key has: a key with more
    than ``part`` rows is dealt in parts of about that many. There are at most rows / part such keys."""
    hot = per_key.where(F.col("n") > part).select(F.col("hi").alias("h"), F.ceil(F.col("n") / part).alias("parts"))
    left = rows.join(F.broadcast(hot), F.col("hi") == F.col("h"), "left").select("hi", "lo", F.coalesce(F.pmod(F.xxhash64("lo"), F.col("parts")), F.lit(0)).alias("salt"))
    right = per_key.select("hi", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / part) - 1)).alias("salt"))
    return left.join(right, ["hi", "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, least_part: int = 256) -> DataFrame:
    """Connected components of an edge table by alternating large-star and small-star steps.

    Returns ``node, root`` for every node of an edge that is not its own component's smallest node;
    ``root`` is the smallest node that it reaches. Each round is two aggregations and two joins
    over at most as many rows as there are edges. A star's centre may be arbitrarily large: its minimum
    is taken map-side first, and its edges are joined back in parts of a thousandth of all (or
    ``least_part``). Rounds grow with the logarithm of a component's size, and each deletes the tables
    of the one before. Raises if ``most_rounds`` don't suffice.
    """
    spark = edges.sparkSession
    now, path = _staged_at(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        return (row["n"], row["s"])

    def smallest(df: DataFrame, m) -> tuple[DataFrame, str]:
        return _staged_at(df.groupBy("hi").agg(m.alias("m"), F.count("*").alias("n")), "least")

    was = mark(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        part = max(least_part, 2 * was[0] // 1000)
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least, least_path = smallest(both, F.least(F.min("lo"), F.col("hi")))
        large, large_path = _staged_at(_join_split(both, least, part).where("lo > hi and lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")), "large")
        # small-star: link the smaller neighbours of a node, and itself, to the smallest
        low, low_path = smallest(large, F.min("lo"))
        links = F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))
        small = _join_split(large, low, part).select(F.explode(links).alias("e")).select("e.*").where("hi <> lo").distinct()
        now, small_path = _staged_at(small, "edges")
        is_now = mark(now)
        for gone in (path, least_path, large_path, low_path):
            _delete(spark, gone)
        path = small_path
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


_LIBC = ctypes.CDLL(None)


def _give_back() -> None:
    """Return freed memory to the system: the workers of one executor share its memory, and stay for other stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


#: Bytes of a batch of texts that a JVM sends to a worker; a count of rows is no bound on them.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` for rows with texts, in batches of about ``BATCH_BYTES`` or a single row: both the JVM and
    the worker hold a batch, for every task of an executor. Plans read the bound when they run, so it is set for the
    session; a lower one is kept. A task begins without what other stages kept and ends by giving memory back."""
    spark = df.sparkSession
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others()
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, text: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most_bytes`` of text each, or a single row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
        _give_back()


class Words:
    """The words of a column of texts, as codes into its distinct words.

    ``ends[i]`` is where text i's words end in ``codes``; ``distinct`` holds bytes. Splitting and
    coding run in Arrow's kernels, so Python work is for each distinct word of the batch. Words are
    what is between ASCII white space; null text has none.
    """

    def __init__(self, column: pa.Array, lower: str = "ascii"):
        import pyarrow.compute as pc

        kind = pa.large_string() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.string()
        texts = pc.fill_null(column.cast(kind), "")
        texts = pc.ascii_lower(texts) if lower == "ascii" else pc.utf8_lower(texts) if lower == "utf8" else texts
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(there)])
        self.ends = ends[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()].astype(np.int64)
        coded = (flat if there.all() else flat.filter(pa.array(there))).dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64, copy=False)
        self.distinct: list[bytes] = coded.dictionary.cast(pa.large_binary() if kind == pa.large_string() else pa.binary()).to_pylist()

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return self.ends - self.starts

    def __len__(self) -> int:
        return len(self.ends)
