"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors within cosine c are within Euclidean distance sqrt(2 - 2c). Each of several
tables buckets them by quantised random projections; vectors that share a bucket and a label are
compared by their exact cosine in double precision. Identical vectors are one row of the index.

Buckets give no pairs: for each vector they give the number of vectors it links to, a pair being
counted only in the first table that its two vectors share, and links that connect what is
connected. A bucket of more than ``block`` vectors is dealt over tasks in pairs of blocks, so every
pair is still compared and no task holds more than two blocks.

The number of projections grows with the rows and the number of tables follows from it, so that a
pair just at the threshold is found with probability ``recall``, a closer one more often.

Vectors are scaled by a power of two, which is exact and keeps their norms within range whatever their
size; a table of floats travels as floats, and every comparison is in double precision.

Defined results: a null or empty vector, a zero one, one with a null or non-finite component and one
with a null label links with nothing; vectors of different lengths don't link; rows that repeat a
vec_id are vectors of their own, linked if equal; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import components, staged

THRESHOLD = 0.98
WIDTH = 5.0  # of a quantum, in distances at the threshold


def collision(ratio: float) -> float:
    """Chance that a projection quantised to ``ratio`` times their distance puts two vectors together."""
    normal = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))


def plan(rows: int, recall: float = 0.98, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections, tables) for a number of rows."""
    distance = math.sqrt(2 - 2 * threshold)
    far = collision(WIDTH * distance / math.sqrt(2))
    projections = max(8, math.ceil(math.log(max(rows, 2) / 1000) / -math.log(far)))
    each = collision(WIDTH) ** projections
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - each))


def _vectors(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Usable vectors as bytes, scaled by a power of two, with a digest; both null for the others."""
        for b in batches:
            raw, digest = [], []
            for label, v in zip(b.column(1), b.column(2)):
                data = None
                if label.is_valid and v.is_valid and len(v) and not v.values.null_count:
                    values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    most = float(np.abs(values).max())
                    if 0 < most < math.inf:  # false for nan, too
                        data = (np.ldexp(values, -math.frexp(most)[1]) + 0.0).astype(kind).tobytes()
                raw.append(data)
                digest.append(None if data is None else hashlib.sha256(data).digest()[:16])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "digest", "vector"])

    return run


def _unit(vectors: list[bytes], size: int, kind: str) -> np.ndarray:
    """Rows of norm one in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashes(projections: int, tables: int, distance: float, seed: int, kind: str):
    quantum, width = WIDTH * distance, np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for b in batches:
            vectors = b.column(b.schema.get_field_index("vector")).to_pylist()
            sizes = np.array([len(v) // width for v in vectors])
            keys = np.zeros((len(vectors), tables), np.int64)
            for size in np.unique(sizes):
                if size not in made:
                    rng = np.random.default_rng([seed, int(size)])
                    made[size] = rng.standard_normal((size, tables * projections)), rng.uniform(0, quantum, tables * projections), rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
                a, shift, mix = made[size]
                own = np.flatnonzero(sizes == size)
                x = _unit([vectors[i] for i in own], size, kind)
                q = np.floor((x @ a + shift) / quantum).astype(np.int64).reshape(len(own), tables, projections)
                with np.errstate(over="ignore"):
                    keys[own] = (q * mix).sum(2) * np.int64(31) + np.int64(size)
            flat = pa.array(keys.ravel())
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * tables, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, "keys"])

    return run


def _compare(threshold: float, kind: str):
    """Rows of whole buckets, sorted by bucket: counts of links of each vector, and connecting links."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def bucket(table: int, side: np.ndarray, ids, copies, x, keys) -> tuple[list, list, list]:
        """side: 0 for both sides of the comparison, else 1 and 2 for the two blocks compared."""
        left, right = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
        counts = np.zeros(len(ids), np.int64)
        a, b = [], []
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            r, c = np.nonzero(x[i] @ x[right].T >= threshold)
            r, c = i[r], right[c]
            own = r < c if (side == 0).all() else r != c
            r, c = r[own], c[own]
            first = np.ones(len(r), bool)
            for t in range(table):
                first &= keys[r, t] != keys[c, t]
            r, c = r[first], c[first]
            np.add.at(counts, r, copies[c])
            np.add.at(counts, c, copies[r])
            for p, q in zip(r.tolist(), c.tolist()) if len(r) < 4 * len(i) else _thin(r, c):
                a.append(ids[p])
                b.append(ids[q])
        linked = np.flatnonzero(counts)
        return [*ids[linked], *a], [None] * len(linked) + b, [*counts[linked], *[0] * len(a)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names = ["table", "label", "key", "i", "j"]

        def changes(rows) -> np.ndarray:
            """Whether a row is of another bucket than the one before; the first is not."""
            cell = np.stack([np.asarray(rows.column(x)) for x in names])
            return np.concatenate([[False], (cell[:, 1:] != cell[:, :-1]).any(0)])

        def groups(rows: pa.Table):
            ids, copies, table, side = (rows.column(x).to_numpy() for x in ("id", "copies", "table", "side"))
            vectors = rows.column("vector").to_pylist()
            keys = rows.column("keys").to_pylist()
            start = np.concatenate([[0], np.flatnonzero(changes(rows))])
            for at, to in zip(start, np.append(start[1:], len(ids))):
                if to - at < 2 or len({len(v) for v in vectors[at:to]}) > 1:
                    continue
                x = _unit(vectors[at:to], len(vectors[at]) // np.dtype(kind).itemsize, kind)
                a, b, n = bucket(int(table[at]), side[at:to], ids[at:to], copies[at:to], x, np.array(keys[at:to], np.int64).reshape(to - at, -1))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=out)

        for b in batches:
            if not b.num_rows:
                continue
            new = np.flatnonzero(changes(b))
            apart = bool(held) and any(held[-1].column(b.schema.get_field_index(x))[-1].as_py() != b.column(b.schema.get_field_index(x))[0].as_py() for x in names)
            cut = int(new[-1]) if len(new) else 0
            if cut or apart:
                yield from groups(pa.Table.from_batches([*held, *([b.slice(0, cut)] if cut else [])]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from groups(pa.Table.from_batches(held))

    return run


def _thin(r: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links r, c of one block of rows."""
    root: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = root[i]
        return i

    for p, q in zip(r.tolist(), c.tolist()):
        x, y = top(p), top(q)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield p, q


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.98, block: int = 4096, seed: int = 7) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    chosen = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>"))
    all_ = staged(chosen.mapInArrow(_vectors(kind), "vec_id long, label long, digest binary, vector binary"), "vectors")
    usable = all_.where("digest is not null")
    distinct = staged(
        usable.groupBy("label", "digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")).withColumn("id", F.monotonically_increasing_id()),
        "distinct",
    )
    n = distinct.count()
    projections, tables = plan(n, recall, threshold)
    distance = math.sqrt(2 - 2 * threshold)
    hashed = staged(
        distinct.select("id", "label", "copies", "vector").mapInArrow(_hashes(projections, tables, distance, seed, kind), "id long, label long, copies long, vector binary, keys array<long>"),
        "hashed",
    )
    spots = hashed.select("id", "label", F.posexplode("keys").alias("table", "key"))
    counts = spots.groupBy("table", "label", "key").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = staged(counts.withColumn("blocks", F.ceil(F.col("rows") / block)), "buckets")
    rows = hashed.select("*", F.posexplode("keys").alias("table", "key")).join(counts.drop("rows"), ["table", "label", "key"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    # of the keys only those of the tables before, which tell whether a pair was met already
    cell = ["table", "label", "key", "i", "j"]
    dealt = rows.select(
        "table", "label", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "copies", side.cast("int").alias("side"), "vector", F.slice("keys", F.lit(1), F.col("table")).alias("keys")
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // 50_000)
    found = dealt.repartition(tasks, *cell).sortWithinPartitions(*cell).mapInArrow(_compare(threshold, kind), "a long, b long, n long")
    found = staged(found, "links")
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null"))
    member = distinct.join(linked, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    member = staged(member.select("label", "digest", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root")), "members")
    smallest = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(smallest, "root").select(F.col("label").alias("l"), F.col("digest").alias("d"), (F.col("copies") - 1 + F.col("n")).alias("links"), "component")
    joined = all_.drop("vector").join(named, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
