"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint takes, bit by bit, the majority of its four-word shingles' 64-bit hashes.
Two fingerprints that differ in at most k bits, cut into k // 2 + 1 segments, differ by at most one
bit in some segment. So each distinct fingerprint is indexed once for every bit of every segment,
under the segment with that bit left out: fingerprints equal but for one bit meet in an equality
join, and each meeting is verified on all 64 bits.

Copies share a fingerprint and are one row of the index. Within a key, links are found as a
spanning forest: from each fingerprint on, what it reaches leaves the set of those still to be
reached, so a dense group of m fingerprints gives m - 1 links and not all its pairs, and no
connection is lost.

Values of a segment that more than ``popular`` distinct fingerprints have are popular. A key that a
popular value gives also holds one of 2 * (k // 2) + 1 parts of the other segments, one of which must be
equal: five times the rows, in keys that are shared by chance a few hundred times less often. Such a key
with more rows than ``block`` (or a hundred-thousandth of all) is dealt over tasks in pairs of blocks. The
result is the same.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked
like any other; a null doc_id gets a row, and null as component_id if its component has no other;
rows that repeat are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import binary_texts, components, map_texts, slices, staged

SHINGLE = 4
MOST_BITS = 4
SEED = 42
_PART = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist())
    n = len(words) - shingle + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        hashes = np.fromiter((digest(joined[a:b], seed) for (a, b), _ in zip(spans, range(min(_PART, n - at)))), np.uint64, min(_PART, n - at))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def segments(most_bits: int = MOST_BITS) -> list[np.ndarray]:
    """The bits of each segment."""
    return np.array_split(np.arange(64), most_bits // 2 + 1)


def masks(most_bits: int = MOST_BITS, refined: bool = False) -> np.ndarray:
    """What each index key keeps of a fingerprint: a segment less one bit, and when refined one part of the rest."""
    out = []
    for segment in segments(most_bits):
        rest = np.setdiff1d(np.arange(64), segment)
        parts = np.array_split(rest, most_bits + 1) if refined else [np.array([], int)]
        for left_out in segment:
            for part in parts:
                out.append(sum(1 << int(i) for i in (*segment, *part) if i != left_out))
    return np.array(out, np.uint64)


def index_keys(prints: np.ndarray, kept: np.ndarray, seed: int = 1) -> np.ndarray:
    """Keys of each fingerprint, one for each mask; a chance collision only adds a candidate."""
    with np.errstate(over="ignore"):
        x = (prints[:, None] & kept[None, :]) + np.arange(seed, seed + len(kept), dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_MAP = 32768  # bits of a bitmap that bitmap_construct_agg makes


def popular_values(prints: DataFrame, most_bits: int, popular: int) -> list[np.ndarray]:
    """For each segment a bitmap of its values that more than ``popular`` fingerprints have: with segments of 22 bits
    a megabyte in all, whatever the rows."""
    parts = segments(most_bits)
    values = F.array(*[F.struct(F.lit(k).alias("segment"), (F.shiftrightunsigned("print", int(x[0])).bitwiseAND((1 << len(x)) - 1)).alias("value")) for k, x in enumerate(parts)])
    often = prints.select(F.explode(values).alias("v")).groupBy("v.segment", "v.value").agg(F.count("*").alias("n")).where(F.col("n") > popular)
    maps = often.groupBy("segment", (F.col("value") / _MAP).cast("long").alias("at")).agg(F.bitmap_construct_agg(F.col("value") % _MAP).alias("bits"))
    out = [np.zeros(1 << len(x), bool) for x in parts]
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[: len(out[r["segment"]])]
        out[r["segment"]][r["at"] * _MAP : r["at"] * _MAP + len(bits)] = bits
    return out


def forest(prints: np.ndarray, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``most_bits``, as pairs of indexes."""
    links, open_ = [], np.arange(len(prints))
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            near = np.bitwise_count(prints[open_] ^ prints[i]) <= most_bits
            if near.any():
                reached = open_[near]
                links += [(i, j) for j in reached]
                queue += reached.tolist()
                open_ = open_[~near]
    return links


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, 1):
            found = np.array([fingerprint(x) for x in binary_texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["ids" if pa.types.is_struct(b.column(0).type) else "doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` (the fingerprint as a signed long) for each row."""
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), _prints, "doc_id long, print long")


def _spread(sent, most_bits: int):
    """``key, print, refined``: keys of a segment's value, or of a popular one its refined keys. Fingerprints that
    share a key have the same two values, or those less one bit, so they agree on which it is."""
    plain, fine, parts = masks(most_bits), masks(most_bits, True), segments(most_bits)
    names = ["key", "print", "refined"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        popular = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(bool) for x in sent.value]
        each = len(fine) // len(plain)
        for b in batches:
            prints = b.column(0).to_numpy()
            for at in range(0, len(prints), 4096):
                own = prints[at : at + 4096]
                bare = own.view(np.uint64)
                hot = np.zeros((len(own), len(plain)), bool)
                k = 0
                for segment, often in zip(parts, popular):
                    value = (bare >> np.uint64(segment[0])) & np.uint64(len(often) - 1 if len(segment) > 2 else (1 << len(segment)) - 1)
                    for bit in range(len(segment)):
                        hot[:, k] = often[value] | often[value ^ np.uint64(1 << bit)]
                        k += 1
                row, mask = np.nonzero(~hot)
                keys = index_keys(bare, plain).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, mask]), pa.array(own[row]), pa.array(np.zeros(len(row), bool))], names=names)
                if hot.any():
                    row, mask = np.nonzero(np.repeat(hot, each, axis=1))
                    keys = index_keys(bare, fine, 1000).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row, mask]), pa.array(own[row]), pa.array(np.ones(len(row), bool))], names=names)

    return run


def _meet(most_bits: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows sorted by key, whole keys only."""
        prints = value.view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        a, b = [], []
        small = np.repeat(size, size) <= 8
        for d in range(1, 8):
            same = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            same = same[np.bitwise_count(prints[same] ^ prints[same + d]) <= most_bits]
            a.append(value[same])
            b.append(value[same + d])
        for at, n in zip(start[size > 8], size[size > 8]):
            own = value[at : at + n]
            found = np.array(forest(own.view(np.uint64), most_bits), np.int64).reshape(-1, 2)
            a.append(own[found[:, 0]])
            b.append(own[found[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, value = [np.array([], np.int64)], [np.array([], np.int64)]
        for b in batches:
            k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if cut or key[-1].size == 0 or key[-1][-1] != k[0]:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, links(np.concatenate([*key, k[:cut]]), np.concatenate([*value, v[:cut]])))), schema=out)
                key, value = [], []
            key.append(k[cut:])
            value.append(v[cut:])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, links(np.concatenate(key), np.concatenate(value)))), schema=out)

    return run


def links(prints: DataFrame, most_bits: int = MOST_BITS, popular: int = 4096, block: int = 65536) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (one column) that connect all that is within ``most_bits``."""
    spark = prints.sparkSession
    n = prints.count()
    often = popular_values(prints, most_bits, popular)
    sent = spark.sparkContext.broadcast([np.packbits(x, bitorder="little").tobytes() for x in often])
    keyed = prints.mapInArrow(_spread(sent, most_bits), "key long, print long, refined boolean")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(masks(most_bits)) // 2_000_000)
    cell = F.col("key")
    if any(x.any() for x in often):
        keyed = staged(keyed, "keys")
        fine = keyed.where("refined")
        size = fine.groupBy("key").agg(F.count("*").alias("rows"))
        total = fine.count()
        tasks = max(tasks, total // 2_000_000)
        large = staged(size.where(F.col("rows") > max(block, total // 100_000)).select(F.col("key").alias("k"), F.ceil(F.col("rows") / block).alias("blocks")), "large")  # at most 100,000 keys
        if large.limit(1).count():
            keyed = keyed.join(F.broadcast(large), F.col("refined") & (F.col("key") == F.col("k")), "left")
            keyed = keyed.withColumn("own", F.pmod(F.xxhash64("print"), F.coalesce("blocks", F.lit(1))))
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
            keyed = keyed.withColumn("other", other)
            # a cell's number takes the key's place; a chance collision only adds candidates
            cell = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = keyed.select(cell.alias("key"), "print")
    return dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_meet(most_bits), "a long, b long")


def _members(of: DataFrame, most_bits: int, popular: int, block: int) -> DataFrame:
    """``print, least, root`` of each distinct fingerprint of ``of`` (doc_id, print), staged."""
    distinct = staged(of.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("print"), most_bits, popular, block))
    member = distinct.join(roots, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    return staged(member, "members")


def first_rows(rows: DataFrame, row_id: str = "row_id", most_bits: int = MOST_BITS, popular: int = 4096, block: int = 65536) -> DataFrame:
    """``keep_row``: the number of one row of each component of a table numbered by ``row_id``: that of the smallest
    doc_id (null only if there is no other), then of the smallest number."""
    chosen = rows.select(F.struct(F.col(row_id).cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id")).alias("ids"), "text")
    of = staged(map_texts(chosen, _prints, "ids struct<row_id:long,doc_id:long>, print long").select("ids.*", "print"), "prints")
    member = _members(of.select("doc_id", "print"), most_bits, popular, block).select(F.col("print").alias("p"), "root")
    # of each fingerprint first, so that copies of one text travel as a row for each task
    best = of.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("best"))
    return best.join(member, F.col("print") == F.col("p")).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row_id").alias("keep_row"))


def simhash_components(docs: DataFrame, most_bits: int = MOST_BITS, popular: int = 4096, block: int = 65536) -> DataFrame:
    """One row for each document: ``doc_id, fingerprint, component_id``."""
    of = staged(fingerprints(docs), "prints")
    member = _members(of, most_bits, popular, block)
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select(F.col("print").alias("p"), "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return of.join(named, F.col("print") == F.col("p")).select("doc_id", hexed.alias("fingerprint"), "component_id")
