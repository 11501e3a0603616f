"""Exact deduplication over a cuckoo-filter index of live content digests.

Two texts are equal when they are identical after every ASCII white-space character is deleted.
Each map task keeps a :class:`CuckooIndex` of the contents it has met: a filter of 16-bit marks whose every
slot has a record stored beside it. A miss of both buckets of a digest is proof that it is new; where a mark
hits, the slot's stored content key (the normalised text's SHA-256 and its length) is compared, so a false
hit never merges two texts. The index holds a bounded number of live digests; when it is full, its oldest
entries are emitted as partial groups and deleted. Partial groups are dealt by digest, and a second index
for each bucket merges them, so a text with a billion copies reaches a bucket as a few rows for each task.

Defined results: null text counts as empty and equals white space alone; a null doc_id is a
document like any other and sorts first; rows that repeat a doc_id and text are one group, of which
one row stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import batches_of, binary_texts, free_name, map_texts, staged

_SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
KICKS = 200


class CuckooFilter:
    """16-bit marks in buckets of four slots, with two candidate buckets for each key. ``held`` names for each
    slot what the owner stored for the key whose mark is there; both move together."""

    def __init__(self, buckets: int = 1024):
        self.buckets = 1 << max(0, buckets - 1).bit_length()
        self.table = array("H", bytes(2 * SLOTS * self.buckets))
        self.held = array("q", bytes(8 * SLOTS * self.buckets))
        self.size = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _put(self, bucket: int, mark: int, what: int) -> bool:
        for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.table[i]:
                self.table[i], self.held[i] = mark, what
                return True
        return False

    def insert(self, digest: bytes, what: int = 0) -> bool:
        """False if no room was found; the caller then rebuilds the filter from its keys."""
        mark, first, second = self._place(digest)
        if self._put(first, mark, what) or self._put(second, mark, what):
            self.size += 1
            return True
        bucket = second
        for kick in range(KICKS):
            i = SLOTS * bucket + kick % SLOTS
            mark, self.table[i] = self.table[i], mark
            what, self.held[i] = self.held[i], what
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, what):
                self.size += 1
                return True
        return False

    def hits(self, digest: bytes) -> Iterator[int]:
        """Slots whose mark is the digest's, in its two buckets."""
        mark, first, second = self._place(digest)
        for bucket in (first, second) if first != second else (first,):
            for i in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.table[i] == mark:
                    yield i

    def __contains__(self, digest: bytes) -> bool:
        return any(True for _ in self.hits(digest))

    def clear(self, slot: int) -> None:
        self.table[slot] = 0
        self.size -= 1


class CuckooIndex:
    """Live contents with their records, found through the filter's slots alone.

    A content key is (digest, bytes of the normalised text). A hit is verified against the key stored for that
    slot. On overflow the filter doubles and is refilled from the stored keys. Entries are numbered as
    they come, so the oldest are known.
    """

    def __init__(self, buckets: int = 1024):
        self.filter = CuckooFilter(buckets)
        self.entries: dict[int, tuple[bytes, int, list]] = {}  # by number: digest, length, record
        self.next = 0
        self.resizes = 0

    def __len__(self) -> int:
        return len(self.entries)

    def _slot(self, digest: bytes, length: int) -> int | None:
        for slot in self.filter.hits(digest):
            stored = self.entries[self.filter.held[slot]]
            if stored[0] == digest and stored[1] == length:
                return slot
        return None

    def find(self, digest: bytes, length: int = 0) -> list | None:
        slot = self._slot(digest, length)
        return None if slot is None else self.entries[self.filter.held[slot]][2]

    def insert(self, digest: bytes, record: list, length: int = 0) -> None:
        """Add a content that :meth:`find` did not find."""
        self.entries[self.next] = (digest, length, record)
        self.next += 1
        if not self.filter.insert(digest, self.next - 1):
            self._resize()

    def delete(self, digest: bytes, length: int = 0) -> list | None:
        slot = self._slot(digest, length)
        if slot is None:
            return None
        self.filter.clear(slot)
        return self.entries.pop(self.filter.held[slot])[2]

    def _resize(self) -> None:
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(digest, number) for number, (digest, _, _) in self.entries.items()):
                return

    def oldest(self, n: int) -> list[tuple[bytes, int]]:
        return [(digest, length) for (digest, length, _), _ in zip(self.entries.values(), range(n))]

    def items(self) -> Iterator[tuple[bytes, int, list]]:
        return iter(self.entries.values())


def normalised(text: bytes) -> bytes:
    return text.translate(None, _SPACE)


def _better(a: list, b: list) -> bool:
    """Whether record a stays before b: more code points, then smaller doc_id (null first), then row."""
    return (-a[0], a[1] is not None, a[1] or 0, a[2]) < (-b[0], b[1] is not None, b[1] or 0, b[2])


def merge(rows: Iterable[tuple[bytes, int, list]], most_live: int) -> Iterator[tuple]:
    """Groups of (digest, length, record) through a cuckoo index; a record is [code points, doc_id, row, count]."""
    index = CuckooIndex()
    for digest, length, record in rows:
        known = index.find(digest, length)
        if known is None:
            if len(index) >= most_live:
                for old, size in index.oldest(most_live // 2):
                    yield (old, size, *index.delete(old, size))
            index.insert(digest, record, length)
        else:
            count = known[3] + record[3]
            if _better(record, known):
                known[:] = record
            known[3] = count
    for digest, length, record in index.items():
        yield (digest, length, *record)


_DIGESTS = "row_id long, doc_id long, n_points long, digest binary, length long"
_GROUPS = "digest binary, length long, n_points long, keep_id long, keep_row long, group_size long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("length", pa.int64()), ("n_points", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])
_DIGEST_ARROW = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("digest", pa.binary()), ("length", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = binary_texts(batch.column(1))
        bare = [normalised(x) for x in texts]
        digests = [hashlib.sha256(x).digest() for x in bare]
        points = [len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in texts]
        rows = batch.column(2) if batch.num_columns > 2 else pa.array(range(row, row + len(texts)), pa.int64())
        row += len(texts)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array(points, pa.int64()), pa.array(digests, pa.binary()), pa.array(list(map(len, bare)), pa.int64())], schema=_DIGEST_ARROW)


def _first_pass(most_live: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for row, doc, n, digest, length in zip(*(b.column(i).to_pylist() for i in range(5))):
                    yield digest, length, [n, doc, row, 1]

        yield from batches_of(_GROUP_ARROW, merge(rows(), most_live))

    return run


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for digest, length, *record in zip(*(b.column(i).to_pylist() for i in range(6))):
                yield digest, length, record

    yield from batches_of(_GROUP_ARROW, merge(rows(), 1 << 62))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row_id: str | None = None) -> DataFrame:
    """``row_id, doc_id, n_points, digest`` for each row, staged so that row_id is fixed; ``row_id`` names a
    column that numbers the rows already."""
    chosen = docs.select(F.col(doc_id).cast("long"), F.col(text), *([F.col(row_id).cast("long")] if row_id else []))
    return staged(map_texts(chosen, _digest, _DIGESTS), "digests")


def groups_of(digested: DataFrame, most_live: int = 100_000, bucket_rows: int = 200_000) -> DataFrame:
    """One row for each distinct digest: its size and the row that stays.

    ``most_live`` bounds the entries of a map task's index, ``bucket_rows`` the mean entries of a
    bucket's: the number of buckets grows with the partial groups.
    """
    spark = digested.sparkSession
    partial = staged(digested.mapInArrow(_first_pass(most_live), _GROUPS), "partial")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // bucket_rows))
    return partial.repartition(buckets, "digest").mapInArrow(_second_pass, _GROUPS)


def exact_dedup(docs: DataFrame, most_live: int = 100_000) -> DataFrame:
    """One row for each document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digested = digests(docs)
    groups = groups_of(digested, most_live).select(F.col("digest").alias("of"), F.col("length").alias("of_length"), "keep_id", "keep_row", "group_size")
    joined = digested.join(groups, (F.col("digest") == F.col("of")) & (F.col("length") == F.col("of_length")))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def numbered(docs: DataFrame, name: str = "numbered") -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, staged so that it is fixed, and that column's name."""
    row_id = free_name(docs, "row_id")
    return staged(docs.withColumn(row_id, F.monotonically_increasing_id()), name), row_id


def keep_rows(rows: DataFrame, row_id: str, kept: DataFrame) -> DataFrame:
    """The rows of a :func:`numbered` table whose number is in ``kept`` (one column), without it. Numbers grow with
    the rows, so they are never broadcast."""
    return rows.join(kept.select(F.col(kept.columns[0]).alias(row_id)).hint("merge"), row_id, "left_semi").drop(row_id)


def first_rows(rows: DataFrame, row_id: str = "row_id", most_live: int = 100_000) -> DataFrame:
    """``keep_row``: the number of the one row that stays of each group of equal texts of a :func:`numbered` table."""
    return groups_of(digests(rows, row_id=row_id), most_live).select("keep_row")


def apply_changes(index: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """A new index table ``digest, members`` after documents come and go.

    ``inserts`` and ``deletes`` have one ``digest`` column. Per bucket, live digests are loaded in a
    cuckoo index; a digest whose last member goes is deleted from it. Deleting an unknown digest
    does nothing.
    """
    rows = (
        index.select("digest", F.col("members").cast("long").alias("n"), F.lit(0).alias("what"))
        .unionByName(inserts.groupBy("digest").agg(F.count("*").alias("n")).withColumn("what", F.lit(1)))
        .unionByName(deletes.groupBy("digest").agg(F.count("*").alias("n")).withColumn("what", F.lit(2)))
    )
    out = pa.schema([("digest", pa.binary()), ("members", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for b in batches:  # sorted: what is stored, then what comes, then what goes
            for digest, n, what in zip(*(b.column(i).to_pylist() for i in range(3))):
                known = live.find(digest)
                if what < 2 and known is None:
                    live.insert(digest, [n])
                elif what < 2:
                    known[0] += n
                elif known is not None:
                    known[0] -= n
                    if known[0] <= 0:
                        live.delete(digest)
        yield from batches_of(out, ((k, v[0]) for k, _, v in live.items()))

    return rows.repartition("digest").sortWithinPartitions("what").mapInArrow(run, "digest binary, members long")
