"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

A document's token ids and one end id are cut into whole sequences and a rest. Of the rests only the
histogram of lengths goes to the driver, at most ``length`` numbers: lengths are placed longest
first, each into the packs with the most room, by counts of packing patterns and never by document.
A pattern's slots take ranges of ranks, so a piece finds its sequence and offset from its length and
its rank among pieces of that length. Ranks are counted in hashed parts of each length, so a length
that a third of all documents share is no single task.

Sequences are padded to ``length``, unless the tokens in them are a power of two. On the given
tables padding is under one in a thousand.

Defined results: null text is empty, and an empty document is its end id alone; rows that repeat a
doc_id are packed each for itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Words, map_texts, slices, small_table, staged, worker_cache

LENGTH = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

#: Fixed values of the vocabulary's splitter, for text of Latin letters.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Text that the fast way reads as the tokenizer does: no controls, odd spaces, special tokens or combining marks.
_ODD = "[^\t-\r -;=-~¡-įı-ɏ‐-‧€]"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids equal to the tokenizer's own.

    White space parts tokens in this vocabulary, so a batch's texts are split there and each
    distinct part is encoded once; parts are kept across batches, those
    of the last one or two times ``most_cached``.
    Text with anything out of the ordinary goes through the tokenizer itself.
    """

    def __init__(self, path: str, most_cached: int = 150_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = self._byte_letters()
        self.most = most_cached
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The byte-level alphabet: printable Latin-1 stands for itself, other bytes from U+0100 on, in order."""
        own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
        others = iter(range(256, 512))
        return {b: chr(b) if b in own else chr(next(others)) for b in range(256)}

    def _part(self, chunk: bytes) -> bytes:
        s, out = chunk.decode(), array("I")
        for part in (s,) if s.isalpha() else _SPLIT.findall(s):
            out.extend([t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))])
        return out.tobytes()

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's end."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        words = Words(plain, "utf8")
        if len(self.cache) > self.most:
            self.cache, self.older = {}, self.cache
        cache, older, parts = self.cache, self.older, []
        for chunk in words.distinct:
            ids = cache.get(chunk)
            if ids is None:
                ids = cache[chunk] = older.get(chunk) or self._part(chunk)
            parts.append(ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        flat = np.frombuffer(b"".join(parts), np.uint32)
        each = sizes[words.codes]
        upto = np.cumsum(each)
        ids = flat[np.repeat(starts[words.codes] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[words.ends]
        if not len(odd):
            return ids, ends
        split = np.split(ids, ends[:-1])
        for i in odd:
            split[i] = np.array(self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(split).astype(np.uint32), np.cumsum([len(x) for x in split])


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its cache lives across a stage's tasks."""
    return worker_cache(("encoder", path), lambda: Encoder(path))


_PIECES = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECE_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in _PIECES.split(", ")])


def _cut(path: str | None, length: int, end_id: int, with_ids: bool):
    schema = _PIECE_ARROW.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _PIECE_ARROW
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path()).batch
        row = TaskContext.get().partitionId() << 33
        for b in (x for batch in batches for x in slices(batch, 1, 2 << 20)):
            cols: list[list] = [[] for _ in schema.names]
            ids, ends = encode(b.column(1))
            at = 0
            for doc, to in zip(b.column(0).to_pylist(), ends.tolist()):
                n = to - at + 1
                for start in range(0, n, length):
                    own = ids[at + start : min(at + start + length, to)]
                    crc, size = zlib.crc32(own), min(length, n - start)
                    if size > len(own):
                        crc = zlib.crc32(end, crc)
                    for c, v in zip(cols, (row, doc, start, size, crc, n)):
                        c.append(v)
                    if with_ids:
                        cols[-1].append(own.tolist() + [end_id] * (size - len(own)))
                at, row = to, row + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run, _PIECES + (", ids array<long>" if with_ids else "")


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The documents' ids cut into pieces of ``length`` and a rest, staged; ``with_ids`` keeps the ids themselves."""
    run, schema = _cut(path, length, end_id, with_ids)
    return staged(map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, schema), "pieces")


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and how many sequences follow each.

    Lengths are placed longest first; each goes to the packs with the most room, whose count it
    splits. The work is bounded by the number of lengths and patterns, whatever the counts.

    >>> pack_histogram({3: 2, 1: 3}, 4)
    [((3, 1), 2), ((1,), 1)]
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []  # a heap of -room, with stale entries
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, count: int, pattern: tuple[int, ...]) -> None:
        if not room:
            done.append((pattern, count))
        else:
            if room not in open_packs:
                open_packs[room] = []
                heapq.heappush(rooms, -room)
            open_packs[room].append((count, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if rooms and -rooms[0] >= size:
                room = -rooms[0]
                count, pattern = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
                    heapq.heappop(rooms)
                n = min(left, count)
                if count > n:
                    put(room, count - n, pattern)
                put(room - size, n, (*pattern, size))
            else:
                # as many sequences as hold what is left, filled with this size
                each = length // size
                n = left // each or 1
                put(length - size * min(each, left), n, (size,) * min(each, left))
                n *= min(each, left)
            left -= n
    return done + [(p, c) for packs in open_packs.values() for c, p in packs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: pieces of ``size`` with ranks from ``low`` on go to sequences from ``first`` on, at ``offset``."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], first, offset))
            taken[size] += count
            offset += size
        first += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("size", "low", "first", "offset"), table.T.copy()))


def with_ranks(cut: DataFrame, histogram: dict[int, int], part_rows: int = 1_000) -> DataFrame:
    """``rank`` of each piece among those of its length, gapless from 0, counted in hashed parts."""
    spark = cut.sparkSession
    parts = small_table(spark, {"of": list(histogram), "parts": [max(1, -(-n // part_rows)) for n in histogram.values()]})
    dealt = cut.join(F.broadcast(parts), F.col("length") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("row_id", "start"), F.col("parts")))
    dealt = dealt.drop("of", "parts").repartition("length", "part")
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("row_id", "start")) - 1)
    sums = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("length").alias("l"), F.col("part").alias("p"), before.alias("before"))
    return own.join(sums, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("before") + F.col("nth")).drop("l", "p", "part", "nth", "before")


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        start = np.searchsorted(table["size"], np.arange(table["size"].max(initial=0) + 2))
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                lo, hi = start[s], start[s + 1]
                at[own] = lo + np.searchsorted(table["low"][lo:hi], rank[own], "right") - 1
            keep = [i for i, x in enumerate(b.schema.names) if x != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(table["first"][at] + rank - table["low"][at]), pa.array(table["offset"][at])],
                names=[*(b.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (and ``row_id``, which tells repeated documents apart, and ``ids`` if asked for)."""
    spark = docs.sparkSession
    cut = pieces(docs, length, end_id, path, with_ids)
    found = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    plan = spark.sparkContext.broadcast(slots(pack_histogram(found, length)))
    ranked = with_ranks(cut, found)
    import pyspark.sql.types as T

    schema = T.StructType([*[f for f in ranked.schema.fields if f.name != "rank"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    out = ranked.mapInArrow(_place(plan), schema)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id", *(["ids"] if with_ids else []))
