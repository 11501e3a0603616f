"""A quality classifier by co-training of two views of a document.

The content view sees the words of a text: relative frequencies of hashed words and of their shapes.
The page view sees metadata only: length, layout, character classes, repetition, language and source.
Each view's logistic model is fitted on labelled documents. Then, for ``ROUNDS`` rounds, both score every
unlabelled document in tasks; of the ``SHARE`` of them that a view is surest of, as many of either class as
its share, found by a histogram of all odds, it hands ``MOST_NEW`` chosen by hash to the *other* view as
training rows. Both views are calibrated on labelled rows kept back from training, and a logistic model of
the two calibrated log-odds scores every document.

Documents are turned into features once, in a staged table that every round reads. Only the fit is bounded:
``MOST_LABELLED`` labelled documents and ``MOST_NEW`` pseudo-labelled ones for each round and view go to the
driver as feature vectors; candidates and thresholds come from all documents. Labels come only from
training rows (crc32 of the id as text, modulo 5, is not 0).

Defined results: null text is empty; null language and source are values of their own; a null
doc_id is never labelled; rows that repeat are scored each for itself; without labels of both classes
every score is the share of good labels (one half without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Words, bounded_sample, slices, staged
from siftwell.llm.language_model import held_out
from siftwell.llm.toxicity import fit_logistic

MOST_LABELLED = 6000
MOST_NEW = 1500
ROUNDS = 4
SHARE = 0.08  # of the unlabelled documents that a view may label in a round
WORD_BUCKETS, SHAPE_BUCKETS = 4096, 512
CONTENT = WORD_BUCKETS + SHAPE_BUCKETS
#: Character classes counted by the page view.
CLASSES = ("[A-Z]", "[0-9]", "[.,;:!?]", r"[#$%&*|<>{}=~^_\\]", "[^\x00-\x7f]", "\n", "!!")
LANGS, SOURCES = 8, 32
PAGE = len(CLASSES) + 5 + LANGS + SOURCES

_RUN = re.compile(r"(.)\1+")


def shape(word: bytes) -> bytes:
    """A word's look: letters, capitals and digits by class, runs written once."""
    s = word.decode("utf-8", "replace")
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in s)
    return _RUN.sub(r"\1", out).encode()


class Views:
    """Both views of a batch with columns text, lang, source."""

    def __init__(self, text: pa.Array, lang: pa.Array, source: pa.Array, memo: dict[bytes, tuple[int, int]]):
        words = Words(text, lower="")
        if len(memo) > 400_000:
            memo.clear()
        pairs = np.empty((len(words.distinct), 2), np.int64)
        for i, word in enumerate(words.distinct):
            got = memo.get(word)
            if got is None:
                got = memo[word] = (zlib.crc32(word.lower()) % WORD_BUCKETS, WORD_BUCKETS + zlib.crc32(shape(word)) % SHAPE_BUCKETS)
            pairs[i] = got
        self.words, self.buckets = words, pairs
        self.page = self._page(text, lang, source)

    def _page(self, text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
        words = self.words
        texts = pc.fill_null(text, "")
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
        out = np.zeros((len(words), PAGE))
        for k, pattern in enumerate(CLASSES):
            out[:, k] = np.sqrt(pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / np.maximum(size, 1))
        k = len(CLASSES)
        n = words.counts
        same = np.concatenate([[False], words.codes[1:] == words.codes[:-1]])
        repeats = np.concatenate([[0], np.cumsum(same)])
        out[:, k] = np.log1p(size)
        out[:, k + 1] = np.log1p(n)
        out[:, k + 2] = (repeats[words.ends] - repeats[words.starts]) / np.maximum(n, 1)
        out[:, k + 3] = size / np.maximum(n, 1)
        out[:, k + 4] = n == 0
        out[:, k + 3] = np.minimum(out[:, k + 3], 40) / 10
        for column, at, width in ((lang, k + 5, LANGS), (source, k + 5 + LANGS, SOURCES)):
            coded = column.cast(pa.string()).dictionary_encode()
            place = np.array([at + zlib.crc32((x or "").encode()) % width for x in coded.dictionary.to_pylist()] or [at])
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(codes >= 0)
            out[rows, place[codes[rows]]] = 1.0
        return out

    def content(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and ten times the relative frequencies of text i."""
        own = self.buckets[self.words.codes[self.words.starts[i] : self.words.ends[i]]].ravel()
        buckets, counts = np.unique(own, return_counts=True)
        return buckets.astype(np.uint16), (10.0 * counts / max(1, len(own) // 2)).astype(np.float32)


_FEATURES = "doc_id long, held_out boolean, buckets binary, counts binary, page binary"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for b in (x for batch in batches for x in slices(batch, 2)):
        v = Views(b.column(2), b.column(3), b.column(4), memo)
        content = [v.content(i) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([x.tobytes() for x, _ in content], pa.binary()), pa.array([y.astype(np.float16).tobytes() for _, y in content], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in v.page], pa.binary())],
            names=["doc_id", "held_out", "buckets", "counts", "page"],
        )


def _read(buckets: list[bytes], values: list[bytes], page: list[bytes]) -> tuple["Sparse", np.ndarray]:
    """Both views of rows of features."""
    ends = np.cumsum([0, *(len(x) // 2 for x in buckets)]).astype(np.int64)
    at = np.frombuffer(b"".join(buckets), np.uint16).astype(np.int64)
    return Sparse(ends, at, np.frombuffer(b"".join(values), np.float16).astype(float)), np.frombuffer(b"".join(page), np.float32).reshape(-1, PAGE).astype(float)


class Sparse:
    """Rows of content features."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.ends, self.at, self.value = ends, at, value
        self.row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))

    def pick(self, rows: np.ndarray) -> "Sparse":
        sizes = np.diff(self.ends)[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        place = np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)
        return Sparse(ends, self.at[place], self.value[place])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self.ends) - 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], CONTENT)


def fit_content(x: Sparse, y: np.ndarray, weight: np.ndarray, penalty: float = 0.02, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights with an intercept last, by accelerated gradient steps, from ``start`` if given."""
    share = float((weight * y).sum() / weight.sum())
    w = np.zeros(CONTENT + 1) if start is None else start.copy()
    if start is None:
        w[-1] = math.log((share + 1e-3) / (1 - share + 1e-3))
    moment, total = w.copy(), weight.sum()
    bound = 0.25 * float(np.max(np.bincount(x.row, x.value**2, len(y)), initial=0.0)) + 0.25
    rate = 4.0 / bound
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(moment[:-1]) + moment[-1], -30, 30)))
        r = weight * (p - y)
        gradient = np.append(x.back(r), r.sum()) / total
        gradient[:-1] += penalty / total * moment[:-1]
        after = moment - rate * gradient
        moment = after + k / (k + 3) * (after - w)
        w = after
    return w


class Model:
    """Weights of both views, their calibrations and how they combine; ``prior`` where nothing was learned."""

    def __init__(self, content=None, page=None, scale=None, calibrate=None, combine=None, prior: float = 0.5):
        self.content, self.page, self.scale, self.calibrate, self.combine, self.prior = content, page, scale, calibrate, combine, prior

    def scores(self, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good by content, by page and by both; ``content`` holds sums without the intercept."""
        if self.content is None:
            flat = np.full(len(page), self.prior)
            return flat, flat, flat
        odds = [content + self.content[-1], (page / self.scale) @ self.page[:-1] + self.page[-1]]
        odds = [np.clip(a * z + b, -12, 12) for z, (a, b) in zip(odds, self.calibrate)]
        both = odds[0] * self.combine[0] + odds[1] * self.combine[1] + self.combine[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*odds, both))


def fit_views(content: Sparse, page: np.ndarray, label: np.ndarray, weight: list[np.ndarray], scale: np.ndarray, before: list | None = None) -> list[np.ndarray]:
    """Weights of the content and the page view on the rows that have a weight for them."""
    rows = [np.flatnonzero(w > 0) for w in weight]
    start = None if before is None else before[0]
    return [
        fit_content(content.pick(rows[0]), label[rows[0]], weight[0][rows[0]], steps=150 if before is None else 40, start=start),
        fit_logistic(page[rows[1]] / scale, label[rows[1]]),
    ]


def _odds(sent):
    """``key, content, page``: the log-odds of good by both views, for each row of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (of_content, of_page), scale = sent.value
        for b in (x for batch in batches for x in slices(batch, 2)):
            content, page = _read(*(b.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content.dot(of_content[:-1]) + of_content[-1]), pa.array((page / scale) @ of_page[:-1] + of_page[-1])], names=["doc_id", "key", "content", "page"])

    return run


def surest(odds: DataFrame, view: str, good: float, share: float = SHARE) -> DataFrame:
    """Rows whose odds by ``view`` are among the ``share`` surest of all, as many of either class as ``good`` says,
    with ``label``; odds within one are never sure. Cut at bins of 1/64."""
    bins = {r["bin"]: r["n"] for r in odds.groupBy(F.floor(F.greatest(F.lit(-32.0), F.least(F.lit(32.0), F.col(view))) * 64).alias("bin")).agg(F.count("*").alias("n")).collect()}  # 4,097 at most
    most = share * sum(bins.values())

    def cut(order: list[int], n: float) -> float:
        last = None
        for b in order:
            if n <= 0:
                break
            last, n = b, n - bins[b]
        return last

    low, high = cut(sorted(bins), most * (1 - good)), cut(sorted(bins, reverse=True), most * good)
    z = F.col(view)
    bad = F.lit(False) if low is None else (z < (low + 1) / 64) & (z < -1.0)
    fine = F.lit(False) if high is None else (z >= high / 64) & (z > 1.0)
    return odds.where(bad | fine).withColumn("label", F.when(z > 0, 1).otherwise(0))


def train(features: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_new: int = MOST_NEW, rounds: int = ROUNDS) -> Model:
    """The co-trained model of a staged table of features; what goes to the driver is bounded by ``most_labelled`` and
    ``most_new`` rows for each round and view."""
    sc = features.sparkSession.sparkContext
    known = (
        labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("long").alias("label"))
        .where("of is not null and label in (0, 1)")
        .groupBy("of")
        .agg(F.max("label").alias("label"))
    )
    chosen = bounded_sample(known.where(F.crc32(F.col("of").cast("string").cast("binary")) % 5 != 0), "of", most_labelled)

    def fetch(rows: DataFrame) -> tuple[list, list, list, list]:
        found = rows.select("buckets", "counts", "page", "label").collect()
        found.sort(key=lambda r: (zlib.crc32(bytes(r["page"])), bytes(r["page"]), bytes(r["buckets"])))
        return tuple([r[c] for r in found] for c in ("buckets", "counts", "page", "label"))

    held = fetch(features.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")))
    label = np.array(held[3], float)
    good = float(label.mean()) if len(label) else 0.5
    aside = np.arange(len(label)) % 5 == 0
    if len(label) < 20 or not 0 < good < 1 or not 0 < label[~aside].mean() < 1:
        return Model(prior=good)
    content, page = _read(*held[:3])
    scale = np.maximum(page[~aside].std(0), 1e-3)
    own = np.where(aside, 0.0, 1.0)
    weight = [own, own]
    models = fit_views(content, page, label, weight, scale)
    numbered = features.select("doc_id", F.xxhash64("doc_id", "page", "buckets").alias("key"), "buckets", "counts", "page")
    for k in range(rounds):
        sent = sc.broadcast((models, scale))
        odds = numbered.mapInArrow(_odds(sent), "doc_id long, key long, content double, page double")
        odds = staged(odds.join(known.select("of"), F.col("doc_id") == F.col("of"), "left_anti"), "odds")
        new = []
        for view in ("content", "page"):
            # each round draws from rows of its own, so that none is handed over twice
            drawn = surest(odds, view, good).where(F.pmod(F.xxhash64("key", F.lit(view)), F.lit(rounds)) == k)
            drawn = bounded_sample(drawn.select("key", "label").distinct(), "key", most_new)
            new.append(fetch(numbered.join(F.broadcast(drawn.withColumnRenamed("key", "drawn")), F.col("key") == F.col("drawn")).dropDuplicates(["key"])))
        held = tuple([*old, *a, *b] for old, a, b in zip(held, *new))
        content, page = _read(*held[:3])
        label = np.array(held[3], float)
        # what the content view was sure of is for the page view, and the other way about
        from_content, from_page = (np.full(len(x[0]), 0.5) for x in new)
        none = [np.zeros(len(x[0])) for x in new]
        weight = [np.concatenate([weight[0], none[0], from_page]), np.concatenate([weight[1], from_content, none[1]])]
        models = fit_views(content, page, label, weight, scale, models)
    n = len(aside)
    rows = np.flatnonzero(aside)
    z = [content.pick(np.arange(n)).dot(models[0][:-1]) + models[0][-1], (page[:n] / scale) @ models[1][:-1] + models[1][-1]]
    calibrate = [tuple(fit_logistic(v[rows, None], label[rows], 1e-3)) for v in z]
    both = np.stack([np.clip(a * v + b, -12, 12) for v, (a, b) in zip(z, calibrate)], 1)
    return Model(models[0], models[1], scale, calibrate, fit_logistic(both[rows], label[rows], 1e-1), good)


def features_of(docs: DataFrame) -> DataFrame:
    """Both views of each document as a staged table."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5).alias("held_out"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return staged(chosen.mapInArrow(_vectors, _FEATURES), "features")


def score_quality(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_new: int = MOST_NEW) -> DataFrame:
    """One row for each document: ``doc_id, held_out, content_score, page_score, score, predicted, kept``."""
    features = features_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train(features, labels, most_labelled, most_new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        weights = np.zeros(CONTENT) if m.content is None else m.content[:-1]
        for b in (x for batch in batches for x in slices(batch, 2)):
            content, page = _read(*(b.column(i).to_pylist() for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, m.scores(content.dot(weights), page))], names=["doc_id", "held_out", "content_score", "page_score", "score"])

    scored = features.mapInArrow(run, "doc_id long, held_out boolean, content_score double, page_score double, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).withColumn("kept", F.col("score") >= 0.5)
