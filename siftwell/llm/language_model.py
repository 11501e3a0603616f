"""A hidden Markov language model, trained by Baum-Welch over partitions and scored exactly.

Tokens are words between ASCII white space, A-Z lower-cased, and one end for each text. The states
emit classes: each of the ``HEAD`` most frequent words is a class, every other word belongs to the
class of its last three bytes, and within that class it has its share of smoothed counts:

    P(w | state) = P(class(w) | state) * (c(w) + 0.1) / sum over the class of (c + 0.1)

where unseen words are one more member of each class. The second factor doesn't depend on the state,
so a text's probability is the exact forward probability of its classes times those shares.
Each round of Baum-Welch runs over all training texts; expected counts are summed in every task,
then across tasks, and the driver gets one row for each class.

Counts of frequent words travel as a bounded broadcast (``KNOWN`` words of at most 64 bytes); those
of the long tail are joined, so no task holds the vocabulary.

Defined results: null text is empty, and an empty text is its end alone; a null doc_id counts as
training text; rows that repeat are scored each for itself; without any training text every
probability is that of the smoothed empty counts; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Words, slices, staged

HEAD = 1 << 14
TAILS = 1 << 12
KNOWN = 1 << 17
MOST_BYTES = 64
STATES = 8
ROUNDS = 4
SMOOTH = 0.1
_BLOCK = 1 << 18  # tokens in a block of texts that run in step


def held_out(doc_id, parts: int = 10):
    """Whether crc32 of the id as text is a multiple of ``parts``; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(False))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


# -- counts -------------------------------------------------------------------------------------


def _count(most_words: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in (x for batch in batches for x in slices(batch, 0)):
            words = Words(b.column(0))
            for word, n in zip(words.distinct, np.bincount(words.codes, minlength=len(words.distinct)).tolist()):
                held[word] = held.get(word, 0) + n
            if len(held) > most_words:
                yield out()
                held.clear()
        yield out()

    return run


def word_counts(training: DataFrame) -> DataFrame:
    """``word`` (bytes) and ``c`` over all texts of ``training`` (one text column), staged."""
    partial = training.mapInArrow(_count(), "word binary, n long")
    return staged(partial.groupBy("word").agg(F.sum("n").alias("c")), "counts")


class Vocabulary:
    """What every task needs of the counts: frequent words, and sums of the tail's classes."""

    def __init__(self, counts: DataFrame, texts: int):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens = total["n"] + texts
        self.types = total["v"] + (1 if texts else 0)
        self.texts = texts
        self.base = float(np.log10(self.tokens + SMOOTH * (self.types + 1)))
        # bins of counts, a few thousand rows, tell from which bin on at most KNOWN words are as frequent
        short = counts.where(F.octet_length("word") <= MOST_BYTES).withColumn("bin", F.floor(F.log2("c") * 64).cast("long"))
        lowest, words = None, 0
        for r in sorted(short.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):
            words += r["n"]
            if words > KNOWN:
                break
            lowest = r["bin"]
        known = [] if lowest is None else short.where(F.col("bin") >= lowest).select("word", "c").collect()
        known.sort(key=lambda r: (-r["c"], bytes(r["word"])))
        self.known = {bytes(r["word"]): (i, r["c"]) for i, r in enumerate(known)}
        self.head = min(HEAD, len(known))
        self.classes = self.head + TAILS + 1
        head_words = [bytes(r["word"]) for r in known[: self.head]]
        # sums of all words by class, less those that are classes of their own
        of = (F.crc32(F.expr("substring(word, -3, 3)")) % TAILS).cast("int").alias("k")
        sums, members = np.zeros(TAILS), np.zeros(TAILS)
        for r in counts.groupBy(of).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # at most TAILS rows
            sums[r["k"]], members[r["k"]] = r["c"], r["v"]
        for word in head_words:
            sums[tail_class(word)] -= self.known[word][1]
            members[tail_class(word)] -= 1
        self.tail_sums = sums + SMOOTH * (members + 1)
        weights = np.concatenate([[self.known[w][1] + SMOOTH for w in head_words], self.tail_sums, [texts + SMOOTH]])
        self.prior = weights / weights.sum()


# -- encoding -----------------------------------------------------------------------------------

_ENCODED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, shares double, codes binary, tail array<struct<word:binary,n:long>>"


def _encode(sent):
    out = pa.schema(
        [("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("shares", pa.float64()), ("codes", pa.binary()),
         ("tail", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = sent.value
        share = np.log10(v.tail_sums)
        end_code, end_log = v.classes - 1, float(np.log10(v.texts + SMOOTH))
        row = TaskContext.get().partitionId() << 33
        for b in (x for batch in batches for x in slices(batch, 2)):
            words = Words(b.column(2))
            code = np.zeros(len(words.distinct), np.uint16)
            log, minus = np.zeros(len(code)), np.zeros(len(code))
            known = np.zeros(len(code), bool)
            for i, word in enumerate(words.distinct):
                found = v.known.get(word)
                if found is not None and found[0] < v.head:
                    code[i] = found[0]
                else:
                    k = tail_class(word)
                    code[i] = v.head + k
                    minus[i] = share[k]
                if found is not None:
                    known[i] = True
                    log[i] = found[1]
            log[known] = np.log10(log[known] + SMOOTH)
            in_tail = code >= v.head
            codes = words.codes
            sums = [np.concatenate([[0.0], np.cumsum(x[codes])]) for x in (known, log, np.where(in_tail, log - minus, 0.0))]
            n_known, base, shares = (x[words.ends] - x[words.starts] for x in sums)
            coded = code[codes]
            tails = np.flatnonzero(~known[codes])
            cut = np.searchsorted(tails, np.concatenate([[0], words.ends]))
            names, numbers, ends = [], [], [0]
            for i in range(len(words)):
                own = codes[tails[cut[i] : cut[i + 1]]]
                if len(own):
                    d, n = np.unique(own, return_counts=True)
                    names += [words.distinct[j] for j in d]
                    numbers += n.tolist()
                ends.append(len(names))
            tail = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(numbers, pa.int64())], names=["word", "n"]))
            last = np.array([end_code], np.uint16).tobytes()
            data = [coded[s:e].tobytes() + last for s, e in zip(words.starts, words.ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(words))), b.column(0), b.column(1), pa.array(words.counts + 1), pa.array(n_known.astype(np.int64) + (1 if v.texts else 0)),
                 pa.array(base + end_log), pa.array(shares), pa.array(data, pa.binary()), tail],
                schema=out,
            )
            row += len(words)

    return run


# -- the model ----------------------------------------------------------------------------------


class Model:
    """Start, transition and class emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: a row for each class

    @classmethod
    def first(cls, prior: np.ndarray, states: int = STATES, seed: int = 11) -> "Model":
        """Sticky states whose emissions stray from the overall frequencies at random."""
        rng = np.random.default_rng(seed)
        emit = prior[:, None] * np.exp(rng.standard_normal((len(prior), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def from_counts(cls, counts: np.ndarray, prior: np.ndarray, strength: float = 20.0) -> "Model":
        """counts: rows of classes, then of states moved from, then of the start."""
        classes, states = len(prior), counts.shape[1]
        emit = counts[:classes] + strength * prior[:, None]
        move = counts[classes : classes + states] + 1.0
        start = counts[classes + states] + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Block:
    """Texts that run in step, longest first: at step t the first ``active[t]`` of them go on."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(x) for x in texts])
        steps = sizes[0]
        grid = np.zeros((steps, len(texts)), np.uint16)
        for i, x in enumerate(texts):
            grid[: len(x), i] = x
        there = np.arange(steps)[:, None] < sizes[None, :]
        self.codes = grid[there]
        self.active = there.sum(1)
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.texts = len(texts)


def blocks(texts: list[np.ndarray], most: int = _BLOCK) -> Iterator[tuple[np.ndarray, Block]]:
    """Blocks of texts of like length, with the texts' places."""
    order = np.argsort([-len(x) for x in texts], kind="stable")
    at = 0
    while at < len(order):
        width = max(1, most // max(1, len(texts[order[at]])))
        own = order[at : at + width]
        yield own, Block([texts[i] for i in own])
        at += width


def forward(m: Model, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each text, and for Baum-Welch the scaled forward rows, scales and emissions."""
    seen = m.emit.astype(np.float64)[block.codes]
    alpha = np.empty_like(seen)
    scale = np.empty(len(seen))
    at, active = block.at, block.active
    now = m.start * seen[: active[0]]
    for t in range(len(active)):
        lo, hi = at[t], at[t + 1]
        if t:
            now = (now[: hi - lo] @ m.move) * seen[lo:hi]
        total = now.sum(1)
        now = now / total[:, None]
        alpha[lo:hi], scale[lo:hi] = now, total
    logs = np.log10(scale)
    score = np.zeros(block.texts)
    for t in range(len(active)):
        score[: active[t]] += logs[at[t] : at[t + 1]]
    return score, alpha, scale, seen


def expected_counts(m: Model, block: Block, counts: np.ndarray) -> float:
    """Add a block's expected counts to ``counts`` (laid out as in :meth:`Model.from_counts`); its log10 probability."""
    score, alpha, scale, seen = forward(m, block)
    states, classes = m.emit.shape[1], len(m.emit)
    at, active = block.at, block.active
    moves = np.zeros((states, states))
    beta = np.ones((active[-1], states))
    for t in range(len(active) - 1, -1, -1):
        lo, hi = at[t], at[t + 1]
        if t + 1 < len(active):
            on = seen[hi : at[t + 2]] * beta / scale[hi : at[t + 2], None]
            moves += alpha[lo : lo + active[t + 1]].T @ on
            beta = np.ones((hi - lo, states))
            beta[: active[t + 1]] = on @ m.move.T
        alpha_t = alpha[lo:hi]
        if t:
            before = alpha_t * beta
            alpha[lo:hi] = before / before.sum(1, keepdims=True)
        else:
            first = alpha_t * beta
            alpha[lo:hi] = first / first.sum(1, keepdims=True)
    counts[classes : classes + states] += moves * m.move
    counts[classes + states] += alpha[: active[0]].sum(0)
    order = np.argsort(block.codes, kind="stable")
    sorted_codes = block.codes[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
    counts[sorted_codes[start]] += np.add.reduceat(alpha[order], start, axis=0)
    return float(score.sum())


def _texts(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def _expect(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        states = m.emit.shape[1]
        counts = np.zeros((len(m.emit) + states + 2, states))
        for b in (x for batch in batches for x in slices(batch, 0)):
            for _, block in blocks(_texts(b, "codes")):
                counts[-1, 0] += expected_counts(m, block, counts)
        rows = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(counts[rows, k]) for k in range(states))], names=["row", *(f"s{k}" for k in range(states))])

    return run


def baum_welch(encoded: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after ``rounds`` over all texts that are not held out, and their log10 probability before each round."""
    sc = encoded.sparkSession.sparkContext
    training = encoded.where("not held_out").select("codes")
    m, history = Model.first(vocabulary.prior, states), []
    names = [f"s{k}" for k in range(states)]
    for _ in range(rounds):
        sent = sc.broadcast(m)
        sums = training.mapInArrow(_expect(sent), "row long, " + ", ".join(f"{x} double" for x in names)).groupBy("row").agg(*[F.sum(x).alias(x) for x in names])
        counts = np.zeros((len(vocabulary.prior) + states + 2, states))
        for r in sums.collect():  # a row for each class, state and the start
            counts[r["row"]] = r[1:]
        history.append(float(counts[-1, 0]))
        m = Model.from_counts(counts, vocabulary.prior)
        sent.unpersist()
    return m, history


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for b in (x for batch in batches for x in slices(batch, 1)):
            found = np.zeros(b.num_rows)
            for own, block in blocks(_texts(b, "codes")):
                found[own] = forward(m, block)[0]
            keep = [i for i, x in enumerate(b.schema.names) if x != "codes"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(found)], names=[*(b.schema.names[i] for i in keep), "hmm"])

    return run


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    sc = docs.sparkSession.sparkContext
    chosen = docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    training = chosen.where("not held_out")
    counts = word_counts(training.select("text"))
    vocabulary = Vocabulary(counts, training.count())
    sent = sc.broadcast(vocabulary)
    encoded = staged(chosen.mapInArrow(_encode(sent), _ENCODED), "encoded")
    model, _ = baum_welch(encoded, vocabulary, states, rounds)
    of_model = sc.broadcast(model)
    kept = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "shares"]
    types = "row_id long, codes binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, shares double".replace("codes binary, ", "")
    scored = encoded.select("row_id", "codes", *kept[1:]).mapInArrow(_score(of_model), types + ", hmm double")
    tail = encoded.select("row_id", F.explode("tail").alias("t")).select("row_id", "t.word", "t.n")
    c = F.coalesce(F.col("c"), F.lit(0))
    looked_up = tail.join(counts, "word", "left").groupBy("row_id").agg(
        F.sum(F.col("n") * F.log10(c + F.lit(SMOOTH))).alias("tail_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known")
    )
    joined = scored.join(looked_up, "row_id", "left")
    more = F.coalesce("tail_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(vocabulary.base)).alias("base_score"),
        (F.col("hmm") + F.col("shares") + more).alias("score"),
    )
