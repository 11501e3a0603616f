"""Toxicity by a fuzzy lexicon: Levenshtein automata intersected with a trie, and context windows.

The lexicon is learned from labelled texts: whole words and word beginnings (stems) that toxic texts
hold and others don't. Of a word of a text, each run of letters and the word with the digits and symbols
inside it are matched, and the best match counts. Matching is by walking the trie and the word's Levenshtein
automaton together, so misspelled terms within the term's distance are found; a term of at least
``FUZZY_FROM`` letters allows one edit, of ``SWAP_FROM`` also two neighbours swapped, of ``TWO_FROM`` two
edits; a shorter one and a stem allow none, but the learned words under a stem are matched like terms. Words
whose letters as a set rule out every term are passed over without a walk. Around each hit a window of
words tells quotation from abuse: quotation marks, reporting words, the share of other hits, and
the learned weights of the window's words. Hits and windows are summed to a text's features, and a
logistic model fitted on labelled texts gives the score.

Labels are learned only from training rows (crc32 of the id as text, modulo 5, is not 0), and from at
most ``MOST_LABELLED`` of them, chosen by a hash of their ids; of those, every term that passes the weight
test is in the lexicon. Labels, language, source and id are never inputs of a score.

Defined results: null text is empty; empty texts get the score of a text without hits; a null
doc_id is training text that no label names; rows that repeat are scored each for itself; without any
toxic training row the lexicon is empty and every score is that of the label's share; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import Words, bounded_sample, map_texts, slices, staged, worker_cache

MOST_LABELLED = 20_000
FUZZY_FROM = 4
SWAP_FROM = 5
TWO_FROM = 8
STEM_LETTERS = range(3, 9)
WINDOW = 6
LEAST_TEXTS = 4

#: Words that report speech, and marks of quotation, in the languages of the corpus.
REPORTING = frozenset(
    "said says saying called calls quote quoted quoting wrote writes word term reported dit disait appelle citation mot "
    "sagte sagt nannte zitat wort schrieb dijo dice llama cita palabra".split()
)
QUOTES = "\"'«»„“”‘’`"

_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
_BUCKETS = 4096


def core(word: bytes) -> str:
    """The first run of letters of a word, lower-cased."""
    found = _LETTERS.search(word.decode("utf-8", "replace").lower())
    return found.group() if found else ""


def forms(word: bytes) -> list[str]:
    """What of a word is matched: each run of letters, and the word from its first letter or digit to its
    last with all between, if that is something else. The first run is first."""
    text = word.decode("utf-8", "replace").lower()
    runs = _LETTERS.findall(text)
    inner = _INNER.search(text)
    return [*runs, *([inner.group()] if inner and runs and inner.group() not in runs else [])]


# -- the lexicon --------------------------------------------------------------------------------


class Automaton:
    """The Levenshtein automaton of a word: states are the numbers of its letters that may be used up, as bits,
    for each number of edits. ``swaps`` lets two neighbours change places as one edit."""

    def __init__(self, word: str, edits: int, swaps: bool):
        self.size, self.edits, self.swaps = len(word), edits, swaps
        self.full = (2 << len(word)) - 1
        self.places: dict[str, int] = {}
        for i, letter in enumerate(word):
            self.places[letter] = self.places.get(letter, 0) | 1 << i
        self.start = tuple((2 << e) - 1 & self.full for e in range(edits + 1))

    def step(self, states: tuple, letter: str, older: tuple | None, last: str) -> tuple:
        """The states after ``letter``; ``older`` are those before ``last``, the letter before it."""
        here = self.places.get(letter, 0)
        now = (states[0] & here) << 1
        out = [now]
        swap = here & self.places.get(last, 0) >> 1 if self.swaps and older is not None else 0
        for e in range(1, self.edits + 1):
            one = states[e - 1]
            now = ((states[e] & here) << 1 | one << 1 | one | now << 1 | (((older[e - 1] & swap) << 2) if swap else 0)) & self.full
            out.append(now)
        return tuple(out)

    def accepted(self, states: tuple) -> int | None:
        """The fewest edits that end at the word's end."""
        for e, bits in enumerate(states):
            if bits >> self.size & 1:
                return e
        return None


class Tier:
    """A trie of the terms that allow as many edits; :meth:`find` intersects it with a word's automaton."""

    def __init__(self, terms: list[str], edits: int, swaps: bool):
        self.edits, self.swaps, self.root = edits, swaps, {}
        for term in sorted(terms):
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node["end"] = term
        self.sizes = range(min(map(len, terms), default=1) - edits, max(map(len, terms), default=-9) + edits + 1)

    def find(self, word: str) -> list[tuple[int, str]]:
        """(edits, term) of each term within the distance."""
        if len(word) not in self.sizes:
            return []
        automaton, found = Automaton(word, self.edits, self.swaps), []
        stack = [(self.root, automaton.start, None, "")]
        while stack:
            node, states, older, last = stack.pop()
            for letter, child in node.items():
                if letter == "end":
                    e = automaton.accepted(states)
                    if e is not None:
                        found.append((e, child))
                    continue
                after = automaton.step(states, letter, older, last)
                if after[-1]:
                    stack.append((child, after, states, letter))
        return found


_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def _hashes(rows: np.ndarray, less: int) -> Iterator[np.ndarray]:
    """Polynomial hashes of words of one length (a row of code points each) with up to ``less`` letters left out."""
    n = rows.shape[1]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
    upto = np.zeros((n + 1, len(rows)), np.uint64)
    for i in range(n):
        upto[i + 1] = upto[i] * _BASE + rows[:, i] + np.uint64(1)
    yield upto[n]
    if less < 1:
        return
    rest = [upto[n] - upto[j + 1] * power[n - 1 - j] for j in range(n)]
    for j in range(n):
        yield upto[j] * power[n - 1 - j] + rest[j]
        for i in range(j if less > 1 else 0):
            yield ((upto[i] - upto[i + 1]) * power[j - 1 - i] + upto[j]) * power[n - 1 - j] + rest[j]


def _by_length(points: np.ndarray, start: np.ndarray, size: np.ndarray, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of each length in ``sizes``: their places and a row of code points for each."""
    order = np.argsort(size, kind="stable")
    cut = np.searchsorted(size[order], np.arange(sizes.start, sizes.stop + 1))
    for k, n in enumerate(sizes):
        own = order[cut[k] : cut[k + 1]]
        if len(own):
            yield own, points[start[own][:, None] + np.arange(n)].astype(np.uint64)


class Lexicon:
    """Terms and stems with weights; ``family`` holds words that a stem covers, which only misspellings need."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], family: dict[str, float] | None = None):
        self.terms, self.stems = terms, stems
        self.stem_sizes = sorted({len(s) for s in stems})
        self.fuzzy = {t: w for t, w in {**(family or {}), **terms}.items() if len(t) >= FUZZY_FROM}
        self.tiers = [Tier([t for t in self.fuzzy if self._rule(t) == rule], *rule) for rule in ((1, False), (1, True), (2, True))]
        # what is left of each term when as many letters go as it allows edits, by hash; of stems, all
        self.names = [*self.fuzzy, *(t for t in terms if t not in self.fuzzy), *stems]
        at, left = [], []
        for k, name in enumerate(self.names):
            less = self._rule(name)[0] if k < len(self.fuzzy) else 0
            own = np.unique(np.concatenate(list(_hashes(np.array([list(map(ord, name))], np.uint64), less))))
            left.append(own)
            at.append(np.full(len(own), k))
        left, at = np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(left, kind="stable")
        self.left, self.at = left[order], at[order]
        self.longest = max(map(len, self.names), default=0)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.left >> np.uint64(42)] = True

    @staticmethod
    def _rule(term: str) -> tuple[int, bool]:
        """Edits that a term allows, and whether swapped neighbours are one."""
        return 2 if len(term) >= TWO_FROM else 1, len(term) >= SWAP_FROM

    def find(self, word: str, tiers: list[Tier] | None = None) -> tuple[str, int, float] | None:
        """The best match as (kind, edits, weight): fewest edits, then the heaviest term."""
        exact = [("term", 0, self.terms[word])] if word in self.terms else []
        exact += [("stem", 0, self.stems[word[:n]]) for n in self.stem_sizes if word[:n] in self.stems]
        if exact:
            return max(exact, key=lambda x: x[2])
        found = [x for tier in (self.tiers if tiers is None else tiers) for x in tier.find(word)]
        if not found:
            return None
        edits = min(e for e, _ in found)
        return "term", edits, max(self.fuzzy[t] for e, t in found if e == edits)

    def near(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[int, set[str]]:
        """Words that may match, with the terms and stems they may match: some letters left out, both are the same.
        Words are ranges of code points. Every match is among these, as an edit is no more than a letter
        left out of either side."""
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def look(own: np.ndarray, hashes: np.ndarray) -> None:
            may = np.flatnonzero(self.seen[hashes >> np.uint64(42)])
            lo, hi = (np.searchsorted(self.left, hashes[may], side) for side in ("left", "right"))
            n = hi - lo
            if n.any():
                pairs.append((np.repeat(own[may], n), self.at[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())]))

        for own, rows in _by_length(points, start, size, range(1, self.longest + 3)):
            for hashes in _hashes(rows, 1 if rows.shape[1] < TWO_FROM - 2 else 2):
                look(own, hashes)
        for n in self.stem_sizes:
            long = np.flatnonzero(size > n)
            look(long, next(_hashes(points[start[long][:, None] + np.arange(n)].astype(np.uint64), 0)))
        out: dict[int, set[str]] = {}
        for words, names in pairs:
            for w, k in zip(words.tolist(), names.tolist()):
                out.setdefault(w, set()).add(self.names[k])
        return out

    def find_all(self, words: list[bytes]) -> dict[int, tuple[str, int, float]]:
        """The best match of each word that has one, among its forms: :meth:`find` over the trie of the terms it is near."""
        points = np.frombuffer(b" ".join([*words, b""]).decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        stop = np.flatnonzero(points == 32)
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        letter = _IS_LETTER[np.minimum(points, 0xFFFF)]
        place = np.arange(len(points))
        if not len(stop):
            return {}
        first = np.minimum.reduceat(np.where(letter, place, len(points)), start)
        last = np.maximum.reduceat(np.where(letter, place, -1), start)
        size = last + 1 - first
        letters = np.add.reduceat(letter.astype(np.int64), start)
        digit = (points >= 48) & (points <= 57)
        odd = (letters > 0) & ((letters != size) | np.add.reduceat(digit.astype(np.int64), start).astype(bool))
        plain = np.flatnonzero((letters > 0) & ~odd)
        best: dict[int, tuple[str, int, float]] = {}

        def judge(word: int, form: str, names: set[str]) -> None:
            own = [Tier([t for t in names if t in self.fuzzy and self._rule(t) == rule], *rule) for rule in ((1, False), (1, True), (2, True))]
            got = self.find(form, own)
            if got and (word not in best or (got[1], -got[2]) < (best[word][1], -best[word][2])):
                best[word] = got

        for k, names in self.near(points, first[plain], size[plain]).items():
            i = plain[k]
            judge(int(i), "".join(map(chr, points[first[i] : last[i] + 1])), names)
        # words with digits or symbols inside: each run of letters, and the whole
        of, text = [], []
        for i in np.flatnonzero(odd).tolist():
            for form in forms(words[i]):
                of.append(i)
                text.append(form)
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        joined = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        for k, names in self.near(joined, np.cumsum(sizes) - sizes, sizes).items():
            judge(of[k], text[k], names)
        return best


# -- learning the lexicon -----------------------------------------------------------------------


def _entries(words: Words, lo: int, hi: int, memo: dict[bytes, tuple[str, ...]]) -> set[str]:
    """Terms of one text: its words, and their beginnings marked by a star."""
    out: set[str] = set()
    for i in np.unique(words.codes[lo:hi]):
        word = words.distinct[i]
        got = memo.get(word)
        if got is None:
            own = core(word)
            got = memo[word] = ((own,) if len(own) >= 3 else ()) + tuple(own[:n] + "*" for n in STEM_LETTERS if n < len(own))
        out.update(got)
    return out


def _frequencies(only):
    """Text frequencies of terms, of those in ``only`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if only is None else only.value
        held: dict[str, int] = {}
        for b in (x for batch in batches for x in slices(batch, 0)):
            words, memo = Words(b.column(0)), {}
            for lo, hi in zip(words.starts, words.ends):
                entries = _entries(words, lo, hi, memo)
                for x in entries if chosen is None else entries & chosen:
                    held[x] = held.get(x, 0) + 1
            if len(held) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    return run


def learn_lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, most_sent: int = 300_000) -> Lexicon:
    """Terms whose presence is much likelier in toxic texts; ``toxic`` and ``clean`` have one text column.

    The driver gets the terms that pass the test. Terms of toxic texts are sent to the tasks that count clean
    ones if they are no more than ``most_sent``; else all terms of clean texts are counted and joined.
    """
    if not n_toxic:
        return Lexicon({}, {})

    def counted(texts: DataFrame, only, name: str) -> DataFrame:
        return map_texts(texts, _frequencies(only), "term string, n long").groupBy("term").agg(F.sum("n").alias(name))

    ours = staged(counted(toxic, None, "n").where(F.col("n") >= LEAST_TEXTS), "terms")
    sent = toxic.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in ours.select("term").collect())) if ours.count() <= most_sent else None
    other = F.coalesce(F.col("m"), F.lit(0))
    weight = F.log((F.col("n") + 0.5) / F.lit(n_toxic + 1)) - F.log((other + 0.5) / F.lit(n_clean + 1))
    found = ours.join(counted(clean, sent, "m"), "term", "left").select("term", "n", weight.alias("weight")).where((F.col("weight") >= 2.5) & (F.col("n") >= 6 * other))
    scored = [(r["n"], r["weight"], r["term"]) for r in found.collect()]
    count = {term: n for n, _, term in scored}
    # words first; then the broadest beginnings that are families of words and not one word of them
    scored.sort(key=lambda x: (x[2].endswith("*"), -x[0], -len(x[2]), x[2]))
    terms = {term: weight for _, weight, term in scored if not term.endswith("*")}
    order = sorted(terms)
    stems: dict[str, float] = {}
    family: dict[str, float] = {}
    for n, weight, term in scored:
        name = term[:-1]
        if not term.endswith("*") or any(name[:k] in stems for k in range(1, len(name) + 1)):
            continue
        longer = [x for x in order[bisect_left(order, name) : bisect_left(order, name + chr(0x10FFFF))] if x in terms]
        if any(count[x] >= 0.8 * n for x in longer):
            continue
        stems[name] = weight
        for x in longer:
            family[x] = terms.pop(x)
    return Lexicon(terms, stems, family)


# -- features -----------------------------------------------------------------------------------

FEATURES = ("exact", "fuzzy", "stem", "weight", "top", "density", "quoted", "reported", "crowd", "context", "any")


def _bucket(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) % _BUCKETS


class Matcher:
    """Features of a batch of texts."""

    def __init__(self, lexicon: Lexicon, context: np.ndarray | None = None):
        self.lexicon, self.context = lexicon, context

    def features(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """A row of FEATURES for each text, and (text, buckets of words around its hits) for texts with hits."""
        words = Words(column)
        hits = self.lexicon.find_all(words.distinct)
        out = np.zeros((len(words), len(FEATURES)))
        near: list[tuple[int, np.ndarray]] = []
        if not hits:
            return out, near
        is_hit = np.zeros(len(words.distinct), bool)
        is_hit[list(hits)] = True
        at = np.flatnonzero(is_hit[words.codes])
        text = np.searchsorted(words.ends, at, "right")
        for t in np.unique(text):
            lo, hi = int(words.starts[t]), int(words.ends[t])
            own = at[text == t]
            row = out[t]
            around: list[int] = []
            for p in own.tolist():
                kind, edits, weight = hits[int(words.codes[p])]
                window = range(max(lo, p - WINDOW), min(hi, p + WINDOW + 1))
                codes = [int(words.codes[q]) for q in window if q != p]
                names = [words.distinct[c] for c in codes]
                word = words.distinct[int(words.codes[p])].decode("utf-8", "replace")
                quoted = word[:1] in QUOTES or word[-1:] in QUOTES or (
                    any(x[:1].decode("latin-1") in QUOTES for x in names[:WINDOW]) and any(x[-1:].decode("latin-1") in QUOTES for x in names[-WINDOW:])
                )
                reported = any(core(x) in REPORTING for x in names)
                row[0] += kind == "term" and edits == 0
                row[1] += edits > 0
                row[2] += kind == "stem"
                row[3] += weight * (0.5 if edits else 1.0)
                row[4] = max(row[4], weight * (0.5 if edits else 1.0))
                row[6] += quoted
                row[7] += reported
                row[8] += sum(c in hits for c in codes)
                around += [_bucket(x) for x, c in zip(names, codes) if c not in hits]
            n = len(own)
            row[5] = n / (hi - lo) ** 0.5
            row[6:8] /= n
            row[8] = math.log1p(row[8])
            row[:4] = np.log1p(row[:4])
            row[10] = 1.0
            buckets = np.array(around, np.int64)
            near.append((int(t), buckets))
            if self.context is not None and len(buckets):
                row[9] = float(self.context[buckets].mean())
        return out, near


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model with an intercept last, by Newton's method with a ridge penalty."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, context: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.lexicon, self.context, self.scale, self.weights = lexicon, context, scale, weights
        self.token = uuid.uuid4().hex  # tells models apart in a worker's cache

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _collect_features(sent):
    out = pa.schema([("toxic", pa.int64()), ("features", pa.list_(pa.float64())), ("near", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for b in (x for batch in batches for x in slices(batch, 1)):
            rows, near = matcher.features(b.column(1))
            around: list[list[int]] = [[] for _ in range(len(rows))]
            for t, buckets in near:
                around[t] = buckets.tolist()
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(around, pa.list_(pa.int64()))], schema=out)

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED, parts: int = 5) -> DataFrame:
    """``label, text`` of at most ``most`` labelled training documents.

    Only ids travel to the join: at most ``most`` of them, so the broadcast is bounded and no text
    is shuffled.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("__labelled"), F.col(label).cast("long").alias("__label"))
        .where("__labelled is not null and __label in (0, 1)")
        .where(F.crc32(F.col("__labelled").cast("string").cast("binary")) % parts != 0)
        .groupBy("__labelled")
        .agg(F.max("__label").alias("__label"))
    )
    chosen = bounded_sample(chosen, "__labelled", most)
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__labelled"))
    return joined.select(F.col("__label").alias("label"), F.coalesce("text", F.lit("")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    sc = docs.sparkSession.sparkContext
    rows = staged(training_rows(docs, labels, "toxic", most), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (rows.where(F.col("label") == k).select("text") for k in (1, 0))
    lexicon = learn_lexicon(toxic, clean, sizes.get(1, 0), sizes.get(0, 0))
    sent = sc.broadcast(lexicon)
    found = map_texts(rows, _collect_features(sent), "toxic long, features array<double>, near array<long>").collect()  # at most `most` rows of labelled texts
    y = np.array([r["toxic"] for r in found], float)
    x = np.array([r["features"] for r in found], float).reshape(len(found), len(FEATURES))
    # weights of words around hits in toxic texts against hits in others
    sums = np.full((2, _BUCKETS), 1.0)
    for r in found:
        np.add.at(sums[int(r["toxic"])], r["near"], 1.0)
    context = np.clip(np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum()), -2, 2) if sums[0].sum() > _BUCKETS * 1.2 else np.zeros(_BUCKETS)
    for i, r in enumerate(found):
        if r["near"]:
            x[i, 9] = context[r["near"]].mean()
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(FEATURES))
    weights = fit_logistic(x / scale, y) if 0 < y.sum() < len(y) else np.append(np.zeros(len(FEATURES)), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return Model(lexicon, context, scale, weights)


def with_scores(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: texts pass through, nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        matcher = worker_cache(("matcher", m.token), lambda: Matcher(m.lexicon, m.context))
        for b in (x for batch in batches for x in slices(batch, place, 2 << 20)):
            rows, _ = matcher.features(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(rows))], names=[*b.schema.names, name])

    return map_texts(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``."""
    from siftwell.llm.language_model import held_out

    model = train(docs, labels, most)
    chosen = docs.select(F.col("doc_id").cast("long"), held_out("doc_id", 5).alias("held_out"), "text")
    # scores at the far side of the texts: only ids and numbers come back
    slim = _slim(chosen, model)
    return slim.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _slim(chosen: DataFrame, model: Model) -> DataFrame:
    sent = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        matcher = worker_cache(("matcher", m.token), lambda: Matcher(m.lexicon, m.context))
        for b in (x for batch in batches for x in slices(batch, 2, 2 << 20)):
            rows, _ = matcher.features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.scores(rows))], names=["doc_id", "held_out", "score"])

    return map_texts(chosen, run, "doc_id long, held_out boolean, score double")
