"""Line deduplication against a plain rendering of its definition."""

import random
import re

import regex

from siftwell.llm import line_dedup as L

SCHEMA = "doc_id long, text string"


def cut(text):
    """The lines by the docstring's words, a piece at a time."""
    out = re.split(f"(?<=\\n)|(?<=[{L.PICKED}] )", text or "")
    for least, after in L.FURTHER:
        out = [p for u in out for p in (regex.split(after, u) if len(u.encode()) >= least else [u])]
    return [u for u in out if u]


def weight(unit):
    return len(unit.encode())


def rng_texts():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]

    def sentence():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 9))).capitalize() + "."

    passages = [[sentence() for _ in range(rng.randint(4, 12))] for _ in range(6)]
    out = []
    for _ in range(60):
        body = [sentence() for _ in range(rng.randint(2, 20))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        out.append("".join(s + rng.choice([" ", "\n"]) for s in body).rstrip())
    return out


def brute(docs, least=L.LEAST_BYTES):
    """Every gram of lines that has an earlier equal covers its lines; long runs of covered lines go."""
    seen, result = {}, {}
    for doc, text in sorted(docs):
        units = cut(text)
        keys = [u.strip(" \t\r\n") for u in units]
        covered = set()
        for i in range(len(keys) - 1):
            gram = (keys[i], keys[i + 1])
            if gram in seen:
                covered |= {i, i + 1}
            seen.setdefault(gram, (doc, i))
        for i, key in enumerate(keys):
            if weight(units[i]) >= least:
                if key in seen:
                    covered.add(i)
                seen.setdefault(key, (doc, i))
        kept, i = [], 0
        while i < len(units):
            j = i
            while j in covered:
                j += 1
            if j > i and sum(map(weight, units[i:j])) >= least:
                i = j
            elif j > i:
                kept += units[i:j]
                i = j
            else:
                kept.append(units[i])
                i += 1
        result[doc] = "".join(kept)
    return result


def test_against_brute_force(spark):
    docs = list(enumerate(rng_texts()))
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    want = brute(docs)
    texts, fewer = dict(docs), 0
    for d, text in want.items():
        # at most one line at either end of a run may be missed, and nothing else be deleted
        at, left = 0, cut(got[d])
        for line in cut(text):
            while left[at] != line:
                at, fewer = at + 1, fewer + 1
            at += 1
        fewer += len(left) - at
    runs = sum(want[d] != t for d, t in texts.items())
    assert runs > 20 and fewer <= runs and sum(got[d] != t for d, t in texts.items()) > 0.9 * runs


def test_every_long_shared_passage_goes(spark):
    rng = random.Random(4)
    passage = " ".join(" ".join(f"p{rng.randrange(999)}" for _ in range(8)) + "." for _ in range(8))
    docs = [(i, f"Own start {i} and more. " + " ".join(f"x{i}y{k}" for k in range(20)) + " " + passage + f" tail {i}.\nEnd {i} here.") for i in range(30)]
    got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got[0]["text"] == docs[0][1] and got[0]["n_lines_deleted"] == 0
    inner = ". ".join(passage.split(". ")[1:-1])
    assert all(inner not in got[i]["text"] and f"x{i}y3" in got[i]["text"] and f"End {i} here." in got[i]["text"] for i in range(1, 30))


def test_odd_rows(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, long_line), (4, long_line), (4, long_line), (5, "short. line.")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] != 1)
    assert got == [(0, long_line), (2, ""), (3, "\n\n"), (4, ""), (4, ""), (5, "short. line.")]
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wide_ids_control_characters_and_other_texts_of_one_id(spark):
    a = "First sentence of some length here. Second sentence that is longer than the first. Third sentence closes the passage with many more words in it, so that it is long enough. "
    rows = [(-5, a + "a one."), (1 << 60, "Lead in. " + a + "the two."), (7, "\x01" + a + "our three."), (7, "other text")]
    got = sorted((r["doc_id"], r["text"]) for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[0] == (-5, rows[0][1]) and (1 << 60, "Lead in. the two.") in got and (7, "other text") in got


def test_passages_that_begin_and_end_mid_sentence(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    for ends in ("", ".", "\u0964"):  # no full stop inside, one now and then, another alphabet's
        rows, passages = [], []
        for k in range(20):
            words = [word() + (ends if ends and i % 17 == 9 else "") for i in range(rng.randint(51, 90))]
            passages.append(" ".join(words))
            own = lambda: " ".join(word() for _ in range(rng.randint(5, 30)))
            rows += [(2 * k, f"{own()} {passages[-1]} {own()}."), (2 * k + 1, f"{own()} {passages[-1]} {own()}.")]
        got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
        texts = dict(rows)
        for k, passage in enumerate(passages):
            first, later = got[2 * k], got[2 * k + 1]
            assert first["text"] == texts[2 * k]
            before, after = texts[2 * k + 1].split(passage + " ")
            assert later["text"].startswith(before) and later["text"].endswith(after)
            left = len(later["text"]) - len(before) - len(after)
            assert left < 2 * 96 and later["bytes_deleted"] == len(texts[2 * k + 1].encode()) - len(later["text"].encode())


def test_lines_concatenate_to_the_text(spark):
    texts = ["", " ", "a  b " * 30, "x" * 90 + " y", "\x01" + "one two, three four five. " * 9, "Tab\tand\nline " * 12 + "\n\n", "end of a line that is long enough to be cut. \n"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert {r["doc_id"]: "".join(r["u"]) for r in df.selectExpr("doc_id", f"{L._units()} as u").collect()} == dict(enumerate(texts))


def test_fingerprints_are_the_minima_and_long_lines_and_compiled(spark):
    texts = rng_texts() + ["", "One line", "a one. b two.", "a one. b two. c three.", "again. " * 9 + "x. y. " + "again. " * 3, "x" * 130, "y" * 150 + "\nz z.\n" + "y" * 150]
    cut, base = L.numbered_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    want = set()
    for r in cut.selectExpr("doc", "hashes", "longs", "transform(sequence(0, size(hashes)), i -> xxhash64(get(hashes, i), get(hashes, i + 1))) as g").collect():
        g = r["g"][: max(len(r["hashes"]) - 1, 0)]
        least = {0} if len(g) == 1 else {i + (g[i + 1] <= g[i]) for i in range(len(g) - 1)}
        # of equals in a row, the last
        want |= {r["doc"] * base + i * 2 for i in least if i + 1 >= len(g) or g[i] != g[i + 1]} | {r["doc"] * base + x["i"] * 2 + 1 for x in r["longs"]}
    for slim in (True, False):
        prints = L.fingerprints(cut, base, slim)
        assert sorted(r["spot"] for r in prints.collect()) == sorted(want)
        # array functions with lambdas are interpreted, which took a third of the query's time
        assert "lambda" not in prints._jdf.queryExecution().executedPlan().toString()


def test_prints_joined_in_memory_and_sorted_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(rng_texts())), SCHEMA)
    mapped = sorted(map(tuple, L.line_dedup(docs).collect()))
    monkeypatch.setattr(L, "MAPPED", 0)
    assert sorted(map(tuple, L.line_dedup(docs).collect())) == mapped and any(n for *_, n, _ in mapped)
