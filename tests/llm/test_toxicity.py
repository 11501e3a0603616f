"""The fuzzy lexicon against edit distances, and held-out accuracy of the score."""

import random

from siftwell.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def distance(a, b, swaps=True):
    """Edits with swapped neighbours, none of which is edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def edits(term, word):
    """Edits from a term to a word if they are allowed for it."""
    if len(term) < X.FUZZY_FROM:
        return None
    n = distance(term, word, len(term) >= X.SWAP_FROM)
    return n if n <= (2 if len(term) >= X.TWO_FROM else 1) else None


def test_lexicon_finds_what_edit_distance_finds():
    rng = random.Random(3)
    for letters in ("abc", "abcdefgé"):
        terms = {"".join(rng.choice(letters) for _ in range(rng.randint(3, 11))): rng.random() for _ in range(60)}
        stems = {"ccca": 1.0, "bab": 2.0}
        lexicon, counted = X.Lexicon(terms, stems), [0, 0, 0, 0]
        words = ["".join(rng.choice(letters + "d1") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
        for term in terms:
            for _ in range(20):
                word = list(term)
                for _ in range(rng.randint(0, 3)):
                    at = rng.randrange(len(word) + 1)
                    word[at : at + rng.randint(0, 2)] = reversed(word[at : at + 2]) if rng.random() < 0.3 else [rng.choice(letters)] * rng.randint(0, 1)
                words.append("".join(word))
        quick = lexicon.find_all([w.encode() for w in words])
        for i, word in enumerate(words):
            exact = [w for t, w in terms.items() if t == word] + [w for s, w in stems.items() if word.startswith(s)]
            near = [(edits(t, word), -w) for t, w in terms.items() if edits(t, word) is not None]
            got = lexicon.find(word)
            if exact:
                assert got[1:] == (0, max(exact))
                counted[0] += 1
            elif near:
                e, w = min(near)
                assert got == ("term", e, -w), word
                counted[e] += 1
            else:
                assert got is None
            runs = [x for x in map(lexicon.find, X.forms(word.encode())) if x]
            assert quick.get(i) == (min(runs, key=lambda x: (x[1], -x[2])) if runs else None), word
        assert min(counted[:3]) > 50


def test_models_in_one_worker_are_told_apart():
    a, b = (X.Model(X.Lexicon({}, {}), None, None, None) for _ in range(2))
    assert a.token != b.token


def test_a_lexicon_has_no_most_terms(spark):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string")
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(1500)]
    toxic = [" ".join(names) for _ in range(6)]
    for most_sent in (300_000, 10):
        lexicon = X.learn_lexicon(frame(toxic), frame(["some other words"] * 40), 6, 40, most_sent)
        assert sum(lexicon.find(n) is not None for n in names) == len(names) > 512


def test_quotation_differs_from_abuse():
    import pyarrow as pa

    m = X.Matcher(X.Lexicon({"idiot": 5.0}, {}))
    rows, near = m.features(pa.array(["you idiot leave now", 'he said "idiot" in the report', "id1ot idiott", None, ""]))
    names = dict(zip(X.FEATURES, range(len(X.FEATURES))))
    assert rows[0][names["quoted"]] == 0 and rows[1][names["quoted"]] == 1 and rows[1][names["reported"]] == 1
    assert rows[2][names["fuzzy"]] > 0 and not rows[3].any() and not rows[4].any() and len(near) == 3


def test_held_out_accuracy(spark):
    from siftwell.llm.queries import op3_toxicity

    got = {r["doc_id"]: r for r in op3_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i, r in got.items() if r["held_out"] and i in labels]
    right = sum(got[i]["predicted"] == labels[i] for i in held) / len(held)
    found = sum(got[i]["predicted"] for i in held if labels[i]) / sum(labels[i] for i in held)
    assert right > 0.97 and found > 0.85


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (None, None), (1, "you idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in X.score_toxicity(docs, labels).collect()] == [0.5] * 3
    assert X.score_toxicity(docs.limit(0), labels).collect() == []


def test_digits_symbols_and_later_runs_of_letters():
    import pyarrow as pa

    m = X.Matcher(X.Lexicon({"idiot": 5.0, "stupid": 4.0, "moron": 3.0}, {}))
    at = dict(zip(X.FEATURES, range(len(X.FEATURES))))
    for text, kind in (("id1ot", "fuzzy"), ("st*pid", "fuzzy"), ("(m0ron!)", "fuzzy"), ("well,idiot", "exact"), ("you-idiot", "exact"), ("a/idiot.", "exact")):
        assert m.features(pa.array([text]))[0][0][at[kind]] > 0, text
    assert not m.features(pa.array(["12 -- a-b well,then 1st p.2/x"]))[0].any()


def test_misspelled_families_short_terms_swaps_and_two_edits(spark):
    frame = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string")
    toxic = ["idiot you", "idiots you", "idiotic you", "scum you", "worthless you"] * 6
    clean = ["the tools you have", "a sum you lent", "the others you know"] * 10
    lexicon = X.learn_lexicon(frame(toxic), frame(clean), len(toxic), len(clean))
    assert not lexicon.terms.keys() & {"idiot", "idiots", "idiotic"} and lexicon.stems
    for word, edits in (("idoit", 1), ("idoits", 1), ("ldiot", 1), ("ediotic", 1), ("scun", 1), ("wortless", 1), ("wrothless", 1), ("warthles", 2), ("vorthles", 2)):
        assert (lexicon.find(word) or (None, None))[:2] == ("term", edits), word
    assert not any(lexicon.find(w) for text in clean for w in text.split() if w != "sum")
