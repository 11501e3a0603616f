"""Pseudonyms: format, validity, linkage and the exact round trip."""

import datetime
import hashlib
import re

import regex

from siftwell.llm import pii as P

SCHEMA = "doc_id long, text string"
TEXTS = [
    "mail und.34@mail7.example.com, call +1 (017) 555-7713 now",
    "card 4539578763621486 and 4539 5787 6362 1486, not 4539578763621487",
    "host 97.51.17.173 but 300.1.1.1 and 1.2.3.4.5",
    "on 2024-02-29 and 2023-02-29, 31/12/1999, 1.2.2003, 31.11.2000",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!',
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE88 3704 0044 0532 0130 00; ssn 123-45-6789",
    "und.34@mail7.example.com again, (415) 555-2671 and 4539578763621486",
    None,
    "",
    "nothing here, version 4.0. and CC 3",
]


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def shape(s):
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r["doc_id"]: r for r in P.pseudonymise(df, **kw).collect()}


def test_pseudonyms(spark):
    got = run(spark, TEXTS, key="k")
    out = {i: r["text"] for i, r in got.items()}
    assert out[7] is None and out[8] == "" and out[9] == TEXTS[9] and got[9]["n_found"] == 0
    for i in (1, 2):
        assert shape(out[i]).replace("9", "") == shape(TEXTS[i]).replace("9", "")
    cards = re.findall(r"\b\d{16}\b|\b\d{4} \d{4} \d{4} \d{4}\b", out[1])
    assert luhn(cards[0]) and cards[0] != "4539578763621486" and cards[1].replace(" ", "") == cards[0]
    assert out[1].endswith("not 4539578763621487")
    assert out[6].endswith(cards[0]) and out[6].split()[0].strip(",") == re.search(r"\S+@\S+?(?=,)", out[0]).group()
    assert out[0].count("@mail7.example.com") == 1 and "und.34" not in out[0] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} now", out[0]) and "017" not in out[0]
    ip = re.search(r"host (\S+) but 300.1.1.1 and 1.2.3.4.5", out[2]).group(1)
    assert ip != "97.51.17.173" and all(int(x) < 256 for x in ip.split("."))
    dates = re.fullmatch(r"on (\d{4}-\d\d-\d\d) and 2023-02-29, (\d\d/\d\d/\d{4}), (\d{1,2}\.\d{1,2}\.\d{4}), 31\.11\.2000", out[3]).groups()
    datetime.date.fromisoformat(dates[0])
    datetime.datetime.strptime(dates[1], "%d/%m/%Y")
    assert dates[0] != "2024-02-29" and re.search(r'token = "[0-9a-f]{40}" TOKEN = "[0-9A-F]{40}"!!', out[4]) and "04dbeb" not in out[4]
    ibans = re.match(r"iban (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\dWEST\d{14}) and DE88 3704 0044 0532 0130 00; ssn (\d{3}-\d\d-\d{4})", out[5]).groups()
    for x in ibans[:2]:
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert "3704 0044" not in ibans[0] and ibans[2] != "123-45-6789"


def test_round_trip_and_permutation(spark):
    numbers = [f"ip 10.0.{i}.{j}" for i in range(12) for j in range(12)]
    out = run(spark, numbers, key="secret")
    assert len({r["text"] for r in out.values()}) == len(numbers)
    back = run(spark, [out[i]["text"] for i in range(len(numbers))], key="secret", inverse=True)
    assert [back[i]["text"] for i in range(len(numbers))] == numbers
    there = run(spark, TEXTS, key="k2")
    again = run(spark, [there[i]["text"] for i in range(len(TEXTS))], key="k2", inverse=True)
    assert [again[i]["text"] for i in range(len(TEXTS))] == TEXTS


# -- a plain rendering of the definition


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def feistel(key, x, kind, alphabet="0123456789", tweak=""):
    l, r = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(P.ROUNDS):
        own, other = (l, r) if i % 2 == 0 else (r, l)
        h = sha("|".join([key, kind, str(len(x)), str(i), tweak, other]))
        stream = "".join(sha(key, h, str(b)) for b in range(len(own) // 32 + 1))
        own = "".join(alphabet[(alphabet.index(c) + int(stream[2 * j : 2 * j + 2], 16)) % len(alphabet)] for j, c in enumerate(own))
        l, r = (own, r) if i % 2 == 0 else (l, own)
    return l + r


def feistel_number(key, x, kind, high, low):
    l, r = divmod(x, low)
    for i in range(P.ROUNDS):
        shift = int(sha("|".join([key, kind, "0", str(i), "", str(r if i % 2 == 0 else l)]))[:12], 16)
        l, r = ((l + shift) % high, r) if i % 2 == 0 else (l, (r + shift) % low)
    return l * low + r


def fill(old, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in old)


def words(key, x, kind, letters):
    p = "".join(c for c in x.lower() if c in letters)
    n = iter(feistel(key, "".join(c for c in x if c.isdigit()), kind + "-digits", tweak=p))
    l = iter(feistel(key, p, kind, letters))
    return "".join(next(n) if c.isdigit() else (next(l) if c == c.lower() else next(l).upper()) if c.lower() in letters else c for c in x)


def new_card(key, u):
    w = feistel(key, u[:-1], "card")
    return next(w + c for c in "0123456789" if luhn(w + c))


def row_of(m):
    g, found = re.split("[ -]", m), []
    if luhn("".join(g)) or len(g) == 1:
        return None
    for o in range(len(g)):
        for e in range(o, len(g)):
            own = "".join(g[o : e + 1])
            if re.fullmatch(P.LAYOUT, " ".join(g[o : e + 1])) and luhn(own):
                found.append((len(own), -len("".join(g[:o]))))
    return max(found, default=None)


def expected(key, m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        local, domain = m.split("@")
        return words(key, local, "email", P.LETTERS) + "@" + domain
    if re.match("(?i)token|secret|pass|api", m):
        u = re.search("[0-9A-Fa-f]{16,}$", m).group()
        return m[: -len(u)] + words(key, u, "secret", P.HEX_LETTERS)
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = m.split(".")
        if not all(int(x) < 256 and x == str(int(x)) for x in o):
            return m
        v = feistel(key, "".join(f"{int(x):02x}" for x in o), "ip", P.HEX)
        return ".".join(str(int(v[i : i + 2], 16)) for i in range(0, 8, 2))
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}", m):
        start = datetime.date(1800, 1, 1)
        t = re.split("[./-]", m)
        y, mo, d = t if "-" in m else t[::-1]
        try:
            v = (datetime.date(int(y), int(mo), int(d)) - start).days
        except ValueError:
            return m
        if not 0 <= v < 189 * 773:
            return m
        while True:
            v = feistel_number(key, v, "date", 189, 773)
            new = start + datetime.timedelta(v)
            if "-" in m:
                return new.isoformat()
            if (len(d) == 2 or new.day < 10) and (len(mo) == 2 or new.month < 10):
                sep = "/" if "/" in m else "."
                return sep.join([str(new.day).zfill(len(d)), str(new.month).zfill(len(mo)), str(new.year)])
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = (int(x) for x in m.split("-"))
        if not (1 <= a < 900 and a != 666 and g and s):
            return m
        v = feistel_number(key, ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, "ssn", 898 * 99, 9999)
        a = v // 989901 + 1
        return f"{a + (a > 665):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"
    if m[0] in "+(":
        c = "1" if m[0] == "(" else re.match(P.COUNTRY, digits).group()
        ahead = "" if m[0] == "(" else c
        return fill(m, ahead + feistel(key, digits[len(ahead) :], "phone", tweak=c))
    if m[0].isalpha():
        u = m.replace(" ", "")
        mod = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
        if not ("02" <= u[2:4] <= "98" and mod(u[4:] + u[:4]) == 1):
            return m
        b = fill(u[4:], feistel(key, re.sub("[^0-9]", "", u[4:]), "iban"))
        it = iter(u[:2] + f"{98 - mod(b + u[:2] + '00'):02d}" + b)
        return "".join(next(it) if c != " " else c for c in m)
    if luhn(digits):
        return fill(m, new_card(key, digits))
    r = row_of(m)
    if r is None:
        return m
    size, ahead = r[0], -r[1]
    out = m
    while True:
        u = re.sub("[^0-9]", "", out)
        out = fill(out, u[:ahead] + new_card(key, u[ahead : ahead + size]) + u[ahead + size :])
        if row_of(out) == r:
            return out


PATTERN = regex.compile("|".join(f"(?:{p})" for p in P.PATTERNS.values()).replace(r"\x22", '"'))
HARD = [
    f"mail {'Long.Name1' * 9}@example.org and John.Doe@x.org, john.doe@x.org, 7@x.org",
    "4111 1111 1111 1111 123 and 123 4111 1111 1111 1111, 4111-1111-1111-1111 9999 8 and 3782 822463 10005 77",
    "+49 30 1234567, +49301234567, +1 (415) 555-2671, (415) 555-2671, +352 27 12 34",
    "000-00-0000 666-12-1234 900-12-1234 123-00-1234 001-01-0001 899-99-9999 667-01-0001 665-01-0001",
    "1.2.2020 01.02.2020 12.11.2020 9/9/1999 31/1/1850 1/12/2199 10.010.1.1 1.01.1.1",
    'secret: aBcDeF0123456789aBcDeF api_key=' + "0f" * 50 + ' password = "ABCDEF0123456789"',
]


def test_every_pseudonym_is_what_the_definition_says(spark):
    table = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    texts = [*HARD, *TEXTS, *table.values()]
    got = run(spark, texts, key="some key")
    changed = 0
    for i, text in enumerate(texts):
        assert got[i]["text"] == (None if text is None else PATTERN.sub(lambda m: expected("some key", m.group()), text)), text
        changed += got[i]["n_replaced"]
    assert changed > 100
    back = run(spark, [got[i]["text"] for i in range(len(texts))], key="some key", inverse=True)
    assert [back[i]["text"] for i in range(len(texts))] == texts


def test_linked_whatever_the_spacing_and_case(spark):
    out = run(spark, HARD, key="k")
    a, b = re.findall(r"([A-Za-z.]+)@x\.org", out[0]["text"])[:2]
    assert a.lower() == b and a != b and "Long.Name1" not in out[0]["text"]
    assert "4111 1111 1111 1111" not in out[1]["text"] and "822463 10005" not in out[1]["text"] and " 123 and 123 " in out[1]["text"]
    p = [re.sub("[^0-9]", "", x) for x in out[2]["text"].split(", ")]
    assert p[0] == p[1] and p[2] == "1" + p[3] and p[4].startswith("352")
    assert out[3]["text"].startswith("000-00-0000 666-12-1234 900-12-1234 123-00-1234 ") and out[3]["n_replaced"] == 4
    assert re.match(r"\d\.\d\.\d{4} \d\d\.\d\d\.\d{4} \d\d\.\d\d\.\d{4} \d/\d/\d{4} \d\d/\d/\d{4} \d/\d\d/\d{4} 10.010.1.1 1.01.1.1", out[4]["text"])


def test_clashing_columns_and_long_text(spark):
    long = "word 97.51.17.173 " * 20_000
    df = spark.createDataFrame([(1, long, "a", 2, 3), (1, long, "b", 2, 3)], "doc_id long, text string, hits string, new int, u int")
    got = P.pseudonymise(df).collect()
    assert len(got) == 2 and all(r["n_replaced"] == 20_000 and len(r["text"].split()) == 40_000 for r in got)


def test_empty_table(spark):
    assert P.pseudonymise(spark.createDataFrame([], SCHEMA)).collect() == []
