"""Repeated runs of lines, found by winnowing over line hashes; DataFrame and SQL functions only.

A text is cut after every newline, and where a space follows after full stops and after words that end in a
letter of ``PICKED``. A line of at least 96 bytes is cut further by the rules of ``FURTHER``, the last of which
is every space. So two texts that share a passage cut it alike but for one line at either end, wherever
their sentences begin and end; lines have about four words. Every two lines in a row are hashed, and the
smaller hash of every two neighbouring pairs (the later of equals) is a fingerprint: two texts that share
three lines in a row share a fingerprint of them. A line of at least ``least_bytes`` is a fingerprint by itself.

Each fingerprint is joined to its first occurrence, by document and position. Fingerprints within a shared
run leave no gap, and at most one line at either end is missing; the hashes of those neighbours travel with
the fingerprint, so matches are extended both ways. A fingerprint is 64 bits and is verified by 32 others
that are computed from the same lines in another way, a neighbour is compared by 48. Runs of covered lines with at
least ``least_bytes`` are deleted, each from every text but the first that holds it. Lines are compared
with letter case, without the spaces (before a newline, white space) at their ends.

A fingerprint that very many texts hold is summed map-side to its first occurrence, and the join
back can be split at it; what follows is by document.

Defined results: null text stays null; a null doc_id sorts first; rows that repeat doc_id and text are
one document, cleaned alike; rows with one doc_id and several texts are documents of their own, in the
order of their texts' hashes; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import row_numbers, staged

LEAST_BYTES = 120
#: What ends a line where a space follows, and the rules for lines of so many bytes.
PICKED = ".n"
FURTHER = (
    (96, "(?<= )(?<=[sStTrR] |[nNsStTrR][!?,;:.] |[nNsStTrR]!! )"),
    (128, "(?<= )(?<=[a-mA-M] |[a-mA-M][!?,;:.] |[a-mA-M]!! )"),
    (384, "(?<= )"),
)
#: Prints of a partition that are joined by a table in memory, of a few dozen bytes each; more are sorted.
MAPPED = 200_000


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _units(text: str = "text") -> str:
    """The lines of a text, which concatenate to it. First cuts are marked by a control character and split there;
    a text that has that character itself is split by pattern."""
    marked = f"coalesce({text}, '')"
    for end in (*(f"'{c} '" for c in PICKED), r"'\n'"):
        marked = f"replace({marked}, {end}, concat({end}, char(1)))"
    by_pattern = f"split(coalesce({text}, ''), '(?<=\\\\n)|(?<=[{PICKED}] )')"
    whole = f"if(contains({text}, char(1)), {by_pattern}, split({marked}, char(1)))"
    cut = "u"
    for least, apart in FURTHER:
        again = f"split(u, '{apart}')"
        cut = f"if(octet_length(u) < {least}, array(u), {again})" if cut == "u" else f"flatten(transform({cut}, u -> if(octet_length(u) < {least}, array(u), {again})))"
    long = f"if(octet_length(u) < {FURTHER[0][0]}, array(u), {cut})"
    return f"array_remove({_let('w', whole, f'if(exists(w, u -> octet_length(u) >= {FURTHER[0][0]}), flatten(transform(w, u -> {long})), w)')}, '')"


def lines(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``doc_id, version, hashes, sizes, longs``: line hashes and bytes of each text, and the places of its long
    lines, each with another hash; version is a hash of the text."""
    clean = "if(endswith(u, '\\n'), btrim(u, ' \\t\\r\\n'), trim(u))"
    proof = f"cast(conv(substr(md5({clean}), 1, 8), 16, 10) as bigint)"
    long = f"filter(transform(units, (u, i) -> if(octet_length(u) < {least_bytes}, null, struct(i as i, {proof} as proof))), x -> x is not null)"
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .selectExpr("doc_id", "xxhash64(text) as version", f"{_units()} as units")
        .selectExpr("doc_id", "version", f"transform(units, u -> xxhash64({clean})) as hashes", "transform(units, u -> octet_length(u)) as sizes", "units")
        .selectExpr("doc_id", "version", "hashes", "sizes", f"if(array_max(sizes) >= {least_bytes}, {long}, array()) as longs")
    )


def numbered_lines(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, int]:
    """:func:`lines` of each distinct document with its number ``doc``, and the base of places as numbers. ``doc``
    is the doc_id where ids are unique and fit, else the rank by doc_id and version."""
    cut = staged(lines(docs, least_bytes), "lines")
    ids = cut.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.size("hashes")).alias("longest"))
    seen = ids.agg(F.max("n").alias("n"), F.max("longest").alias("longest"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("ids"), F.count("doc_id").alias("named")).first()
    base = 2 << max(16, int(seen["longest"] or 0).bit_length())
    if seen["ids"] == seen["named"] and (seen["n"] or 0) <= 1 and (seen["lo"] or 0) >= 0 and (seen["hi"] or 0) < (1 << 62) // base:
        return cut.withColumn("doc", F.col("doc_id")), base
    ranked = row_numbers(cut.select("doc_id", "version").distinct(), F.asc_nulls_first("doc_id"), F.asc_nulls_first("version"), name="doc")
    ranked = ranked.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "doc")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("version").eqNullSafe(F.col("of_version"))
    # copies are dropped by aggregation, so that many rows of one document meet as one of each task
    one = cut.groupBy("doc_id", "version").agg(*[F.first(c).alias(c) for c in ("hashes", "sizes", "longs")])
    return staged(one.join(ranked, same).drop("of", "of_version"), "lines"), base


def fingerprints(cut: DataFrame, base: int, slim: bool = False) -> DataFrame:
    """``print, spot, before, after`` of each text's fingerprints; the first two only if ``slim``.

    ``spot`` is document and place as one number, so that the first of many is a plain minimum:
    doc * base + line * 2 + whether it is a line by itself. ``before`` and ``after`` each hold 16 bits of the
    proof that verifies the print and, above them, 48 bits of the hash of the line there, or 0.
    """
    # a pair is at i >= 0, the long line number k at -1 - k; expressions of rows are compiled, unlike those of arrays
    at = cut.where("size(hashes) > 0").selectExpr(f"doc * {base} as place", "hashes", "longs", "explode(sequence(-size(longs), size(hashes) - 1)) as i")
    around = "get(hashes, i - 1) as a", "get(hashes, i) as b", "get(hashes, i + 1) as c", "get(hashes, i + 2) as d"
    own, left, right = "xxhash64(b, c)", "xxhash64(a, b)", "xxhash64(c, d)"
    minimum = f"(a is null and d is null) or (a is not null and {own} <= {left}) or (d is not null and {own} < {right})"
    chosen = at.selectExpr("*", *around).where(f"i < 0 or (c is not null and not (d is not null and {own} = {right}) and ({minimum}))")
    line, n = "get(longs, -1 - i).i", "if(i < 0, 1, 2)"
    spots = chosen.selectExpr("hashes", "longs", "place", "i", f"if(i < 0, {line}, i) as line", "b", "c")
    found = "if(i < 0, xxhash64(get(hashes, line), 1), xxhash64(b, c)) as print", "place + line * 2 + if(i < 0, 1, 0) as spot"
    if slim:
        return spots.selectExpr(*found)
    proof = "if(i < 0, get(longs, -1 - i).proof, b ^ shiftrightunsigned(c, 7)) as proof"
    side = lambda where, bits: f"shiftleft(coalesce(get(hashes, {where}), 0L), 16) | ({bits} & 65535L)"
    return spots.selectExpr("hashes", *found, "line", "i", proof).selectExpr(
        "print", "spot", f"{side('line - 1', 'proof')} as before", f"{side(f'line + {n}', 'shiftright(proof, 16)')} as after"
    )


def repeated_runs(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``doc_id, version, runs``: runs of repeated lines of each text that has any, as structs lo, hi in order."""
    cut, base = numbered_lines(docs, least_bytes)
    first = fingerprints(cut, base, slim=True).groupBy("print").agg(F.min("spot").alias("first"), F.count("*").alias("n")).where("n > 1")
    # as tables of their own, so that the joins below deal both sides anew and can split a common fingerprint
    first = staged(first.select("print", "first"), "first")
    # prints are dealt evenly and each is there once, so that few enough fit a table in memory and nothing is sorted
    few = first.count() <= MAPPED * docs.sparkSession._jsparkSession.sessionState().conf().numShufflePartitions()
    mapped = lambda df: df.hint("shuffle_hash") if few else df
    found = staged(fingerprints(cut, base).join(mapped(first), "print"), "found")
    own = mapped(found.where("spot = first").selectExpr("print", "before as first_before", "after as first_after"))
    proof = lambda x, y: f"(({x} ^ {y}) & 65535L) = 0"
    later = found.where("spot <> first").join(own, "print").where(f"{proof('before', 'first_before')} and {proof('after', 'first_after')}")
    same = lambda x, y: f"if({x} = {y} and shiftright({x}, 16) <> 0L, 1, 0)"
    hits = later.selectExpr(
        f"spot div {base} as doc", f"cast((spot % {base}) div 2 as int) as line", "2 - cast(spot % 2 as int) as len", f"{same('before', 'first_before')} as left", f"{same('after', 'first_after')} as right"
    ).selectExpr("doc", "line - left as lo", "line + len - 1 + right as hi")
    own = Window.partitionBy("doc").orderBy("lo", "hi")
    before = F.coalesce(F.max("hi").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2))
    islands = hits.withColumn("fresh", F.when(F.col("lo") > before + 1, 1).otherwise(0)).withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("doc", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    listed = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    joined = listed.join(cut.select(F.col("doc").alias("of"), "doc_id", "version", "sizes"), F.col("doc") == F.col("of"))
    long_enough = f"filter(runs, r -> aggregate(slice(sizes, r.lo + 1, r.hi - r.lo + 1), 0L, (t, x) -> t + x) >= {least_bytes})"
    return joined.selectExpr("doc_id", "version", f"{long_enough} as runs").where("size(runs) > 0")


def line_dedup(docs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row for each document: ``doc_id, text`` without its repeated runs, ``n_lines_deleted, bytes_deleted``."""
    runs = repeated_runs(docs, least_bytes).select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "runs")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    joined = chosen.join(runs, F.col("doc_id").eqNullSafe(F.col("of")) & F.xxhash64("text").eqNullSafe(F.col("of_version")), "left")
    start, end = "if(j = 0, 0, runs[j - 1].hi + 1)", "if(j = size(runs), size(units), runs[j].lo)"
    pieces = f"array_join(flatten(transform(sequence(0, size(runs)), j -> slice(units, {start} + 1, greatest({end} - ({start}), 0)))), '')"
    made = f"struct({pieces} as text, aggregate(runs, 0, (a, x) -> a + x.hi - x.lo + 1) as n)"
    whole = f"if(runs is null, struct(text as text, 0 as n), {_let('units', _units(), made)})"
    # by a generator, which computes its struct once
    cleaned = joined.selectExpr("doc_id", "text as whole", "runs is null as same", f"inline(array({whole})) as (text, n)")
    return cleaned.selectExpr("doc_id", "text", "n as n_lines_deleted", "if(same, 0L, cast(octet_length(whole) - octet_length(text) as bigint)) as bytes_deleted")
