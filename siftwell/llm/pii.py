"""Format-preserving pseudonyms for personal data by keyed Feistel permutations, in SQL functions only.

Values are found by pattern and validated: payment cards by their Luhn digit, bank accounts by their
check digits, addresses by their ranges, dates by the calendar. A valid value is replaced by another
one of the same form: its digits run through ten rounds of an alternating Feistel network whose round
function is a keyed hash, so that the map is a permutation of all values of that form. Equal values
get equal pseudonyms in every document, different ones different pseudonyms, and whoever has the key
can undo it (``inverse=True``). What fails validation is ordinary text and stays.

======== ====================================== =================================================
kind     found                                  pseudonym
======== ====================================== =================================================
email    local@domain                           the local part's letters and its digits, domain kept
card     13-19 digits, Luhn; within a longer    all digits but the last, which is made to fit
         row of groups, a group or 4-4-4-4,
         4-4-4-4-3 or 4-6-5 digits
iban     country, check digits 02-98, account   digits of the account; check digits made to fit
phone    +country and digits, or (ddd) ddd-dddd digits after the country's code; the latter is +1
ssn      ddd-dd-dddd, areas 001-899 but 666,    its number among the valid ones
         groups and serials from 1
ip       four numbers up to 255, no zeros ahead its 32 bits
date     y-m-d, d/m/y or d.m.y, 1800 to 2199    its day, within those 400 years and the dates whose
                                                day and month have as many digits
secret   name = "16 or more hex digits"         its letters and its digits
======== ====================================== =================================================

Letters keep their case and place, so addresses that differ in case alone stay linked; numbers keep their
spacing and stay linked whatever it is. A permutation is kept within its form by cycle walking: it is
applied again until the result has the form.

Defined results: null text stays null; values in a text are replaced from left to right and never
overlap; a null doc_id is kept; rows that repeat are treated alike; an empty table gives an empty
result. The key is part of the plan, so plans and event logs must be guarded as the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DECIMAL = "0123456789"
HEX = "0123456789abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX_LETTERS = "abcdef"
#: Days in 400 years of the Gregorian calendar are 189 * 773.
_FIRST_DAY, _A, _B = "1800-01-01", 189, 773
#: Country codes of one and two digits; the others have three.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Fixed value: the groups of a card within a longer row of groups.
LAYOUT = "[0-9]{13,19}|[0-9]{4}( [0-9]{4}){3}( [0-9]{3})?|[0-9]{4} [0-9]{6} [0-9]{5}"
WALK = 256  # steps of cycle walking; the least likely form has one in five

#: The patterns, in order of preference at one place of a text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|password|api_?key)\s?[=:]\s?[\x22']?[0-9A-Fa-f]{16,}(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Feistel:
    """Builds SQL expressions for one key and direction."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.inverse = _text(key), inverse
        self.order = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"

    def _hash(self, kind: str, n: str, round_: str, tweak: str, other: str) -> str:
        return f"sha2(concat_ws('|', {self.key}, '{kind}', {n}, {round_}, {tweak}, {other}), 256)"

    def _add(self, x: str, inner: str, alphabet: str) -> str:
        """Symbols of x shifted by two hex digits each of a keyed stream."""
        sign = "-" if self.inverse else "+"
        stream = f"array_join(transform(sequence(0, (length({x}) - 1) div 32), b -> sha2(concat({self.key}, h, b), 256)), '')"
        shift = f"cast(conv(substr(f, 2 * j - 1, 2), 16, 10) as int)"
        shifted = f"array_join(transform(sequence(1, length({x})), j -> substr('{alphabet}', cast(pmod(instr('{alphabet}', substr({x}, j, 1)) - 1 {sign} {shift}, {len(alphabet)}) as int) + 1, 1)), '')"
        return f"if(length({x}) = 0, '', {_let('h', inner, _let('f', stream, shifted))})"

    def digits(self, x: str, kind: str, alphabet: str = DECIMAL, tweak: str = "''") -> str:
        """A permutation of strings over ``alphabet`` of one length, another one for each ``tweak``."""
        n = f"length({x})"
        even = f"struct({self._add('a.l', self._hash(kind, n, 'i', tweak, 'a.r'), alphabet)} as l, a.r as r)"
        odd = f"struct(a.l as l, {self._add('a.r', self._hash(kind, n, 'i', tweak, 'a.l'), alphabet)} as r)"
        start = f"struct(substr({x}, 1, cast({n} div 2 as int)) as l, substr({x}, cast({n} div 2 as int) + 1) as r)"
        return f"aggregate({self.order}, {start}, (a, i) -> if(i % 2 = 0, {even}, {odd}), a -> concat(a.l, a.r))"

    def number(self, x: str, kind: str, high: int, low: int) -> str:
        """A permutation of the numbers below high * low."""
        sign = "-" if self.inverse else "+"
        f = lambda other: f"cast(conv(substr({self._hash(kind, '0', 'i', chr(39) * 2, other)}, 1, 12), 16, 10) as bigint)"
        even = f"struct(pmod(a.l {sign} {f('a.r')}, {high}L) as l, a.r as r)"
        odd = f"struct(a.l as l, pmod(a.r {sign} {f('a.l')}, {low}L) as r)"
        start = f"struct(cast({x} div {low} as bigint) as l, cast({x} % {low} as bigint) as r)"
        return f"aggregate({self.order}, {start}, (a, i) -> if(i % 2 = 0, {even}, {odd}), a -> a.l * {low} + a.r)"

    def words(self, x: str, kind: str, letters: str) -> str:
        """``x`` with its letters and its digits permuted, each among themselves; the digits depend on the letters."""
        was = "w.is" if self.inverse else "w.was"
        number = f"struct(w.is as is, {self.digits('w.n', kind + '-digits', DECIMAL, was)} as n)"
        plain = f"regexp_replace(lower({x}), '[^{letters[0]}-{letters[-1]}]', '')"
        found = f"struct(p as was, {self.digits('p', kind, letters)} as is, regexp_replace({x}, '[^0-9]', '') as n)"
        letter, digit = f"substr(z.is, s.l, 1)", "substr(z.n, s.d, 1)"
        c = f"substr({x}, q, 1)"
        step = (
            f"case when {c} between '0' and '9' then struct(concat(s.out, {digit}) as out, s.l as l, s.d + 1 as d) "
            f"when lower({c}) between '{letters[0]}' and '{letters[-1]}' then struct(concat(s.out, if({c} = lower({c}), {letter}, upper({letter}))) as out, s.l + 1 as l, s.d as d) "
            f"else struct(concat(s.out, {c}) as out, s.l as l, s.d as d) end"
        )
        filled = f"aggregate(sequence(1, length({x})), struct('' as out, 1 as l, 1 as d), (s, q) -> {step}, s -> s.out)"
        return _let("p", plain, _let("w", found, _let("z", number, filled)))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _refill(old: str, new: str, symbols: str) -> str:
    """``old`` with its characters in ``symbols`` replaced one after the other by those of ``new``."""
    return (
        f"aggregate(sequence(1, length({old})), struct('' as out, 1 as at), (s, p) -> "
        f"if(substr({old}, p, 1) rlike '[{symbols}]', struct(concat(s.out, substr({new}, s.at, 1)) as out, s.at + 1 as at), struct(concat(s.out, substr({old}, p, 1)) as out, s.at as at)), s -> s.out)"
    )


def _luhn(x: str, doubled: int) -> str:
    """Luhn sum of a digit string in which positions from the right that leave ``doubled`` modulo 2 are doubled."""
    d = f"cast(substr({x}, length({x}) - q + 1, 1) as int)"
    return f"aggregate(sequence(1, length({x})), 0, (t, q) -> t + if(q % 2 = {doubled}, 2 * {d} - if({d} > 4, 9, 0), {d}))"


def _mod97(x: str) -> str:
    c = f"substr({x}, q, 1)"
    return f"aggregate(sequence(1, length({x})), 0, (t, q) -> if({c} rlike '[0-9]', (t * 10 + ascii({c}) - 48) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _replacement(m: str, f: Feistel) -> str:
    """The pseudonym of a matched value, or the value itself where validation fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = _let("e", f"substring_index({m}, '@', 1)", f"concat({f.words('e', 'email', LETTERS)}, substring({m}, instr({m}, '@')))")
    secret = _let("u", f"regexp_extract({m}, '([0-9A-Fa-f]{{16,}})$', 1)", f"concat(substr({m}, 1, length({m}) - length(u)), {f.words('u', 'secret', HEX_LETTERS)})")
    octets = f"split({m}, '[.]')"
    ip_hex = f"array_join(transform({octets}, o -> lpad(lower(hex(cast(o as int))), 2, '0')), '')"
    new_ip = _let("v", _let("u", ip_hex, f.digits("u", "ip", HEX)), "concat_ws('.', transform(sequence(0, 3), o -> conv(substr(v, 2 * o + 1, 2), 16, 10)))")
    ip = f"if(forall({octets}, o -> cast(o as int) < 256 and (o = '0' or o not like '0%')), {new_ip}, {m})"
    day = lambda v: f"date_add(date'{_FIRST_DAY}', cast({v} as int))"
    first, again = (f.number(x, "date", _A, _B) for x in ("v", "w"))
    valid = lambda v: f"between 0 and {_A * _B - 1}".join([f"{v} ", ""])
    iso = _let("v", f"datediff(try_to_date({m}, 'yyyy-MM-dd'), date'{_FIRST_DAY}')", f"if({valid('v')}, date_format({day(first)}, 'yyyy-MM-dd'), {m})")
    form = f"((length(t[0]) = 2 or day({day('w')}) < 10) and (length(t[1]) = 2 or month({day('w')}) < 10))"
    walked = f"aggregate(sequence(1, {WALK}), {first}, (w, k) -> if({form}, w, {again}))"
    sep = f"if({m} like '%/%', '/', '.')"
    shown = _let("y", day("x"), f"concat(lpad(cast(day(y) as string), length(t[0]), '0'), {sep}, lpad(cast(month(y) as string), length(t[1]), '0'), {sep}, date_format(y, 'yyyy'))")
    other = _let("t", f"split({m}, '[./]')", _let("v", f"datediff(try_to_date(concat_ws('/', t), 'd/M/yyyy'), date'{_FIRST_DAY}')", f"if({valid('v')}, {_let('x', walked, shown)}, {m})"))
    date = f"coalesce(case when {m} like '____-%' then {iso} else {other} end, {m})"
    area, group, serial = (f"cast(substr(u, {at}, {n}) as int)" for at, n in ((1, 3), (4, 2), (6, 4)))
    ssn_number = f"(cast({area} - 1 - if({area} > 666, 1, 0) as bigint) * 99 + {group} - 1) * 9999 + {serial} - 1"
    ssn_area = "(v div 989901 + 1)"
    ssn_shown = f"concat(lpad(cast({ssn_area} + if({ssn_area} > 665, 1, 0) as string), 3, '0'), lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), lpad(cast(v % 9999 + 1 as string), 4, '0'))"
    new_ssn = _let("v", _let("x", ssn_number, f.number("x", "ssn", 898 * 99, 9999)), _let("w", ssn_shown, _refill(m, "w", "0-9")))
    ssn = _let("u", digits, f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {new_ssn}, {m})")
    country = f"if({m} like '(%', '1', regexp_extract(u, '^({COUNTRY})', 1))"
    head = f"if({m} like '(%', 0, length(c))"
    phone = _let("u", digits, _let("c", country, _let("d", f"substring(u, {head} + 1)", _let("n", f"concat(substring(u, 1, {head}), {f.digits('d', 'phone', DECIMAL, 'c')})", _refill(m, "n", "0-9")))))
    new_card = _let("w", f.digits("substr(u, 1, length(u) - 1)", "card"), f"concat(w, cast(pmod(-({_luhn('w', 1)}), 10) as string))")

    def row(x: str) -> str:
        """Where in a row of groups a card is, as the digits before it and its own; null if all of it is one or none."""
        groups, joined = f"split({x}, '[ -]')", "concat_ws(' ', slice(g, o + 1, e - o + 1))"
        one = _let("x", "array_join(slice(g, o + 1, e - o + 1), '')", f"if({joined} rlike '^({LAYOUT})$' and {_luhn('x', 0)} % 10 = 0, struct(length(x) as size, -length(array_join(slice(g, 1, o), '')) as ahead), null)")
        some = f"array_max(flatten(transform(sequence(0, size(g) - 1), o -> transform(sequence(o, size(g) - 1), e -> {one}))))"
        whole = _let("x", "array_join(g, '')", f"{_luhn('x', 0)} % 10 = 0")
        return _let("g", groups, f"if({whole} or size(g) = 1, null, {some})")

    part = lambda x: _let("u", f"substr(regexp_replace({x}, '[^0-9]', ''), 1 - r.ahead, r.size)", new_card)
    put = lambda x: _let("y", f"regexp_replace({x}, '[^0-9]', '')", _let("n", f"concat(substr(y, 1, -r.ahead), {part(x)}, substr(y, 1 - r.ahead + r.size))", _refill(x, "n", "0-9")))
    walked_card = f"aggregate(sequence(1, {WALK}), {put(m)}, (c, k) -> if({row('c')} <=> r, c, {put('c')}))"
    inner_card = _let("r", row(m), f"if(r is null, {m}, {walked_card})")
    card = _let("u", digits, f"if({_luhn('u', 0)} % 10 = 0, {_let('n', new_card, _refill(m, 'n', '0-9'))}, if({m} rlike '[ -]', {inner_card}, {m}))")
    plain = f"regexp_replace({m}, ' ', '')"
    account_digits = "regexp_replace(substring(u, 5), '[^0-9]', '')"
    new_account = _let("w", _let("d", account_digits, f.digits("d", "iban")), _refill("substring(u, 5)", "w", "0-9"))
    rebuilt = _let("b", new_account, f"concat(substr(u, 1, 2), lpad(cast(98 - {_mod97('concat(b, substr(u, 1, 2), ' + _text('00') + ')')} as string), 2, '0'), b)")
    iban = _let("u", plain, f"if(substr(u, 3, 2) between '02' and '98' and {_mod97('concat(substring(u, 5), substr(u, 1, 4))')} = 1, {_let('n', rebuilt, _refill(m, 'n', '0-9A-Z'))}, {m})")
    return (
        f"case when {m} like '%@%' then {email} when {m} rlike '(?i)^(token|secret|pass|api)' then {secret} "
        f"when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {ip} when {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})$' then {date} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} when {m} rlike '^[+(]' then {phone} when {m} rlike '^[A-Z]{{2}}' then {iban} else {card} end"
    )


DEMONSTRATION = "siftwell-demonstration-key"


def pseudonymise(docs: DataFrame, key: str = DEMONSTRATION, inverse: bool = False) -> DataFrame:
    """One row for each document: ``doc_id, text`` with pseudonyms, ``n_found`` and ``n_replaced`` values.

    ``key`` must be a secret of the deployment; the default is for demonstration. ``inverse`` undoes
    a run with the same key.
    """
    pattern = _text("|".join(f"(?:{p})" for p in PATTERNS.values()))
    may = "text rlike '[0-9@]'"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).selectExpr(
        "doc_id", "text", f"if({may}, regexp_extract_all(text, {pattern}, 0), cast(array() as array<string>)) as hits"
    )
    replaced = found.selectExpr("doc_id", "text", "hits", f"transform(hits, m -> {_replacement('m', Feistel(key, inverse))}) as new")
    gaps = f"split(text, {pattern}, -1)"
    joined = f"{_let('g', gaps, 'array_join(transform(g, (x, i) -> concat(x, if(i < size(new), new[i], ' + _text('') + '))), ' + _text('') + ')')}"
    return replaced.selectExpr(
        "doc_id",
        f"case when text is null or size(hits) = 0 then text else {joined} end as text",
        "size(coalesce(hits, cast(array() as array<string>))) as n_found",
        "coalesce(aggregate(zip_with(hits, new, (a, b) -> if(a = b, 0, 1)), 0, (t, x) -> t + x), 0) as n_replaced",
    )
