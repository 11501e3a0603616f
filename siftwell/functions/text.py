"""Text functions: tokens, query cleaning, titles, paths, sentences, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "doc://"

#: Words that queries drop.
STOP_WORDS = (
    "a an and are as at be by for from has have he in is it its of on that the to was will with does do did "
    "can could should would what where when why how who which this these those there here"
).split()

#: Filters written inside a query.
FILTER_FIELDS = ("category", "difficulty", "tag", "keyword")

_OPERATORS = re.compile(r"[?!^()\[\]{}]")
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats included."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda x: x != "")


def sanitise_query(query: str) -> str:
    """Drop operator characters and stop words; a word with a colon stays."""
    if not query.strip():
        return query
    return " ".join(w for w in _OPERATORS.sub("", query).split() if ":" in w or w.lower() not in STOP_WORDS)


def sanitised(query: Column) -> Column:
    """:func:`sanitise_query` for a column of queries."""
    words = F.filter(F.split(F.regexp_replace(query, r"[?!^()\[\]{}]", ""), r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w: w.contains(":") | ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), F.lower(w)))
    return F.when(F.trim(query) == "", query).otherwise(F.array_join(kept, " "))


def parse_filters(query: str) -> tuple[str, list[tuple[str, str]]]:
    """(clean text, filters) of a query with inline ``field:value`` filters."""
    filters, rest = [], []
    for term in query.split():
        field, colon, value = term.partition(":")
        if colon and field.lower() in FILTER_FIELDS:
            filters.append((field.lower(), value))
        else:
            rest.append(term)
    return sanitise_query(" ".join(rest)), filters


def inline_filters(query: Column) -> Column:
    """Array of ``field:value`` filters in a column of queries, fields lower-cased."""
    found = F.filter(F.split(query, r"\s+"), lambda w: F.lower(w).rlike("^(" + "|".join(FILTER_FIELDS) + "):"))
    return F.transform(found, lambda w: F.concat(F.lower(F.substring_index(w, ":", 1)), F.lit(":"), F.regexp_replace(w, "^[^:]*:", "")))


def code_query(query: Column) -> Column:
    """Code punctuation (``::``, arrows, angle brackets) as spaces."""
    return F.regexp_replace(query, "::|->|<|>", " ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def virtual_path(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(SCHEME), collection, F.lit("/"), path)


def split_virtual_path(uri: Column) -> tuple[Column, Column]:
    """Collection and path of a virtual path, null if it isn't one."""
    rest = F.when(uri.startswith(SCHEME), F.substring(uri, len(SCHEME) + 1, 1 << 30))
    return F.nullif(F.substring_index(rest, "/", 1), F.lit("")), F.regexp_extract(rest, "^[^/]*/(.*)$", 1)


def parent_dir(path: Column) -> Column:
    """What is before the last slash, or a dot."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def slug(path: Column) -> Column:
    """Path in lower case with only letters, digits, slash, dot and hyphen."""
    plain = F.regexp_replace(F.replace(F.lower(path), F.lit("___"), F.lit("/")), r"[^\p{L}\p{N}/.-]", "-")
    return F.regexp_replace(F.replace(plain, F.lit("--"), F.lit("-")), "^-+|-+$", "")


def heading_title(text: Column, path: Column) -> Column:
    """First heading of level one or two in 50 lines; after a generic one the first of level two; else the file's stem."""
    first50 = F.array_join(F.slice(F.split(text, "\r?\n"), 1, 50), "\n")
    first = F.trim(F.regexp_extract(first50, r"(?m)^##?[ \t]+(.+)$", 1))
    second = F.trim(F.regexp_extract(F.array_join(F.slice(F.split(text, "\r?\n"), 2, 50), "\n"), r"(?m)^##[ \t]+(.+)$", 1))
    generic = first.isin("README", "Index") | first.contains("Notes")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""), "[-_]", " ")
    return F.when(generic & (second != ""), second).when(first != "", first).otherwise(stem)


def page_title(url: Column, html: Column) -> Column:
    """First ``# `` line, else the title element, else the last path segment."""
    mark = F.nullif(F.trim(F.regexp_extract(html, r"(?m)^[ \t]*# (.+)$", 1)), F.lit(""))
    element = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), F.lit(""))
    last = F.element_at(F.filter(F.split(F.regexp_replace(url, r"^https?://|[?#].*$", ""), "/"), lambda x: x != ""), -1)
    return F.coalesce(mark, element, last)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop before a space or newline, else at most 200 bytes at a word's end."""
    t = F.trim(text)
    space, line = F.instr(t, ". "), F.instr(t, ".\n")
    cut = F.decode(F.substring(F.encode(t, "utf-8"), 1, 200), "utf-8")
    safe = F.regexp_replace(cut, "�+$", "")
    words = F.when(safe.contains(" "), F.regexp_replace(safe, " [^ ]*$", "")).otherwise(safe)
    return F.when(space > 0, F.substring(t, F.lit(1), space)).when(line > 0, F.substring(t, F.lit(1), line)).when(F.octet_length(t) <= 200, t).otherwise(F.concat(words, F.lit("...")))


def normalised_term(term: Column) -> Column:
    return F.replace(F.lower(term), F.lit(" "), F.lit("_"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def embedding_text(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), text)


def csv_field(value: Column) -> Column:
    """RFC 4180: quoted where needed, quotes doubled."""
    return F.when(value.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def xml_text(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


#: File extensions and the languages they name.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go"}


def extension(path: Column) -> Column:
    return F.when(F.element_at(F.split(path, "/"), -1).contains("."), F.substring_index(path, ".", -1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(extension(path))]


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: ``*`` crosses slashes, braces are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = j
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"
