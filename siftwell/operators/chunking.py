"""Chunks of documents: character windows, source-code scanners, navigation and chunk search.

Cutting is done in Arrow batches; everything else is DataFrame work. Positions are UTF-8 bytes.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import LANGUAGES
from siftwell.operators import bm25

SIZE, OVERLAP = 3200, 480
CHUNK_FIELDS = "document_hash string, seq int, pos int, content string, chunk_type string, breadcrumb string, start_line int, end_line int, language string, hash string"


@dataclass(frozen=True)
class Chunk:
    text: str
    pos: int
    kind: str = "text"
    breadcrumb: str | None = None
    start_line: int = 1
    end_line: int = 1
    language: str | None = None
    leading: str = ""
    trailing: str = ""

    @property
    def hash(self) -> str:
        """Identity of a chunk's content with what surrounds it."""
        return hashlib.sha256((self.leading + self.text + self.trailing).encode()).hexdigest()[:32]


def _boundary(raw: bytes, at: int, step: int) -> int:
    """The nearest character boundary at or before (-1) or after (1) a byte position."""
    at = max(0, min(at, len(raw)))
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += step
    return at


#: Where windows of text and pieces of code end, in order of preference.
TEXT_MARKS, CODE_MARKS = (b"\n\n", b". ", b"\n", b" "), (b"\n\n", b"\n", b" ")


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP, marks: tuple[bytes, ...] = TEXT_MARKS) -> list[Chunk]:
    """Windows of ``size`` bytes that overlap; each ends at one of ``marks`` in its last 30 %, if there is one."""
    raw = text.encode()
    if len(raw) <= size:
        return [Chunk(text, 0, end_line=text.count("\n") + 1)]
    out, start = [], 0
    while True:
        end = _boundary(raw, start + size, -1)
        if end < len(raw):
            low = _boundary(raw, start + size * 70 // 100, 1)
            for mark in marks:
                found = raw.rfind(mark, low, end)
                if found >= 0:
                    end = found + len(mark)
                    break
        first = raw.count(b"\n", 0, start) + 1
        out.append(Chunk(raw[start:end].decode(), start, start_line=first, end_line=first + raw.count(b"\n", start, end)))
        if end >= len(raw):
            return out
        start = max(_boundary(raw, end - overlap, 1), start + 1)


def oversized(chunk: Chunk, most: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """A chunk above ``most`` bytes as numbered pieces that keep its place and breadcrumb."""
    if len(chunk.text.encode()) <= most:
        return [chunk]
    pieces = windows(chunk.text, most, overlap, CODE_MARKS)
    return [
        replace(
            chunk,
            text=p.text,
            pos=chunk.pos + p.pos,
            breadcrumb=f"{chunk.breadcrumb}[{i}]" if chunk.breadcrumb else None,
            start_line=chunk.start_line + p.start_line - 1,
            end_line=chunk.start_line + p.end_line - 1,
            leading=chunk.leading if i == 0 else "",
            trailing=chunk.trailing if i == len(pieces) - 1 else "",
        )
        for i, p in enumerate(pieces)
    ]


# -- source code --------------------------------------------------------------------------------------

#: Declarations that start a chunk, by language, with the kind of chunk.
DECLARATIONS = {
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)", "function"),
        (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"),
        (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", "trait"),
        (r"impl\b[^{;]*?(\w+)(?:<[^{]*>)?\s*(?:where[^{]*)?(?=\{)", "impl"),
        (r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "module"),
        (r"macro_rules!\s*(\w+)", "macro"),
    ],
    "javascript": [
        (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "function"),
        (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "class"),
        (r"(?:export\s+)?interface\s+(\w+)", "interface"),
        (r"(?:export\s+)?enum\s+(\w+)", "enum"),
        (r"(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=", "type"),
        (r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "function"),
    ],
    "go": [
        (r"func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)\s*(\w+)", "method"),
        (r"func\s+(\w+)", "function"),
        (r"type\s+(\w+)\s+struct", "struct"),
        (r"type\s+(\w+)\s+interface", "interface"),
        (r"type\s+(\w+)", "type"),
    ],
}
DECLARATIONS["typescript"] = DECLARATIONS["tsx"] = DECLARATIONS["javascript"]
_COMMENT = re.compile(r"^\s*(//|/\*|\*|#\[|@)")


def _block_end(lines: list[str], first: int) -> int:
    """Last line of a declaration: where its braces close, or the line that ends its statement."""
    depth, opened, quote = 0, False, ""
    for i in range(first, len(lines)):
        line, k = lines[i], 0
        while k < len(line):
            c = line[k]
            if quote:
                if c == "\\":
                    k += 1
                elif line.startswith(quote, k):
                    k += len(quote) - 1
                    quote = ""
            elif line.startswith("//", k):
                break
            elif line.startswith("/*", k):
                quote = "*/"
                k += 1
            elif c in "\"`" or (c == "'" and re.match(r"'(\\.|[^'\\])*'", line[k:])):
                quote = c
            elif c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return i
            elif c == ";" and not opened and depth == 0:
                return i
            k += 1
        if quote in ('"', "'"):
            quote = ""
    return len(lines) - 1


def _braced(text: str, language: str) -> list[Chunk]:
    patterns = [(re.compile(r"^[ \t]*" + p), kind) for p, kind in DECLARATIONS[language]]
    lines = text.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    out: list[Chunk] = []

    def walk(i: int, end: int, parent: str | None) -> None:
        free = i
        while i <= end:
            found = next(((m, kind) for p, kind in patterns if (m := p.match("\n".join(lines[i : i + 3]))) and m.start() == 0), None)
            if found is None:
                i += 1
                continue
            m, kind = found
            last = min(_block_end(lines, i), end)
            lead = i
            while lead > free and _COMMENT.match(lines[lead - 1]):
                lead -= 1
            names = [g for g in m.groups() if g]
            crumb = "::".join([parent, *names] if parent else names)
            if parent and kind == "function":
                kind = "method"
            body = "\n".join(lines[i : last + 1])
            out.append(Chunk(body, offsets[i], kind, crumb, i + 1, last + 1, language, "\n".join(lines[lead:i])))
            if kind in ("impl", "class", "trait", "module") and last > i + 1:
                walk(i + 1, last - 1, crumb)
            i = free = last + 1

    walk(0, len(lines) - 1, None)
    return out


def _python(text: str) -> list[Chunk]:
    tree = ast.parse(text)
    lines = text.split("\n")
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line.encode()) + 1)
    out: list[Chunk] = []

    def visit(nodes, parent: str | None) -> None:
        for node in nodes:
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]]) - 1
            crumb = f"{parent}::{node.name}" if parent else node.name
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
            lead = first
            while lead > 0 and lines[lead - 1].lstrip().startswith("#"):
                lead -= 1
            doc = ast.get_docstring(node) or ""
            out.append(Chunk("\n".join(lines[first : node.end_lineno]), offsets[first], kind, crumb, first + 1, node.end_lineno, "python", "\n".join(lines[lead:first]) or doc))
            if isinstance(node, ast.ClassDef):
                visit(node.body, crumb)

    visit(tree.body, None)
    return out


def cut(text: str, path: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks of a document: by declarations where its language is known and parses, else by windows."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else None
    found: list[Chunk] = []
    if language == "python":
        try:
            found = _python(text)
        except (SyntaxError, ValueError):
            found = []
    elif language:
        found = _braced(text, language)
    if not found:
        return [replace(c, language=language) for c in windows(text, size, overlap)]
    return [p for c in found for p in oversized(c, size, overlap)]


def chunk_documents(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents with hash, path, body; one set for each content hash."""

    names = [x.split()[0] for x in CHUNK_FIELDS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in CHUNK_FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (h, i, c.pos, c.text, c.kind, c.breadcrumb, c.start_line, c.end_line, c.language, c.hash)
                for h, path, text in zip(*(b.column(i).to_pylist() for i in range(3)))
                for i, c in enumerate(cut(text or "", path or "", size, overlap))
            ]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    once = documents.groupBy("hash").agg(F.min(F.struct("path", "body")).alias("d"))
    return once.select("hash", "d.path", "d.body").mapInArrow(run, CHUNK_FIELDS)


# -- navigation and search ------------------------------------------------------------------------------


def with_neighbours(chunks: DataFrame, document: str = "document_hash", key: str = "hash", seq: str = "seq") -> DataFrame:
    """``previous`` and ``next`` chunk of the same document, null at its ends."""
    w = Window.partitionBy(document).orderBy(seq)
    return chunks.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def surrounding(chunks: DataFrame, key_value: str, key: str = "hash", document: str = "document_hash") -> DataFrame:
    """The chunk and its two neighbours, in order; only its documents' chunks are windowed."""
    own = chunks.where(F.col(key) == key_value).select(document).distinct()
    near = with_neighbours(chunks.join(F.broadcast(own), document, "left_semi"), document, key).where((F.col(key) == key_value) | (F.col("previous") == key_value) | (F.col("next") == key_value))
    return near.orderBy("seq")


def with_context(chunks: DataFrame, document: str = "document_hash", seq: str = "seq", most: int = 200) -> DataFrame:
    """``context`` of each chunk for who describes it: the end of the chunk before and the start of the one after."""
    w = Window.partitionBy(document).orderBy(seq)
    before, after = F.lag("content").over(w), F.lead("content").over(w)
    return chunks.withColumn("context", F.concat(F.coalesce(F.right(before, F.lit(most)), F.lit("")), F.lit("\n"), F.coalesce(F.left(after, F.lit(most)), F.lit(""))))


def fan_out(found: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk hits (hash, score) with their chunk and every active document that has its text: a row for each."""
    own = found.join(chunks.withColumnRenamed("hash", "chunk_hash"), found["hash"] == F.col("chunk_hash")).drop(found["hash"])
    return own.join(documents.where("active").withColumnRenamed("hash", "document_hash"), "document_hash")


def search_chunks(chunks: DataFrame, query: str, limit: int | None, key: str = "id", labels: DataFrame | None = None, wanted: dict[str, str] | None = None) -> DataFrame:
    """``key, score`` of chunks by BM25; an empty query gives all of them at 0.5.

    ``labels`` (chunk_hash, key, value) limits the chunks to those with all ``wanted`` labels.
    """
    for name, value in (wanted or {}).items():
        own = labels.where((F.col("key") == name) & (F.col("value") == value)).select(F.col("chunk_hash").alias(key))
        chunks = chunks.join(own, key, "left_semi")
    if not query.strip():
        return bm25.top(chunks.select(key, F.lit(0.5).alias("score")), limit, F.col(key))
    found = bm25.search(chunks, query, bm25.CHUNK_WEIGHTS, key)
    return bm25.top(found.select(key, bm25.score_of(F.col("relevance"), F.lit(1.0)).alias("score")), limit, F.desc("score"), F.col(key))


def by_label(chunks: DataFrame, labels: DataFrame, name: str, value: str) -> DataFrame:
    return chunks.join(labels.where((F.col("key") == name) & (F.col("value") == value)).select(F.col("chunk_hash").alias("hash")), "hash", "left_semi")
