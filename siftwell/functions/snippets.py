"""Snippets around a match, and truncation for prompts; byte positions, so done in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH, SHORT = 500, 150
PROMPT_CHARS = 8000


def match_position(text: str, query: str) -> int:
    """Byte position of the query, else of its first word of three bytes or more, else 0; case is ignored."""
    low, q = text.lower(), query.lower()
    for part in [q, *[w for w in q.split() if len(w.encode()) >= 3]]:
        at = low.find(part) if part else 0
        if at >= 0:
            return len(text[:at].encode())
    return 0


def snippet(text: str, query: str, length: int = LENGTH, position: int | None = None) -> tuple[str, int, int]:
    """(snippet, start, end): a window of ``length`` bytes about a position, widened to whole words, with ellipses."""
    raw = text.encode()
    if len(raw) <= length:
        return text, 0, len(raw)
    centre = match_position(text, query) if position is None else position
    start = max(0, centre - length // 2)
    end = min(start + length, len(raw))
    start = max(0, end - length) if end == len(raw) else start
    space = b" \t\n\r\x0b\x0c"
    while start > 0 and raw[start - 1] not in space:
        start -= 1
    while end < len(raw) and raw[end] not in space:
        end += 1
    out = raw[start:end].decode("utf-8", "replace")
    if start > 0:
        out = "..." + out.lstrip()
    if end < len(raw):
        out = out.rstrip() + "..."
    return out, start, end


def with_snippet(rows: DataFrame, query: str, length: int = LENGTH, body: str = "body", position: str | None = None) -> DataFrame:
    """``rows`` (a result page) with ``snippet, start_pos, end_pos``; ``position`` names a column of chunk positions."""
    place, at = rows.columns.index(body), rows.columns.index(position) if position else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            positions = [None] * b.num_rows if at is None else b.column(at).to_pylist()
            made = [snippet(t or "", query, length, p) for t, p in zip(b.column(place).to_pylist(), positions)]
            extra = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "snippet", "start_pos", "end_pos"])

    more = [T.StructField("snippet", T.StringType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def truncated(text: str, kind: str = "text", most: int = PROMPT_CHARS) -> str:
    """Text cut to ``most`` characters: Markdown keeps headings and their first paragraphs, code its head
    and declarations, other text its head and tail."""
    if len(text) <= most:
        return text
    if kind == "markdown":
        out, used = [], 0
        for section in text.split("\n#"):
            part = section[: max(200, most // 10)]
            if used + len(part) > most:
                break
            out.append(part)
            used += len(part) + 2
        return "\n#".join(out)[:most]
    if kind == "code":
        head = text[: most // 2]
        rest = [x for x in text[most // 2 :].split("\n") if x.lstrip().startswith(("def ", "class ", "fn ", "pub ", "impl ", "struct ", "func ", "type ", "function ", "export ", "interface "))]
        return (head + "\n...\n" + "\n".join(rest))[:most]
    head = most * 2 // 3
    return text[:head] + "\n...\n" + text[-(most - head - 5) :]
