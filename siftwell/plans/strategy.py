"""Choosing how to search: heuristics for one query on the driver, and as columns for many."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases of natural language.
PHRASES = (
    "how to", "how do", "how can", "how should", "how would", "how does", "what is", "what are", "what does", "what's", "why does", "why do", "why is", "why are", "when should", "when do", "when is",
    "where can", "where do", "where is", "who is", "who are", "explain", "show me", "help me", "tell me", "tutorial", "guide", "example", "learn",
)
#: Marks of code.
CODE_MARKS = ("::", "->", "fn ", "func ", "impl ", "class ", "def ", "struct ")


@dataclass(frozen=True)
class Strategy:
    strategy: str
    granularity: str
    confidence: float
    reasoning: str


def is_natural_language(query: str) -> bool:
    return any(p in query.lower() for p in PHRASES)


def is_technical(query: str) -> bool:
    if any(m in query for m in ("::", "_", "->", "=>")) or ("<" in query and ">" in query):
        return True
    return any(len(w.encode()) > 2 and 2 <= sum(c.isupper() for c in w) < len(w.encode()) for w in query.split())


def heuristic_strategy(query: str, has_embeddings: bool) -> Strategy:
    if not has_embeddings:
        return Strategy("bm25", "document", 1.0, "no embeddings")
    language, technical = is_natural_language(query), is_technical(query)
    granularity = "chunk" if technical else "document" if language else "both"
    if language and not technical:
        return Strategy("vector", granularity, 0.7, "natural language")
    return Strategy("hybrid", granularity, 0.6, "mixed or technical")


def strategy_columns(query: Column) -> tuple[Column, Column]:
    """(strategy, granularity) for a column of queries, with embeddings."""
    language = F.lower(query).rlike("|".join(map(re.escape, PHRASES)))
    mixed = F.exists(F.split(query, r"\s+"), lambda w: (F.octet_length(w) > 2) & (F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) >= 2) & (F.length(F.regexp_replace(w, r"[^\p{Lu}]", "")) < F.octet_length(w)))
    technical = query.rlike("::|_|->|=>") | (query.contains("<") & query.contains(">")) | mixed
    return F.when(language & ~technical, "vector").otherwise("hybrid"), F.when(technical, "chunk").when(language, "document").otherwise("both")


def is_code_identifier(query: str) -> bool:
    """Whether a word is in snake_case, camelCase or PascalCase."""
    for w in query.split():
        if len(w) < 2:
            continue
        if "_" in w and all(c.isalnum() or c == "_" for c in w):
            return True
        lower, upper = any(c.islower() for c in w[1:]), any(c.isupper() for c in w[1:])
        if (w[0].isupper() and lower and upper) or (w[0].islower() and upper):
            return True
    return False


#: How a query says a span of time, and how it begins and ends there.
_SPAN = r"(?:(\d+)\s+)?(hour|day|week|month|year)s?"
_PHRASES = (
    (rf"\b(?:in|from|within|over)?\s*(?:the\s+)?(?:last|past)\s+{_SPAN}\b", "after"),
    (rf"\bsince\s+{_SPAN}\s+ago\b", "after"),
    (rf"\b(?:before|older than)\s+{_SPAN}(?:\s+ago)?\b", "before"),
    (r"\b(?:from\s+)?(yesterday|today)\b", "day"),
)


def time_in(query: str) -> tuple[str, str | None, str | None]:
    """A query without its first phrase of each kind about time, and what :func:`filters.parse_time` is given for
    the time after which and before which rows must be."""
    import re

    after = before = None
    for pattern, kind in _PHRASES:
        found = re.search(pattern, query, re.IGNORECASE)
        if not found:
            continue
        if kind == "day":
            after = after or ("1 day ago" if found.group(1).lower() == "today" else "2 days ago")
        else:
            n = found.group(1) or "1"
            said = f"{n} {found.group(2).lower()}{'' if n == '1' else 's'} ago"
            after, before = (after or said, before) if kind == "after" else (after, before or said)
        query = (query[: found.start()] + " " + query[found.end() :]).strip()
    return " ".join(query.split()), after, before
