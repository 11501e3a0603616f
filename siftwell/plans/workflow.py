"""Workflows: steps that are folded over a result page, each a DataFrame to a DataFrame."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.errors import InvalidInput
from siftwell.operators import filters, fusion
from siftwell.plans import strategy


@dataclass(frozen=True)
class Step:
    """One step; ``kind`` is one of KINDS and ``args`` what it takes."""

    kind: str
    args: dict = field(default_factory=dict)


#: Kinds of step.
SEARCHES = ("bm25_search", "vector_search", "hybrid_search", "bm25_chunk_search", "vector_chunk_search", "glossary_search")
KINDS = (*SEARCHES, "filter_metadata", "filter_temporal", "filter_collection", "rerank", "deduplicate", "limit", "expand_query", "merge")


@dataclass
class Workflow:
    steps: Sequence[Step]
    reasoning: str = ""
    expected_results: int = 20
    complexity: str = "simple"


@dataclass
class Searchers:
    """What a workflow searches with: functions of (query, limit, args) to pages with a score, and hooks."""

    search: dict[str, Callable[[str, int, dict], DataFrame]]
    reranker: Callable[[str, DataFrame], DataFrame] | None = None
    expander: Callable[[str], Sequence[str]] | None = None
    now: dt.datetime | None = None


def fallback_workflow(query: str, has_embeddings: bool) -> Workflow:
    """The plan without a planner: by marks of code, by question words, else hybrid."""
    low = query.lower()
    code = any(m in query for m in strategy.CODE_MARKS) or strategy.is_code_identifier(query)
    by = lambda kind: Step(kind, {"query": query, "limit": 20})
    if not has_embeddings:
        steps = [by("bm25_chunk_search" if code else "bm25_search")]
    elif code:
        steps = [by("bm25_chunk_search"), by("bm25_search"), Step("merge", {"strategy": "rrf"}), Step("deduplicate"), Step("limit", {"count": 20})]
    elif any(w in low for w in ("how", "what", "why")):
        steps = [by("vector_search")]
    else:
        steps = [Step("hybrid_search", {"query": query, "limit": 20, "use_expansion": False, "use_reranking": False})]
    return Workflow(steps, "without a planner", 20, "moderate" if code else "simple")


def parse_workflow(text: str) -> Workflow:
    """A planner's answer: the JSON object in it, with ``steps`` of ``{"step": kind, ...}``."""
    found = re.search(r"\{.*\}", text, re.S)
    if not found:
        raise InvalidInput("no JSON object in the answer")
    try:
        raw = json.loads(found.group())
    except json.JSONDecodeError as e:
        raise InvalidInput(str(e)) from e
    steps = []
    for s in raw.get("steps", []):
        s = dict(s)
        kind = s.pop("step", s.pop("type", ""))
        if kind not in KINDS:
            raise InvalidInput(f"no step {kind!r}")
        steps.append(Step(kind, s))
    known = {f.name for f in fields(Workflow)} - {"steps"}
    return Workflow(steps, **{k: v for k, v in raw.items() if k in known})


def plan(query: str, has_embeddings: bool, planner: Callable[[str], str] | None = None) -> Workflow:
    """The planner's workflow, or the fallback if there is none or it gives nothing usable."""
    if planner is not None:
        try:
            made = parse_workflow(planner(query))
            if made.steps:
                return made
        except InvalidInput:
            pass
    return fallback_workflow(query, has_embeddings)


class Context:
    """Results so far, in order, and how they came: ``history`` has a name for each step."""

    def __init__(self):
        self.lists: list[DataFrame] = []
        self.history: list[str] = []

    @property
    def page(self) -> DataFrame | None:
        if not self.lists:
            return None
        if len(self.lists) == 1:
            return self.lists[0]
        return fusion.concatenated([p.withColumn("rank", F.col("ord")).drop("ord") for p in self.lists]).drop("rank", "step")

    def set(self, page: DataFrame) -> None:
        self.lists = [page]


def in_order(page: DataFrame, *order) -> DataFrame:
    return page.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)


def run(workflow: Workflow, searchers: Searchers, limit: int | None = None, key: str = "id") -> tuple[DataFrame | None, list[str]]:
    """Fold the steps: (page with ``ord``, history). Nothing is computed until the page is used."""
    c = Context()
    for step in workflow.steps:
        apply(step, c, searchers, key)
        c.history.append(step.kind)
    page = c.page
    if page is not None and limit:
        page = page.where(F.col("ord") < limit)
    return page, c.history


def apply(step: Step, c: Context, s: Searchers, key: str = "id") -> None:
    a, kind = step.args, step.kind
    if kind in SEARCHES:
        found = s.search[kind](a["query"], a.get("limit", 20), a)
        c.lists.append(in_order(found, F.desc("score"), F.col(key)))
        return
    if kind == "expand_query":
        variants = list(s.expander(a["query"])) if s.expander else []
        found = [in_order(s.search["bm25_search"](q, a.get("limit", 20), a), F.desc("score"), F.col(key)) for q in variants]
        c.lists += found
        if found:
            apply(Step("merge", {"strategy": "rrf"}), c, s, key)
        return
    page = c.page
    if page is None:
        return
    if kind == "filter_metadata":
        names = ("category", "difficulty", "exclude_category", "exclude_difficulty", "tags")
        c.set(filters.guarded(page, filters.metadata_step(**{k: a[k] for k in names if a.get(k)})))
    elif kind == "filter_temporal":
        now = s.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        c.set(filters.temporal(page, filters.parse_time(a.get("after"), now), filters.parse_time(a.get("before"), now)))
    elif kind == "filter_collection":
        c.set(filters.by_collection(page, *a["collections"]))
    elif kind == "deduplicate":
        parts = [x for x in ("chunk_hash", "hash") if x in page.columns]
        c.set(fusion.keep_first(page.withColumn("__key", F.coalesce(*parts)) if parts else page.withColumn("__key", F.col(key)), "__key").drop("__key"))
    elif kind == "limit":
        c.set(page.orderBy("ord").limit(a["count"]))
    elif kind == "rerank":
        if s.reranker is not None:
            first = page.orderBy("ord").limit(min(a.get("limit", 10), 10))
            scored = first.join(s.reranker(a.get("query", ""), first), key, "left").withColumn("score", F.coalesce("rerank", F.lit(0.5))).drop("rerank")
            c.set(in_order(scored, F.desc("score"), F.col(key)))
    elif kind == "merge":
        lists = [p.withColumn("rank", F.col("ord")).drop("ord") for p in c.lists]
        how = a.get("strategy", "rrf")
        if how == "rrf":
            sums = fusion.workflow_rrf(lists, key)
            payload = fusion.keep_first(fusion.concatenated(lists), key).drop("rank", "step", "ord", "score")
            c.set(in_order(payload.join(sums, key).drop("first"), F.desc("score"), F.col(key)))
        elif how in ("append", "interleave"):
            merged = fusion.merge_append(lists, key) if how == "append" else fusion.merge_interleave(lists, key)
            c.set(in_order(merged.drop("rank", "step"), F.col("ord")))
        else:
            raise InvalidInput(f"no merge strategy {how!r}")
    else:
        raise InvalidInput(f"no step {kind!r}")
