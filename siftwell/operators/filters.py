"""Filters: collections, time, typed metadata predicates and the guarded metadata filter."""

from __future__ import annotations

import calendar
import datetime as dt
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.errors import InvalidInput

#: The kinds of a metadata value.
KINDS = ("Text", "Integer", "Float", "Boolean", "DateTime", "Tags", "Enum", "Qualitative", "Quantitative", "Json")


# -- typed metadata values --------------------------------------------------------------------------


class Metadata:
    """A document's own metadata: typed values by name, stored as ``{name: {"type", "value"}}``."""

    def __init__(self, fields: Mapping[str, dict] | None = None):
        self.fields: dict[str, dict] = dict(fields or {})

    def _put(self, name: str, kind: str, value) -> "Metadata":
        self.fields[name] = {"type": kind, "value": value}
        return self

    def text(self, name: str, value: str):
        return self._put(name, "Text", value)

    def integer(self, name: str, value: int):
        return self._put(name, "Integer", int(value))

    def float(self, name: str, value: float):
        return self._put(name, "Float", float(value))

    def boolean(self, name: str, value: bool):
        return self._put(name, "Boolean", bool(value))

    def datetime(self, name: str, value: str):
        return self._put(name, "DateTime", value)

    def tags(self, name: str, values: Sequence[str]):
        return self._put(name, "Tags", list(values))

    def enum(self, name: str, value: str, options: Sequence[str]):
        if value not in options:
            raise InvalidInput(f"{value!r} is not one of {list(options)}")
        return self._put(name, "Enum", {"value": value, "options": list(options)})

    def qualitative(self, name: str, value: str, scale: Sequence[str]):
        if value not in scale:
            raise InvalidInput(f"{value!r} is not on the scale {list(scale)}")
        return self._put(name, "Qualitative", {"value": value, "scale": list(scale)})

    def quantitative(self, name: str, value: float, unit: str):
        return self._put(name, "Quantitative", {"value": float(value), "unit": unit})

    def json(self, name: str, value):
        return self._put(name, "Json", value)

    def get(self, name: str):
        return self.fields.get(name)

    def remove(self, name: str):
        return self.fields.pop(name, None)

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def merge(self, other: "Metadata") -> "Metadata":
        """Both; where names clash the other's value."""
        return Metadata({**self.fields, **other.fields})

    def to_json(self) -> str:
        return json.dumps(self.fields, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Metadata":
        return cls(json.loads(text))

    @classmethod
    def coerce(cls, values: Mapping) -> "Metadata":
        """From plain JSON: strings, whole numbers, floats, booleans and lists of strings."""
        out = cls()
        for name, v in values.items():
            if isinstance(v, bool):
                out.boolean(name, v)
            elif isinstance(v, int):
                out.integer(name, v)
            elif isinstance(v, float):
                out.float(name, v)
            elif isinstance(v, str):
                out.text(name, v)
            elif isinstance(v, list):
                out.tags(name, [str(x) for x in v])
            else:
                out.json(name, v)
        return out

    @classmethod
    def parse_argument(cls, kind: str, argument: str) -> "Metadata":
        """``key=value``; for enums and qualities ``key=value:a,b,c``; for quantities ``key=value:unit``."""
        name, eq, value = argument.partition("=")
        if not eq or not name:
            raise InvalidInput(f"expected key=value, got {argument!r}")
        out = cls()
        if kind in ("enum", "qualitative", "quantitative"):
            value, _, rest = value.partition(":")
            return out.quantitative(name, float(value), rest) if kind == "quantitative" else getattr(out, kind)(name, value, rest.split(","))
        made = {"text": str, "integer": int, "float": float, "datetime": str, "tags": lambda v: v.split(","), "boolean": lambda v: v.lower() == "true", "json": json.loads}
        return getattr(out, kind)(name, made[kind](value))


def formatted(value: dict) -> str:
    kind, v = value["type"], value["value"]
    if kind == "Tags":
        return ", ".join(v)
    if kind in ("Enum", "Qualitative"):
        return v["value"]
    if kind == "Quantitative":
        return f"{v['value']:g} {v['unit']}"
    return json.dumps(v) if kind == "Json" else str(v).lower() if kind == "Boolean" else str(v)


def merged(old: Column, new: Column) -> Column:
    """Two JSON metadata columns merged, the new value winning; null counts as empty."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(as_map(old), lambda k, v: ~F.map_contains_key(as_map(new), k))
    return _to_json(F.map_concat(kept, as_map(new)))


def without(metadata: Column, *names: str) -> Column:
    """JSON metadata less some fields."""
    return _to_json(F.map_filter(F.from_json(metadata, "map<string,string>"), lambda k, v: ~k.isin(*names)))


def _to_json(fields: Column) -> Column:
    """Values are JSON text already; names are quoted and sorted."""
    parts = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(F.to_json(F.array(k)).substr(F.lit(2), F.length(F.to_json(F.array(k))) - 2), F.lit(":"), fields[k]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


# -- predicates -------------------------------------------------------------------------------------


class Predicate:
    """A predicate tree over JSON metadata, compiled to a Column; a missing field or other kind is false."""

    def __init__(self, op: str, field: str = "", value=None, parts: Sequence["Predicate"] = ()):
        self.op, self.field, self.value, self.parts = op, field, value, tuple(parts)

    def __and__(self, other):
        return Predicate("and", parts=(self, other))

    def __or__(self, other):
        return Predicate("or", parts=(self, other))

    def __invert__(self):
        return Predicate("not", parts=(self,))

    def column(self, metadata: Column) -> Column:
        if self.op == "and":
            out = F.lit(True)
            for p in self.parts:
                out = out & p.column(metadata)
            return out
        if self.op == "or":
            out = F.lit(False)
            for p in self.parts:
                out = out | p.column(metadata)
            return out
        if self.op == "not":
            return ~self.parts[0].column(metadata)
        path = "$['" + self.field.replace("'", "\\'") + "']"
        kind = F.get_json_object(metadata, f"{path}.type")
        text = F.get_json_object(metadata, f"{path}.value")
        value = self.value
        whole, real = text.try_cast("bigint"), text.try_cast("double")
        time = F.try_to_timestamp(text)
        tags = F.from_json(text, "array<string>")
        ops = {
            "exists": lambda: kind.isNotNull(),
            "text_eq": lambda: (kind == "Text") & (text == value),
            "text_contains": lambda: (kind == "Text") & text.contains(value),
            "integer_eq": lambda: (kind == "Integer") & (whole == value),
            "integer_gt": lambda: (kind == "Integer") & (whole > value),
            "integer_lt": lambda: (kind == "Integer") & (whole < value),
            "integer_range": lambda: (kind == "Integer") & whole.between(*value),
            "float_eq": lambda: (kind == "Float") & (real == value),
            "float_gt": lambda: (kind == "Float") & (real > value),
            "float_lt": lambda: (kind == "Float") & (real < value),
            "float_range": lambda: (kind == "Float") & real.between(*value),
            "boolean_eq": lambda: (kind == "Boolean") & (text == str(bool(value)).lower()),
            "datetime_after": lambda: (kind == "DateTime") & (time > F.lit(value).cast("timestamp")),
            "datetime_before": lambda: (kind == "DateTime") & (time < F.lit(value).cast("timestamp")),
            "tags_contain": lambda: (kind == "Tags") & F.array_contains(tags, value),
            "tags_all": lambda: (kind == "Tags") & F.forall(F.array(*map(F.lit, value)), lambda t: F.array_contains(tags, t)),
            "tags_any": lambda: (kind == "Tags") & F.arrays_overlap(tags, F.array(*map(F.lit, value))),
            "enum_eq": lambda: (kind == "Enum") & (F.get_json_object(metadata, f"{path}.value.value") == value),
        }
        if self.op not in ops:
            raise InvalidInput(f"no predicate {self.op!r}")
        return F.coalesce(ops[self.op](), F.lit(False))


def parse_predicate(text: str) -> Predicate:
    """``field:op=value`` with eq, contains, gt, lt, after, before, has; or ``field:exists``."""
    field, colon, rest = text.partition(":")
    op, eq, value = rest.partition("=")
    if not colon or not field or (op != "exists" and not eq):
        raise InvalidInput(f"expected field:op=value, got {text!r}")
    whole = re.fullmatch(r"-?\d+", value)
    real = re.fullmatch(r"-?\d+\.\d+", value)
    if op == "exists":
        return Predicate("exists", field)
    if op == "eq":
        if whole:
            return Predicate("integer_eq", field, int(value))
        if real:
            return Predicate("float_eq", field, float(value))
        if value in ("true", "false"):
            return Predicate("boolean_eq", field, value == "true")
        return Predicate("text_eq", field, value) | Predicate("enum_eq", field, value)
    if op in ("gt", "lt"):
        number = float(value)
        return (Predicate(f"integer_{op}", field, int(value)) if whole else Predicate("float_" + op, field, number)) | Predicate("float_" + op, field, number)
    made = {"contains": "text_contains", "after": "datetime_after", "before": "datetime_before", "has": "tags_contain"}
    if op not in made:
        raise InvalidInput(f"no operator {op!r}")
    return Predicate(made[op], field, value)


def find_by_metadata(documents: DataFrame, predicate: Predicate, limit: int | None, metadata: str = "user_metadata", order: str = "id", limit_first: bool = True) -> DataFrame:
    """Documents with metadata that match; as the limit comes first by default, a page may hold fewer than that."""
    rows = documents.where(F.col(metadata).isNotNull()).orderBy(order)
    if limit_first and limit:
        rows = rows.limit(limit)
    rows = rows.where(predicate.column(F.col(metadata)))
    return rows if limit_first or not limit else rows.limit(limit)


# -- time -------------------------------------------------------------------------------------------

#: Units of a relative time, as a step of the calendar.
_STEPS = {"hour": (0, dt.timedelta(hours=1)), "day": (0, dt.timedelta(days=1)), "week": (0, dt.timedelta(weeks=1)), "month": (1, dt.timedelta()), "year": (12, dt.timedelta())}
_AGO = re.compile(r"(-?\d+)\s+(hour|day|week|month|year)s?\b.*\bago\b", re.IGNORECASE)


def _months_before(time: dt.datetime, n: int) -> dt.datetime:
    """The same day n months earlier, or the last of a shorter month."""
    year, month = divmod(time.year * 12 + time.month - 1 - n, 12)
    return time.replace(year=year, month=month + 1, day=min(time.day, calendar.monthrange(year, month + 1)[1]))


def parse_time(text: str | None, now: dt.datetime) -> dt.datetime | None:
    """RFC 3339 times, plain dates, or "N hours/days/weeks/months/years ago"; None where nothing is understood."""
    said = (text or "").strip()
    try:
        time = dt.datetime.fromisoformat(said.replace("Z", "+00:00"))
    except ValueError:
        found = _AGO.search(said)
        if not found:
            return None
        n, (months, span) = int(found.group(1)), _STEPS[found.group(2).lower()]
        return _months_before(now, n * months) - n * span
    return time if time.tzinfo is None else time.astimezone(dt.timezone.utc).replace(tzinfo=None)


def relative_hours(hours: float, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    return now - dt.timedelta(hours=hours), now


def temporal(rows: DataFrame, after: dt.datetime | None = None, before: dt.datetime | None = None, column: str = "modified_at") -> DataFrame:
    """Rows within both bounds, ends included; rows without a time pass."""
    time = F.col(column)
    if after is not None:
        rows = rows.where(time.isNull() | (time >= F.lit(after)))
    if before is not None:
        rows = rows.where(time.isNull() | (time <= F.lit(before)))
    return rows


# -- results ----------------------------------------------------------------------------------------


def by_collection(rows: DataFrame, *names: str) -> DataFrame:
    return rows.where(F.col("collection").isin(*names))


def by_keyword(rows: DataFrame, keyword: str, column: str = "keywords") -> DataFrame:
    """Rows one of whose keywords holds ``keyword``, ignoring case."""
    return rows.where(F.exists(column, lambda k: F.contains(F.lower(k), F.lit(keyword.lower()))))


def guarded(rows: DataFrame, predicate: Column, least_rows: int = 5, most_dropped: float = 0.9) -> DataFrame:
    """Rows that match; all of them if that would drop more than ``most_dropped`` of at least ``least_rows``.

    The share is one row of aggregates beside the page, so nothing is sorted or sent to one task.
    """
    marked = rows.withColumn("__kept", F.coalesce(predicate, F.lit(False)))
    stats = marked.agg(F.count("*").alias("__n"), F.avg(F.col("__kept").cast("double")).alias("__share"))
    guard = (F.col("__n") >= least_rows) & (1 - F.col("__share") > most_dropped)
    return marked.crossJoin(F.broadcast(stats)).where(F.col("__kept") | guard).drop("__kept", "__n", "__share")


def metadata_step(category: str | None = None, difficulty: str | None = None, exclude_category: str | None = None, exclude_difficulty: str | None = None, tags: Sequence[str] = ()) -> Column:
    """Predicate of the metadata filter step; comparisons ignore case, any tag suffices."""
    out = F.lit(True)
    for column, value in (("category", category), ("difficulty", difficulty)):
        if value is not None:
            out = out & F.coalesce(F.lower(column) == value.lower(), F.lit(False))
    for column, value in (("category", exclude_category), ("difficulty", exclude_difficulty)):
        if value is not None:
            out = out & F.coalesce(F.lower(column) != value.lower(), F.lit(True))
    if tags:
        wanted = [t.lower() for t in tags]
        out = out & F.coalesce(F.exists("keywords", lambda k: F.lower(k).isin(*wanted)), F.lit(False))
    return out
