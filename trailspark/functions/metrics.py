"""Path metrics: each a Column over the rows of a path, all of one request in one aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError, UnknownNameError
from ..schema import MISSING, PATH_END, PATH_START, StreamSchema, micros, without_bounds
from .patterns import Resolver, parse_pattern

#: Values of a column above which clustering by density takes the metrics of each as entries, not as columns.
MANY_VALUES = 64
BULK = ("event_count_bulk", "has_event_bulk", "in_segment_bulk")
EVENT_METRICS = ("event_count", "has_event", "event_count_bulk", "has_event_bulk", "has_all_events", "has_any_event", "time_between", "matches_pattern")
ARGS = {
    "length": (), "duration": (), "first_event_time": (), "active_days": ("active_events",),
    "event_count": ("event", "event_col"), "has_event": ("event", "event_col"),
    "event_count_bulk": ("events", "event_col"), "has_event_bulk": ("events", "event_col"),
    "has_all_events": ("events", "event_col"), "has_any_event": ("events", "event_col"),
    "time_between": ("start_event", "end_event", "event_col"), "matches_pattern": ("pattern", "event_col"),
    "in_segment": ("segment_name", "segment_level", "mode", "threshold"), "in_segment_bulk": ("segment_name", "segment_level", "mode", "threshold"),
}


@dataclass
class Built:
    """Columns of one metric: names and aggregates, and what a path without a value gets (None: NULL)."""

    columns: list[tuple[str, Column]]
    default: float | bool | None = 0


def normal(metric: str | dict) -> dict:
    m = {"metric": metric} if isinstance(metric, str) else dict(metric)
    args = m.setdefault("metric_args", {}) or {}
    m["metric_args"] = args
    name = m.get("metric")
    if name not in ARGS:
        raise ParameterError(f"unknown metric {name!r}; known: {sorted(ARGS)}")
    if unknown := sorted(set(args) - set(ARGS[name])):
        raise ParameterError(f"{name} takes {list(ARGS[name])}, got {unknown}")
    return m


def _as_list(value, name: str) -> list:
    out = [value] if isinstance(value, str) else list(value or ())
    if not out:
        raise ParameterError(f"{name} must not be empty")
    return out


class MetricBuilder:
    """Compiles metrics for a stream; ``levels(column)`` gives the distinct values of a column when one is needed."""

    def __init__(self, schema: StreamSchema, keys: list[str], levels, strict: bool = True):
        self.schema, self.keys, self.levels, self.strict = schema, keys, levels, strict
        self.patterns: dict[str, tuple[str, str | None]] = {}

    def _events(self, names: Iterable[str], event_col: str | None) -> None:
        if self.strict and (missing := sorted(set(names) - set(self.levels(event_col or self.schema.event_col, names)) - {PATH_START, PATH_END})):
            raise UnknownNameError(f"no event is named {missing}")

    def build(self, metric: str | dict) -> Built:
        m = normal(metric)
        name, a = m["metric"], m["metric_args"]
        ts, column = self.schema.timestamp_col, a.get("event_col")
        event = F.col(column or self.schema.event_col)
        prefix = f"{column}_" if column else ""
        if name == "length":
            return Built([("length", F.count(F.lit(1)))])
        if name == "duration":
            return Built([("duration", (F.max(micros(ts)) - F.min(micros(ts))) / F.lit(1e6))])
        if name == "first_event_time":
            return Built([("first_event_time", F.min(micros(ts)) / F.lit(1e6))])
        if name == "active_days":
            names = _as_list(a.get("active_events"), "active_events")
            self._events(names, None)
            return Built([("active_days", F.count_distinct(F.when(event.isin(*names), F.to_date(ts))))])
        if name in ("event_count", "has_event"):
            if not isinstance(a.get("event"), str):
                raise ParameterError(f"{name} needs an event")
            self._events([a["event"]], column)
            return Built([self._one(name, a["event"], prefix, event)])
        if name in ("event_count_bulk", "has_event_bulk"):
            if a.get("events") is None and column:
                raise ParameterError(f"{name} with event_col needs its events named")
            names = sorted(self.levels(self.schema.event_col)) if a.get("events") is None else _as_list(a["events"], "events")
            self._events(names, column)
            return Built([self._one(name.removesuffix("_bulk"), e, prefix, event) for e in names])
        if name in ("has_all_events", "has_any_event"):
            names = _as_list(a.get("events"), "events")
            self._events(names, column)
            if name == "has_any_event":
                return Built([(f"has_any_event_{prefix}{'_or_'.join(names)}", F.max(event.isin(*names).cast("int")))])
            every = F.lit(1)
            for e in names:
                every = every * F.max((event == e).cast("int"))
            return Built([(f"has_all_events_{prefix}{'_and_'.join(names)}", every)])
        if name == "time_between":
            start, end = a.get("start_event"), a.get("end_event")
            self._events([e for e in (start, end) if isinstance(e, str)], column)

            def at(e: str | None) -> Column:
                if not isinstance(e, str):
                    raise ParameterError("time_between needs start_event and end_event")
                if e in (PATH_START, PATH_END):
                    return (F.min if e == PATH_START else F.max)(micros(ts))
                return F.min(F.when(event == e, micros(ts)))

            return Built([(f"time_from_{prefix}{start}_to_{end}", (at(end) - at(start)) / F.lit(1e6))], None)
        if name == "matches_pattern":
            if not isinstance(a.get("pattern"), str):
                raise ParameterError("matches_pattern needs a pattern")
            pattern = parse_pattern(a["pattern"])
            if self.strict:
                pattern.check_names(set(self.levels(column or self.schema.event_col, pattern.candidates())))
            tag = f"p{len(self.patterns)}"
            self.patterns[tag] = (a["pattern"], column)
            return Built([(f"matches_pattern_{prefix}{a['pattern']}", F.coalesce(F.max(f"__hit_{tag}"), F.lit(False)))], False)
        return self._segment(a, name)

    def _one(self, name: str, e: str, prefix: str, event: Column) -> tuple[str, Column]:
        if name == "event_count":
            return f"event_count_{prefix}{e}", F.count(F.when(event == e, F.lit(1)))
        return f"has_event_{prefix}{e}", F.max(F.coalesce(event == e, F.lit(False)).cast("int"))

    def segments(self, a: dict, name: str) -> tuple[list[str], str, float | None]:
        """Segments, mode and threshold that a metric of segments asks for."""
        mode, threshold = a.get("mode", "any"), a.get("threshold")
        if mode not in ("any", "all", "event_share"):
            raise ParameterError(f"mode is any, all or event_share, got {mode!r}")
        if threshold is not None and (mode != "event_share" or not 0 <= threshold <= 1):
            raise ParameterError("a threshold is for event_share and lies in [0, 1]")
        given = a.get("segment_name")
        if given is None and name == "in_segment":
            raise ParameterError("in_segment needs a segment_name")
        names = list(self.schema.segment_cols) if given is None else [given]
        for s in names:
            if s not in self.schema.segment_cols:
                raise UnknownNameError(f"no segment is named {s!r}")
        return names, mode, threshold

    def _segment(self, a: dict, name: str) -> Built:
        names, mode, threshold = self.segments(a, name)
        out = []
        for s in names:
            level = a.get("segment_level")
            known = self.levels(s) if level is None or self.strict else None
            levels = known if level is None else _as_list(level, "segment_level") if isinstance(level, (list, tuple, str)) else [level]
            for v in levels:
                if known is not None and v not in known and v != MISSING:
                    raise UnknownNameError(f"{s} has no level {v!r}")
                inside = F.col(s).isNull() if v == MISSING else F.coalesce(F.col(s) == v, F.lit(False))
                if mode == "any":
                    value = F.max(inside.cast("int"))
                elif mode == "all":
                    # one distinct value, not counting NULL, and it is this one
                    only = F.count(F.lit(1)) == F.count(F.when(inside, 1)) if v == MISSING else (F.min(s) == F.max(s)) & (F.min(s) == v)
                    value = F.coalesce(only, F.lit(False)).cast("int")
                else:
                    share = F.avg(inside.cast("double"))
                    value = share if threshold is None else (share >= threshold).cast("int")
                out.append((f"in_segment_{s}_{v}_{mode}", value))
        return Built(out)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Rows with a mark for each pattern: whether its last part can end the pattern here."""
        named = any(parse_pattern(p).named_bounds for p, _ in self.patterns.values())
        if not self.patterns:
            return without_bounds(df)
        first = next(iter(self.patterns.values()))
        rows = Resolver(self.schema, self.keys, first[0], first[1]).prepare(df, bounds=named)
        for tag, (p, column) in self.patterns.items():
            r = Resolver(self.schema, self.keys, p, column, tag)
            before = rows.columns
            rows = r.forward(rows).withColumn(f"__hit_{tag}", F.col(f"__{tag}f{len(r.pattern.parts) - 1}"))
            rows = rows.select(*before, f"__hit_{tag}")
        if not named:
            return rows
        # boundary rows are for the marks only: elsewhere their values count as missing
        marks = {f"__hit_{t}" for t in self.patterns}
        return rows, marks  # type: ignore[return-value]


def path_metrics(df: DataFrame, schema: StreamSchema, keys: list[str], metrics: list, levels, strict: bool = True, extra: list[str] | None = None) -> tuple[DataFrame, list[list[str]]]:
    """One row per path (and ``extra`` columns, if any) with all metrics, and the column names of each metric."""
    builder = MetricBuilder(schema, keys, levels, strict)
    built = [builder.build(m) for m in metrics]
    rows = builder.prepare(df)
    if isinstance(rows, tuple):
        rows, marks = rows
        by_path = Resolver(schema, keys, next(iter(builder.patterns.values()))[0])
        for mark in marks:  # a match that needs a boundary row counts for the path's real rows too
            rows = rows.withColumn(mark, F.max(mark).over(by_path.w.rowsBetween(-(2**31), 2**31 - 1)))
        rows = without_bounds(rows)
    aggregates, names = [], []
    for b in built:
        names.append([n for n, _ in b.columns])
        for n, c in b.columns:
            if all(n != x for x, _ in aggregates):
                aggregates.append((n, c if b.default is None else F.coalesce(c, F.lit(b.default))))
    by = [*keys, *(extra or [])]
    return rows.groupBy(*by).agg(*(c.alias(n) for n, c in aggregates)), names


@dataclass(frozen=True)
class Open:
    """A metric for each value of a column, none of them named; its columns' names are ``prefix``, value and ``suffix``."""

    column: str
    kind: str  # event_count, has_event, any, all or event_share
    threshold: float | None = None

    @property
    def affixes(self) -> tuple[str, str]:
        return (f"in_segment_{self.column}_", f"_{self.kind}") if self.kind in ("any", "all", "event_share") else (f"{self.kind}_", "")


def open_metrics(metrics: list, schema: StreamSchema, keys: list[str], levels, strict: bool = True) -> tuple[list[Open], list]:
    """The metrics that have a column for each value of a column of the data, and the other ones.

    None of the former where a name of a column could come from two metrics, as the first of them counts.
    """
    builder = MetricBuilder(schema, keys, levels, strict)
    found: list[Open] = []
    rest: list = []
    for metric in metrics:
        m = normal(metric)
        name, a = m["metric"], m["metric_args"]
        if name in ("event_count_bulk", "has_event_bulk") and a.get("events") is None and not a.get("event_col"):
            found.append(Open(schema.event_col, name.removesuffix("_bulk")))
        elif name == "in_segment_bulk" and a.get("segment_level") is None:
            names, mode, threshold = builder.segments(a, name)
            found += [Open(s, mode, threshold) for s in names]
        else:
            rest.append(metric)
    found = list(dict.fromkeys(found))
    named = [n for m in rest for n, _ in MetricBuilder(schema, keys, levels, strict).build(m).columns] if found else []
    fixed = [o.affixes for o in found] + [(n, None) for n in named]
    clash = any(x.startswith(p) and (y is None and x.endswith(q) or y == q) for k, (p, q) in enumerate(fixed) if q is not None for j, (x, y) in enumerate(fixed) if j != k)
    return ([], metrics) if clash or any(o.threshold == 0 for o in found) else (found, rest)


def path_entries(df: DataFrame, schema: StreamSchema, keys: list[str], found: list[Open], rest: list, levels, strict: bool = True) -> DataFrame:
    """keys, feature, v: a row for each metric of a path that isn't 0 (of ``rest``, also where it is), and one without a feature for each path.

    So a path has rows for the values it has, not columns for all values there are.
    """
    real = without_bounds(df)
    out = real.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("v"))
    for k, o in enumerate(found):
        path = Window.partitionBy(*keys)
        counts = real.groupBy(*keys, F.col(o.column).cast("string").alias("__level")).agg(F.count(F.lit(1)).alias("__n"))
        value = F.lit(1.0)
        if o.kind == "event_count":
            value = F.col("__n").cast("double")
        elif o.kind == "all":
            counts = counts.withColumn("__of", F.count("__level").over(path)).filter("__of = 1")
        elif o.kind == "event_share":
            counts = counts.withColumn("__of", F.sum("__n").over(path))
            share = F.col("__n").cast("double") / F.col("__of")
            value = share if o.threshold is None else (share >= o.threshold).cast("double")
        own = counts.filter("__level is not null").select(*keys, F.concat(F.lit(f"{k}:"), "__level").alias("feature"), value.alias("v"))
        out = out.unionByName(own.filter("v <> 0"))
    if rest:
        values, names = path_metrics(df, schema, keys, rest, levels, strict)
        every = list(dict.fromkeys(n for group in names for n in group))
        pairs = F.array(*(F.struct(F.lit(f":{n}").alias("feature"), F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)).alias("v")) for n in every))
        out = out.unionByName(values.select(*keys, F.inline(pairs)))
    return out
