"""Stretches of paths: sessions by events, separators, bounds and pauses; runs; and their merging."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.conditions import compile_condition, leaves
from ..functions.durations import seconds
from ..functions.metrics import MetricBuilder
from ..schema import IDX, KIND, RANK, RANKS, StreamSchema, micros
from .rows import check_names, values_in
from .scan import running

GROUP = "__group"
NAMED_GROUPS = ("event_groups", "bounds")


def _pause(schema: StreamSchema, timeout: str) -> Column:
    """Whether a row comes too long after the one before, whose time is ``__before``."""
    gap = micros(schema.timestamp_col) - F.col("__before")
    return F.coalesce(gap > int(round(seconds(timeout, "timeout") * 1e6)), F.lit(False))


def _numbered(df: DataFrame, schema: StreamSchema, keys: list[str], inside: Column, start: Column | None, timeout: str | None) -> DataFrame:
    """Adds the number of the stretch each row is in (NULL outside): a new one where ``inside`` begins, at ``start`` or after a pause."""
    df = df.withColumn("__in", F.coalesce(inside, F.lit(False)))
    times = {} if timeout is None else {"__before": ("lag", micros(schema.timestamp_col))}
    df = running(df, schema, keys, __was=("lag", F.col("__in")), **times)
    begins = ~F.coalesce("__was", F.lit(False))
    if start is not None:
        begins = begins | start
    if timeout is not None:
        begins = begins | _pause(schema, timeout)
    df = running(df, schema, keys, __number=("sum", (F.col("__in") & begins).cast("int")))
    return df.withColumn(GROUP, F.when(F.col("__in"), F.col("__number"))).drop("__in", "__was", "__before", "__number")


def by_events(df: DataFrame, schema: StreamSchema, keys: list[str], events, timeout: str | None = None) -> DataFrame:
    return _numbered(df, schema, keys, values_in(schema.event_col, events), None, timeout)


def by_separator(df: DataFrame, schema: StreamSchema, keys: list[str], separator, timeout: str | None = None) -> DataFrame:
    cut = F.coalesce(values_in(schema.event_col, separator), F.lit(False))
    df = running(df, schema, keys, __seen=("max", cut.cast("int")))
    return _numbered(df, schema, keys, ~cut & (F.col("__seen") == 1), None, timeout).drop("__seen")


def by_bounds(df: DataFrame, schema: StreamSchema, keys: list[str], start_event, end_event, timeout: str | None = None) -> DataFrame:
    """From a start event to the next end event, both included; without one to the end of the path."""
    df = running(df, schema, keys, __n=("number", None))
    at = lambda events: ("max", F.when(values_in(schema.event_col, events), F.col("__n")))
    df = running(df, schema, keys, __begun=at(start_event), __till=at(end_event))
    df = running(df, schema, keys, __ended=("lag", F.col("__till"))).drop("__till")
    inside = F.col("__begun").isNotNull() & (F.col("__ended").isNull() | (F.col("__begun") > F.col("__ended")))
    # right behind an end event a new stretch begins, even if no row lies between
    behind = F.coalesce(F.col("__ended") == F.col("__n") - 1, F.lit(False))
    return _numbered(df, schema, keys, inside, behind, timeout).drop("__n", "__begun", "__ended")


def by_timeout(df: DataFrame, schema: StreamSchema, keys: list[str], timeout: str) -> DataFrame:
    return _numbered(df, schema, keys, F.lit(True), None, timeout)


def split_sessions(df: DataFrame, schema: StreamSchema, separator=None, bounds: dict | None = None, timeout: str | None = None, session_col: str = "session_id", session_index_col: str = "session_index", path_col: str | None = None) -> tuple[DataFrame, StreamSchema]:
    keys = schema.keys(path_col)
    if separator is not None and bounds is not None or separator is None and bounds is None and timeout is None:
        raise ParameterError("give a separator, bounds or a timeout; a timeout goes with either")
    for c in (session_col, session_index_col):
        if c in df.columns:
            raise ParameterError(f"there is a column {c!r} already")
    if separator is not None:
        out = by_separator(df, schema, keys, separator, timeout).filter(~F.coalesce(values_in(schema.event_col, separator), F.lit(False)))
    elif bounds is not None:
        edges = [bounds["start_event"], bounds["end_event"]]
        names = [n for e in edges for n in ([e] if isinstance(e, str) else e)]
        out = by_bounds(df, schema, keys, *edges, timeout).filter(~F.coalesce(values_in(schema.event_col, names), F.lit(False)))
    else:
        out = by_timeout(df, schema, keys, timeout)
    name = F.when(F.col(GROUP).isNotNull(), F.concat_ws("_", F.col(keys[-1]).cast("string"), F.col(GROUP).cast("string")))
    out = out.withColumn(session_col, name).withColumn(session_index_col, F.col(GROUP).cast("long")).drop(GROUP)
    custom = None if schema.custom_cols is None else (*schema.custom_cols, session_index_col)
    return out, replace(schema, path_cols=(*schema.path_cols, session_col), custom_cols=custom)


AGGREGATES = ("first", "last", "min", "max", "mean", "mode", "any")


def aggregate(column: str, how: str, order: Column, kind: str | None = None) -> Column:
    """One value of a group's rows; first, last and any look at values that aren't missing."""
    c = F.col(column)
    if how == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if how in ("min", "max", "mean", "mode"):
        value = {"min": F.min, "max": F.max, "mean": F.avg, "mode": F.mode}[how](c)
        return value
    return F.min_by(c, F.when(c.isNotNull(), order))


def collapse_events(df: DataFrame, schema: StreamSchema, keys: list[str], levels, loops=None, group_col: str | None = None, event_groups=None, bounds: dict | None = None, name=None, agg: dict | None = None, timeout: str | None = None, strict: bool = True) -> DataFrame:
    """Merge runs of rows into one row each, in one aggregate with the rows that stay."""
    modes = {"loops": loops, "group_col": group_col, "event_groups": event_groups, "bounds": bounds}
    given = [k for k, v in modes.items() if v not in (None, False)]
    if len(given) != 1:
        raise ParameterError(f"give one of {list(modes)}, got {given}")
    mode, columns = given[0], df.columns
    if mode == "group_col" and group_col not in columns:
        raise ParameterError(f"no column {group_col!r}")
    if mode == "group_col" and group_col == schema.event_col:
        raise ParameterError(f"group_col is not the event column {group_col!r}; loops=True merges runs of one event")
    cases, fallback, name_col = _names(mode, name)
    agg = dict(agg or {})
    if bad := sorted(set(agg.values()) - set(AGGREGATES)):
        raise ParameterError(f"agg takes {list(AGGREGATES)}, got {bad}")
    if mode in ("loops", "group_col"):
        by = schema.event_col if mode == "loops" else group_col
        times = {} if timeout is None else {"__before": ("lag", micros(schema.timestamp_col))}
        rows = running(df, schema, keys, __last=("lag", F.col(by)), __n=("number", None), **times)
        apart = ~F.col(by).eqNullSafe(F.col("__last")) | (F.col("__n") == 1)
        if timeout is not None:
            apart = apart | _pause(schema, timeout)
        rows = running(rows, schema, keys, **{GROUP: ("sum", apart.cast("int"))}).drop("__last", "__before")
        if mode == "loops" and loops is not True:
            rows = rows.withColumn(GROUP, F.when(values_in(schema.event_col, loops), F.col(GROUP)))
    elif mode == "event_groups":
        rows = by_events(df, schema, keys, event_groups, timeout)
    else:
        rows = by_bounds(df, schema, keys, bounds["start_event"], bounds["end_event"], timeout)
    if "__n" not in rows.columns:
        rows = running(rows, schema, keys, __n=("number", None))
    # a row that stays is a group of its own
    rows = rows.withColumn("__g", F.coalesce(F.col(GROUP).cast("long"), -F.col("__n").cast("long")))
    order = F.col("__n")
    builder = MetricBuilder(schema, keys, levels, strict)
    tests, named = [], {}
    for k, case in enumerate(cases):
        for leaf in leaves(case["condition"]):
            built = builder.build({"metric": leaf["metric"], "metric_args": leaf.get("metric_args") or {}})
            column, value = built.columns[0]
            named[column] = value if built.default is None else F.coalesce(value, F.lit(built.default))
        tests.append((k, case))
    if builder.patterns:
        raise ParameterError("matches_pattern is a metric of paths, not of merged groups")
    out = {}
    for c in columns:
        if c in keys:
            continue
        how = agg.get(c, "first")
        if c in (schema.timestamp_col, IDX, KIND, schema.event_col) and c not in agg or c in (IDX, KIND):
            how = "first"
        out[c] = aggregate(c, how, order)
    merged = rows.groupBy(*keys, "__g").agg(*(v.alias(c) for c, v in out.items()), F.count(F.lit(1)).alias("__count"), *(v.alias(f"__m_{k}") for k, v in enumerate(named.values())), *([F.min_by(name_col, F.when(F.col(name_col).isNotNull(), order)).alias("__name")] if name_col else []))
    touched = F.col("__g") > 0
    if mode == "loops":
        touched = touched & (F.col("__count") > 1)
    if mode == "group_col":
        new = F.col(group_col).cast("string") if name is None else None
    elif mode == "loops":
        new = F.col(schema.event_col)
    else:
        new = None
    if name_col:
        new = F.col("__name").cast("string")
    elif cases:
        where = dict(zip(named, (f"__m_{k}" for k in range(len(named))), strict=True))

        def column_of(leaf: dict) -> str:
            return where[builder.build({"metric": leaf["metric"], "metric_args": leaf.get("metric_args") or {}}).columns[0][0]]

        value = None
        for _, case in tests:
            test = compile_condition(case["condition"], column_of)
            value = F.when(test, F.lit(case["name"])) if value is None else value.when(test, F.lit(case["name"]))
        new = value.otherwise(F.lit(fallback) if fallback is not None else F.col(schema.event_col))
    elif fallback is not None:
        new = F.lit(fallback)
    merged = merged.withColumn(schema.event_col, F.when(touched, new).otherwise(F.col(schema.event_col)))
    merged = merged.withColumn(KIND, F.when(touched, F.lit("collapsed")).otherwise(F.col(KIND))).withColumn(RANK, F.when(touched, F.lit(RANKS["collapsed"])).otherwise(F.col(RANK)))
    return merged.select(*columns)


def _names(mode: str, name) -> tuple[list[dict], str | None, str | None]:
    """Cases, literal or fallback, column: the forms a name takes."""
    if name is None:
        if mode in NAMED_GROUPS:
            raise ParameterError(f"{mode} needs a name: a string, {{'col': ...}} or a list of cases")
        return [], None, None
    if isinstance(name, str):
        check_names([name])
        return [], name, None
    if isinstance(name, dict):
        if set(name) != {"col"}:
            raise ParameterError(f"a dict name has the key 'col' alone, got {sorted(name)}")
        return [], None, name["col"]
    entries = list(name)
    fallback = entries.pop() if entries and isinstance(entries[-1], str) else None
    if not entries or any(not isinstance(c, dict) or not c.get("name") or "condition" not in c for c in entries):
        raise ParameterError("a list name holds dicts with condition and name, and perhaps a string at its end")
    check_names([c["name"] for c in entries] + ([fallback] if fallback else []))
    return entries, fallback, None
