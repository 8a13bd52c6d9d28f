"""Segments: labels of rows from rules, functions, SQL, funnels, time and metrics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.metrics import path_metrics
from ..schema import StreamSchema, without_bounds
from .rows import rename_values, run_sql, temp_name
from .scan import running

OPS = {"=": "eqNullSafe", "==": "eqNullSafe", "!=": "__ne__", ">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}


def by_rules(rules: list) -> Column:
    """Ordered [column, op, value, level]; the last entry may be the level of all other rows."""
    *tests, last = list(rules)
    otherwise = None
    if isinstance(last, (list, tuple)) and len(last) == 4:
        tests = list(rules)
    else:
        otherwise = last[0] if isinstance(last, (list, tuple)) else last
    value = None
    for column, op, operand, level in tests:
        if op in ("in", "not in"):
            options = operand if isinstance(operand, str) else "(" + ", ".join(repr(v) for v in operand) + ")"
            test = F.expr(f"`{column}` {op} {options}")
        elif op in OPS:
            test = getattr(F.col(column), OPS[op])(F.lit(operand))
        else:
            raise ParameterError(f"unknown op {op!r}")
        value = F.when(test, F.lit(level)) if value is None else value.when(test, F.lit(level))
    return value.otherwise(F.lit(otherwise)) if otherwise is not None else value


def by_sql(df: DataFrame, name: str, sql: str) -> DataFrame:
    """A SELECT of one column over ``eventstream``, one value for each of its rows, or an SQL expression.

    The stream's columns are selected beside the query's own one, so rows keep their values without a join.
    """
    if not sql.lstrip().lower().startswith(("select", "with")):
        return df.withColumn(name, F.expr(sql))
    if (at := _outer_select(sql)) is None:
        raise ParameterError("the query has no SELECT")
    out = run_sql(df, f"{sql[:at]} eventstream.*, {sql[at:]}", same_columns=False)
    if len(out.columns) != len(df.columns) + 1:
        raise ParameterError("the query must return a single column")
    return out.toDF(*df.columns, name)


def _outer_select(sql: str) -> int | None:
    """Where the first SELECT outside of brackets, quotes and comments ends."""
    depth = 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[()]|\bselect\b", sql, re.I | re.S):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif m[0].lower() == "select" and depth == 0:
            return m.end()
    return None


def funnel_depth(df: DataFrame, schema: StreamSchema, keys: list[str], steps: list[str], extra: list[str] | None = None) -> DataFrame:
    """keys and depth: how many steps each path reaches in order, each at a later index than the one before."""
    by, e, i = [*keys, *(extra or [])], F.col(schema.event_col), F.col("__idx")
    rows = without_bounds(df).select(*dict.fromkeys([*by, schema.event_col, "__idx", "__rank"]))
    # running minima, each of the one before: no list of a path's events
    for k, s in enumerate(steps):
        found = (e == s) if k == 0 else (e == s) & (i > F.col(f"__at{k - 1}"))
        rows = running(rows, schema, by, **{f"__at{k}": ("min", F.when(found, i))})
    reached = [F.max(F.col(f"__at{k}")).isNotNull().cast("int") for k in range(len(steps))]
    return rows.groupBy(*by).agg(reduce(lambda a, b: a + b, reached).alias("depth"))


def by_funnel(df: DataFrame, schema: StreamSchema, keys: list[str], name: str, steps: list[str]) -> DataFrame:
    if len(steps) < 2:
        raise ParameterError("a funnel has two events or more")
    depth = funnel_depth(df, schema, keys, list(steps))
    level = F.when(F.coalesce(F.col("depth"), F.lit(0)) == 0, F.lit("out_of_funnel")).otherwise(F.get(F.array(*(F.lit(s) for s in steps)), F.col("depth") - 1))
    return df.join(depth, keys, "left").withColumn(name, level).drop("depth").select(*df.columns, name)


def by_time(schema: StreamSchema, start, end) -> Column:
    ts = F.col(schema.timestamp_col)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        inside = inside & (ts <= F.lit(end).cast("timestamp_ntz"))
    return F.when(inside, "inside").otherwise("outside")


def by_metric(df: DataFrame, schema: StreamSchema, keys: list[str], name: str, bins: dict, levels, strict: bool = True) -> DataFrame:
    """Left-closed bins of a path metric, at edges given or at its quantiles over the paths."""
    metric, edges, quantiles, labels = bins.get("metric"), bins.get("edges"), bins.get("quantiles"), bins.get("segment_levels")
    if (edges is None) == (quantiles is None):
        raise ParameterError("give one of edges and quantiles")
    values, names = path_metrics(df, schema, keys, [metric], levels, strict)
    v = temp_name("v")
    values = values.select(*keys, F.col(f"`{names[0][0]}`").cast("double").alias(v))
    if quantiles is not None:
        shares = [i / quantiles for i in range(1, quantiles)] if isinstance(quantiles, int) else list(quantiles)
        n_levels = len(shares) + 1
        from ..plans.quantiles import quantiles

        cuts = quantiles(values, [], F.col(v), [float(s) for s in shares]).agg(F.max("q").alias("__cuts"))  # one row
        values = values.join(F.broadcast(cuts))
        bounds = [F.get("__cuts", F.lit(k)) for k in range(len(shares))]
    else:
        if sorted(set(edges)) != list(edges):
            raise ParameterError("edges ascend")
        n_levels, bounds = len(edges) + 1, [F.lit(float(e)) for e in edges]
    labels = list(labels) if labels is not None else [f"bin_{k + 1}" for k in range(n_levels)]
    if len(labels) != n_levels:
        raise ParameterError(f"{n_levels} levels need as many names, got {len(labels)}")
    level = F.when(F.col(v).isNull(), F.lit("undefined"))
    for bound, label in zip(bounds, labels, strict=False):
        level = level.when(F.col(v) < bound, F.lit(label))
    values = values.select(*keys, level.otherwise(F.lit(labels[-1])).alias(name))
    return df.join(values, keys, "left").withColumn(name, F.coalesce(name, F.lit("undefined"))).select(*df.columns, name)


def rename_levels(df: DataFrame, name: str, mapping: dict) -> DataFrame:
    """Level by level; missing stays missing."""
    return rename_values(df, name, mapping)
