"""Rows added to paths: boundaries, synthetic events, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.patterns import add_position, anchors_of, needs_bounds, with_virtual_bounds, Resolver
from ..schema import IDX, KIND, RANK, RANKS, StreamSchema, micros, without_bounds
from .rows import check_names, run_sql, values_in


def add_start_end_events(df: DataFrame, schema: StreamSchema, keys: list[str]) -> DataFrame:
    """Boundary rows around each path at the grain; those already there, found by kind, are replaced."""
    return with_virtual_bounds(df, schema, keys, schema.event_col)


def _clone(columns: list[str], schema: StreamSchema, name: str, kind: str) -> Column:
    new = {schema.event_col: F.lit(name), KIND: F.lit(kind), RANK: F.lit(RANKS[kind])}
    return F.struct(*((new[c] if c in new else F.col(c)).alias(c) for c in columns))


def _beside(df: DataFrame, schema: StreamSchema, where: Column, name: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    # path columns stay outside of what is unfolded, so a partitioning by them stays known
    inside = [c for c in columns if c not in schema.path_cols]
    own = F.struct(*(F.col(c) for c in inside))
    new = _clone(inside, schema, name, kind)
    return df.select(*schema.path_cols, F.inline(F.when(where, F.array(new, own)).otherwise(F.array(own)))).select(*columns)


def add_source_events(df: DataFrame, schema: StreamSchema, name: str, source_event) -> DataFrame:
    names = [source_event] if isinstance(source_event, str) else list(source_event)
    check_names([name])
    if not names:
        return df
    return _beside(df, schema, F.coalesce(values_in(schema.event_col, names), F.lit(False)), name, "synthetic")


def add_sql_events(df: DataFrame, schema: StreamSchema, name: str, sql: str) -> DataFrame:
    check_names([name])
    rows = run_sql(df, sql)
    new = rows.withColumns({schema.event_col: F.lit(name), KIND: F.lit("synthetic"), RANK: F.lit(RANKS["synthetic"])})
    return df.unionByName(new.select(*df.columns))


def add_anchor_events(df: DataFrame, schema: StreamSchema, keys: list[str], name: str, anchor) -> DataFrame:
    """A row before the row at each resolved position, once for each position."""
    check_names([name])
    specs = anchors_of(anchor)
    columns = df.columns
    rows = Resolver(schema, keys, specs[0].pattern).prepare(df, bounds=needs_bounds(*specs))
    found = []
    for k, spec in enumerate(specs):
        rows = add_position(rows, schema, keys, spec, f"__a{k}")
        found.append(F.col(f"__a{k}_idx"))
    at = rows.select(*keys, F.explode(F.array_distinct(F.array_compact(F.array(*found)))).alias(IDX)).distinct().withColumn("__new", F.lit(True))
    joined = df.join(at, [*keys, IDX], "left")
    # of rows that share an index the last gives its values
    w = schema.backwards([*keys, IDX])
    joined = joined.withColumn("__new", F.coalesce(F.col("__new"), F.lit(False)) & (F.row_number().over(w) == 1))
    return _beside(joined, schema, F.col("__new"), name, "synthetic", columns)


def add_churn_events(df: DataFrame, schema: StreamSchema, name: str, inactivity_days: float, active_events=None) -> DataFrame:
    """A row behind each active row after which more than the days pass without one, up to the end of all data."""
    check_names([name])
    if inactivity_days <= 0:
        raise ParameterError("inactivity_days is positive")
    keys, ts = schema.keys(), micros(schema.timestamp_col)
    active = F.lit(True) if active_events is None else F.coalesce(values_in(schema.event_col, active_events), F.lit(False))
    end = df.agg(F.max(ts).alias("__end"))  # one row
    back = schema.backwards(keys).rowsBetween(-(2**31), -1)
    rows = df.withColumn("__on", active).withColumn("__next", F.last(F.when(F.col("__on"), ts), ignorenulls=True).over(back))
    rows = rows.join(F.broadcast(end))
    gone = F.col("__on") & ((F.coalesce("__next", "__end") - ts) > int(round(inactivity_days * 86_400_000_000)))
    return _beside(rows, schema, gone, name, "churn", df.columns)


__all__ = ["add_anchor_events", "add_churn_events", "add_source_events", "add_sql_events", "add_start_end_events", "without_bounds"]
