"""Operators on whole paths: windows between anchors, daily states, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.conditions import compile_condition, leaves
from ..functions.metrics import path_metrics
from ..functions.patterns import Resolver, add_position, anchors_of, needs_bounds
from ..schema import IDX, KIND, RANK, StreamSchema, is_bound
from .rows import values_in
from .sessions import aggregate

STATES = ("new", "current", "reactivated", "resurrected", "at_risk_wau", "at_risk_mau", "dormant")


def truncate_paths(df: DataFrame, schema: StreamSchema, keys: list[str], start_anchor=None, end_anchor=None) -> DataFrame:
    """Rows from the latest of the start positions to the earliest of the end positions, which aren't looked for before it.

    Positions are window aggregates of the same partitioning: one shuffle and no join.
    """
    if start_anchor is None and end_anchor is None:
        raise ParameterError("give start_anchor, end_anchor or both")
    starts, ends = anchors_of(start_anchor) if start_anchor is not None else [], anchors_of(end_anchor) if end_anchor is not None else []
    if any(s.occurrence == "all" for s in (*starts, *ends)):
        raise ParameterError("a bound is one position: occurrence is first or last")
    columns = df.columns
    rows = Resolver(schema, keys, (starts or ends)[0].pattern).prepare(df, bounds=needs_bounds(*starts, *ends))
    low = high = None
    for k, s in enumerate(starts):
        rows = add_position(rows, schema, keys, s, f"__s{k}", side="start")
    if starts:
        rows = rows.withColumn("__low", F.greatest(*(F.col(f"__s{k}_idx") for k in range(len(starts)))) if len(starts) > 1 else F.col("__s0_idx"))
        low = F.col("__low")
    for k, s in enumerate(ends):
        allowed = None if low is None else F.col(IDX) >= low
        rows = add_position(rows, schema, keys, s, f"__e{k}", side="end", allowed=allowed)
    if ends:
        rows = rows.withColumn("__high", F.least(*(F.col(f"__e{k}_idx") for k in range(len(ends)))) if len(ends) > 1 else F.col("__e0_idx"))
        high = F.col("__high")
    if low is not None and high is not None:
        rows = rows.filter((F.col(IDX) >= low) & (F.col(IDX) <= high))
    else:
        rows = rows.filter(F.col(IDX) >= low if high is None else F.col(IDX) <= high)
    return rows.filter(~is_bound()).select(*columns)


def to_daily_states(df: DataFrame, schema: StreamSchema, active_events=None, max_dormant_days: int = 30, agg: dict | None = None, path_col: str | None = None) -> DataFrame:
    """A row for each path and day, named by how long ago the path was active before; one window for all of it."""
    keys, ts, columns = schema.keys(path_col), schema.timestamp_col, df.columns
    agg = dict(agg or {})
    active = F.lit(True) if active_events is None else F.coalesce(values_in(schema.event_col, active_events), F.lit(False))
    others = [c for c in columns if c not in (*keys, schema.event_col, ts, KIND, IDX, RANK)]
    finer = [c for c in schema.path_cols if c not in keys]
    order = F.struct(IDX, RANK, schema.event_col)
    kept = [c for c in others if c not in finer]
    days = df.withColumn("__day", F.to_date(ts)).groupBy(*keys, "__day").agg(F.max(active.cast("int")).alias("__on"), *(aggregate(c, agg.get(c, "first"), order).alias(c) for c in kept))
    whole = Window.partitionBy(*keys).orderBy("__day")
    end = df.agg(F.max(F.to_date(ts)).alias("__end"))  # one row
    # up to the day before the next day with rows, and behind the last one as long as dormant days last
    days = days.withColumn("__next", F.lead("__day").over(whole))
    until = F.coalesce(F.date_sub("__next", 1), F.least(F.date_add("__day", max_dormant_days), F.col("__end")))
    filled = days.join(F.broadcast(end)).withColumn("__d", F.explode(F.sequence("__day", until)))
    filled = filled.withColumn("__on", F.when(F.col("__d") == F.col("__day"), F.col("__on")).otherwise(F.lit(0)))
    by_day = Window.partitionBy(*keys).orderBy("__d")
    before = F.max(F.when(F.col("__on") == 1, F.col("__d"))).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    rows = filled.withColumn("__before", before)
    week, month = F.col("__before") >= F.date_sub("__d", 7), F.col("__before") >= F.date_sub("__d", 30)
    state = (
        F.when((F.col("__on") == 1) & F.col("__before").isNull(), "new").when((F.col("__on") == 1) & week, "current").when((F.col("__on") == 1) & month, "reactivated").when(F.col("__on") == 1, "resurrected")
        .when(week, "at_risk_wau").when(month, "at_risk_mau").otherwise("dormant")
    )
    rows = rows.withColumns({schema.event_col: state, ts: F.col("__d").cast(df.schema[ts].dataType), KIND: F.lit("collapsed"), RANK: F.lit(1), IDX: F.row_number().over(by_day).cast("long")})
    for c in finer:
        rows = rows.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    for c in kept:  # a day without rows, or without a value, repeats the last one
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*columns)


def condition_paths(df: DataFrame, schema: StreamSchema, keys: list[str], condition, levels, strict: bool = True) -> DataFrame:
    """Keys of the paths for which the tree holds."""
    configs: dict[str, dict] = {}
    for leaf in leaves(condition):
        m = {"metric": leaf["metric"], "metric_args": leaf.get("metric_args") or {}}
        configs[repr(m)] = m
    metrics, names = path_metrics(df, schema, keys, list(configs.values()), levels, strict)
    column = {k: n[0] for k, n in zip(configs, names, strict=True)}

    def column_of(leaf: dict) -> str:
        return column[repr({"metric": leaf["metric"], "metric_args": leaf.get("metric_args") or {}})]

    return metrics.filter(compile_condition(condition, column_of)).select(*keys)
