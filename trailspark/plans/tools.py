"""Aggregate questions about paths; every result is a long table.

``group`` names a column that splits the paths in two for differences: it joins all partition and
grouping keys, so both sides are one pass over one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.durations import seconds
from ..functions.metrics import normal, path_metrics
from ..functions.patterns import Resolver, add_position, anchors_of, needs_bounds, parse_pattern, with_virtual_bounds
from ..operators.scan import running
from ..operators.segments import funnel_depth
from ..schema import MISSING, PATH_END, PATH_START, StreamSchema, is_bound, micros, without_bounds
from .quantiles import is_count, quantiles

GROUP = "__grp"
EDGE_WEIGHTS = ("count", "unique_paths", "share_of_total", "avg_per_path", "proba_out", "proba_in", "time_median", "time_q95")


def difference(rows: DataFrame, by: list[str], value: str, missing: float | None = 0.0) -> DataFrame:
    """Group 1 minus group 2 of each cell; a cell that one side lacks counts as ``missing``."""
    side = lambda g: F.max(F.when(F.col(GROUP) == g, F.col(value)))
    both = rows.groupBy(*by).agg(side(1).alias("__a"), side(2).alias("__b"))
    fill = lambda c: F.col(c) if missing is None else F.coalesce(c, F.lit(missing))
    return both.select(*by, (fill("__a") - fill("__b")).alias(value))


def transitions(df: DataFrame, schema: StreamSchema, keys: list[str], edge_weight: str = "count", group: bool = False) -> DataFrame:
    """src, dst, value: edges between events that follow each other, boundary rows included."""
    if edge_weight not in EDGE_WEIGHTS:
        raise ParameterError(f"edge_weight is one of {list(EDGE_WEIGHTS)}, got {edge_weight!r}")
    g = [GROUP] if group else []
    by, e, ts = [*keys, *g], schema.event_col, schema.timestamp_col
    rows = with_virtual_bounds(df.select(*dict.fromkeys([*by, e, ts, "__kind", "__idx", "__rank"])), schema, by, e)
    timed, at = edge_weight.startswith("time"), F.unix_seconds(F.col(ts).cast("timestamp"))
    rows = running(rows, schema, by, __dst=("lead", F.col(e)), **({"__then": ("lead", at)} if timed else {}))
    follow = rows.select(*by, F.col(e).alias("src"), F.col("__dst").alias("dst"), *([(F.col("__then") - at).alias("__s")] if timed else [])).filter("dst is not null")
    cell = [*g, "src", "dst"]
    if timed:
        share = 0.5 if edge_weight == "time_median" else 0.95
        return quantiles(follow, cell, F.col("__s"), [share]).select(*cell, F.get("q", F.lit(0)).alias("value"))
    if edge_weight == "count":
        return follow.groupBy(*cell).agg(F.count(F.lit(1)).alias("value"))
    if edge_weight == "unique_paths":
        # a path's edges are already in one place: its distinct ones need no shuffle
        return follow.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy(*cell).agg(F.count(F.lit(1)).alias("value"))
    edges = follow.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    if edge_weight in ("proba_out", "proba_in"):
        side = "src" if edge_weight == "proba_out" else "dst"
        return edges.select(*cell, (F.col("n") / F.sum("n").over(Window.partitionBy(*g, side))).alias("value"))
    total = F.sum("n") if edge_weight == "share_of_total" else F.sum(F.when(F.col("src") == PATH_START, F.col("n")))
    totals = edges.groupBy(*g).agg(total.alias("t")) if group else edges.agg(total.alias("t"))  # one row for each group
    joined = edges.join(F.broadcast(totals), g) if group else edges.join(F.broadcast(totals))
    return joined.select(*cell, F.try_divide("n", "t").alias("value"))


def step_matrix(df: DataFrame, schema: StreamSchema, keys: list[str], max_steps: int | None = None, group: bool = False) -> DataFrame:
    """step, event, value: the share of paths at each event; step 0 is the start, the rest has ended."""
    g = [GROUP] if group else []
    by = [*keys, *g]
    rows = running(without_bounds(df), schema, by, step=("number", None))
    if max_steps is not None:
        rows = rows.filter(F.col("step") <= max_steps)
    cells = rows.groupBy(*g, "step", F.col(schema.event_col).alias("event")).agg(F.count(F.lit(1)).alias("n"))
    # every path has a first step; these tables have a row for each step at most
    paths = cells.filter("step = 1").groupBy(*g).agg(F.sum("n").alias("p")) if group else cells.filter("step = 1").agg(F.sum("n").alias("p"))
    at = cells.groupBy(*g, "step").agg(F.sum("n").alias("t"))
    ended = at.select(*g, "step", F.lit(PATH_END).alias("event"), F.col("t"))
    join = lambda x: x.join(F.broadcast(paths), g) if group else x.join(F.broadcast(paths))
    parts = join(cells).select(*g, "step", "event", F.try_divide("n", "p").alias("value"))
    parts = parts.unionByName(join(ended).select(*g, "step", "event", (F.lit(1.0) - F.try_divide("t", "p")).alias("value")).filter("value > 0"))
    return parts.unionByName(paths.filter("p is not null").select(*g, F.lit(0).cast("long").alias("step"), F.lit(PATH_START).alias("event"), F.lit(1.0).alias("value")))


def centred_matrix(df: DataFrame, schema: StreamSchema, keys: list[str], max_steps: int, pattern: str | None = None, anchor=None, event_col: str | None = None, group: bool = False) -> DataFrame:
    """block, step, event, value: what stands around each part of a pattern, or around an anchor, from its first match.

    Each column of a block is divided by its own sum.
    """
    if (pattern is None) == (anchor is None):
        raise ParameterError("give a pattern or an anchor")
    g = [GROUP] if group else []
    by = [*keys, *g]
    whole = Window.partitionBy(*by)
    blocks: list[tuple[str, int, bool]] = []
    start_anchored = False
    if anchor is not None:
        spec = anchors_of(anchor)[0]
        if spec.occurrence == "all":
            raise ParameterError("a block has one centre for a path: occurrence is first or last")
        rows = Resolver(schema, by, spec.pattern).prepare(df, bounds=True)
        rows = add_position(rows, schema, by, spec, "__c0")
        blocks.append(("__c0_step", 1, False))
    else:
        r = Resolver(schema, by, pattern, event_col)
        m = r.resolve(r.prepare(df, bounds=True))
        rows = m.df
        for i, part in enumerate(r.pattern.parts):
            # one match of the whole pattern: each part as early as it can be
            rows = rows.withColumn(f"__c{i}_step", F.min(F.when(F.col(m.ok[i]), F.col("__step"))).over(whole))
            ends = part[-1].names == (PATH_END,)
            blocks.append((f"__c{i}_step", len(part), ends))
        start_anchored = r.pattern.parts[0][0].names == (PATH_START,)
    cells = []
    for i, (centre, length, ends) in enumerate(blocks):
        rel = F.col("__step") - F.col(centre)
        high = length - 1 if ends else length + max_steps - 1
        cells.append(F.when((rel >= -max_steps) & (rel <= high), F.struct(F.lit(i).alias("block"), rel.alias("step"))))
    counted = rows.select(*g, F.col(schema.event_col).alias("event"), F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy(*g, "c.block", "c.step", "event").agg(F.count(F.lit(1)).alias("n"))
    if start_anchored:
        # who has ended stays ended in the first block: a running sum over its few columns
        w = Window.partitionBy(*g, "block", "event").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        ended = (F.col("event") == PATH_END) & (F.col("block") == 0)
        ends_at = counted.filter(ended)
        last = counted.filter("block = 0").groupBy(*g, "block").agg(F.max("step").alias("m"))
        ends_at = ends_at.join(F.broadcast(last), [*g, "block"]).withColumn("to", F.lead("step").over(Window.partitionBy(*g, "block").orderBy("step"))).withColumn("n", F.sum("n").over(w))
        ends_at = ends_at.withColumn("step", F.explode(F.sequence("step", F.coalesce(F.col("to") - 1, "m")))).select(*g, "block", "step", "event", "n")
        counted = counted.filter(~ended).unionByName(ends_at)
    return counted.select(*g, F.col("block").cast("long").alias("block"), F.col("step").cast("long").alias("step"), "event", (F.col("n") / F.sum("n").over(Window.partitionBy(*g, "block", "step"))).alias("value"))


def funnel(df: DataFrame, schema: StreamSchema, keys: list[str], steps: list[str], group: bool = False) -> DataFrame:
    """step_index, step, unique_paths, conversion_rate, step_conversion_rate."""
    g = [GROUP] if group else []
    depth = funnel_depth(df, schema, keys, steps, g)
    counts = [F.count(F.when(F.col("depth") >= k + 1, 1)).alias(f"n{k}") for k in range(len(steps))]
    one = depth.groupBy(*g).agg(F.count(F.lit(1)).alias("t"), *counts) if group else depth.agg(F.count(F.lit(1)).alias("t"), *counts)
    out = []
    for k, s in enumerate(steps):
        rate = F.coalesce(F.try_divide(F.col(f"n{k}"), F.col("t")), F.lit(0.0))
        before = rate if k == 0 else F.coalesce(F.try_divide(F.col(f"n{k}"), F.col(f"n{k - 1}")), F.lit(0.0))
        out.append(F.struct(F.lit(k + 1).cast("long").alias("step_index"), F.lit(s).alias("step"), F.col(f"n{k}").alias("unique_paths"), rate.alias("conversion_rate"), before.alias("step_conversion_rate")))
    return one.select(*g, F.inline(F.array(*out)))


def _within(value) -> tuple[str, float] | None:
    if value is None:
        return None
    if isinstance(value, bool) or isinstance(value, int) and value < 1:
        raise ParameterError(f"within is a positive number of events or a duration, got {value!r}")
    return ("steps", value) if isinstance(value, int) else ("seconds", seconds(value, "within"))


def conversion(df: DataFrame, schema: StreamSchema, keys: list[str], start_anchor, end_anchor, within=None) -> DataFrame:
    """For each pair of anchors: paths that reach the start, those that then match the whole end pattern, and the lift."""
    starts, ends, limit = anchors_of(start_anchor), anchors_of(end_anchor), _within(within)
    if any(s.occurrence == "all" for s in (*starts, *ends)):
        raise ParameterError("a path converts or not: occurrence is first or last")
    whole = Window.partitionBy(*keys)
    columns = df.columns
    rows = Resolver(schema, keys, starts[0].pattern).prepare(df, bounds=needs_bounds(*starts, *ends))
    for j, e in enumerate(ends):
        rows = add_position(rows, schema, keys, e, f"__base{j}")
    pairs = []
    at_step = lambda s: F.max(F.when(F.col("__step") == F.col(s), micros(schema.timestamp_col))).over(whole)
    for i, s in enumerate(starts):
        rows = add_position(rows, schema, keys, s, f"__s{i}")
        if limit and limit[0] == "seconds":
            rows = rows.withColumn(f"__s{i}_ts", at_step(f"__s{i}_step"))
        for j, e in enumerate(ends):
            tag = f"__e{i}_{j}"
            rows = add_position(rows, schema, keys, e, tag, allowed=F.col("__step") > F.col(f"__s{i}_step"))
            if limit and limit[0] == "seconds":
                rows = rows.withColumn(f"{tag}_ts", at_step(f"{tag}_step"))
            pairs.append((i, j, tag))
    kept = [c for c in rows.columns if c not in columns and c != "__step"]
    one = rows.groupBy(*keys).agg(*(F.max(c).alias(c) for c in kept))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, j, tag in pairs:
        has = F.col(f"__s{i}_step").isNotNull()
        done = has & F.col(f"{tag}_step").isNotNull()
        if limit and limit[0] == "steps":
            done = done & (F.col(f"{tag}_step") - F.col(f"__s{i}_step") <= int(limit[1]))
        elif limit:
            done = done & (F.col(f"{tag}_ts") - F.col(f"__s{i}_ts") <= int(round(limit[1] * 1e6)))
        aggregates += [F.count(F.when(has, 1)).alias(f"a{i}_{j}"), F.count(F.when(done, 1)).alias(f"b{i}_{j}"), F.count(F.when(F.col(f"__base{j}_step").isNotNull(), 1)).alias(f"c{i}_{j}")]
    sums = one.agg(*aggregates)
    out = []
    for i, j, _ in pairs:
        rate, base = F.try_divide(F.col(f"b{i}_{j}"), F.col(f"a{i}_{j}")), F.try_divide(F.col(f"c{i}_{j}"), F.col("n"))
        out.append(F.struct(F.lit(starts[i].pattern).alias("start_anchor"), F.lit(ends[j].pattern).alias("end_anchor"), F.col(f"a{i}_{j}").alias("paths_with_start"), F.col(f"b{i}_{j}").alias("converted"), rate.alias("conversion_rate"), base.alias("base_rate"), F.try_divide(rate, base).alias("lift")))
    return sums.select(F.inline(F.array(*out)))


#: Aggregates of an overview: the mean, and quantiles by their shares.
AGGS = {"mean": None, "median": 0.5, "q5": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


def segment_overview(df: DataFrame, schema: StreamSchema, keys: list[str], segment_col: str, metrics: list[dict], levels, strict: bool = True) -> DataFrame:
    """metric, agg, level, value: metrics of (path, level) pairs summed up by level; sizes and shares always."""
    if segment_col not in schema.segment_cols:
        raise ParameterError(f"no segment is named {segment_col!r}")
    configs = [({k: v for k, v in m.items() if k != "agg"}, m.get("agg", "mean")) for m in map(_spec, metrics)]
    if bad := sorted({a for _, a in configs} - {*AGGS, "complement_distance"}):
        raise ParameterError(f"unknown agg {bad}")
    values, names = path_metrics(df, schema, keys, [c for c, _ in configs] or ["length"], levels, strict, [segment_col])
    level = F.coalesce(F.col(segment_col).cast("string"), F.lit(MISSING)).alias("level")
    values = values.withColumn("level", level)
    wanted: list[tuple[str, str]] = []
    for (_, agg), columns in zip(configs, names if configs else [], strict=False):
        wanted += [(c, agg) for c in columns if (c, agg) not in wanted]
    number = lambda c: F.col(f"`{c}`").cast("double")
    selected: dict[str, list[str]] = {}
    for c, a in wanted:
        if AGGS.get(a) is not None and not is_count(values, c):
            selected.setdefault(c, []).append(a)
    plain = [(c, a) for c, a in wanted if a != "complement_distance" and a not in selected.get(c, ())]
    summed = lambda c, a: F.avg(number(c)) if AGGS[a] is None else F.percentile(number(c), F.lit(AGGS[a]))
    one = values.groupBy("level").agg(F.count(F.lit(1)).cast("double").alias("__size"), *(summed(c, a).alias(f"__v{k}") for k, (c, a) in enumerate(plain)))
    total = one.agg(F.sum("__size").alias("__t"))  # one row
    cells = [F.struct(F.lit("segment_size").alias("metric"), F.lit("size").alias("agg"), F.col("__size").alias("value")), F.struct(F.lit("segment_share").alias("metric"), F.lit("share").alias("agg"), (F.col("__size") / F.col("__t")).alias("value"))]
    cells += [F.struct(F.lit(c).alias("metric"), F.lit(a).alias("agg"), F.col(f"__v{k}").cast("double").alias("value")) for k, (c, a) in enumerate(plain)]
    out = one.join(F.broadcast(total)).select("level", F.explode(F.array(*cells)).alias("x")).select(F.col("x.metric"), F.col("x.agg"), "level", F.col("x.value"))
    for c, names in selected.items():
        cells = [F.struct(F.lit(c).alias("metric"), F.lit(a).alias("agg"), F.get("q", F.lit(k)).alias("value")) for k, a in enumerate(names)]
        found = quantiles(values, ["level"], number(c), [AGGS[a] for a in names])
        every = values.select("level").distinct().join(found, "level", "left")  # a level without a value has none
        out = out.unionByName(every.select("level", F.explode(F.array(*cells)).alias("x")).select(F.col("x.metric"), F.col("x.agg"), "level", F.col("x.value")))
    for c in dict.fromkeys(c for c, a in wanted if a == "complement_distance"):
        out = out.unionByName(complement_distance(values.select("level", number(c).alias("v"))).select(F.lit(c).alias("metric"), F.lit("complement_distance").alias("agg"), "level", "value"))
    return out


def _spec(m) -> dict:
    m = {"metric": m} if isinstance(m, str) else dict(m)
    agg = m.pop("agg", None)
    m = normal(m)
    return m if agg is None else m | {"agg": agg}


def complement_distance(values: DataFrame) -> DataFrame:
    """level, value: Wasserstein-1 distance of v within a level to v in all others, from the two running shares.

    Values are counted first; the windows run over the distinct values for each level.
    """
    counts = values.filter("v is not null").groupBy("level", "v").agg(F.count(F.lit(1)).alias("n"))
    all_values = counts.groupBy("v").agg(F.sum("n").alias("total"))
    levels = counts.groupBy("level").agg(F.sum("n").alias("own"))
    every = levels.agg(F.sum("own").alias("every"))
    grid = levels.join(F.broadcast(every)).join(all_values).join(counts, ["level", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("level").orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rest = F.col("every") - F.col("own")
    apart = F.abs(F.try_divide(F.sum("n").over(run), F.col("own")) - F.try_divide(F.sum(F.col("total") - F.col("n")).over(run), rest))
    steps = grid.select("level", (apart * (F.lead("v").over(w) - F.col("v"))).alias("a"), rest.alias("rest"))
    return steps.groupBy("level").agg(F.when(F.max("rest") > 0, F.coalesce(F.sum("a"), F.lit(0.0))).alias("value"))


def route_stats(df: DataFrame, schema: StreamSchema, keys: list[str], nodes: list[str]) -> DataFrame:
    """One row: how often the nodes follow each other without a break, in how many paths, how long it takes, and the Markov estimate."""
    if len(nodes) < 2:
        raise ParameterError("a route has two nodes or more")
    e, ts = schema.event_col, schema.timestamp_col
    rows = with_virtual_bounds(df.select(*dict.fromkeys([*keys, e, ts, "__kind", "__idx", "__rank"])), schema, keys, e)
    w, k = schema.window(keys), len(nodes) - 1
    test = F.col(e) == nodes[0]
    for i, n in enumerate(nodes[1:], 1):
        test = test & (F.lead(e, i).over(w) == n)
    took = (F.lead(micros(ts), k).over(w) - micros(ts)) / F.lit(1e6)
    pairs = list(zip(nodes, nodes[1:], strict=False))
    follows = F.lead(e).over(w)
    rows = rows.select(*keys, F.coalesce(test, F.lit(False)).alias("hit"), took.alias("took"), F.col(e).alias("src"), follows.alias("dst"), (F.col("__kind") == PATH_START).alias("first"))
    per = rows.groupBy(*keys).agg(F.count(F.when(F.col("hit"), 1)).alias("n"), *(F.count(F.when((F.col("src") == a) & (F.col("dst") == b), 1)).alias(f"e{i}") for i, (a, b) in enumerate(pairs)), *(F.count(F.when((F.col("src") == a) & F.col("dst").isNotNull(), 1)).alias(f"o{i}") for i, (a, _) in enumerate(pairs)))
    # quantiles need the single times, sums the paths
    sums = per.agg(F.sum("n").alias("occurrences"), F.count(F.when(F.col("n") > 0, 1)).alias("unique_paths"), F.count(F.lit(1)).alias("paths"), *(F.sum(f"e{i}").alias(f"e{i}") for i in range(k)), *(F.sum(f"o{i}").alias(f"o{i}") for i in range(k)))
    times = quantiles(rows.filter("hit"), [], F.col("took"), [0.5, 0.95]).agg(F.max(F.get("q", F.lit(0))).alias("time_median"), F.max(F.get("q", F.lit(1))).alias("time_q95"))
    chain = F.lit(1.0)
    for i in range(k):
        chain = chain * F.coalesce(F.try_divide(F.col(f"e{i}"), F.col(f"o{i}")), F.lit(0.0))
    return sums.join(F.broadcast(times)).select("occurrences", "unique_paths", F.try_divide("unique_paths", "paths").alias("path_share"), "time_median", "time_q95", chain.alias("markov_probability"))


def event_counts(df: DataFrame, schema: StreamSchema) -> DataFrame:
    return without_bounds(df).groupBy(F.col(schema.event_col).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def top_events(df: DataFrame, schema: StreamSchema, n: int = 20) -> DataFrame:
    counts = event_counts(df, schema)
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("event", "n", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "event").limit(n)


def path_stats(df: DataFrame, schema: StreamSchema, keys: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """metric, stat, value: count, mean, std, min, percentiles and max of the length and duration of paths."""
    ts = schema.timestamp_col
    per = without_bounds(df).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("length"), ((F.max(micros(ts)) - F.min(micros(ts))) / F.lit(1e6)).alias("duration"))
    stats: list[tuple[str, str, Column]] = []
    for m in ("length", "duration"):
        stats += [(m, "count", F.count(m).cast("double")), (m, "mean", F.avg(m)), (m, "std", F.stddev_samp(m)), (m, "min", F.min(m)), (m, "max", F.max(m))]
        if m == "length":  # few distinct values
            stats += [(m, f"{int(p * 100)}%", F.percentile(m, F.lit(float(p)))) for p in percentiles]
    one = per.agg(*(c.alias(f"s{k}") for k, (_, _, c) in enumerate(stats)))
    if percentiles:
        times = quantiles(per, [], F.col("duration"), [float(p) for p in percentiles]).agg(F.max("q").alias("q"))
        one = one.join(F.broadcast(times))
        for k, p in enumerate(percentiles):
            one = one.withColumn(f"s{len(stats)}", F.get("q", F.lit(k)))
            stats.append(("duration", f"{int(p * 100)}%", F.col("q")))
    return one.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(s).alias("stat"), F.col(f"s{k}").alias("value")) for k, (m, s, _) in enumerate(stats)))))


def shape(df: DataFrame, schema: StreamSchema) -> DataFrame:
    """One row: events, distinct names, first and last time, and the number of paths at each grain."""
    real = without_bounds(df)
    ts = schema.timestamp_col
    return real.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(schema.event_col).alias("n_event_names"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), *(F.count_distinct(c).alias(f"n_{c}") for c in schema.path_cols))


def restrict(df: DataFrame, schema: StreamSchema, keys: list[str], pattern: str) -> DataFrame:
    """All rows of the paths that hold the pattern: its mark is spread over the path's rows by the same window."""
    r = Resolver(schema, keys, pattern)
    named = bool(parse_pattern(pattern).named_bounds)
    columns = df.columns
    rows = r.forward(r.prepare(df, bounds=named))
    hit = F.max(f"__mf{len(r.pattern.parts) - 1}").over(Window.partitionBy(*keys))
    return rows.withColumn("__hit", hit).filter("__hit").filter(~is_bound()).select(*columns)
