"""The stream: a lazy frame, its schema and how it came about."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import EmptyResultError, ParameterError, UnknownNameError
from .functions.metrics import MANY_VALUES, open_metrics, path_entries, path_metrics
from .functions.patterns import anchors_of, parse_pattern, resolve_anchors
from .operators import added, paths, rows, segments, sessions, urls
from .plans import learned, tools
from .schema import BOUNDS, IDX, KIND, MISSING, RANK, RANKS, REST, StreamSchema, is_bound, without_bounds

#: Methods that a recipe may name.
OPS: dict[str, Callable] = {}


def op(method):
    """Registers a processor; its result remembers the call."""
    names = list(inspect.signature(method).parameters)[1:]

    @functools.wraps(method)
    def call(self, *args, **kwargs):
        out = method(self, *args, **kwargs)
        step = {"type": method.__name__, **dict(zip(names, args, strict=False)), **kwargs}
        return Stream(out.df, out.schema, (*self.recipe_ops, step), self.strict)

    OPS[method.__name__] = call
    return call


class Stream:
    """Ordered events of paths.  Every method returns a new stream or a frame; nothing runs before a sink,
    except for checks of names against the data, which ``strict=False`` leaves out."""

    def __init__(self, df: DataFrame, schema: StreamSchema, recipe_ops: tuple = (), strict: bool = True):
        self.df, self.schema, self.recipe_ops, self.strict = df, schema, recipe_ops, strict
        self._levels: dict[str, list] = {}
        self._present: dict[str, dict] = {}

    # sources

    @classmethod
    def from_dataframe(cls, df: DataFrame, schema: StreamSchema | dict | None = None, order_col: str | None = None, validate: bool = True, strict: bool = True) -> Stream:
        """``order_col`` orders events of one time; without it they keep the order in which they are read."""
        from .sources.load import load

        frame, s = load(df, StreamSchema.of(schema), order_col, validate)
        return cls(frame, s, (), strict)

    @classmethod
    def from_recipe(cls, df: DataFrame, recipe: list[dict], schema: StreamSchema | dict | None = None, **load) -> Stream:
        return cls.from_dataframe(df, schema, **load).apply(recipe)

    def apply(self, recipe: list[dict]) -> Stream:
        out = self
        for step in recipe:
            step = dict(step)
            name = step.pop("type", None)
            if name not in OPS:
                raise ParameterError(f"no operation {name!r}; known: {sorted(OPS)}")
            if name == "filter_paths" and "condition" not in step:  # a condition may stand in the step itself
                grain = {k: step.pop(k) for k in ("path_col",) if k in step}
                step = {"condition": step, **grain}
            out = OPS[name](out, **step)
        return out

    def recipe(self) -> list[dict]:
        return [dict(s) for s in self.recipe_ops]

    # sinks and facts

    def to_dataframe(self, exclude_start_end: bool = True) -> DataFrame:
        return without_bounds(self.df) if exclude_start_end else self.df

    def is_empty(self, exclude_start_end: bool = True) -> bool:
        return self.to_dataframe(exclude_start_end).isEmpty()

    def equals(self, other: Stream, technical: bool = False) -> bool:
        cols = [c for c in self.df.columns if technical or c not in (KIND, IDX, RANK)]
        if set(cols) != {c for c in other.df.columns if technical or c not in (KIND, IDX, RANK)}:
            return False
        a, b = (s.to_dataframe().select(*cols, IDX) if IDX not in cols else s.to_dataframe().select(*cols) for s in (self, other))
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def levels(self, column: str, among=None) -> list:
        """Sorted distinct values of a column that aren't missing; looked up once for a stream.

        With ``among`` only which of these values there are: no more reach the driver than are asked about.
        """
        if column not in self.df.columns:
            raise UnknownNameError(f"no column {column!r}")
        real = without_bounds(self.df)
        if among is not None and column not in self._levels:
            asked, seen = list(dict.fromkeys(among)), self._present.setdefault(column, {})
            if new := [v for v in asked if v not in seen]:
                there = {r[0] for r in real.filter(F.col(column).isin(*new)).select(column).distinct().collect()}
                texts = {str(v) for v in there}
                seen.update({v: v in there or str(v) in texts for v in new})
            return [v for v in asked if seen[v]]
        if column not in self._levels:
            self._levels[column] = sorted((r[0] for r in real.select(column).filter(F.col(column).isNotNull()).distinct().collect()), key=str)
        return self._levels[column]

    def get_event_counts(self) -> DataFrame:
        return tools.event_counts(self.df, self.schema)

    def get_segment_levels(self) -> dict[str, list]:
        out = {}
        for s in self.schema.segment_cols:
            missing = not self.df.filter(F.col(s).isNull()).isEmpty()
            out[s] = self.levels(s) + ([MISSING] if missing else [])
        return out

    @property
    def fingerprint(self) -> str:
        facts = tools.shape(self.df, self.schema).first().asDict()
        counts = sorted((r["event"], r["n"]) for r in self.get_event_counts().collect())
        text = json.dumps({"n_rows": facts["n_events"], "n_paths": facts[f"n_{self.schema.path_col}"], "events": counts, "schema": self.schema.as_dict()}, sort_keys=True)
        return hashlib.md5(text.encode()).hexdigest()

    def checkpoint(self) -> Stream:
        """Cut a long chain of plans where executors can be lost without it."""
        return Stream(self.df.checkpoint(), self.schema, self.recipe_ops, self.strict)

    def _known(self, column: str, names) -> None:
        names = [names] if isinstance(names, str) else list(names)
        if self.strict and names:
            there = self.levels(column, [n for n in names if n != MISSING])
            if bad := [n for n in names if n not in there and n not in (*BOUNDS, MISSING)]:
                raise UnknownNameError(f"{column} has no value {bad}")

    def _known_pattern(self, *patterns, event_col: str | None = None, absent_narrows: bool = False) -> None:
        """Names in patterns and anchors must be events: a mistyped one would find nothing, or everything."""
        if not self.strict:
            return
        for p in patterns:
            for spec in anchors_of(p) if p is not None else []:
                column, parsed = spec.event_col or event_col or self.schema.event_col, parse_pattern(spec.pattern)
                parsed.check_names(set(self.levels(column, parsed.candidates())), absent_narrows)

    def _of(self, df: DataFrame, schema: StreamSchema | None = None) -> Stream:
        return Stream(df, schema or self.schema, self.recipe_ops, self.strict)

    # rows

    @op
    def filter_events(self, keep: dict | None = None, drop: dict | None = None, func=None, sql: str | None = None) -> Stream:
        for c, v in {**(keep or {}), **(drop or {})}.items():
            self._known(c, v)
        return self._of(rows.filter_events(self.df, self.schema, keep, drop, func, sql))

    @op
    def drop_events(self, names) -> Stream:
        self._known(self.schema.event_col, names)
        return self._of(rows.drop_events(self.df, self.schema, names))

    @op
    def rename_events(self, mapping: dict) -> Stream:
        self._known(self.schema.event_col, mapping)
        rows.check_names(mapping.values())
        return self._of(rows.rename_values(self.df, self.schema.event_col, mapping))

    @op
    def edit_events(self, rename: dict | None = None, delete=None) -> Stream:
        self._known(self.schema.event_col, [*(rename or {}), *(delete or ())])
        return self._of(rows.edit_events(self.df, self.schema, rename, delete))

    @op
    def filter_paths(self, condition, path_col: str | None = None) -> Stream:
        keys = self.schema.keys(path_col)
        ids = paths.condition_paths(self.df, self.schema, keys, condition, self.levels, self.strict)
        out = self._of(self.df.join(ids, keys, "left_semi"))
        if self.strict and out.is_empty():
            raise EmptyResultError("no path fulfils the condition")
        return out

    @op
    def sample_paths(self, n: int | None = None, frac: float | None = None, random_state: int = 0) -> Stream:
        return self._of(rows.sample_paths(self.df, self.schema.keys(), n, frac, random_state))

    @op
    def restrict_to_pattern(self, pattern: str, path_col: str | None = None) -> Stream:
        self._known_pattern(pattern)
        return self._of(tools.restrict(self.df, self.schema, self.schema.keys(path_col), pattern))

    # added and merged rows

    @op
    def add_start_end_events(self, path_col: str | None = None) -> Stream:
        return self._of(added.add_start_end_events(self.df, self.schema, self.schema.keys(path_col)))

    @op
    def add_events(self, name: str, source_event=None, sql: str | None = None, anchor=None, churn: dict | None = None, path_col: str | None = None) -> Stream:
        if sum(x is not None for x in (source_event, sql, anchor, churn)) != 1:
            raise ParameterError("give one of source_event, sql, anchor and churn")
        if source_event is not None:
            self._known(self.schema.event_col, source_event)
            return self._of(added.add_source_events(self.df, self.schema, name, source_event))
        if sql is not None:
            return self._of(added.add_sql_events(self.df, self.schema, name, sql))
        if anchor is not None:
            self._known_pattern(anchor)
            return self._of(added.add_anchor_events(self.df, self.schema, self.schema.keys(path_col), name, anchor))
        return self._of(added.add_churn_events(self.df, self.schema, name, **churn))

    @op
    def collapse_events(self, loops=None, group_col: str | None = None, event_groups=None, bounds: dict | None = None, name=None, agg: dict | None = None, timeout: str | None = None, path_col: str | None = None) -> Stream:
        return self._of(sessions.collapse_events(self.df, self.schema, self.schema.keys(path_col), self.levels, loops, group_col, event_groups, bounds, name, agg, timeout, self.strict))

    @op
    def split_sessions(self, separator=None, bounds: dict | None = None, timeout: str | None = None, session_col: str = "session_id", session_index_col: str = "session_index", path_col: str | None = None) -> Stream:
        return self._of(*sessions.split_sessions(self.df, self.schema, separator, bounds, timeout, session_col, session_index_col, path_col))

    @op
    def truncate_paths(self, start_anchor=None, end_anchor=None, path_col: str | None = None) -> Stream:
        # of several anchors some may name what isn't there
        self._known_pattern(start_anchor, end_anchor, absent_narrows=True)
        return self._of(paths.truncate_paths(self.df, self.schema, self.schema.keys(path_col), start_anchor, end_anchor))

    @op
    def to_daily_states(self, active_events=None, max_dormant_days: int = 30, agg: dict | None = None, path_col: str | None = None) -> Stream:
        return self._of(paths.to_daily_states(self.df, self.schema, active_events, max_dormant_days, agg, path_col))

    @op
    def urls_to_events(self, column: str, nodes: list[dict] | None = None, strip_host: bool = True, strip_query: bool = True, strip_locale: bool = True, keep_full_paths: bool = False, host_col: str | None = None, query_col: str | None = None, locale_col: str | None = None, slug_col: str | None = None) -> Stream:
        return self._of(*urls.urls_to_events(self.df, self.schema, column, nodes, strip_host, strip_query, strip_locale, keep_full_paths, host_col, query_col, locale_col, slug_col))

    # segments

    @op
    def add_segment(self, name: str, rules: list | None = None, func=None, sql: str | None = None, funnel_events: list[str] | None = None, time_range: tuple | None = None, metric_bins: dict | None = None, path_col: str | None = None) -> Stream:
        given = [x for x in (rules, func, sql, funnel_events, time_range, metric_bins) if x is not None]
        if len(given) > 1:
            raise ParameterError("give at most one of rules, func, sql, funnel_events, time_range and metric_bins")
        keys, schema = self.schema.keys(path_col), self.schema.with_segment(name)
        if not given:
            if name not in self.df.columns:
                raise UnknownNameError(f"no column {name!r} to make a segment of")
            return self._of(self.df, schema)
        if name in self.df.columns:
            raise ParameterError(f"there is a column {name!r} already")
        if rules is not None:
            df = self.df.withColumn(name, segments.by_rules(rules))
        elif func is not None:
            value = func(self.df)
            df = self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
        elif sql is not None:
            df = segments.by_sql(self.df, name, sql)
            if self.strict and df.count() != self.df.count():
                raise ParameterError("the query must return a value for each row of the stream")
        elif funnel_events is not None:
            self._known(self.schema.event_col, funnel_events)
            df = segments.by_funnel(self.df, self.schema, keys, name, funnel_events)
        elif time_range is not None:
            df = self.df.withColumn(name, segments.by_time(self.schema, *time_range))
        else:
            df = segments.by_metric(self.df, self.schema, keys, name, metric_bins, self.levels, self.strict)
        return self._of(df, schema)

    @op
    def drop_segment(self, name: str) -> Stream:
        if name not in self.schema.segment_cols:
            raise UnknownNameError(f"no segment is named {name!r}")
        from dataclasses import replace

        return self._of(self.df.drop(name), replace(self.schema, segment_cols=tuple(c for c in self.schema.segment_cols if c != name)))

    @op
    def rename_segment_levels(self, name: str, mapping: dict) -> Stream:
        self._known(name, mapping)
        return self._of(segments.rename_levels(self.df, name, mapping))

    @op
    def add_clusters(self, name: str, features: list, n_clusters="3-8", scaler: str | None = "minmax", nmf_components=None, path_col: str | None = None, method: str = "kmeans", method_args: dict | None = None) -> Stream:
        keys = self.schema.keys(path_col)
        labels, _ = self._clusters(features, method, self._method_args(method, method_args, n_clusters), scaler, nmf_components, keys)
        df = self.df.join(labels.withColumnRenamed("cluster", name), keys, "left").select(*self.df.columns, name)
        return self._of(df, self.schema.with_segment(name))

    # questions

    def get_metrics(self, metrics: list, path_col: str | None = None) -> DataFrame:
        keys = self.schema.keys(path_col)
        return path_metrics(self.df, self.schema, keys, metrics, self.levels, self.strict)[0]

    def resolve_anchors(self, pattern: str, occurrence: str = "first", path_col: str | None = None, event_col: str | None = None) -> DataFrame:
        self._known_pattern(pattern, event_col=event_col)
        return resolve_anchors(self.df, self.schema, self.schema.keys(path_col), pattern, occurrence, event_col)

    def _tagged(self, diff: tuple) -> DataFrame:
        """Rows of either group, marked; a row of both is there twice."""
        if len(diff) == 3:
            column, *sides = diff
            if column not in self.schema.segment_cols:
                raise UnknownNameError(f"no segment is named {column!r}")
            c = F.col(column)

            def side(v, other) -> Column:
                if v == MISSING:
                    return c.isNull()
                if v == REST:
                    return ~F.coalesce(c.isNull() if other == MISSING else c == F.lit(other).cast(self.df.schema[column].dataType), F.lit(False))
                return F.coalesce(c == F.lit(v).cast(self.df.schema[column].dataType), F.lit(False))

            one, two = side(sides[0], sides[1]), side(sides[1], sides[0])
        elif len(diff) == 2:
            # a table of ids, however many: a plan of as many literals would not do
            groups: dict = {}
            for g, ids in enumerate(diff, 1):
                for i in ids:
                    groups.setdefault(i, set()).add(g)
            kind = self.df.schema[self.schema.path_col].dataType.simpleString()
            known = self.df.sparkSession.createDataFrame([(i, sorted(g)) for i, g in groups.items()], ["__id", "__in"] if groups else f"__id {kind}, __in array<int>")
            return self.df.join(known, F.col(self.schema.path_col) == F.col("__id")).withColumn(tools.GROUP, F.explode(F.col("__in").cast("array<int>"))).drop("__id", "__in")
        else:
            raise ParameterError("diff is (segment, level, level) or two lists of path ids")
        return self.df.withColumn(tools.GROUP, F.explode(F.array_compact(F.array(F.when(one, 1), F.when(two, 2)))))

    def _asked(self, ask, diff, by: list[str], value: str, missing: float | None = 0.0) -> DataFrame:
        return ask(self.df, False) if diff is None else tools.difference(ask(self._tagged(diff), True), by, value, missing)

    def transition_graph_data(self, edge_weight: str = "count", path_col: str | None = None, diff: tuple | None = None, path_pattern: str | None = None) -> DataFrame:
        if path_pattern is not None:
            return self.restrict_to_pattern(path_pattern, path_col).transition_graph_data(edge_weight, path_col, diff)
        keys = self.schema.keys(path_col)
        missing = None if edge_weight.startswith("time") else 0.0
        return self._asked(lambda df, g: tools.transitions(df, self.schema, keys, edge_weight, g), diff, ["src", "dst"], "value", missing)

    def step_matrix_data(self, max_steps: int | None = None, path_col: str | None = None, diff: tuple | None = None, path_pattern: str | None = None, anchor=None) -> DataFrame:
        keys = self.schema.keys(path_col)
        self._known_pattern(path_pattern, anchor)
        if path_pattern is None and anchor is None:
            return self._asked(lambda df, g: tools.step_matrix(df, self.schema, keys, max_steps, g), diff, ["step", "event"], "value")
        return self._asked(lambda df, g: tools.centred_matrix(df, self.schema, keys, max_steps or 5, path_pattern, anchor, group=g), diff, ["block", "step", "event"], "value")

    step_sankey_data = step_matrix_data

    def top_transitions(self, n: int = 20, edge_weight: str = "count", path_col: str | None = None, diff: tuple | None = None) -> DataFrame:
        """The ``n`` edges of the largest weight, or difference of weights, whatever its sign."""
        return self.transition_graph_data(edge_weight, path_col, diff).orderBy(F.abs("value").desc_nulls_last(), "src", "dst").limit(n)

    def top_of_steps(self, k: int = 5, events: list[str] | None = None, max_steps: int | None = None, path_col: str | None = None, diff: tuple | None = None) -> DataFrame:
        """step, event, value, rank: the ``k`` largest cells of each step, and all cells of ``events``."""
        cells = self.step_matrix_data(max_steps, path_col, diff)
        ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("step").orderBy(F.abs("value").desc(), "event")).cast("long"))
        return ranked.filter((F.col("rank") <= k) | F.col("event").isin(*(events or [])))

    @staticmethod
    def payload(rows: DataFrame, most_rows: int = 10_000) -> dict:
        """A result table as JSON-ready columns and rows; more than ``most_rows`` are an error, not cut off."""
        found = rows.limit(most_rows + 1).collect()
        if len(found) > most_rows:
            raise ParameterError(f"the result has more than {most_rows} rows")
        return {"columns": rows.columns, "rows": [json.loads(json.dumps(list(r), default=str)) for r in found]}

    def funnel_data(self, steps: list[str], diff: tuple | None = None, path_col: str | None = None) -> DataFrame:
        keys = self.schema.keys(path_col)
        if not steps:
            return self.df.sparkSession.createDataFrame([], "step_index long, step string, unique_paths long, conversion_rate double, step_conversion_rate double")
        self._known(self.schema.event_col, steps)
        if diff is None:
            return tools.funnel(self.df, self.schema, keys, steps)
        both = tools.funnel(self._tagged(diff), self.schema, keys, steps, True)
        parts = [tools.difference(both.withColumn("v", F.col(c).cast("double")), ["step_index", "step"], "v").withColumnRenamed("v", c) for c in ("unique_paths", "conversion_rate", "step_conversion_rate")]
        return parts[0].join(parts[1], ["step_index", "step"]).join(parts[2], ["step_index", "step"])

    def get_conversion_rate(self, start_anchor, end_anchor, within=None, path_col: str | None = None) -> DataFrame:
        self._known_pattern(start_anchor, end_anchor)
        return tools.conversion(self.df, self.schema, self.schema.keys(path_col), start_anchor, end_anchor, within)

    def segment_overview_data(self, segment_col: str, metrics: list | None = None, path_col: str | None = None) -> DataFrame:
        return tools.segment_overview(self.df, self.schema, self.schema.keys(path_col), segment_col, metrics or [], self.levels, self.strict)

    def get_metric_distribution(self, segment_col: str, metric, segment_levels: list | None = None, path_col: str | None = None, by_value: bool = False) -> dict:
        """``by_value``: a bin for each distinct value; without it only up to ten values have one each."""
        keys = self.schema.keys(path_col)
        values, names = path_metrics(self.df, self.schema, keys, [metric], self.levels, self.strict, [segment_col])
        out = learned.distribution(values, names[0][0], segment_col, segment_levels, by_value)
        v = F.col(f"`{names[0][0]}`").cast("double").alias("v")
        level = F.coalesce(F.col(segment_col).cast("string"), F.lit(MISSING)).alias("level")
        for r in tools.complement_distance(values.select(level, v)).collect():
            if r["level"] in out["levels"]:
                out["levels"][r["level"]]["complement_distance"] = r["value"]
        return out

    def get_cluster_distribution(self, labels: DataFrame, metric, clusters: list | None = None, path_col: str | None = None) -> dict:
        """The distribution of a metric over the clusters of ``labels``, as ``cluster_analysis_data`` returns them."""
        df = self.df.join(labels, self.schema.keys(path_col), "left").select(*self.df.columns, "cluster")
        return self._of(df, self.schema.with_segment("cluster")).get_metric_distribution("cluster", metric, clusters, path_col)

    @staticmethod
    def _method_args(method: str, method_args: dict | None, n_clusters) -> dict:
        """``n_clusters`` is short for the argument of k-means."""
        return {"n_clusters": n_clusters, **(method_args or {})} if method == "kmeans" else method_args or {}

    def _clusters(self, features: list, method: str, method_args: dict, scaler, nmf_components, keys: list[str], select: dict | None = None):
        if method == "hdbscan" and nmf_components is None and scaler in (None, "minmax"):
            found, rest = open_metrics(features, self.schema, keys, self.levels, self.strict)
            real = without_bounds(self.df)
            if any(real.select(c).distinct().limit(MANY_VALUES + 1).count() > MANY_VALUES for c in dict.fromkeys(o.column for o in found)):
                entries = path_entries(self.df, self.schema, keys, found, rest, self.levels, self.strict)
                return learned.cluster_paths(entries, keys, None, method, method_args, scaler, select=select)
        values, names = path_metrics(self.df, self.schema, keys, features, self.levels, self.strict)
        return learned.cluster_paths(values, keys, list(dict.fromkeys(n for group in names for n in group)), method, method_args, scaler, nmf_components, select=select)

    def cluster_analysis_data(self, features: list, n_clusters="3-8", scaler: str | None = "minmax", nmf_components=None, overview_metrics: list | None = None, path_col: str | None = None, method: str = "kmeans", method_args: dict | None = None, select: dict | None = None) -> dict:
        keys = self.schema.keys(path_col)
        labels, info = self._clusters(features, method, self._method_args(method, method_args, n_clusters), scaler, nmf_components, keys, select)
        df = self.df.join(labels, keys, "left")
        overview = self._of(df, self.schema.with_segment("cluster")).segment_overview_data("cluster", overview_metrics or features, path_col)
        return {"labels": labels, "overview": overview, **info}

    def describe(self, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), top_events: int = 20) -> dict[str, DataFrame | dict]:
        out: dict = {"schema": self.schema.as_dict(), "shape": tools.shape(self.df, self.schema), "events": tools.top_events(self.df, self.schema, top_events)}
        out["paths"] = {c: tools.path_stats(self.df, self.schema, self.schema.keys(c), percentiles) for c in self.schema.path_cols}
        out["segments"] = {s: without_bounds(self.df).groupBy(s).agg(F.count(F.lit(1)).alias("n")) for s in self.schema.segment_cols}
        return out

    def route_stats(self, nodes: list[str], path_col: str | None = None) -> DataFrame:
        self._known(self.schema.event_col, nodes)
        return tools.route_stats(self.df, self.schema, self.schema.keys(path_col), nodes)


__all__ = ["OPS", "RANKS", "Stream", "is_bound"]
