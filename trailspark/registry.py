"""Registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stream import Stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: What a query asks of its stream.
ASKED: dict[str, Callable[[Stream], DataFrame]] = {}

_BASE = """WITH ev AS (SELECT user_id, event_type AS event, ts AS timestamp, event_id, value, CAST(user_id % 3 AS VARCHAR) AS seg,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
sx AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY idx) AS sn FROM (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) > 21600000000 THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY idx))),
ss AS (SELECT * EXCLUDE (brk, sn), user_id || '_' || CAST(sn AS BIGINT) AS session_id, CAST(sn AS BIGINT) AS session_index FROM sx),
bd AS (SELECT user_id, seg, event, timestamp, idx, 2 AS k FROM ev UNION ALL SELECT user_id, any_value(seg), 'path_start', min(timestamp), 1, 0 FROM ev GROUP BY user_id UNION ALL SELECT user_id, any_value(seg), 'path_end', max(timestamp), max(idx), 4 FROM ev GROUP BY user_id),
ld AS (SELECT user_id, seg, event AS src, lead(event) OVER w AS dst, CAST(floor(epoch(lead(timestamp) OVER w)) - floor(epoch(timestamp)) AS BIGINT) AS s FROM bd WINDOW w AS (PARTITION BY user_id ORDER BY idx, k)),
ed AS (SELECT src, dst, count(*) AS n, count(DISTINCT user_id) AS u FROM ld WHERE dst IS NOT NULL GROUP BY ALL)
"""


def events(spark: SparkSession, sf_dir: str, long_paths: int | None = None) -> Stream:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_type").alias("event"), F.col("ts").alias("timestamp"), "event_id", "value", (F.col("user_id") % 3).cast("string").alias("seg"))
    return Stream.from_dataframe(rows, {"path_cols": ["user_id"], "segment_cols": ["seg"], "long_paths": long_paths}, order_col="event_id", validate=False, strict=False)


def sessions(spark: SparkSession, sf_dir: str) -> Stream:
    return events(spark, sf_dir).split_sessions(timeout="6h")


def query(name: str, sql: str | None, of: Callable[[SparkSession, str], Stream] = events, base: bool = True):
    def register(f: Callable[[Stream], DataFrame]) -> Callable[[Stream], DataFrame]:
        QUERIES[name], ASKED[name] = lambda spark, sf_dir: f(of(spark, sf_dir)), f
        if sql is not None:
            ORACLES[name] = (_BASE if base else "") + sql
        return f

    return register


def rows(s: Stream, *more: str) -> DataFrame:
    return s.df.select("user_id", "event_id", "event", *more)


query("event_counts", "SELECT event, count(*) AS n FROM ev GROUP BY event")(lambda s: s.get_event_counts())
query("path_steps", "SELECT user_id, event_id, event, idx AS step FROM ev")(lambda s: s.df.select("user_id", "event_id", "event", F.col("__idx").alias("step")))

for _weight, _sql in {
    "count": "SELECT src, dst, n AS value FROM ed",
    "unique_paths": "SELECT src, dst, u AS value FROM ed",
    "share_of_total": "SELECT src, dst, n / (SELECT sum(n) FROM ed)::DOUBLE AS value FROM ed",
    "avg_per_path": "SELECT src, dst, n / (SELECT count(DISTINCT user_id) FROM ev)::DOUBLE AS value FROM ed",
    "proba_out": "SELECT src, dst, n / (sum(n) OVER (PARTITION BY src))::DOUBLE AS value FROM ed",
    "proba_in": "SELECT src, dst, n / (sum(n) OVER (PARTITION BY dst))::DOUBLE AS value FROM ed",
    "time_median": "SELECT src, dst, quantile_cont(s, 0.5)::DOUBLE AS value FROM ld WHERE dst IS NOT NULL GROUP BY ALL",
    "time_q95": "SELECT src, dst, quantile_cont(s, 0.95)::DOUBLE AS value FROM ld WHERE dst IS NOT NULL GROUP BY ALL",
}.items():
    query(f"transitions_{_weight}", _sql)(lambda s, w=_weight: s.transition_graph_data(w))

query("transition_diff", """, g AS (SELECT CASE WHEN seg = '0' THEN 1 ELSE 2 END AS g, src, dst, count(*) AS n FROM ld WHERE dst IS NOT NULL GROUP BY ALL)
, p AS (SELECT g, src, dst, n / (sum(n) OVER (PARTITION BY g, src))::DOUBLE AS v FROM g)
SELECT src, dst, coalesce(max(CASE WHEN g = 1 THEN v END), 0) - coalesce(max(CASE WHEN g = 2 THEN v END), 0) AS value FROM p GROUP BY ALL""")(lambda s: s.transition_graph_data("proba_out", diff=("seg", "0", "<REST>")))

query("step_matrix", """, c AS (SELECT idx AS step, event, count(*) AS n FROM ev WHERE idx <= 10 GROUP BY ALL), p AS (SELECT count(DISTINCT user_id) AS p FROM ev)
SELECT step, event, n / p::DOUBLE AS value FROM c, p UNION ALL SELECT 0, 'path_start', 1.0 UNION ALL
SELECT step, 'path_end', 1.0 - sum(n)::BIGINT / p::DOUBLE FROM c, p GROUP BY step, p HAVING sum(n) < p""")(lambda s: s.step_matrix_data(max_steps=10))

_FUNNEL = """, f1 AS (SELECT session_id, min(idx) AS i FROM ss WHERE event = 'view' GROUP BY 1), f2 AS (SELECT s.session_id, min(s.idx) AS i FROM ss s JOIN f1 f ON s.session_id = f.session_id AND s.idx > f.i WHERE event = 'click' GROUP BY 1),
f3 AS (SELECT s.session_id, min(s.idx) AS i FROM ss s JOIN f2 f ON s.session_id = f.session_id AND s.idx > f.i WHERE event = 'purchase' GROUP BY 1), t AS (SELECT count(DISTINCT session_id) AS t FROM ss),
n AS (SELECT 1 AS step_index, 'view' AS step, count(*) AS c FROM f1 UNION ALL SELECT 2, 'click', count(*) FROM f2 UNION ALL SELECT 3, 'purchase', count(*) FROM f3)
SELECT step_index::BIGINT AS step_index, step, c AS unique_paths, c / t::DOUBLE AS conversion_rate, CASE WHEN step_index = 1 THEN c / t::DOUBLE ELSE c / (lag(c) OVER (ORDER BY step_index))::DOUBLE END AS step_conversion_rate FROM n, t"""
query("funnel", _FUNNEL, sessions)(lambda s: s.funnel_data(["view", "click", "purchase"], path_col="session_id"))
query("funnel_diff", """, f AS (SELECT session_id, CASE WHEN seg = '0' THEN 1 ELSE 2 END AS g, min(CASE WHEN event = 'view' THEN idx END) AS a FROM ss GROUP BY ALL),
h AS (SELECT f.*, (SELECT min(idx) FROM ss WHERE ss.session_id = f.session_id AND event = 'click' AND idx > a) AS b FROM f),
r AS (SELECT g, count(*) AS t, count(a) AS c1, count(b) AS c2 FROM h GROUP BY g), x AS (SELECT g, 1 AS step_index, 'view' AS step, c1 AS c, c1 / t::DOUBLE AS r, c1 / t::DOUBLE AS q FROM r UNION ALL SELECT g, 2, 'click', c2, c2 / t::DOUBLE, c2 / c1::DOUBLE FROM r)
SELECT a.step_index::BIGINT AS step_index, a.step, (a.c - b.c)::DOUBLE AS unique_paths, a.r - b.r AS conversion_rate, a.q - b.q AS step_conversion_rate FROM x a JOIN x b USING (step_index) WHERE a.g = 1 AND b.g = 2""", sessions)(lambda s: s.funnel_data(["view", "click"], diff=("seg", "0", "<REST>"), path_col="session_id"))

query("describe_shape", "SELECT count(*) AS n_events, count(DISTINCT event) AS n_event_names, min(timestamp) AS first_time, max(timestamp) AS last_time, count(DISTINCT user_id) AS n_user_id FROM ev")(lambda s: s.describe()["shape"])
query("top_events", ", c AS (SELECT event, count(*) AS n FROM ev GROUP BY 1) SELECT event, n, n / (SELECT sum(n) FROM c)::DOUBLE AS share FROM c ORDER BY n DESC, event LIMIT 3")(lambda s: s.describe(top_events=3)["events"])
_STATS = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{n}' AS stat, {x.format(m)}::DOUBLE AS value FROM p" for m in ("length", "duration") for n, x in (("count", "count({0})"), ("mean", "avg({0})"), ("std", "stddev_samp({0})"), ("min", "min({0})"), ("max", "max({0})"), ("25%", "quantile_cont({0}, 0.25)"), ("50%", "quantile_cont({0}, 0.5)"), ("75%", "quantile_cont({0}, 0.75)")))
query("path_stats", ", p AS (SELECT user_id, count(*)::DOUBLE AS length, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration FROM ev GROUP BY 1) SELECT metric, stat, round(value, 6) AS value FROM (" + _STATS + ")")(lambda s: s.describe()["paths"]["user_id"].withColumn("value", F.round("value", 6)))

query("filter_keep", "SELECT user_id, event_id, event FROM ev WHERE event IN ('view', 'click') AND seg IN ('1')")(lambda s: rows(s.filter_events(keep={"event": ["view", "click"], "seg": ["1"]})))
query("filter_drop", "SELECT user_id, event_id, event FROM ev WHERE NOT (event IN ('error') OR seg IN ('2'))")(lambda s: rows(s.filter_events(drop={"event": ["error"], "seg": ["2"]})))
query("filter_func", "SELECT user_id, event_id, event FROM ev WHERE value > 5")(lambda s: rows(s.filter_events(func=lambda df: df["value"] > 5)))
query("filter_sql", "SELECT user_id, event_id, event FROM ev WHERE value < 2 AND event <> 'view'")(lambda s: rows(s.filter_events(sql="SELECT * FROM eventstream WHERE value < 2 AND event <> 'view'")))
query("drop_events", "SELECT user_id, event_id, event FROM ev WHERE event <> 'error'")(lambda s: rows(s.drop_events(["error"])))
query("rename_events", "SELECT user_id, event_id, CASE event WHEN 'view' THEN 'seen' ELSE event END AS event FROM ev")(lambda s: rows(s.rename_events({"view": "seen"})))
query("edit_events", "SELECT user_id, event_id, CASE event WHEN 'view' THEN 'seen' ELSE event END AS event FROM ev WHERE event <> 'error'")(lambda s: rows(s.edit_events({"view": "seen"}, ["error"])))
query("filter_paths", """, m AS (SELECT session_id, count(*) AS l, count(CASE WHEN event = 'purchase' THEN 1 END) AS p, max(CASE WHEN event = 'error' THEN 1 ELSE 0 END) AS e, count(CASE WHEN event = 'view' THEN 1 END) AS v FROM ss GROUP BY 1)
SELECT user_id, event_id, event FROM ss WHERE session_id IN (SELECT session_id FROM m WHERE l >= 2 AND (p > 0 OR v IN (2, 3)) AND NOT e = 1)""", sessions)(
    lambda s: rows(s.filter_paths([{"op": ">=", "metric": "length", "value": 2}, {"op": "or", "args": [{"op": ">", "metric": "event_count", "metric_args": {"event": "purchase"}, "value": 0}, {"op": "in", "metric": "event_count", "metric_args": {"event": "view"}, "value": [2, 3]}]}, {"op": "not", "args": [{"op": "=", "metric": "has_event", "metric_args": {"event": "error"}, "value": True}]}], path_col="session_id"))
)


def _metric(name: str, sql: str, metrics: list, of=events, path_col: str | None = None) -> None:
    query(name, sql, of)(lambda s: s.get_metrics(metrics, path_col).drop(*(["user_id"] if path_col else [])))


_metric("metric_length_duration", "SELECT user_id, count(*) AS length, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration, epoch_us(min(timestamp)) / 1e6 AS first_event_time FROM ev GROUP BY 1", ["length", "duration", "first_event_time"])
_metric("metric_event_count", "SELECT session_id, count(CASE WHEN event = 'click' THEN 1 END) AS event_count_click, max((event = 'view')::INT) AS has_event_view FROM ss GROUP BY 1", [{"metric": "event_count", "metric_args": {"event": "click"}}, {"metric": "has_event", "metric_args": {"event": "view"}}], sessions, "session_id")
_metric("metric_bulk", "SELECT session_id, " + ", ".join(f"count(CASE WHEN event = '{e}' THEN 1 END) AS event_count_{e}, max((event = '{e}')::INT) AS has_event_{e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM ss GROUP BY 1", [{"metric": "event_count_bulk"}, {"metric": "has_event_bulk"}], sessions, "session_id")
_metric("metric_has_all_any", "SELECT session_id, max((event = 'view')::INT) * max((event = 'click')::INT) AS has_all_events_view_and_click, max((event IN ('error', 'signup'))::INT) AS has_any_event_error_or_signup FROM ss GROUP BY 1", [{"metric": "has_all_events", "metric_args": {"events": ["view", "click"]}}, {"metric": "has_any_event", "metric_args": {"events": ["error", "signup"]}}], sessions, "session_id")
_metric("metric_time_between", "SELECT session_id, (min(CASE WHEN event = 'click' THEN epoch_us(timestamp) END) - min(CASE WHEN event = 'view' THEN epoch_us(timestamp) END)) / 1e6 AS time_from_view_to_click, (max(epoch_us(timestamp)) - min(CASE WHEN event = 'view' THEN epoch_us(timestamp) END)) / 1e6 AS time_from_view_to_path_end FROM ss GROUP BY 1", [{"metric": "time_between", "metric_args": {"start_event": "view", "end_event": "click"}}, {"metric": "time_between", "metric_args": {"start_event": "view", "end_event": "path_end"}}], sessions, "session_id")
_metric("metric_active_days", "SELECT user_id, count(DISTINCT CASE WHEN event IN ('purchase') THEN timestamp::DATE END) AS active_days FROM ev GROUP BY 1", [{"metric": "active_days", "metric_args": {"active_events": "purchase"}}])
_metric("metric_in_segment", """SELECT user_id, max((seg = '1')::INT) AS in_segment_seg_1_any, CASE WHEN min(seg) = max(seg) AND min(seg) = '2' THEN 1 ELSE 0 END AS in_segment_seg_2_all, avg((seg = '0')::INT)::DOUBLE AS in_segment_seg_0_event_share FROM ev GROUP BY 1""", [{"metric": "in_segment", "metric_args": {"segment_name": "seg", "segment_level": lvl, "mode": m}} for lvl, m in (("1", "any"), ("2", "all"), ("0", "event_share"))])
query("metric_matches_pattern", """, m AS (SELECT DISTINCT a.session_id FROM ss a JOIN ss b ON a.session_id = b.session_id AND b.idx > a.idx WHERE a.event = 'view' AND b.event = 'click' AND NOT EXISTS (SELECT 1 FROM ss c WHERE c.session_id = a.session_id AND c.idx > a.idx AND c.idx < b.idx AND c.event = 'purchase'))
SELECT session_id, session_id IN (SELECT session_id FROM m) AS hit FROM (SELECT DISTINCT session_id FROM ss)""", sessions)(lambda s: s.get_metrics([{"metric": "matches_pattern", "metric_args": {"pattern": "view->[^purchase]*->click"}}], "session_id").select("session_id", F.col("`matches_pattern_view->[^purchase]*->click`").alias("hit")))

query("sessions_timeout", "SELECT user_id, event_id, event, session_id, session_index FROM ss")(lambda s: rows(s.split_sessions(timeout="6h"), "session_id", "session_index"))
query("sessions_separator", """, c AS (SELECT *, sum((event = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM ev), d AS (SELECT * FROM c WHERE event <> 'signup'), e AS (SELECT *, CASE WHEN g > 0 THEN dense_rank() OVER (PARTITION BY user_id, g > 0 ORDER BY g) END AS n FROM d)
SELECT user_id, event_id, event, CASE WHEN n IS NOT NULL THEN user_id || '_' || n END AS session_id, n::BIGINT AS session_index FROM e""")(lambda s: rows(s.split_sessions(separator="signup"), "session_id", "session_index"))
query("sessions_bounds", """, a AS (SELECT *, max(CASE WHEN event = 'view' THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS b, max(CASE WHEN event = 'purchase' THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ev),
i AS (SELECT *, coalesce(b > coalesce(e, 0), false) AS i FROM a), n AS (SELECT *, CASE WHEN i THEN sum((i AND (NOT coalesce(l, false) OR coalesce(e = idx - 1, false)))::INT) OVER (PARTITION BY user_id ORDER BY idx) END AS n FROM (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM i))
SELECT user_id, event_id, event, CASE WHEN n IS NOT NULL THEN user_id || '_' || n::BIGINT END AS session_id, n::BIGINT AS session_index FROM n WHERE event NOT IN ('view', 'purchase')""")(lambda s: rows(s.split_sessions(bounds={"start_event": "view", "end_event": "purchase"}), "session_id", "session_index"))

_RUNS = ", r AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY idx) AS g FROM (SELECT *, ({cut})::INT AS x FROM (SELECT *, lag({by}) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM ev)))"
query("collapse_loops", _RUNS.format(cut="l IS DISTINCT FROM event", by="event") + " SELECT user_id, min(event_id) AS event_id, any_value(event) AS event, CASE WHEN count(*) > 1 THEN 'collapsed' ELSE 'raw' END AS kind, round(avg(value), 6) AS value FROM r GROUP BY user_id, g")(lambda s: s.collapse_events(loops=True, agg={"value": "mean", "event_id": "min"}).df.select("user_id", "event_id", "event", F.col("__kind").alias("kind"), F.round("value", 6).alias("value")))
query("collapse_group_col", _RUNS.format(cut="l IS DISTINCT FROM timestamp::DATE::VARCHAR", by="timestamp::DATE::VARCHAR") + " SELECT user_id, min(event_id) AS event_id, any_value(timestamp::DATE::VARCHAR) AS event, max(value) AS value FROM r GROUP BY user_id, g")(lambda s: rows(s.add_segment("day", func=lambda df: F.to_date("timestamp").cast("string")).collapse_events(group_col="day", agg={"value": "max", "event_id": "min"}), "value"))
_SETS = """, r AS (SELECT *, CASE WHEN i THEN sum((i AND NOT coalesce(l, false))::INT) OVER (PARTITION BY user_id ORDER BY idx) ELSE -idx END AS g FROM (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM (SELECT *, event IN ('view', 'click') AS i FROM ev)))"""
query("collapse_event_groups", _SETS + " SELECT user_id, arg_min(event_id, idx) AS event_id, CASE WHEN g > 0 THEN 'browse' ELSE any_value(event) END AS event FROM r GROUP BY user_id, g")(lambda s: rows(s.collapse_events(event_groups=["view", "click"], name="browse")))
query("collapse_named_cases", _SETS + " SELECT user_id, arg_min(event_id, idx) AS event_id, CASE WHEN g < 0 THEN any_value(event) WHEN count(*) >= 3 THEN 'long' WHEN max((event = 'click')::INT) = 1 THEN 'clicked' ELSE 'other' END AS event FROM r GROUP BY user_id, g")(
    lambda s: rows(s.collapse_events(event_groups=["view", "click"], name=[{"condition": {"op": ">=", "metric": "length", "value": 3}, "name": "long"}, {"condition": {"op": "=", "metric": "has_event", "metric_args": {"event": "click"}, "value": 1}, "name": "clicked"}, "other"]))
)
query("collapse_bounds", """, a AS (SELECT *, max(CASE WHEN event = 'view' THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS b, max(CASE WHEN event = 'purchase' THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ev),
i AS (SELECT *, coalesce(b > coalesce(e, 0), false) AS i FROM a), n AS (SELECT *, CASE WHEN i THEN sum((i AND (NOT coalesce(l, false) OR coalesce(e = idx - 1, false)))::INT) OVER (PARTITION BY user_id ORDER BY idx) ELSE -idx END AS n FROM (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM i))
SELECT user_id, arg_min(event_id, idx) AS event_id, CASE WHEN n > 0 THEN 'deal' ELSE any_value(event) END AS event FROM n GROUP BY user_id, n""")(lambda s: rows(s.collapse_events(bounds={"start_event": "view", "end_event": "purchase"}, name="deal")))

query("start_end_events", "SELECT user_id, event, idx, k AS rank FROM bd")(lambda s: s.add_start_end_events().df.select("user_id", "event", F.col("__idx").alias("idx"), F.col("__rank").alias("rank")))
query("add_source_event", "SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'sale' FROM ev WHERE event = 'purchase'")(lambda s: rows(s.add_events("sale", source_event=["purchase"])))
query("add_sql_event", "SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'dear' FROM ev WHERE value > 9")(lambda s: rows(s.add_events("dear", sql="SELECT * FROM eventstream WHERE value > 9")))
query("add_churn", """SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'gone' FROM (SELECT *, coalesce(lead(timestamp) OVER (PARTITION BY user_id ORDER BY idx), (SELECT max(timestamp) FROM ev)) AS nx FROM ev WHERE event = 'purchase') WHERE epoch_us(nx) - epoch_us(timestamp) > 5 * 86400000000""")(lambda s: rows(s.add_events("gone", churn={"inactivity_days": 5, "active_events": ["purchase"]})))
query("add_anchor_event", """, a AS (SELECT a.user_id, min(a.idx) + 1 AS idx FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx = a.idx + 1 WHERE a.event = 'view' AND b.event = 'click' GROUP BY 1) SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'first_pair' FROM ev JOIN a USING (user_id, idx)""")(lambda s: rows(s.add_events("first_pair", anchor="view->click")))
query("truncate_window", """, a AS (SELECT user_id, min(idx) AS lo FROM ev WHERE event = 'view' GROUP BY 1), b AS (SELECT a.user_id, lo, min(idx) AS hi FROM a JOIN ev ON a.user_id = ev.user_id AND idx >= lo AND event = 'purchase' GROUP BY ALL) SELECT user_id, event_id, event FROM ev JOIN b USING (user_id) WHERE idx BETWEEN lo AND hi""")(lambda s: rows(s.truncate_paths("view", "purchase")))
query("truncate_offset", """, a AS (SELECT user_id, max(idx) AS hi FROM ev WHERE event = 'purchase' GROUP BY 1) SELECT user_id, event_id, event FROM ev JOIN a USING (user_id) WHERE idx BETWEEN greatest(1, hi - 2) AND hi""")(lambda s: rows(s.truncate_paths({"pattern": "purchase", "occurrence": "last", "offset": -2}, {"pattern": "purchase", "occurrence": "last"})))
query("daily_states", """, d AS (SELECT user_id, timestamp::DATE AS day, max((event = 'purchase')::INT) AS act FROM ev GROUP BY ALL), r AS (SELECT user_id, min(day) AS a, least(max(day) + 5, (SELECT max(timestamp)::DATE FROM ev)) AS z FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM r), j AS (SELECT g.user_id, g.day, coalesce(act, 0) AS act FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day),
l AS (SELECT *, max(CASE WHEN act = 1 THEN day END) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM j)
SELECT user_id, day::TIMESTAMP AS timestamp, CASE WHEN act = 1 THEN CASE WHEN p IS NULL THEN 'new' WHEN p >= day - 7 THEN 'current' WHEN p >= day - 30 THEN 'reactivated' ELSE 'resurrected' END WHEN p >= day - 7 THEN 'at_risk_wau' WHEN p >= day - 30 THEN 'at_risk_mau' ELSE 'dormant' END AS event FROM l""")(lambda s: s.to_daily_states(active_events=["purchase"], max_dormant_days=5).df.select("user_id", "timestamp", "event"))

query("segment_rules", "SELECT user_id, event_id, event, CASE WHEN value > 7 THEN 'high' WHEN event IN ('view', 'click') THEN 'browse' ELSE 'rest' END AS tier FROM ev")(lambda s: rows(s.add_segment("tier", rules=[["value", ">", 7, "high"], ["event", "in", ["view", "click"], "browse"], "rest"]), "tier"))
query("segment_sql", "SELECT user_id, event_id, event, CASE WHEN value > 5 THEN 'a' ELSE 'b' END AS half FROM ev")(lambda s: rows(s.add_segment("half", sql="SELECT IF(value > 5, 'a', 'b') FROM eventstream"), "half"))
query("segment_time_range", "SELECT user_id, event_id, event, CASE WHEN timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 12:00:00' THEN 'inside' ELSE 'outside' END AS early FROM ev")(lambda s: rows(s.add_segment("early", time_range=("2024-01-05", "2024-01-10 12:00:00")), "early"))
query("segment_funnel", """, f AS (SELECT session_id, min(CASE WHEN event = 'view' THEN idx END) AS a FROM ss GROUP BY 1), h AS (SELECT f.*, (SELECT min(idx) FROM ss WHERE ss.session_id = f.session_id AND event = 'click' AND idx > a) AS b FROM f)
SELECT user_id, event_id, event, CASE WHEN b IS NOT NULL THEN 'click' WHEN a IS NOT NULL THEN 'view' ELSE 'out_of_funnel' END AS deep FROM ss JOIN h USING (session_id)""", sessions)(lambda s: rows(s.add_segment("deep", funnel_events=["view", "click"], path_col="session_id"), "deep"))
query("segment_metric_bins", """, m AS (SELECT user_id, count(*) AS l FROM ev GROUP BY 1), q AS (SELECT quantile_cont(l::DOUBLE, 1 / 3.0::DOUBLE) AS a, quantile_cont(l::DOUBLE, 2 / 3.0::DOUBLE) AS b FROM m)
SELECT user_id, event_id, event, CASE WHEN l < a THEN 'bin_1' WHEN l < b THEN 'bin_2' ELSE 'bin_3' END AS size FROM ev JOIN m USING (user_id), q""")(lambda s: rows(s.add_segment("size", metric_bins={"metric": "length", "quantiles": 3}), "size"))

_OV = """, m AS (SELECT user_id, seg AS level, count(*)::DOUBLE AS length, count(CASE WHEN event = 'click' THEN 1 END)::DOUBLE AS c FROM ev GROUP BY ALL)"""
query("segment_overview", _OV + """ SELECT 'segment_size' AS metric, 'size' AS agg, level, count(*)::DOUBLE AS value FROM m GROUP BY level UNION ALL SELECT 'segment_share', 'share', level, count(*) / (SELECT count(*) FROM m)::DOUBLE FROM m GROUP BY level
UNION ALL SELECT 'length', 'median', level, quantile_cont(length, 0.5) FROM m GROUP BY level UNION ALL SELECT 'event_count_click', 'mean', level, avg(c) FROM m GROUP BY level""")(lambda s: s.segment_overview_data("seg", [{"metric": "length", "agg": "median"}, {"metric": "event_count", "metric_args": {"event": "click"}}]))
query("overview_complement_distance", _OV + """, v AS (SELECT DISTINCT length AS v FROM m), l AS (SELECT DISTINCT level FROM m),
c AS (SELECT l.level, v.v, (SELECT count(*) FROM m WHERE m.level = l.level AND length <= v.v) / (SELECT count(*) FROM m WHERE m.level = l.level)::DOUBLE AS f, (SELECT count(*) FROM m WHERE m.level <> l.level AND length <= v.v) / (SELECT count(*) FROM m WHERE m.level <> l.level)::DOUBLE AS g FROM l, v),
s AS (SELECT level, abs(f - g) * (lead(v) OVER (PARTITION BY level ORDER BY v) - v) AS a FROM c) SELECT level, round(sum(a), 9) AS value FROM s GROUP BY level""")(lambda s: s.segment_overview_data("seg", [{"metric": "length", "agg": "complement_distance"}]).filter("metric = 'length'").select("level", F.round("value", 9).alias("value")))

_CONV = """, a AS (SELECT session_id, min(idx) AS i, arg_min(timestamp, idx) AS t FROM ss WHERE event = 'view' GROUP BY 1), b AS (SELECT a.session_id, min(s.idx) AS j, arg_min(s.timestamp, s.idx) AS u FROM a JOIN ss s ON s.session_id = a.session_id AND s.idx > a.i AND s.event = 'click' GROUP BY 1),
n AS (SELECT count(DISTINCT session_id) AS n, count(DISTINCT CASE WHEN event = 'click' THEN session_id END) AS c FROM ss), x AS (SELECT count(*) AS p, count(CASE WHEN {ok} THEN 1 END) AS q FROM a LEFT JOIN b USING (session_id))
SELECT 'view' AS start_anchor, 'click' AS end_anchor, p AS paths_with_start, q AS converted, q / p::DOUBLE AS conversion_rate, c / n::DOUBLE AS base_rate, (q / p::DOUBLE) / (c / n::DOUBLE) AS lift FROM x, n"""
query("conversion_rate", _CONV.format(ok="j IS NOT NULL"), sessions)(lambda s: s.get_conversion_rate("view", "click", path_col="session_id"))
query("conversion_within_steps", _CONV.format(ok="j - i <= 1"), sessions)(lambda s: s.get_conversion_rate("view", "click", within=1, path_col="session_id"))
query("conversion_within_time", _CONV.format(ok="epoch_us(u) - epoch_us(t) <= 7200000000"), sessions)(lambda s: s.get_conversion_rate("view", "click", within="2h", path_col="session_id"))
query("step_matrix_anchor", """, c AS (SELECT user_id, min(idx) AS c FROM ev WHERE event = 'purchase' GROUP BY 1), r AS (SELECT bd.event, CASE WHEN k = 0 THEN 0 WHEN k = 4 THEN idx + 1 ELSE idx END - c AS step FROM bd JOIN c USING (user_id)), n AS (SELECT step, event, count(*) AS n FROM r WHERE step BETWEEN -2 AND 2 GROUP BY ALL)
SELECT 0::BIGINT AS block, step, event, n / (sum(n) OVER (PARTITION BY step))::DOUBLE AS value FROM n""")(lambda s: s.step_matrix_data(max_steps=2, anchor="purchase"))
query("step_matrix_pattern", """, a AS (SELECT user_id, min(idx) AS c0 FROM ev WHERE event = 'view' GROUP BY 1), b AS (SELECT a.user_id, c0, min(idx) AS c1 FROM a JOIN ev ON a.user_id = ev.user_id AND idx > c0 AND event = 'purchase' GROUP BY ALL),
r AS (SELECT bd.event, CASE WHEN k = 0 THEN 0 WHEN k = 4 THEN idx + 1 ELSE idx END AS s, c0, c1 FROM bd JOIN b USING (user_id)), n AS (SELECT 0 AS block, s - c0 AS step, event, count(*) AS n FROM r WHERE s - c0 BETWEEN -2 AND 2 GROUP BY ALL UNION ALL SELECT 1, s - c1, event, count(*) FROM r WHERE s - c1 BETWEEN -2 AND 2 GROUP BY ALL)
SELECT block::BIGINT AS block, step, event, n / (sum(n) OVER (PARTITION BY block, step))::DOUBLE AS value FROM n""")(lambda s: s.step_matrix_data(max_steps=2, path_pattern="view->.*->purchase"))
query("route_stats", """, w AS (SELECT user_id, event, lead(event) OVER x AS e1, lead(event, 2) OVER x AS e2, (epoch_us(lead(timestamp, 2) OVER x) - epoch_us(timestamp)) / 1e6 AS t FROM ev WINDOW x AS (PARTITION BY user_id ORDER BY idx)), h AS (SELECT * FROM w WHERE event = 'view' AND e1 = 'click' AND e2 = 'purchase'),
p AS (SELECT (SELECT n FROM ed WHERE src = 'view' AND dst = 'click') / (SELECT sum(n) FROM ed WHERE src = 'view')::DOUBLE * ((SELECT n FROM ed WHERE src = 'click' AND dst = 'purchase') / (SELECT sum(n) FROM ed WHERE src = 'click')::DOUBLE) AS mp)
SELECT count(*) AS occurrences, count(DISTINCT user_id) AS unique_paths, count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM ev)::DOUBLE AS path_share, quantile_cont(t, 0.5) AS time_median, quantile_cont(t, 0.95) AS time_q95, (SELECT mp FROM p) AS markov_probability FROM h""")(lambda s: s.route_stats(["view", "click", "purchase"]))
query("resolve_anchors", """, m AS (SELECT a.user_id, a.idx AS i, b.idx AS j FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx > a.idx WHERE a.event = 'view' AND b.event = 'click' AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.user_id = a.user_id AND c.idx > a.idx AND c.idx < b.idx AND c.event = 'purchase'))
SELECT user_id, 0::BIGINT AS ordinal, min(i) AS step, min(i) AS "index" FROM m GROUP BY 1 UNION ALL SELECT user_id, 1, min(j), min(j) FROM m GROUP BY 1""")(lambda s: s.resolve_anchors("view->[^purchase]*->click"))


_PAIRS = ", m AS (SELECT a.user_id, a.idx AS i, b.idx AS j FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx > a.idx WHERE a.event = 'view' AND b.event = 'click')"
query("resolve_last", _PAIRS + """ SELECT user_id, 0::BIGINT AS ordinal, max(i) AS step, max(i) AS "index" FROM m GROUP BY 1 UNION ALL SELECT user_id, 1, max(j), max(j) FROM m GROUP BY 1""")(lambda s: s.resolve_anchors("view->.*->click", "last"))
query("resolve_all", _PAIRS + """ SELECT DISTINCT user_id, 0::BIGINT AS ordinal, i AS step, i AS "index" FROM m UNION ALL SELECT DISTINCT user_id, 1, j, j FROM m""")(lambda s: s.resolve_anchors("view->.*->click", "all"))
query("restrict_to_pattern", "SELECT user_id, event_id, event FROM ev WHERE user_id IN (SELECT a.user_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx = a.idx + 1 WHERE a.event = 'signup' AND b.event <> 'error')")(lambda s: rows(s.restrict_to_pattern("signup->[^error]")))
query("restrict_class_gap", """ SELECT user_id, event_id, event FROM ev WHERE user_id IN (SELECT a.user_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx > a.idx WHERE a.event = 'signup' AND b.event IN ('purchase', 'error')
AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.user_id = a.user_id AND c.idx > a.idx AND c.idx < b.idx AND c.event NOT IN ('view', 'click')))""")(lambda s: rows(s.restrict_to_pattern("signup->[view|click]*->[purchase|error]")))
query("anchor_all_starts", ", a AS (SELECT a.user_id, a.idx FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx = a.idx + 1 WHERE a.event = 'view' AND b.event = 'click') SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'pair' FROM ev JOIN a USING (user_id, idx)")(lambda s: rows(s.add_events("pair", anchor={"pattern": "view->click", "at": "start", "occurrence": "all"})))
_MOVED = """, a AS (SELECT user_id, arg_min(timestamp, idx) AS t FROM ev WHERE event = 'view' GROUP BY 1), b AS (SELECT a.user_id, coalesce({ok}, {edge}) AS idx FROM a JOIN ev USING (user_id) GROUP BY a.user_id)
SELECT user_id, event_id, event FROM ev UNION ALL SELECT user_id, event_id, 'mark' FROM ev JOIN b USING (user_id, idx)"""
query("anchor_duration_offset", _MOVED.format(ok="min(CASE WHEN timestamp >= t + INTERVAL 1 DAY THEN idx END)", edge="max(idx)"))(lambda s: rows(s.add_events("mark", anchor={"pattern": "view", "offset": "1d", "offset_side": "start"})))
query("anchor_offset_back", _MOVED.format(ok="max(CASE WHEN timestamp <= t - INTERVAL 12 HOUR THEN idx END)", edge="min(idx)"))(lambda s: rows(s.add_events("mark", anchor={"pattern": "view", "offset": "-12h"})))
query("anchor_event_col", ", a AS (SELECT user_id, min(idx) AS i FROM ev WHERE seg = '2' GROUP BY 1) SELECT user_id, event_id, event FROM ev JOIN a USING (user_id) WHERE idx >= i")(lambda s: rows(s.truncate_paths({"pattern": "2", "event_col": "seg"})))
query("truncate_several_anchors", """, b AS (SELECT user_id, min(CASE WHEN event = 'purchase' THEN idx END) AS p, min(CASE WHEN event = 'error' THEN idx END) AS e FROM ev GROUP BY 1)
SELECT user_id, event_id, event FROM ev JOIN b USING (user_id) WHERE idx <= coalesce(least(p, e), p, e)""")(lambda s: rows(s.truncate_paths(end_anchor=["purchase", "error"])))
query("sessions_separator_timeout", """, c AS (SELECT *, event = 'signup' AS cut, max((event = 'signup')::INT) OVER w AS seen, coalesce(epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w) > 21600000000, false) AS pause FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY idx)), d AS (SELECT *, NOT cut AND seen = 1 AS i FROM c),
n AS (SELECT *, CASE WHEN i THEN sum((i AND (NOT coalesce(l, false) OR pause))::INT) OVER (PARTITION BY user_id ORDER BY idx) END::BIGINT AS n FROM (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY idx) AS l FROM d))
SELECT user_id, event_id, event, CASE WHEN n IS NOT NULL THEN user_id || '_' || n END AS session_id, n AS session_index FROM n WHERE NOT cut""")(lambda s: rows(s.split_sessions(separator="signup", timeout="6h"), "session_id", "session_index"))
query("collapse_group_null", _RUNS.format(cut="idx = 1 OR l IS DISTINCT FROM CASE WHEN value > 5 THEN 'high' END", by="CASE WHEN value > 5 THEN 'high' END") + " SELECT user_id, min(event_id) AS event_id, any_value(CASE WHEN value > 5 THEN 'high' END) AS event, 'collapsed' AS kind FROM r GROUP BY user_id, g")(
    lambda s: s.add_segment("part", func=lambda df: F.when(df["value"] > 5, "high")).collapse_events(group_col="part", agg={"event_id": "min"}).df.select("user_id", "event_id", "event", F.col("__kind").alias("kind"))
)
query("collapse_aggregates", _RUNS.format(cut="l IS DISTINCT FROM seg || event", by="seg || event") + " SELECT user_id, min(event_id) AS event_id, any_value(event) AS event, arg_max(value, idx) AS value FROM r GROUP BY user_id, g")(lambda s: rows(s.collapse_events(loops=True, agg={"value": "last", "event_id": "min"}), "value"))
query("segment_sql_column", "SELECT user_id, event_id, event, CASE WHEN idx <= 3 THEN 'first' ELSE 'later' END AS phase FROM ev")(lambda s: rows(s.add_segment("phase", sql="SELECT CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) <= 3 THEN 'first' ELSE 'later' END FROM eventstream"), "phase"))
query("rename_levels", "SELECT user_id, event_id, event, CASE seg WHEN '0' THEN 'zero' WHEN '1' THEN 'one' ELSE seg END AS seg FROM ev")(lambda s: rows(s.rename_segment_levels("seg", {"0": "zero", "1": "one"}), "seg"))
query("promote_segment", "SELECT user_id AS level, count(*) AS n FROM ev GROUP BY 1 HAVING user_id < 5")(lambda s: s.add_segment("value").drop_segment("value").df.filter("user_id < 5").groupBy(F.col("user_id").alias("level")).agg(F.count(F.lit(1)).alias("n")))
query("segment_metric_edges", """, m AS (SELECT user_id, (min(CASE WHEN event = 'click' THEN epoch_us(timestamp) END) - min(CASE WHEN event = 'view' THEN epoch_us(timestamp) END)) / 1e6 AS v FROM ev GROUP BY 1)
SELECT user_id, event_id, event, CASE WHEN v IS NULL THEN 'undefined' WHEN v < 0 THEN 'before' WHEN v < 86400 THEN 'a day' ELSE 'later' END AS soon FROM ev JOIN m USING (user_id)""")(lambda s: rows(s.add_segment("soon", metric_bins={"metric": {"metric": "time_between", "metric_args": {"start_event": "view", "end_event": "click"}}, "edges": [0, 86400], "segment_levels": ["before", "a day", "later"]}), "soon"))
query("daily_states_fill", """, d AS (SELECT user_id, timestamp::DATE AS day, arg_min(value, idx) AS value FROM ev GROUP BY ALL), r AS (SELECT user_id, min(day) AS a, least(max(day) + 5, (SELECT max(timestamp)::DATE FROM ev)) AS z FROM d GROUP BY 1),
g AS (SELECT user_id, unnest(generate_series(a, z, INTERVAL 1 DAY))::DATE AS day FROM r)
SELECT g.user_id, g.day::TIMESTAMP AS timestamp, last_value(d.value IGNORE NULLS) OVER (PARTITION BY g.user_id ORDER BY g.day) AS value FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day""")(lambda s: s.to_daily_states(max_dormant_days=5).df.select("user_id", "timestamp", "value"))
query("step_matrix_diff", """, n AS (SELECT seg AS g, idx AS step, event, count(*) AS n FROM ev WHERE idx <= 3 AND seg IN ('0', '1') GROUP BY ALL), p AS (SELECT seg AS g, count(DISTINCT user_id) AS p FROM ev GROUP BY 1),
v AS (SELECT g, step, event, n / p::DOUBLE AS v FROM n JOIN p USING (g) UNION ALL SELECT g, 0, 'path_start', 1.0 FROM p WHERE g IN ('0', '1') UNION ALL SELECT g, step, 'path_end', 1.0 - sum(n)::BIGINT / p::DOUBLE FROM n JOIN p USING (g) GROUP BY g, step, p HAVING sum(n) < p)
SELECT step, event, coalesce(max(CASE WHEN g = '0' THEN v END), 0) - coalesce(max(CASE WHEN g = '1' THEN v END), 0) AS value FROM v GROUP BY step, event""")(lambda s: s.step_matrix_data(max_steps=3, diff=("seg", "0", "1")))
_EDGES = """, w AS (SELECT user_id, event, idx, {g} AS g FROM ev), x AS (SELECT user_id, g, event, idx, 2 AS k FROM w WHERE g IS NOT NULL UNION ALL SELECT user_id, g, 'path_start', min(idx), 0 FROM w WHERE g IS NOT NULL GROUP BY ALL UNION ALL SELECT user_id, g, 'path_end', max(idx), 4 FROM w WHERE g IS NOT NULL GROUP BY ALL),
y AS (SELECT g, event AS src, lead(event) OVER (PARTITION BY user_id, g ORDER BY idx, k) AS dst FROM x), c AS (SELECT g, src, dst, count(*) AS n FROM y WHERE dst IS NOT NULL GROUP BY ALL)
SELECT src, dst, (coalesce(max(CASE WHEN g = 1 THEN n END), 0) - coalesce(max(CASE WHEN g = 2 THEN n END), 0))::DOUBLE AS value FROM c GROUP BY ALL"""
query("transitions_diff_ids", _EDGES.format(g="CASE WHEN user_id IN (1, 2, 3, 4) THEN 1 WHEN user_id IN (5, 6, 7) THEN 2 END"))(lambda s: s.transition_graph_data("count", diff=([1, 2, 3, 4], [5, 6, 7])))
query("transitions_diff_missing", _EDGES.format(g="CASE WHEN value > 5 THEN 1 ELSE 2 END"))(lambda s: s.add_segment("part", func=lambda df: F.when(df["value"] > 5, "high")).transition_graph_data("count", diff=("part", "high", "<MISSING>")))
query("overview_quantiles", _OV + " UNION ALL ".join([" SELECT 'segment_size' AS metric, 'size' AS agg, level, count(*)::DOUBLE AS value FROM m GROUP BY level", "SELECT 'segment_share', 'share', level, count(*) / (SELECT count(*) FROM m)::DOUBLE FROM m GROUP BY level", *(f"SELECT 'length', 'q{q}', level, quantile_cont(length, 0.{q:02d}) FROM m GROUP BY level" for q in (5, 25, 75, 95))]))(
    lambda s: s.segment_overview_data("seg", [{"metric": "length", "agg": f"q{q}"} for q in (5, 25, 75, 95)])
)
_metric("metric_in_segment_bulk", "SELECT user_id, " + ", ".join(f"max((seg = '{v}')::INT) AS in_segment_seg_{v}_any" for v in "012") + " FROM ev GROUP BY 1", [{"metric": "in_segment_bulk"}])
_metric("metric_event_col", "SELECT session_id, count(CASE WHEN seg = '1' THEN 1 END) AS event_count_seg_1, max((seg = '2')::INT) AS has_event_seg_2 FROM ss GROUP BY 1", [{"metric": "event_count", "metric_args": {"event": "1", "event_col": "seg"}}, {"metric": "has_event", "metric_args": {"event": "2", "event_col": "seg"}}], sessions, "session_id")
query("clusters_separate", ", h AS (SELECT user_id, max((event = 'purchase')::INT) AS hit FROM ev GROUP BY 1) SELECT hit, count(*) AS n, 1::BIGINT AS clusters FROM h GROUP BY 1")(
    lambda s: s.add_clusters("cluster", [{"metric": "has_event", "metric_args": {"event": "purchase"}}], n_clusters=2).df.groupBy("user_id", "cluster").agg(F.max((F.col("event") == "purchase").cast("int")).alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"))
)


def _part(alone: Column) -> Column:
    return F.when(F.col("user_id") % 25 == 7, alone).otherwise((F.col("user_id") % 3).cast("string"))


query("clusters_density", ", h AS (SELECT user_id, CASE WHEN user_id % 25 = 7 THEN 'alone' ELSE seg END AS part FROM ev GROUP BY ALL) SELECT part, count(*) AS n, 1::BIGINT AS clusters, (part = 'alone')::BIGINT AS noise FROM h GROUP BY 1")(
    # three dense parts, and pairs of users that lie alone
    lambda s: s.add_segment("part", func=lambda df: _part(F.concat(F.lit("alone"), F.floor(F.col("user_id") / 50).cast("string"))))
    .add_clusters("cluster", [{"metric": "in_segment_bulk", "metric_args": {"segment_name": "part"}}], method="hdbscan", method_args={"min_cluster_size": 3})
    .df.select("user_id", "cluster", _part(F.lit("alone")).alias("part")).distinct()
    .groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"), F.max((F.col("cluster") == "noise").cast("long")).alias("noise"))
)
query("top_transitions", "SELECT src, dst, n AS value FROM ed ORDER BY n DESC, src, dst LIMIT 7")(lambda s: s.top_transitions(7))
query("top_of_steps", """, c AS (SELECT idx AS step, event, count(*) AS n FROM ev WHERE idx <= 4 GROUP BY ALL), p AS (SELECT count(DISTINCT user_id) AS p FROM ev),
v AS (SELECT step, event, n / p::DOUBLE AS value FROM c, p UNION ALL SELECT 0, 'path_start', 1.0 UNION ALL SELECT step, 'path_end', 1.0 - sum(n)::BIGINT / p::DOUBLE FROM c, p GROUP BY step, p HAVING sum(n) < p),
r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY abs(value) DESC, event) AS rank FROM v) SELECT step, event, value, rank FROM r WHERE rank <= 2 OR event = 'error'""")(lambda s: s.top_of_steps(2, ["error"], max_steps=4))
query("filter_missing", "SELECT user_id, event_id, event FROM ev WHERE NOT coalesce(value > 5, false) OR value > 9")(
    lambda s: rows(s.add_segment("part", func=lambda df: F.when(df["value"] > 9, "top").when(df["value"] > 5, "high")).filter_events(keep={"part": ["top", "<MISSING>"]}))
)
query("sample_paths_whole", "SELECT count(DISTINCT user_id) AS paths, 0::BIGINT AS cut FROM (SELECT DISTINCT user_id FROM ev LIMIT 20)")(
    lambda s: s.sample_paths(n=20, random_state=3).df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(s.df.groupBy("user_id").agg(F.count(F.lit(1)).alias("of")), "user_id").agg(F.count(F.lit(1)).alias("paths"), F.count(F.when(F.col("n") != F.col("of"), 1)).alias("cut"))
)


def _pages(spark: SparkSession, sf_dir: str) -> Stream:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("user_id"), F.lit("page").alias("event"), F.col("page_id").alias("timestamp"), "page_id", "url")
    return Stream.from_dataframe(rows, {"path_cols": ["user_id"]}, order_col="page_id", validate=False, strict=False)


query("urls_to_events", r"""WITH p AS (SELECT page_id, rtrim(ltrim(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')), '/'), '/') AS p, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) <> '' AS has FROM pages),
q AS (SELECT page_id, CASE WHEN p = '' AND has THEN '/' ELSE p END AS p FROM p), l AS (SELECT page_id, p, CASE WHEN regexp_matches(split_part(p, '/', 1), '^[a-z]{2}(-[a-z]{2,4})*$') THEN split_part(p, '/', 1) ELSE '' END AS locale FROM q)
SELECT page_id, 'page:/' || CASE WHEN locale <> '' THEN CASE WHEN p = locale THEN '/' ELSE substr(p, length(locale) + 2) END ELSE p END AS event, locale FROM l""", _pages, base=False)(lambda s: s.urls_to_events("url", locale_col="locale").df.select("page_id", "event", "locale"))
query("sample_paths", None)(lambda s: rows(s.sample_paths(n=20, random_state=3)))
query("clusters_kmeans", None)(lambda s: rows(s.add_clusters("cluster", ["length", {"metric": "event_count", "metric_args": {"event": "purchase"}}], n_clusters="2-3"), "cluster"))
query("recipe_replay", "SELECT user_id, event_id, CASE event WHEN 'view' THEN 'seen' ELSE event END AS event FROM ev WHERE event <> 'error'")(lambda s: rows(s.apply(s.drop_events(["error"]).rename_events({"view": "seen"}).recipe())))

# the same answers where a path is cut into chunks of 16 indexes
for _name in ("sessions_timeout", "sessions_separator_timeout", "sessions_bounds", "collapse_loops", "funnel", "transitions_count", "step_matrix"):
    QUERIES[f"long_{_name}"] = lambda spark, sf_dir, name=_name: ASKED[name](_long(spark, sf_dir, name))
    ORACLES[f"long_{_name}"] = ORACLES[_name]


def _long(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    s = events(spark, sf_dir, long_paths=16)
    return s.split_sessions(timeout="6h") if name == "funnel" else s


query("overview_duration_quantiles", """, m AS (SELECT user_id, seg AS level, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS d FROM ev GROUP BY ALL)
SELECT 'duration' AS metric, a AS agg, level, v AS value FROM (SELECT level, quantile_cont(d, 0.05) AS q5, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.95) AS q95 FROM m GROUP BY level) UNPIVOT (v FOR a IN (q5, median, q95))""")(
    lambda s: s.segment_overview_data("seg", [{"metric": "duration", "agg": a} for a in ("q5", "median", "q95")]).filter("metric = 'duration'")
)


query("urls_nodes", r"""WITH p AS (SELECT page_id, rtrim(ltrim(lower(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')), '/'), '/') AS p, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) <> '' AS has FROM pages),
q AS (SELECT page_id, CASE WHEN p = '' AND has THEN '/' ELSE p END AS p FROM p WHERE p <> 'fr' AND NOT starts_with(p, 'fr/')),
s AS (SELECT page_id, p, CASE WHEN starts_with(p, 'en/') THEN CASE split_part(p, '/', 2) WHEN '615.html' THEN 'special' WHEN '300' THEN 'page' ELSE 'page' END WHEN p <> 'es/254' AND starts_with(p, 'es/') AND NOT starts_with(p, 'es/254/') THEN 'sub-page' WHEN starts_with(p, 'es/254/') THEN 'below' ELSE '' END AS slug FROM q)
SELECT page_id, slug, 'page:/' || CASE WHEN slug = '' THEN p WHEN starts_with(p, 'es/254/') THEN 'es/254/' || slug ELSE split_part(p, '/', 1) || '/' || slug END AS event FROM s""", _pages, base=False)(
    lambda s: s.urls_to_events(
        "url", strip_locale=False, slug_col="slug",
        nodes=[{"path": "en", "aggregate_children": True, "name": "page"}, {"path": "en/615.html", "name": "special"}, {"path": "en/300"}, {"path": "/FR/", "exclude": True}, {"path": "es", "aggregate_children": True}, {"path": "es/254", "aggregate_children": True, "name": "below"}],
    ).df.select("page_id", "slug", "event")
)


def _bars(s: Stream) -> DataFrame:
    early = s.filter_events(func=lambda df: F.hour("timestamp") < 3)
    found = early.get_metric_distribution("seg", {"metric": "event_count", "metric_args": {"event": "purchase"}}, by_value=True)
    rows = [(level, k, n, float(x["mean"]), x["median"], x["size"]) for level, x in found["levels"].items() for k, n in enumerate(x["histogram"])]
    return s.df.sparkSession.createDataFrame(rows, "level string, bin long, n long, mean double, median double, size long")


query("distribution_counts", """, h AS (SELECT user_id, seg, sum((event = 'purchase')::INT) AS v FROM ev WHERE hour(timestamp) < 3 GROUP BY ALL), b AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS bin FROM (SELECT DISTINCT v FROM h))
SELECT l.seg AS level, bin, count(h.v) AS n, any_value(l.mean) AS mean, any_value(l.median) AS median, any_value(l.size) AS size FROM (SELECT seg, avg(v) AS mean, quantile_cont(v::DOUBLE, 0.5) AS median, count(*) AS size FROM h GROUP BY 1) l CROSS JOIN b LEFT JOIN h ON h.seg = l.seg AND h.v = b.v GROUP BY l.seg, bin""")(_bars)
