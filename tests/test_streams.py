from datetime import datetime, timedelta

import pytest
from trailspark import Stream
from trailspark.errors import ParameterError, SchemaError, UnknownNameError
from trailspark.functions.durations import seconds
from trailspark.sources.load import nesting_faults, shop_events

BEGIN = datetime(2024, 1, 1)


def stream(spark, rows, **schema):
    return Stream.from_dataframe(spark.createDataFrame([(u, e, BEGIN + timedelta(minutes=m)) for u, e, m in rows], "user_id string, event string, timestamp timestamp_ntz"), schema or None)


@pytest.fixture()
def small(spark):
    return stream(spark, [("a", "x", 0), ("a", "x", 1), ("a", "y", 40), ("b", "y", 0), ("b", "x", 5), ("b", "path_start", 6)])


def names(s, user):
    return [r["event"] for r in s.df.filter(f"user_id = '{user}'").orderBy("__idx", "__rank", "event").collect()]


def test_boundaries_are_found_by_kind(small):
    twice = small.add_start_end_events().add_start_end_events()
    assert names(twice, "a") == ["path_start", "x", "x", "y", "path_end"]
    assert names(twice, "b") == ["path_start", "y", "x", "path_start", "path_end"]


def test_loops_collapse_once(small):
    once = small.collapse_events(loops=True)
    assert names(once, "a") == ["x", "y"]
    assert once.equals(once.collapse_events(loops=True))


def test_a_gap_of_the_timeout_stays(small):
    rows = small.split_sessions(timeout="39m").df.filter("user_id = 'a'").select("session_index").distinct().count()
    assert rows == 1
    assert small.split_sessions(timeout="38m").df.filter("user_id = 'a'").select("session_index").distinct().count() == 2


def test_equal_times_keep_input_order(spark):
    s = stream(spark, [("a", e, 0) for e in "cab"])
    assert names(s, "a") == ["c", "a", "b"]


def test_keep_and_drop_part_the_rows(small):
    assert small.filter_events(keep={"event": ["x"]}).df.count() + small.filter_events(drop={"event": ["x"]}).df.count() == small.df.count()


def test_recipe_replays(spark, small):
    made = small.drop_events(["y"]).rename_events({"x": "z"})
    assert small.apply(made.recipe()).equals(made)


def test_probabilities_sum_to_one(small):
    from pyspark.sql import functions as F

    assert all(abs(r["s"] - 1) < 1e-9 for r in small.transition_graph_data("proba_out").groupBy("src").agg(F.sum("value").alias("s")).collect())


def test_errors(spark, small):
    with pytest.raises(UnknownNameError):
        small.drop_events(["nothing"])
    with pytest.raises(SchemaError):
        stream(spark, [("a", "x->y", 0)])
    with pytest.raises(SchemaError):
        stream(spark, [(None, "x", 0)])
    with pytest.raises(ParameterError):
        seconds("30")
    with pytest.raises(SchemaError):
        stream(spark, [("a", "x", 0)], path_cols=["user_id"], event_col="user_id")


def test_shop_nests(spark):
    s = Stream.from_dataframe(shop_events(spark, 30), {"path_cols": ["user_id", "session_id"], "segment_cols": ["platform"]})
    assert nesting_faults(s.df, s.schema).isEmpty()
    assert s.describe()["shape"].first()["n_user_id"] == 30
    out = s.get_metric_distribution("platform", "length")
    assert set(out["levels"]) <= {"mobile", "desktop"}
    assert s.cluster_analysis_data(["length", "duration"], n_clusters="2-3", path_col="user_id")["n_clusters"] in (2, 3)


def test_live_counts(spark, tmp_path):
    from trailspark import StreamSchema
    from trailspark.streaming.live import live_sessions, windowed_counts

    rows = spark.createDataFrame([("a", "x", BEGIN + timedelta(minutes=m)) for m in (0, 1, 31, 90)], "user_id string, event string, timestamp timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("counts", windowed_counts(source, StreamSchema(), "10m")), ("live", live_sessions(source, StreamSchema(), "30m"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 1, 2]


def test_runs_of_missing_values_merge(spark):
    s = stream(spark, [("a", e, m) for m, e in enumerate("vwxyz")])
    from pyspark.sql import functions as F

    kinds = s.add_segment("part", func=lambda df: F.when(df["event"].isin("v", "w", "z"), "p")).collapse_events(group_col="part").df.orderBy("__idx").collect()
    assert [(r["event"], r["__kind"]) for r in kinds] == [("p", "collapsed"), (None, "collapsed"), ("p", "collapsed")]
    for bad in ("event", "nothing"):
        with pytest.raises(ParameterError):
            s.collapse_events(group_col=bad)


def test_mistyped_names_in_patterns_raise(small):
    from trailspark.errors import PatternError

    for ask in (
        lambda: small.truncate_paths("[^oops]"), lambda: small.get_conversion_rate("x", "oops"), lambda: small.step_matrix_data(path_pattern="x->oops"), lambda: small.step_matrix_data(anchor="oops"),
        lambda: small.add_events("new", anchor="oops"), lambda: small.resolve_anchors("x->oops"), lambda: small.restrict_to_pattern("[x|oops]"), lambda: small.transition_graph_data(path_pattern="oops"), lambda: small.route_stats(["x", "oops"]),
    ):
        with pytest.raises(UnknownNameError):
            ask()
    assert small.truncate_paths(end_anchor=["oops", "y"]).df.columns == small.df.columns
    with pytest.raises(PatternError):
        small.rename_events({"y": "[x|z]"}).resolve_anchors("[x|z]")
    with pytest.raises(PatternError):
        small.rename_events({"y": "x|z"}).resolve_anchors("[x|z]->x")


def test_segment_sql_has_one_column(small):
    made = small.add_segment("part", sql="with t as (select 1) select case when event = 'x' then 'a' else 'b' end from eventstream")
    assert {(r["event"], r["part"]) for r in made.df.collect()} == {("x", "a"), ("y", "b"), ("path_start", "b")}
    for bad in ("select *, 'a' as part from eventstream", "select event from eventstream where event = 'x'"):
        with pytest.raises(ParameterError):
            small.add_segment("part", sql=bad)


def test_boundary_rows_need_no_second_shuffle(small):
    plan = small.transition_graph_data("count")._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.find("Initial Plan") :] if "Initial Plan" in plan else plan
    assert final.count("Exchange hashpartitioning(user_id") == 1


def test_levels_bring_only_what_is_asked(small):
    assert small.levels("event", ["x", "oops"]) == ["x"] and not small._levels


def test_clusters_over_a_grid(spark):
    import numpy as np

    rows = [(f"u{u}", e, k) for u in range(60) for k, e in enumerate(["x"] * (1 + 6 * (u % 3)) + ["y"] * (1 + 5 * (u % 2)))]
    s = stream(spark, rows)
    features = [{"metric": "event_count", "metric_args": {"event": e}} for e in "xy"]
    out = s.cluster_analysis_data(features, method_args={"n_clusters": [2, 6]}, nmf_components=[2])
    grid = out["silhouette"]
    assert grid["params"] == [{"n_clusters": 2, "nmf_components": 2}, {"n_clusters": 6, "nmf_components": 2}] and grid["best_index"] == 1
    assert out["best_params"] == {"method": "kmeans", "method_args": {"n_clusters": 6}, "scaler": "minmax", "nmf_components": 2}
    # weights times parts give the scaled features back, so cluster means do too
    means = np.array(list(out["nmf"]["W_cluster_means"].values())) @ np.array(out["nmf"]["H_matrix"])
    assert sorted(map(tuple, np.round(means, 1).tolist())) == [(0.0, 0.0), (0.0, 1.0), (0.5, 0.0), (0.5, 1.0), (1.0, 0.0), (1.0, 1.0)]
    chosen = s.cluster_analysis_data(features, n_clusters="2-3", select={"n_clusters": 3})
    assert chosen["n_clusters"] == 3 and chosen["silhouette"]["selected_index"] == 1
    same = s.add_clusters("c", features, n_clusters=6).df.select("user_id", "c").distinct().collect()
    groups = {}
    for r in same:
        groups.setdefault(r["c"], set()).add(int(r["user_id"][1:]) % 6)
    assert len(groups) == 6 and all(len(g) == 1 for g in groups.values())
    for bad in ({"method": "other"}, {"method_args": {"eps": 1}}, {"select": {"n_clusters": 9}}):
        with pytest.raises(ParameterError):
            s.cluster_analysis_data(features, **bad)


def test_distributions_follow_the_data(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    minutes = {f"u{i}": float(m) for i, m in enumerate(np.concatenate((rng.normal(50, 9, 80), rng.normal(70, 9, 120))))}
    rows = [(u, e, m) for u, t in minutes.items() for e, m in (("x", 0), ("y", round(t, 3)))]
    s = stream(spark, rows).add_segment("part", rules=[["user_id", "in", [f"u{i}" for i in range(80)], "low"], "high"])
    out = s.get_metric_distribution("part", "duration", ["low", "high"])
    seconds_of = np.array([round(t, 3) * 60 for t in minutes.values()])
    low, high = seconds_of[:80], seconds_of[80:]
    edges = np.histogram_bin_edges(seconds_of, "auto")
    assert not out["discrete"] and not out["log"] and np.allclose(out["edges"], edges, atol=1e-3)
    for name, own in (("low", low), ("high", high)):
        got = out["levels"][name]
        assert sum(got["histogram"]) == len(own) and np.abs(np.array(got["histogram"]) - np.histogram(own, edges)[0]).sum() <= 2
        x, y = map(np.array, got["density"])
        width = own.std(ddof=1) * len(own) ** -0.2
        assert np.allclose(y, np.exp(-0.5 * ((x[:, None] - own) / width) ** 2).mean(1) / (width * np.sqrt(2 * np.pi)), atol=1e-6)
    grid = np.sort(seconds_of)
    cdf = lambda own: np.searchsorted(np.sort(own), grid[:-1], "right") / len(own)
    assert out["distance"] == pytest.approx((np.abs(cdf(low) - cdf(high)) * np.diff(grid)).sum(), rel=1e-6)
    assert s.get_metric_distribution("part", "length")["levels"]["low"]["histogram"] == [80]


def test_payloads_are_whole_or_an_error(small):
    import json

    out = Stream.payload(small.transition_graph_data("proba_out"))
    assert json.loads(json.dumps(out)) == out and out["columns"] == ["src", "dst", "value"] and len(out["rows"]) == small.transition_graph_data("count").count()
    with pytest.raises(ParameterError):
        Stream.payload(small.transition_graph_data("count"), most_rows=1)


def test_differences_of_many_paths(spark):
    rows = [(u, e, 60 * k) for u in range(60) for k, e in enumerate("ab" if u % 2 else "ac")]
    s = Stream.from_dataframe(spark.createDataFrame(rows, "user_id int, event string, timestamp long"))
    odd, all_of = [u for u in range(60) if u % 2], list(range(60))
    got = {(r["src"], r["dst"]): r["value"] for r in s.transition_graph_data("count", diff=(odd, all_of)).collect()}
    assert got[("a", "b")] == 0 and got[("a", "c")] == -30 and got[("path_start", "a")] == -30
    assert {r["value"] for r in s.transition_graph_data("count", diff=([], [1])).collect()} == {-1.0}
    assert s.transition_graph_data("count", diff=([], [])).collect() == []
    plan = s.transition_graph_data("count", diff=(list(range(5000)), [1]))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" not in plan and " IN (" not in plan
