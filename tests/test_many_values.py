"""Registered queries where the data has more distinct values than the test tables."""

import datetime

import duckdb
import numpy as np
import pytest
from test_density import alike, brute
from trailspark import registry
from trailspark.plans import density
from trailspark.plans.shared import tables

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def equals_sql(spark, folder, name, rows):
    """Whether a query over events (user, event, hour) equals its SQL."""
    day = datetime.datetime(2024, 1, 1)
    table = [(k, day + datetime.timedelta(hours=h, seconds=k % 3600), u, e, 1.0, "{}") for k, (u, e, h) in enumerate(rows)]
    spark.createDataFrame(table, EVENTS).write.parquet(f"{folder}/events.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    own = sorted(repr([r[c] for c in columns]) for r in df.collect())
    return own == sorted(map(repr, map(list, cursor.fetchall()))) and len(own)


def test_a_bar_for_each_of_many_counts(spark, tmp_path):
    rows = [(u, e, u % 4) for u in range(40) for e in ["view"] + ["purchase"] * (u // 3 if u < 36 else 300)]
    assert equals_sql(spark, tmp_path, "distribution_counts", rows) == 3 * 13


def test_clusters_by_more_levels_than_columns(spark, tmp_path, monkeypatch):
    """Points hold the levels that paths have, and no list of all levels reaches the driver."""
    from trailspark import Stream
    from trailspark.plans import learned

    widths, asked = [], []
    model, levels = learned.density_model, Stream.levels
    monkeypatch.setattr(learned, "density_model", lambda points, *a: widths.append(max(len(r["x"]) for r in points.collect())) or model(points, *a))
    monkeypatch.setattr(Stream, "levels", lambda self, column, *a: asked.append(column) or levels(self, column, *a))
    rows = [(u, "view", u % 24) for u in range(4000)]
    assert equals_sql(spark, tmp_path, "clusters_density", rows) == 4
    assert widths == [2] and asked == []


METRICS = [
    [{"metric": "in_segment_bulk"}],
    [{"metric": "in_segment_bulk", "metric_args": {"segment_name": "part", "mode": "all"}}, "length"],
    [{"metric": "in_segment_bulk", "metric_args": {"mode": "event_share"}}, {"metric": "time_between", "metric_args": {"start_event": "e1", "end_event": "e0"}}],
    [{"metric": "in_segment_bulk", "metric_args": {"mode": "event_share", "threshold": 0.5}}, {"metric": "event_count_bulk"}],
    [{"metric": "event_count_bulk"}, {"metric": "has_event_bulk"}],
    [{"metric": "event_count_bulk"}, {"metric": "event_count", "metric_args": {"event": "e1"}}],  # one column from two metrics
]


@pytest.mark.parametrize("metrics", METRICS)
@pytest.mark.parametrize("scaler", ["minmax", None])
def test_entries_are_the_columns_that_are_not_0(spark, metrics, scaler):
    from trailspark import Stream
    from trailspark.functions.metrics import open_metrics, path_entries, path_metrics
    from trailspark.plans.learned import scaled, sparse_points

    rng = np.random.default_rng(4)
    rows = [(u, f"e{rng.integers(0, 4 if u else 1)}", 60 * k, None if rng.random() < 0.2 else f"p{rng.integers(0, 3)}") for u in range(30) for k in range(rng.integers(1, 5))]
    s = Stream.from_dataframe(spark.createDataFrame([*rows, (99, "e0", 0, None)], "user_id int, event string, timestamp long, part string"), {"segment_cols": ["part"]})
    found, rest = open_metrics(metrics, s.schema, ["user_id"], s.levels)
    assert bool(found) == (metrics is not METRICS[-1])
    if not found:
        return
    values, names = path_metrics(s.df, s.schema, ["user_id"], metrics, s.levels)
    features = list(dict.fromkeys(n for group in names for n in group))
    wide = {r["user_id"]: sorted(r[f"__f{k}"] for k in range(len(features)) if r[f"__f{k}"] != 0) for r in scaled(values, features, scaler).collect()}
    with tables(spark) as keep:
        points = {r["user_id"]: r["__x"] for r in sparse_points(path_entries(s.df, s.schema, ["user_id"], found, rest, s.levels), ["user_id"], scaler, keep).collect()}
    assert all(x[::2] == sorted(set(x[::2])) for x in points.values())
    assert {u: sorted(x[1::2]) for u, x in points.items()} == wide and len(wide) == 31


@pytest.mark.parametrize("ties", [False, True])
def test_sparse_points_over_blocks_against_brute_force(spark, monkeypatch, ties):
    monkeypatch.setattr(density, "POINTS_IN_BLOCK", 60)
    monkeypatch.setattr(density, "LEAF", 16)
    monkeypatch.setattr(density, "AXES", 6)
    rng = np.random.default_rng(7)
    x = np.zeros((260, 90))
    for k in range(200):  # four groups of ten dimensions of their own, and points with a few of all
        own = 10 * (k % 4) + rng.integers(0, 10, 4 if k % 4 else 8)
        x[k, own] = rng.integers(1, 3, len(own)) if ties else rng.normal(3, 0.4, len(own))
    for k in range(200, 260):
        x[k, rng.integers(0, 90, 3)] = rng.integers(1, 4, 3) if ties else rng.normal(3, 2, 3)
    x = np.unique(x, axis=0)
    pairs = [([v for d in np.flatnonzero(r).tolist() for v in (float(d), float(r[d]))], 1) for r in x]
    with tables(spark) as keep:
        points = keep.keep(spark.createDataFrame(pairs, "x array<double>, g long"))
        at = density.points_with_cores(points, 4, keep, density.Space(density.widest_axes(points)))[0]
        assert at.select("b").distinct().count() > 3 and at.groupBy("b").count().agg({"count": "max"}).first()[0] < 130
        got = {tuple(r["x"]): r["label"] for r in density.density_model(points, 4, keep, True).labels(points).collect()}
    labels, expected = np.array([got[tuple(p)] for p, _ in pairs]), brute(x, 4)
    assert alike(labels, expected) and len(set(labels.tolist())) > 2


def test_equal_dimensions_of_one_point_each_fill_blocks_evenly():
    x = [[float(d), 1.0] for d in range(3000)]
    block = density.Cuts(density.Space(np.arange(32)).cuttable(x[:1000]), 8, True).of(density.Space(np.arange(32)).cuttable(x))
    assert np.bincount(block, minlength=8).max() < 2 * 3000 / 8


def test_no_coordinates_at_all(spark):
    with tables(spark) as keep:
        points = keep.keep(spark.createDataFrame([([], 7)], "x array<double>, g long"))
        assert [r["label"] for r in density.density_model(points, 3, keep, True).labels(points).collect()] == [density.NOISE]
