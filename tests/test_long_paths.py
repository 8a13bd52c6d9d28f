"""Scans in two levels: the same answers as by windows, with ties, missing values and paths of one row, and no task with a whole path."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark import Stream
from trailspark.errors import SchemaError
from trailspark.operators.scan import KINDS, running


def stream(spark, long_paths):
    rng = random.Random(7)
    rows = [(u, rng.choice("abcx"), 1000 + rng.randrange(3000), rng.choice([None, "g", "h"]), k) for u in range(6) for k in range([1, 2, 3, 17, 40, 150][u])]
    df = spark.createDataFrame(rows, "user_id int, event string, timestamp long, part string, k long").repartition(5)
    return Stream.from_dataframe(df, {"path_cols": ["user_id"], "segment_cols": ["part"], "long_paths": long_paths}, order_col="k")


ASK = {
    "places": lambda s: s.df.select("user_id", "k", "__idx"),
    "sessions": lambda s: s.split_sessions(timeout="20s").df.select("user_id", "k", "session_id", "session_index"),
    "separator": lambda s: s.split_sessions(separator="x", timeout="60s").df.select("user_id", "k", "session_id"),
    "bounds": lambda s: s.split_sessions(bounds={"start_event": "a", "end_event": ["b", "x"]}).df.select("user_id", "k", "session_id"),
    "sessions of sessions": lambda s: s.split_sessions(separator="x").split_sessions(timeout="10s", session_col="inner", session_index_col="inner_index", path_col="session_id").df.select("user_id", "k", "inner"),
    "loops": lambda s: s.collapse_events(loops=True, agg={"k": "max"}).df.select("user_id", "event", "k", "__kind"),
    "group": lambda s: s.collapse_events(group_col="part", agg={"k": "max"}, timeout="30s").df.select("user_id", "event", "k", "__kind"),
    "groups": lambda s: s.collapse_events(event_groups=["a", "b"], name="ab", agg={"k": "min"}).df.select("user_id", "event", "k"),
    "funnel": lambda s: s.funnel_data(["a", "b", "a", "x"]),
    "edges": lambda s: s.transition_graph_data("count"),
    "times": lambda s: s.transition_graph_data("time_median"),
    "edges of sessions": lambda s: s.split_sessions(separator="x").transition_graph_data("unique_paths", path_col="session_id"),
    "steps": lambda s: s.step_matrix_data(max_steps=30),
    "difference": lambda s: s.step_matrix_data(max_steps=4, diff=("part", "g", "<REST>")),
}


@pytest.mark.parametrize("name", ASK)
def test_chunks_give_what_windows_give(spark, name):
    whole, cut = (sorted(map(str, ASK[name](stream(spark, n)).collect())) for n in (None, 4))
    assert whole == cut and whole


def test_kinds_by_hand(spark):
    df = spark.createDataFrame([(1, i, 0, "e", v) for i, v in enumerate([None, 3, None, 5, 1, None, 2], 1)], "p int, __idx long, __rank int, event string, v int")
    schema = stream(spark, 2).schema
    out = running(df, schema, ["p"], **{k: (k, F.col("v")) for k in KINDS}).orderBy("__idx").collect()
    got = {k: [r[k] for r in out] for k in KINDS}
    assert got == {
        "number": [1, 2, 3, 4, 5, 6, 7], "sum": [None, 3, 3, 8, 9, 9, 11], "max": [None, 3, 3, 5, 5, 5, 5], "min": [None, 3, 3, 3, 1, 1, 1],
        "lag": [None, None, 3, None, 5, 1, None], "lead": [3, None, 5, 1, None, 2, None],
    }


def test_a_long_path_is_many_tasks_work(spark):
    n, before = 60_000, spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(n).select(F.lit(1).alias("user_id"), F.when(F.col("id") % 7 == 0, "a").otherwise("b").alias("event"), (F.col("id") * 60).alias("timestamp"), "id")
        s = Stream.from_dataframe(df, {"path_cols": ["user_id"], "long_paths": 2000}, order_col="id")
        out = s.split_sessions(timeout="30s")
        rows = out.df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max("session_index").alias("last")).collect()
        assert sum(r["n"] for r in rows) == n and max(r["n"] for r in rows) < 0.6 * n and max(r["last"] for r in rows) == n
        assert s.df.agg(F.sum(F.col("__idx") - F.col("id") - 1)).first()[0] == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_schema_checks_the_length(spark):
    for bad in (0, -1, "9", True):
        with pytest.raises(SchemaError):
            stream(spark, bad)


def test_empty_stream(spark):
    df = spark.createDataFrame([], "user_id int, event string, timestamp long, k long")
    s = Stream.from_dataframe(df, {"path_cols": ["user_id"], "long_paths": 3}, order_col="k", strict=False)
    assert s.split_sessions(timeout="1m").df.collect() == [] and s.transition_graph_data().collect() == []
