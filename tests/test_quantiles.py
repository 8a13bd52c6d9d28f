"""Quantiles by selection against NumPy and the built-in function: ties, signs, tails, groups of one value, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailspark.plans.quantiles import quantiles

SHARES = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.95, 1.0]


def groups():
    rng = np.random.default_rng(12)
    return {
        "normal": rng.normal(0, 10, 501), "tail": rng.pareto(0.6, 400), "ties": rng.integers(-3, 4, 300).astype(float), "times": 1.7e9 + rng.integers(0, 86_400_000_000, 600) / 1e6,
        "tiny": rng.normal(0, 1e-12, 200), "one": np.array([4.5]), "same": np.full(50, -2.0), "two": np.array([1e300, -1e300]), "zeros": np.array([0.0, -0.0, 0.0, 1.0]),
    }


def test_groups_against_numpy(spark):
    data = groups()
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("one", None), ("none", None)]
    out = {r["g"]: r["q"] for r in quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], F.col("x"), SHARES).collect()}
    assert set(out) == set(data)
    for g, xs in data.items():
        if g != "two":
            assert out[g] == pytest.approx(np.quantile(xs, SHARES), rel=1e-12, abs=1e-24), g
    assert out["two"][0] == -1e300 and out["two"][-1] == 1e300


def test_equal_to_the_built_in_function(spark):
    rows = [(int(k) % 5, float(x)) for k, x in enumerate(np.random.default_rng(2).lognormal(3, 2, 2000))]
    df = spark.createDataFrame(rows, "g int, x double")
    built_in = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    assert {r["g"]: r["q"] for r in quantiles(df, ["g"], F.col("x"), SHARES).collect()} == built_in


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "x double")
    assert quantiles(df, [], F.col("x"), [0.5, 0.25]).collect()[0]["q"] == [5.0, 2.5]
    assert [r["q"] for r in quantiles(df.filter("x < 0"), [], F.col("x"), [0.5]).collect()] == [[None]]
    assert quantiles(df.filter("x < 0"), ["x"], F.col("x"), [0.5]).collect() == []


def test_no_buffer_of_all_values(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.rand(1).alias("x"))
    plan = quantiles(df, ["g"], F.col("x"), [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
