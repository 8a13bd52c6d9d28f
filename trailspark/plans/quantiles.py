"""Exact quantiles by selection: histograms that are refined where a wanted rank lies.

``percentile`` keeps a counter for each distinct value of a group in one task.  Here values are counted where they are
dealt by value; the counts of coarse bins say in which bin a rank lies, those of its fine bins in which of
them, and only that bin's values are put in order.  A bin is a monotone function of the value, so no ranges are sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a unit of the logarithm: at most some 90,000 coarse bins of all doubles, and 2 ** 21 fine ones of each.
COARSE, FINE = 2.0**6, 2.0**27


def _bin(v: Column, scale: float) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(scale))


def _picked(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows (by, __j, __rank, n, ..) those in which rank ``__rank`` of the whole group's lies, the ranks now counted from their start."""
    start = F.sum("n").over(Window.partitionBy(*by, "__j").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("__start", start).filter((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("n"))).withColumn("__rank", F.col("__rank") - F.col("__start")).drop("n", "__start")


def quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """by, q (array): for each group the linearly interpolated quantiles of ``value``, missing values left out; ``by`` aren't missing.

    Without ``by`` there is one row, of missing values where there is none.
    """
    v = F.col("__v")
    counted = rows.select(*by, value.cast("double").alias("__v")).filter("__v is not null").groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select(*by, _bin(v, COARSE).alias("__b1"), _bin(v, FINE).alias("__b2"), "__v", "n")
    fine = counted.groupBy(*by, "__b1", "__b2").agg(F.sum("n").alias("n"))
    coarse = fine.groupBy(*by, "__b1").agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("__last", F.sum("n").over(Window.partitionBy(*by)) - 1)
    ranks = [f(F.lit(float(s)) * F.col("__last")).cast("long") for s in shares for f in (F.floor, F.ceil)]
    wanted = coarse.select(*by, "__b1", "n", "__last", F.posexplode(F.array(*ranks)).alias("__j", "__rank"))
    first = _picked(wanted, by, "__b1")
    second = _picked(first.join(fine, [*by, "__b1"]), by, "__b2")
    third = _picked(second.join(counted, [*by, "__b1", "__b2"]), by, "__v")
    at = lambda j: F.max(F.when(F.col("__j") == j, v))
    found = third.groupBy(*by).agg(F.max("__last").alias("__last"), *(at(j).alias(f"__x{j}") for j in range(2 * len(shares))))
    out = []
    for k, s in enumerate(shares):
        place, low, high = F.lit(float(s)) * F.col("__last"), F.col(f"__x{2 * k}"), F.col(f"__x{2 * k + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return found.select(*by, F.array(*out).alias("q"))


def is_count(df: DataFrame, column: str) -> bool:
    """Whether a column holds whole numbers: counts of a path's rows have few distinct values, which ``percentile`` may hold."""
    return isinstance(df.schema[column].dataType, (T.IntegralType, T.BooleanType))
