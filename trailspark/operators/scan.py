"""Running values along paths: by one window for a path, or, for very long paths, by a scan in two levels.

With ``long_paths`` in the schema a path is cut into chunks of that many indexes.  A chunk is one task's work: it
has its own running values and one row that sums it up.  These few rows are scanned, and what comes before a
chunk is carried into it.  So no task sees a whole path, whatever its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import IDX, StreamSchema

CHUNK = "__chunk"
KINDS = ("number", "sum", "max", "min", "lag", "lead")


def running(df: DataFrame, schema: StreamSchema, keys: list[str], **specs: tuple) -> DataFrame:
    """``df`` with a column for each of ``specs``: name=(kind, value).

    number: place in the path; sum, max, min: of the rows up to this one; lag, lead: the value of the
    row before or behind.
    """
    w = schema.window(keys)
    if schema.long_paths is None:
        return df.withColumns({name: _over(kind, value, w) for name, (kind, value) in specs.items()})
    values = {f"__v_{n}": v for n, (k, v) in specs.items() if k != "number"}
    rows = df.withColumns({CHUNK: F.floor(F.col(IDX) / F.lit(schema.long_paths)), **values})
    w = Window.partitionBy(*keys, CHUNK).orderBy(*schema.order())
    place = F.struct(*schema.order())
    ends = {"lag": F.max_by, "lead": F.min_by}
    sums = {"number": lambda v: F.count(F.lit(1)), "sum": F.sum, "max": F.max, "min": F.min}
    parts = rows.groupBy(*keys, CHUNK).agg(*((ends[k](F.struct(F.col(f"__v_{n}").alias("v")), place) if k in ends else sums[k](F.col(f"__v_{n}")) if k != "number" else F.count(F.lit(1))).alias(f"__c_{n}") for n, (k, _) in specs.items()))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carries = {"number": lambda c: F.sum(c).over(before), "sum": lambda c: F.sum(c).over(before), "max": lambda c: F.max(c).over(before), "min": lambda c: F.min(c).over(before), "lag": lambda c: F.lag(c).over(chunks), "lead": lambda c: F.lead(c).over(chunks)}
    carried = parts.select(*keys, CHUNK, *(carries[k](f"__c_{n}").alias(f"__c_{n}") for n, (k, _) in specs.items()))
    carried = carried.filter(reduce(lambda a, b: a | b, (F.col(f"__c_{n}").isNotNull() for n in specs)))
    names = {c: f"__k{j}" for j, c in enumerate([*keys, CHUNK])}
    carried = carried.select(*(F.col(c).alias(a) for c, a in names.items()), *(f"__c_{n}" for n in specs))
    local = rows.withColumns({n: _over(k, F.col(f"__v_{n}") if k != "number" else None, w) for n, (k, _) in specs.items()} | {"__edge_lag": F.row_number().over(w) == 1, "__edge_lead": F.lead(F.lit(1)).over(w).isNull()})
    both = local.join(carried, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(a)) for c, a in names.items())), "left")
    out = both.withColumns({n: _joined(k, n) for n, (k, _) in specs.items()})
    return out.select(*(c for c in df.columns if c not in specs), *specs)


def _over(kind: str, value: Column | None, w) -> Column:
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return {
        "number": lambda: F.row_number().over(w).cast("long"), "sum": lambda: F.sum(value).over(so_far), "max": lambda: F.max(value).over(so_far),
        "min": lambda: F.min(value).over(so_far), "lag": lambda: F.lag(value).over(w), "lead": lambda: F.lead(value).over(w),
    }[kind]()


def _joined(kind: str, name: str) -> Column:
    """A chunk's own running value and what is carried into it."""
    own, carry = F.col(name), F.col(f"__c_{name}")
    if kind in ("lag", "lead"):
        return F.when(F.col(f"__edge_{kind}"), carry["v"]).otherwise(own)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(own, carry)
    return F.when(own.isNull(), carry).otherwise(own + F.coalesce(carry, F.lit(0)))


def numbered_by_ranges(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their places in the path of ``key``: dealt by ranges, so that a long path is many tasks' work.

    The rows are written once: their places rest on the ranges, which mustn't change.
    """
    from ..plans.shared import Tables

    keep = Tables(rows.sparkSession)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = keep.keep(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumns({"__p": F.spark_partition_id(), "__at": at}))
    counts = ranges.groupBy("__p", key).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("f"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keep.keep(counts.select(F.col("__p").alias("__q"), F.col(key).alias("__k"), (before - F.col("f") + 1).alias("__start")))
    both = ranges.join(starts, (F.col("__p") == F.col("__q")) & F.col(key).eqNullSafe(F.col("__k")))
    return both.withColumn(name, F.col("__at") + F.col("__start")).drop("__p", "__at", "__q", "__k", "__start")
