"""Filters and edits of rows, and samples of paths."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..schema import DELIMITER, MISSING, StreamSchema


def values_in(column: str, values) -> Column:
    """Whether a column has one of the values; ``MISSING`` among them stands for no value."""
    names = [values] if isinstance(values, str) else list(values)
    if MISSING not in names:
        return F.col(column).isin(*names)
    return F.col(column).isNull() | F.coalesce(F.col(column).isin(*(n for n in names if n != MISSING)), F.lit(False))


def filter_events(df: DataFrame, schema: StreamSchema, keep: dict | None = None, drop: dict | None = None, func=None, sql: str | None = None) -> DataFrame:
    if sum(x is not None for x in (keep, drop, func, sql)) > 1:
        raise ParameterError("give one of keep, drop, func and sql")
    if keep is not None:
        return df.filter(reduce(lambda a, b: a & b, [values_in(c, v) for c, v in keep.items()], F.lit(True)))
    if drop is not None:
        return df.filter(~reduce(lambda a, b: a | b, [values_in(c, v) for c, v in drop.items()], F.lit(False)))
    if func is not None:
        return df.filter(func(df))
    return run_sql(df, sql) if sql is not None else df


def run_sql(df: DataFrame, sql: str, same_columns: bool = True) -> DataFrame:
    """User SQL over the view ``eventstream``; the view is there only while the query is analysed."""
    spark, name = df.sparkSession, "eventstream"
    df.createOrReplaceTempView(name)
    try:
        out = spark.sql(sql)
    finally:
        spark.catalog.dropTempView(name)
    if same_columns and set(out.columns) != set(df.columns):
        raise ParameterError(f"the query must return the columns {sorted(df.columns)}, got {sorted(out.columns)}")
    return out.select(*df.columns) if same_columns else out


def check_names(names) -> None:
    if bad := sorted(n for n in names if DELIMITER in n):
        raise ParameterError(f"event names must not contain {DELIMITER!r}: {bad}")


def rename_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    if not mapping:
        return df
    names = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.coalesce(names[F.col(column)], F.col(column)))


def drop_events(df: DataFrame, schema: StreamSchema, names) -> DataFrame:
    return df.filter(~values_in(schema.event_col, names))


def edit_events(df: DataFrame, schema: StreamSchema, rename: dict | None, delete) -> DataFrame:
    rename, delete = dict(rename or {}), list(delete or ())
    if both := sorted(set(rename) & set(delete)):
        raise ParameterError(f"both renamed and deleted: {both}")
    check_names(rename.values())
    df = drop_events(df, schema, delete) if delete else df
    return rename_values(df, schema.event_col, rename)


def sample_paths(df: DataFrame, keys: list[str], n: int | None = None, frac: float | None = None, random_state: int = 0) -> DataFrame:
    """All rows of the paths drawn: exactly n of them (or all), or each with the odds ``frac``.

    A hash of the path decides, so the same seed draws the same paths wherever they lie.
    """
    if (n is None) == (frac is None):
        raise ParameterError("give one of n and frac")
    draw = F.xxhash64(*keys, F.lit(random_state))
    if frac is not None:
        if not 0 < frac <= 1:
            raise ParameterError("frac lies in (0, 1]")
        return df if frac == 1 else df.filter(F.pmod(draw, F.lit(1 << 30)) < int(frac * (1 << 30)))
    if isinstance(n, bool) or n < 1:
        raise ParameterError("n is a positive number")
    drawn = df.select(*keys).distinct().orderBy(draw, *keys).limit(n)
    return df.join(drawn, keys, "left_semi")


def temp_name(prefix: str) -> str:
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"
