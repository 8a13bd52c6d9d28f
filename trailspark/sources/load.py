"""Frames become streams: types, roles, kinds and the order of events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..schema import DELIMITER, IDX, KIND, RANK, RANKS, TECHNICAL, StreamSchema


def as_timestamp(column: str, kind: T.DataType) -> Column:
    """Numbers count seconds, or parts of them by how many digits they have; strings are parsed."""
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.IntegralType):
        n = F.length(F.abs(c).cast("string"))
        micros = F.when(n <= 10, c * 1_000_000).when(n <= 13, c * 1_000).when(n <= 16, c).otherwise(F.expr(f"`{column}` div 1000"))
        return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def load(df: DataFrame, schema: StreamSchema, order_col: str | None = None, validate: bool = True) -> tuple[DataFrame, StreamSchema]:
    roles = [*schema.path_cols, schema.event_col, schema.timestamp_col, *schema.segment_cols, *(schema.custom_cols or ())]
    if missing := [c for c in roles if c not in df.columns]:
        raise SchemaError(f"no column {missing}; there are {df.columns}")
    if taken := [c for c in df.columns if c in TECHNICAL]:
        raise SchemaError(f"columns {taken} are the engine's own")
    if schema.custom_cols is None:
        schema = replace(schema, custom_cols=tuple(c for c in df.columns if c not in roles))
        roles = df.columns
    if validate:
        facts = df.agg(F.max(F.greatest(*(F.col(c).isNull() for c in schema.path_cols)) if len(schema.path_cols) > 1 else F.col(schema.path_col).isNull()).alias("nulls"), F.max(F.col(schema.event_col).contains(DELIMITER)).alias("names")).first()
        if facts["nulls"]:
            raise SchemaError(f"path columns {list(schema.path_cols)} have missing values")
        if facts["names"]:
            raise SchemaError(f"event names must not contain {DELIMITER!r}")
    order = "__order"
    rows = df.select(*roles, (F.col(order_col) if order_col else F.monotonically_increasing_id()).alias(order))
    rows = rows.withColumn(schema.timestamp_col, as_timestamp(schema.timestamp_col, df.schema[schema.timestamp_col].dataType)).withColumn(schema.event_col, F.col(schema.event_col).cast("string"))
    if schema.long_paths is not None:
        from ..operators.scan import numbered_by_ranges

        rows = numbered_by_ranges(rows, schema.path_col, [schema.timestamp_col, order], IDX)
        return rows.drop(order).withColumns({KIND: F.lit("raw"), RANK: F.lit(RANKS["raw"])}).select(*(c for c in rows.columns if c not in (order, IDX)), KIND, RANK, IDX), schema
    from pyspark.sql import Window

    w = Window.partitionBy(schema.path_col).orderBy(schema.timestamp_col, order)
    rows = rows.withColumns({KIND: F.lit("raw"), RANK: F.lit(RANKS["raw"]), IDX: F.row_number().over(w).cast("long")})
    return rows.drop(order), schema


def nesting_faults(df: DataFrame, schema: StreamSchema) -> DataFrame:
    """Finer path ids that lie in more than one coarser path."""
    parts = [df.filter(F.col(b).isNotNull()).groupBy(F.col(b).cast("string").alias("id")).agg(F.count_distinct(a).alias("n")).filter("n > 1").select(F.lit(b).alias("path_col"), "id", "n") for a, b in zip(schema.path_cols, schema.path_cols[1:], strict=False)]
    out = parts[0] if parts else df.sparkSession.createDataFrame([], "path_col string, id string, n long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_csv(spark: SparkSession, path: str, csv_schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.schema(csv_schema) if csv_schema is not None else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shop_events(spark: SparkSession, n_users: int = 600, seed: int = 42) -> DataFrame:
    """A made-up shop: users with sessions of a few events; hashes of (user, session, step) decide everything."""
    draw = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1000)) / 1000.0
    users = spark.range(n_users).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("user_id"), F.col("id").alias("u"))
    users = users.withColumn("platform", F.when(draw("u", F.lit("p")) < 0.6, "mobile").otherwise("desktop")).withColumn("acquisition_channel", F.element_at(F.array(*(F.lit(x) for x in ("ads", "organic", "referral"))), (draw("u", F.lit("c")) * 3).cast("int") + 1))
    s = users.withColumn("s", F.explode(F.sequence(F.lit(0), (F.lit(2) + draw("u", F.lit("n")) * 7).cast("int"))))
    s = s.withColumn("session_id", F.concat_ws("_", "user_id", F.col("s").cast("string"))).withColumn("day", (F.col("s") * 20 + draw("u", "s") * 19).cast("int"))
    steps = s.withColumn("k", F.explode(F.sequence(F.lit(0), (F.lit(1) + draw("u", "s", F.lit("l")) * 10).cast("int"))))
    x = draw("u", "s", "k")
    name = F.when(F.col("k") == 0, "main").when(x < 0.45, "catalog").when(x < 0.65, "product").when(x < 0.8, "cart").when(x < 0.9, "checkout").when(x < 0.96, "purchase").otherwise("support")
    ts = F.timestamp_micros((F.lit(1_704_067_200) + F.col("day") * 86_400 + F.col("k") * 60 + (x * 50).cast("long")) * 1_000_000).cast("timestamp_ntz")
    return steps.select("user_id", "session_id", name.alias("event"), ts.alias("timestamp"), "platform", "acquisition_channel")
