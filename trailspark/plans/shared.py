"""Tables between the jobs of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python workers get the package's functions with the task and needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and everything runs on one machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trailspark-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


class Tables:
    """Writes frames as tables, so that later plans start from files that outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tables/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    """Tables that are deleted at the end; what is returned from here must be kept elsewhere."""
    made = Tables(spark)
    try:
        yield made
    finally:
        jvm = spark.sparkContext._jvm
        for path in made.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
