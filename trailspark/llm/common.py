"""Shared pieces of the training-data operators: shared storage, hashing, Arrow loops."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers get the package's functions with the task and needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: Rows that a Python worker turns into objects at once; a batch of Arrow may be larger.
ROWS_AT_ONCE = 512
#: Bytes of an Arrow batch. The executor's buffer for a column of texts doubles as it fills; what exceeds a
#: chunk of its pool (4 MB) is taken from the system each time, and stays with its thread when freed.
BATCH_BYTES = "1m"
#: Words a worker keeps hashes of before it starts afresh.
CACHE_WORDS = 100_000
#: Keys a worker remembers to have handed on before it starts afresh.
KEYS_KEPT = 100_000

#: Where ``materialize`` notes the tables it writes, for ``tables_made``.
_made: ContextVar[list[str] | None] = ContextVar("tables made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests on one machine)."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="trailspark-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each SQL execution in here, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where: later plans start from files that outlive executors.

    What the write has shuffled is removed when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame) -> DataFrame:
    return written(df)[0]


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of the tables that are written in here, in order; those of an inner one are added to the outer one's."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        if (outer := _made.get()) is not None:
            outer.extend(made)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of ``materialize`` whose readers have finished."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build()`` returns, written; all tables that it wrote on the way are deleted, also if it fails."""
    with tables_made() as made:
        try:
            out = materialize(build())
            last = made.pop()
        finally:
            release(spark, made)
            made.clear()
        made.append(last)
    return out


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1 MB where the session has the default of 64: worker and executor hold each several times, outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # with None for a default, get gives None where nothing is set
        spark.conf.set(name, BATCH_BYTES)


def give_back() -> None:
    """What a task, or a fit on the driver, has freed goes back to the system: the process keeps it otherwise, and may wait long for its next use."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def kept(name: str, make: Callable[[], object]) -> object:
    """What this Python worker keeps under a name for later tasks of the same operator; made if it isn't there."""
    have = sys.__dict__.setdefault("_trailspark_kept", {})
    if name not in have:
        have[name] = make()
    return have[name]


def let_go() -> None:
    """A worker serves the tasks of many operators: what another one has kept would stay beside all that follows."""
    if sys.__dict__.pop("_trailspark_kept", None):
        give_back()


def lists_in(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as views of its values: no Python object for each value."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, edges = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in pairwise(edges.tolist())]
    return out


def arrow_map(df: DataFrame, schema: str, start: Callable[[], Callable[..., list[tuple]]], finish: bool = False, keeps: bool = False) -> DataFrame:
    """Run Python over ``df`` in Arrow batches, a bounded number of rows at a time.

    ``start()`` runs once in a task and returns ``step(*columns)``, which gets Python lists and
    returns a list of result columns (lists or numpy arrays).  With ``finish``, ``step.finish()``
    is called at the end for what the task has summed up.  With ``keeps``, what a worker has by ``kept`` stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    _small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        target = to_arrow_schema(struct)
        step = start()

        def pack(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(columns, target, strict=True)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                columns = step(*(c.to_pylist() for c in part.columns))
                if columns is not None and len(columns[0]):
                    yield pack(columns)
        if finish:
            columns = step.finish()
            if len(columns[0]):
                yield pack(columns)
        del step
        give_back()

    return df.mapInArrow(run, schema)


def arrow_column(returns: str, start: Callable[[], Callable[..., list]]) -> Callable[..., Column]:
    """A column computed by Python in Arrow batches; the row's other columns stay in the JVM.

    ``start()`` runs once in a task and returns ``step(*columns)``, which gets and returns Python lists,
    for a bounded number of rows at a time.
    """
    from pyspark.sql.pandas.functions import ArrowUDFType
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(returns)
    _small_batches(SparkSession.active())

    def run(batches: Iterator[tuple[pa.Array, ...] | pa.Array]) -> Iterator[pa.Array]:
        let_go()
        target, step = to_arrow_type(kind), start()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            parts = [pa.array(step(*(c.slice(at, ROWS_AT_ONCE).to_pylist() for c in columns)), type=target) for at in range(0, len(columns[0]), ROWS_AT_ONCE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=target)
        del step
        give_back()

    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR_ITER)


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[2]
    return h ^ (h >> np.uint64(29))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes; of the whole sequence as one where it is shorter."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : n + j]) * _MIX[0]
        out ^= out >> np.uint64(31)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for new columns that ``df`` doesn't have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text):
    """Native words ``[^\\x20\\x09-\\x0D]+`` of a text column, as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def let(value, body):
    """``body(value)`` with ``value`` computed once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
