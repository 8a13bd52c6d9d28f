"""Roles of columns, technical columns, and the order of events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .errors import ParameterError, SchemaError

KIND, IDX, RANK = "__kind", "__idx", "__rank"
TECHNICAL = (KIND, IDX, RANK)
PATH_START, PATH_END = "path_start", "path_end"
BOUNDS = (PATH_START, PATH_END)
#: Where a kind of row stands among rows of one index.
RANKS = {PATH_START: 0, "synthetic": 1, "raw": 2, "collapsed": 2, "churn": 3, PATH_END: 4}
DELIMITER = "->"
MISSING = "<MISSING>"
REST = "<REST>"


@dataclass(frozen=True)
class StreamSchema:
    """Which column plays which part; ``path_cols`` go from coarse to fine and nest."""

    path_cols: tuple[str, ...] = ("user_id",)
    event_col: str = "event"
    timestamp_col: str = "timestamp"
    segment_cols: tuple[str, ...] = ()
    custom_cols: tuple[str, ...] | None = field(default=None)
    #: Indexes of a chunk where paths may be too long for one task; None where each path is one task's work.
    long_paths: int | None = None

    def __post_init__(self) -> None:
        for name in ("path_cols", "segment_cols", "custom_cols"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise SchemaError(f"{name} is a list of columns, got {value!r}")
            if value is not None:
                object.__setattr__(self, name, tuple(value))
        if not self.path_cols:
            raise SchemaError("path_cols must name at least one column")
        if self.long_paths is not None and (isinstance(self.long_paths, bool) or not isinstance(self.long_paths, int) or self.long_paths < 1):
            raise SchemaError(f"long_paths is a positive number of indexes, got {self.long_paths!r}")
        names = [*self.path_cols, self.event_col, self.timestamp_col, *self.segment_cols, *(self.custom_cols or ())]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise SchemaError(f"columns with more than one role: {twice}")

    @classmethod
    def of(cls, value: StreamSchema | dict | None) -> StreamSchema:
        if value is None:
            return cls()
        if isinstance(value, StreamSchema):
            return value
        known = cls.__dataclass_fields__
        for key in value:
            if key not in known:
                near = get_close_matches(key, known, 1)
                raise SchemaError(f"unknown schema key {key!r}" + (f", did you mean {near[0]!r}?" if near else ""))
        return cls(**value)

    @property
    def path_col(self) -> str:
        return self.path_cols[0]

    def keys(self, path_col: str | None = None) -> list[str]:
        """Columns that identify a path at a grain: the grain and all coarser ones.

        A hash of the coarsest one serves every grain, so one shuffle does.
        """
        if path_col is None:
            path_col = self.path_col
        if path_col not in self.path_cols:
            raise ParameterError(f"path_col must be one of {list(self.path_cols)}, got {path_col!r}")
        return list(self.path_cols[: self.path_cols.index(path_col) + 1])

    def window(self, keys: Sequence[str]) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy(*self.order())

    def backwards(self, keys: Sequence[str]) -> WindowSpec:
        return Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in (IDX, RANK, self.event_col)))

    def order(self) -> list[str]:
        """Rows of one index stand by rank, and if that ties by name."""
        return [IDX, RANK, self.event_col]

    def with_segment(self, name: str) -> StreamSchema:
        custom = None if self.custom_cols is None else tuple(c for c in self.custom_cols if c != name)
        return self if name in self.segment_cols else replace(self, segment_cols=(*self.segment_cols, name), custom_cols=custom)

    def as_dict(self) -> dict:
        return {"path_cols": list(self.path_cols), "event_col": self.event_col, "timestamp_col": self.timestamp_col, "segment_cols": list(self.segment_cols), "custom_cols": None if self.custom_cols is None else list(self.custom_cols)}


def micros(column: Column | str) -> Column:
    """Microseconds of a timestamp, with or without zone."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return (micros(b) - micros(a)) / F.lit(1e6)


def is_bound() -> Column:
    return F.col(KIND).isin(*BOUNDS)


def without_bounds(df: DataFrame) -> DataFrame:
    return df.filter(~is_bound())
