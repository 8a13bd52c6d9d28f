"""The pattern language of paths, and its resolution to positions by window functions.

    pattern := token ("->" token)*
    token   := NAME | "." | "[" ["^"] NAME ("|" NAME)* "]" | GAP
    GAP     := ".*" | "[" ["^"] NAME ("|" NAME)* "]" "*"
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ParameterError, PatternError, UnknownNameError
from ..operators.scan import running
from ..schema import BOUNDS, DELIMITER, IDX, KIND, PATH_END, PATH_START, RANK, RANKS, StreamSchema, is_bound, micros, without_bounds
from .durations import seconds


@dataclass(frozen=True)
class Token:
    """A class of events; no names and ``negated`` is any event."""

    names: tuple[str, ...]
    negated: bool = False
    gap: bool = False
    shaped: bool = False

    @property
    def spellings(self) -> list[str]:
        """What an event would be named that is written like this class."""
        if not self.names or not (self.shaped or len(self.names) > 1):
            return []
        inner = "|".join(self.names)
        whole = f"[{'^' if self.negated else ''}{inner}]"
        return [whole, *([inner] if len(self.names) > 1 else [])]

    @property
    def plain_gap(self) -> bool:
        return self.gap and self.negated and not self.names

    def matches(self, event: Column) -> Column:
        """Whether this token takes the event; boundary events only where named."""
        if not self.negated:
            return event.isin(*self.names)
        hidden = [*self.names, *BOUNDS]
        return ~event.isin(*hidden)

    def breaks(self, event: Column) -> Column | None:
        """Whether an event in a gap breaks it; boundary events never do."""
        if self.plain_gap:
            return None
        bad = event.isin(*self.names) if self.negated else ~event.isin(*self.names)
        return bad & ~event.isin(*BOUNDS)


_CLASS = re.compile(r"^\[(\^?)([^\[\]]*)\](\*?)$")


def parse_token(text: str) -> Token:
    t = text.strip()
    if not t:
        raise PatternError("a pattern has an empty token")
    if t == ".":
        return Token((), True)
    if t == ".*":
        return Token((), True, True)
    if t.startswith("["):
        m = _CLASS.match(t)
        if not m:
            raise PatternError(f"{t!r}: a class is [a|b] or [^a|b], with * behind it a gap")
        names = tuple(n.strip() for n in m[2].split("|"))
        if not all(names):
            raise PatternError(f"{t!r}: a class has an empty member")
        return Token(names, bool(m[1]), bool(m[3]), True)
    if "[" in t or "]" in t:
        raise PatternError(f"{t!r}: brackets don't match, or a class spans {DELIMITER!r}")
    return Token((t,))


@dataclass(frozen=True)
class Pattern:
    """Parts of adjacent tokens, and the gap before each part but the first."""

    parts: tuple[tuple[Token, ...], ...]
    gaps: tuple[Token, ...]

    @property
    def tokens(self) -> list[Token]:
        return [t for p in self.parts for t in p]

    @property
    def named_bounds(self) -> set[str]:
        return {n for t in self.tokens if not t.negated for n in t.names if n in BOUNDS}

    def place(self, ordinal: int) -> tuple[int, int]:
        """Part and place in it of a token, counted from 0, or from the end below 0."""
        n = len(self.tokens)
        if not -n <= ordinal < n:
            raise ParameterError(f"at: the pattern has {n} tokens, got {ordinal}")
        ordinal %= n
        for i, p in enumerate(self.parts):
            if ordinal < len(p):
                return i, ordinal
            ordinal -= len(p)
        raise AssertionError

    def candidates(self) -> set[str]:
        """Names that ``check_names`` asks about."""
        out: set[str] = set()
        for t in (*self.tokens, *self.gaps):
            out |= {*t.names, *t.spellings}
            for n in t.names:
                out |= {n[1:], n[:-1]}
        return out - {""}

    def check_names(self, known: set[str], absent_narrows: bool = False) -> None:
        """Raise for a name that is no event, and for a class that reads like the name of one.

        With ``absent_narrows`` only names in negated classes must be known: without them those match more.
        """
        for token in (*self.tokens, *self.gaps):
            if both := [s for s in token.spellings if s in known]:
                raise PatternError(f"{both[0]!r} reads as a class of events, but an event has that name; rename it first")
        known = known | set(BOUNDS)
        for token in (*self.tokens, *self.gaps):
            for name in token.names:
                if name in known or absent_narrows and not token.negated and not (name.startswith("^") or name.endswith("$") or "|" in name):
                    continue
                hint = ""
                if name.startswith("^") and name[1:] in known:
                    hint = f"; to start at it, write path_start{DELIMITER}{name[1:]}, to exclude it [^{name[1:]}]"
                elif name.endswith("$") and name[:-1] in known:
                    hint = f"; to end at it, write {name[:-1]}{DELIMITER}path_end"
                elif "|" in name:
                    hint = f"; a choice is written [{name.strip('()')}]"
                raise UnknownNameError(f"no event is named {name!r}{hint}")


def parse_pattern(text: str) -> Pattern:
    """Gaps at either end mean nothing and go, with a warning; repeated plain gaps are one."""
    if not isinstance(text, str) or not text.strip():
        raise PatternError(f"a pattern is a non-empty string, got {text!r}")
    tokens = [parse_token(t) for t in text.split(DELIMITER)]
    while tokens and tokens[0].plain_gap or tokens and tokens[-1].plain_gap:
        warnings.warn(f"{text!r}: a gap at the end of a pattern has no effect", stacklevel=2)
        tokens = tokens[1:] if tokens[0].plain_gap else tokens[:-1]
    if not tokens:
        raise PatternError(f"{text!r} holds nothing but gaps")
    if tokens[0].gap or tokens[-1].gap:
        raise PatternError(f"{text!r}: a restricted gap needs tokens on both sides")
    parts: list[list[Token]] = [[]]
    gaps: list[Token] = []
    for k, t in enumerate(tokens):
        if not t.gap:
            parts[-1].append(t)
        elif tokens[k - 1].gap:
            if not (t.plain_gap and tokens[k - 1].plain_gap):
                raise PatternError(f"{text!r}: two gaps in a row")
        else:
            gaps.append(t)
            parts.append([])
    if all(t.negated for t in tokens if not t.gap):
        warnings.warn(f"{text!r} names no event that must occur", stacklevel=2)
    return Pattern(tuple(map(tuple, parts)), tuple(gaps))


def with_virtual_bounds(df: DataFrame, schema: StreamSchema, keys: list[str], event: str) -> DataFrame:
    """Boundary rows around each path, in place of any it has, by one explode; event names them in ``event`` too."""
    real = without_bounds(df)
    columns = real.columns
    flagged = running(real, schema, keys, __place=("number", None), __next=("lead", F.col(IDX)))
    flagged = flagged.withColumns({"__first": F.col("__place") == 1, "__last": F.col("__next").isNull()})
    # keys stay outside of what is unfolded, so the partitioning by them stays known
    inside = [c for c in columns if c not in keys]
    names = {schema.event_col, event}

    def as_bound(kind: str) -> Column:
        return F.struct(*(F.lit(kind).alias(c) if c in names or c == KIND else F.lit(RANKS[kind]).alias(c) if c == RANK else F.col(c) for c in inside))

    own = F.struct(*(F.col(c) for c in inside))
    rows = F.array_compact(F.array(F.when(F.col("__first"), as_bound(PATH_START)), own, F.when(F.col("__last"), as_bound(PATH_END))))
    return flagged.select(*keys, F.inline(rows)).select(*columns)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


@dataclass
class Matches:
    """``df`` with the step of each row and, for each part, whether a valid match has it start there."""

    df: DataFrame
    ok: list[str]
    step: str
    event: str


class Resolver:
    """Finds a pattern in paths: where each part can start so that the whole pattern matches.

    A part can start at a row if a valid match of the parts before ends ahead of it and one of the parts
    behind follows.  Both are running extremes over one window of the path, the second over the same
    window backwards; there is one shuffle, no join and no list of a path's events.
    """

    def __init__(self, schema: StreamSchema, keys: list[str], pattern: str | Pattern, event_col: str | None = None, tag: str = "m"):
        self.schema, self.keys, self.tag = schema, keys, tag
        self.pattern = parse_pattern(pattern) if isinstance(pattern, str) else pattern
        self.event = event_col or schema.event_col
        self.w, self.back = schema.window(keys), schema.backwards(keys)

    def prepare(self, df: DataFrame, bounds: bool | None = None) -> DataFrame:
        """Rows the pattern looks at, with steps: real rows from 1, boundary rows (if it names them) around them."""
        bounds = bool(self.pattern.named_bounds) if bounds is None else bounds
        rows = with_virtual_bounds(df, self.schema, self.keys, self.event) if bounds else without_bounds(df)
        return rows.withColumn("__step", F.row_number().over(self.w).cast("long") - (1 if bounds else 0))

    def _candidates(self, df: DataFrame, allowed: Column | None, allowed_from: int) -> DataFrame:
        for i, part in enumerate(self.pattern.parts):
            found = reduce(lambda a, b: a & b, [t.matches(F.lead(self.event, k).over(self.w) if k else F.col(self.event)) for k, t in enumerate(part)])
            if allowed is not None and i >= allowed_from:
                found = found & allowed
            df = df.withColumn(f"__{self.tag}c{i}", F.coalesce(found, F.lit(False)))
        return df

    def forward(self, df: DataFrame, allowed: Column | None = None, allowed_from: int = 0) -> DataFrame:
        """Adds f0.. : whether a part can start here given the parts before it."""
        df, t, step = self._candidates(df, allowed, allowed_from), self.tag, F.col("__step")
        past = self.w.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(f"__{t}f0", F.col(f"__{t}c0"))
        for i in range(1, len(self.pattern.parts)):
            length = len(self.pattern.parts[i - 1])
            ended = F.lag(f"__{t}f{i - 1}", length - 1).over(self.w) if length > 1 else F.col(f"__{t}f{i - 1}")
            df = df.withColumn(f"__{t}e", F.when(ended, step))
            previous = F.max(f"__{t}e").over(past)
            good = F.col(f"__{t}c{i}") & previous.isNotNull()
            if (bad := self.pattern.gaps[i - 1].breaks(F.col(self.event))) is not None:
                good = good & (previous >= F.coalesce(F.max(F.when(bad, step)).over(past), F.lit(-1)))
            df = df.withColumn(f"__{t}f{i}", F.coalesce(good, F.lit(False))).drop(f"__{t}e")
        return df

    def resolve(self, df: DataFrame, allowed: Column | None = None, allowed_from: int = 0) -> Matches:
        df, t, step = self.forward(df, allowed, allowed_from), self.tag, F.col("__step")
        m = len(self.pattern.parts)
        past = self.back.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(f"__{t}ok{m - 1}", F.col(f"__{t}f{m - 1}")).withColumn(f"__{t}b{m - 1}", F.col(f"__{t}c{m - 1}"))
        for i in range(m - 2, -1, -1):
            follows = F.min(F.when(F.col(f"__{t}b{i + 1}"), step)).over(past)
            good = follows.isNotNull()
            if (bad := self.pattern.gaps[i].breaks(F.col(self.event))) is not None:
                good = good & (follows <= F.coalesce(F.min(F.when(bad, step)).over(past), F.lit(2**62)))
            length = len(self.pattern.parts[i])
            df = df.withColumn(f"__{t}x", F.coalesce(good, F.lit(False)))
            if length > 1:
                df = df.withColumn(f"__{t}x", F.lag(f"__{t}x", length - 1).over(self.back))
            df = df.withColumn(f"__{t}b{i}", F.coalesce(F.col(f"__{t}c{i}") & F.col(f"__{t}x"), F.lit(False))).drop(f"__{t}x")
            df = df.withColumn(f"__{t}ok{i}", F.col(f"__{t}f{i}") & F.col(f"__{t}b{i}"))
        drop = [f"__{t}{k}{i}" for k in "cfb" for i in range(m)]
        return Matches(df.drop(*drop), [f"__{t}ok{i}" for i in range(m)], "__step", self.event)


@dataclass(frozen=True)
class AnchorSpec:
    """A position: a pattern, which of its tokens, which match, and an offset from there."""

    pattern: str
    at: int | str = "end"
    occurrence: str = "first"
    offset: int | str | None = None
    offset_side: str | None = None
    event_col: str | None = None

    def __post_init__(self) -> None:
        parsed = parse_pattern(self.pattern)
        parsed.place(self.ordinal)
        if self.occurrence not in ("first", "last", "all"):
            raise ParameterError(f"occurrence is first, last or all, got {self.occurrence!r}")
        if self.offset_side not in (None, "start", "end"):
            raise ParameterError(f"offset_side is start or end, got {self.offset_side!r}")
        if self.offset is not None and (isinstance(self.offset, bool) or not isinstance(self.offset, int)):
            seconds(self.offset, "offset")

    @property
    def ordinal(self) -> int:
        if self.at in ("start", "end"):
            return 0 if self.at == "start" else -1
        if isinstance(self.at, bool) or not isinstance(self.at, int):
            raise ParameterError(f"at is start, end or a number, got {self.at!r}")
        return self.at

    @classmethod
    def of(cls, value: str | dict | AnchorSpec) -> AnchorSpec:
        if isinstance(value, cls):
            return value
        if isinstance(value, str):
            return cls(value)
        if not isinstance(value, dict) or "pattern" not in value:
            raise ParameterError(f"an anchor is a pattern or a dict with one, got {value!r}")
        if unknown := sorted(set(value) - set(cls.__dataclass_fields__)):
            raise ParameterError(f"unknown keys of an anchor: {unknown}")
        return cls(**value)


def anchors_of(value) -> list[AnchorSpec]:
    return [AnchorSpec.of(v) for v in (value if isinstance(value, (list, tuple)) else [value])]


def add_position(df: DataFrame, schema: StreamSchema, keys: list[str], spec: AnchorSpec, tag: str, side: str | None = None, allowed: Column | None = None, allowed_from: int = 0) -> DataFrame:
    """``df`` (prepared rows) with {tag}_step and {tag}_idx: the spec's position, equal in all rows of a path.

    With occurrence ``all`` the columns hold a value at each matched row only, that of the position.
    """
    r = Resolver(schema, keys, spec.pattern, spec.event_col, tag)
    m = r.resolve(df, allowed, allowed_from)
    part, at = r.pattern.place(spec.ordinal)
    whole = Window.partitionBy(*keys)
    real = lambda c: F.when(~is_bound(), c)
    here = m.df
    if at:
        here = here.withColumn(f"__{tag}i", F.lead(IDX, at).over(r.w)).withColumn(f"__{tag}t", F.lead(micros(schema.timestamp_col), at).over(r.w))
    else:
        here = here.withColumn(f"__{tag}i", F.col(IDX)).withColumn(f"__{tag}t", micros(schema.timestamp_col))
    found = F.when(F.col(m.ok[part]), F.struct((F.col("__step") + at).alias("step"), F.col(f"__{tag}i").alias("idx"), F.col(f"__{tag}t").alias("ts")))
    if spec.occurrence == "all":
        if spec.offset not in (None, 0):
            return _offset_all(here.withColumn(f"__{tag}p", found), schema, keys, spec, tag, side).drop(*m.ok, f"__{tag}i", f"__{tag}t")
        return here.withColumn(f"{tag}_step", found["step"]).withColumn(f"{tag}_idx", found["idx"]).drop(*m.ok, f"__{tag}i", f"__{tag}t")
    extreme = F.min if spec.occurrence == "first" else F.max
    here = here.withColumn(f"__{tag}p", extreme(found).over(whole))
    p = F.col(f"__{tag}p")
    step, idx = p["step"], p["idx"]
    if spec.offset not in (None, 0):
        if isinstance(spec.offset, int):
            last = F.max(real(F.col("__step"))).over(whole)
            step = F.greatest(F.lit(1), F.least(step + spec.offset, last))
            here = here.withColumn(f"__{tag}s", step)
            idx = F.max(real(F.when(F.col("__step") == F.col(f"__{tag}s"), F.col(IDX)))).over(whole)
            step = F.col(f"__{tag}s")
        else:
            gap = seconds(spec.offset, "offset")
            side = spec.offset_side or side or ("end" if gap < 0 else "start")
            mark, ts = p["ts"] + int(round(gap * 1e6)), micros(schema.timestamp_col)
            both = F.struct(F.col("__step").alias("step"), F.col(IDX).alias("idx"))
            if side == "start":
                chosen, edge = F.min(real(F.when(ts >= mark, both))).over(whole), F.max(real(both)).over(whole)
            else:
                chosen, edge = F.max(real(F.when(ts <= mark, both))).over(whole), F.min(real(both)).over(whole)
            here = here.withColumn(f"__{tag}s", F.when(p.isNotNull(), F.coalesce(chosen, edge)))
            step, idx = F.col(f"__{tag}s")["step"], F.col(f"__{tag}s")["idx"]
    here = here.withColumn(f"{tag}_step", step).withColumn(f"{tag}_idx", F.when(p.isNotNull(), idx))
    return here.withColumn(f"{tag}_step", F.when(p.isNotNull(), F.col(f"{tag}_step"))).drop(*m.ok, f"__{tag}i", f"__{tag}t", f"__{tag}p", f"__{tag}s")


def _offset_all(df: DataFrame, schema: StreamSchema, keys: list[str], spec: AnchorSpec, tag: str, side: str | None) -> DataFrame:
    """Every matched position moved by the offset: by steps with lead and lag, by time with a range frame."""
    w, p = schema.window(keys), F.col(f"__{tag}p")
    whole = Window.partitionBy(*keys)
    real = F.when(~is_bound(), F.struct(F.col("__step").alias("step"), F.col(IDX).alias("idx")))
    first, last = F.min(real).over(whole), F.max(real).over(whole)
    if isinstance(spec.offset, int):
        # from the matched row to the token is known; from there the offset leads on
        part_at = Resolver(schema, keys, spec.pattern, spec.event_col).pattern.place(spec.ordinal)[1]
        moved = F.lead(real, part_at + spec.offset).over(w) if part_at + spec.offset >= 0 else F.lag(real, -(part_at + spec.offset)).over(w)
        value = F.coalesce(moved, last if spec.offset > 0 else first)
    else:
        gap = int(round(seconds(spec.offset, "offset") * 1e6))
        side = spec.offset_side or side or ("end" if gap < 0 else "start")
        by_time = Window.partitionBy(*keys).orderBy(micros(schema.timestamp_col))
        if side == "start":
            value = F.coalesce(F.min(real).over(by_time.rangeBetween(gap, Window.unboundedFollowing)), last)
        else:
            value = F.coalesce(F.max(real).over(by_time.rangeBetween(Window.unboundedPreceding, gap)), first)
    df = df.withColumn(f"__{tag}v", value)
    for name in ("step", "idx"):
        df = df.withColumn(f"{tag}_{name}", F.when(p.isNotNull(), F.col(f"__{tag}v")[name]))
    return df.drop(f"__{tag}v", f"__{tag}p")


def needs_bounds(*specs: AnchorSpec) -> bool:
    return any(parse_pattern(s.pattern).named_bounds for s in specs)


def matching_paths(df: DataFrame, schema: StreamSchema, keys: list[str], pattern: str, event_col: str | None = None) -> DataFrame:
    """Keys of the paths that hold the pattern; the forward pass is enough."""
    r = Resolver(schema, keys, pattern, event_col)
    return r.forward(r.prepare(df)).filter(f"__mf{len(r.pattern.parts) - 1}").select(*keys).distinct()


def resolve_anchors(df: DataFrame, schema: StreamSchema, keys: list[str], pattern: str, occurrence: str = "first", event_col: str | None = None) -> DataFrame:
    """keys, ordinal, step, index: where each token of the pattern stands, in long form."""
    r = Resolver(schema, keys, pattern, event_col)
    m = r.resolve(r.prepare(df))
    rows, fields, n = m.df, [], 0
    for i, part in enumerate(r.pattern.parts):
        for at in range(len(part)):
            rows = rows.withColumn(f"__i{n}", F.when(F.col(m.ok[i]), F.struct((F.col("__step") + at).alias("step"), (F.lead(IDX, at).over(r.w) if at else F.col(IDX)).alias("idx"))))
            fields.append(f"__i{n}")
            n += 1
    if occurrence == "all":
        found = rows.select(*keys, F.posexplode(F.array(*fields)).alias("ordinal", "p")).filter("p is not null").distinct()
    else:
        extreme = F.min if occurrence == "first" else F.max
        found = rows.groupBy(*keys).agg(*(extreme(f).alias(f) for f in fields)).select(*keys, F.posexplode(F.array(*fields)).alias("ordinal", "p")).filter("p is not null")
    return found.select(*keys, F.col("ordinal").cast("long").alias("ordinal"), F.col("p.step").alias("step"), F.col("p.idx").alias("index"))
