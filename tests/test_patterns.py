"""The resolver against brute force, and the grammar."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from trailspark import Stream
from trailspark.errors import PatternError
from trailspark.functions.patterns import parse_pattern

PATTERNS = ["A", "A->B", "A->.*->B", "A->[^C]*->B", "[A|B]->.->C", "path_start->A", "A->.*->path_end", "[^A]->B", "A->[B|C]*->A", "A->B->.*->C->[^A]*->B", "path_start->.*->C->.*->path_end"]


def matches(pattern, events):
    """All tuples of positions of the tokens, over events with boundaries around them."""
    row = ["path_start", *events, "path_end"]
    p = parse_pattern(pattern)

    def takes(t, e):
        bound = e in ("path_start", "path_end")
        return e in t.names if not t.negated else not bound and e not in t.names

    def breaks(t, e):
        if e in ("path_start", "path_end"):
            return False
        return e in t.names if t.negated else e not in t.names

    spots = [[s for s in range(len(row) - len(part) + 1) if all(takes(t, row[s + k]) for k, t in enumerate(part))] for part in p.parts]
    out = []
    for starts in itertools.product(*spots):
        ok = True
        for i, gap in enumerate(p.gaps):
            end = starts[i] + len(p.parts[i]) - 1
            ok = ok and starts[i + 1] > end and not any(breaks(gap, e) for e in row[end + 1 : starts[i + 1]])
        if ok:
            out.append([s + k for s, part in zip(starts, p.parts, strict=True) for k in range(len(part))])
    return out


def stream(spark, paths):
    begin = datetime(2024, 1, 1)
    rows = [(u, e, begin + timedelta(minutes=k)) for u, events in paths.items() for k, e in enumerate(events)]
    return Stream.from_dataframe(spark.createDataFrame(rows, "user_id string, event string, timestamp timestamp_ntz"))


@pytest.mark.parametrize("pattern", PATTERNS)
def test_positions_equal_brute_force(spark, pattern):
    rng = random.Random(5)
    paths = {f"u{i}": [rng.choice("ABC") for _ in range(rng.randint(1, 8))] for i in range(60)}
    s = stream(spark, paths)
    for occurrence, pick in (("first", min), ("last", max)):
        found = {(r["user_id"], r["ordinal"]): r["step"] for r in s.resolve_anchors(pattern, occurrence).collect()}
        expected = {(u, k): pick(m[k] for m in all_of) for u, events in paths.items() if (all_of := matches(pattern, events)) for k in range(len(all_of[0]))}
        assert found == expected


@pytest.mark.parametrize("bad", ["", "A->", "[A|]", "[A", "A->[B]*", "A->[B]*->.*->C", "->A"])
def test_bad_patterns(bad):
    with pytest.raises(PatternError):
        parse_pattern(bad)


def test_conversion_agrees_with_funnel_and_pattern(spark):
    rng = random.Random(6)
    s = stream(spark, {f"u{i}": [rng.choice("ABCD") for _ in range(6)] for i in range(50)})
    converted = s.get_conversion_rate("A", "B").first()["converted"]
    funnel = {r["step_index"]: r["unique_paths"] for r in s.funnel_data(["A", "B"]).collect()}
    column = "matches_pattern_A->.*->B"
    hits = s.get_metrics([{"metric": "matches_pattern", "metric_args": {"pattern": "A->.*->B"}}]).filter(f"`{column}`").count()
    assert converted == funnel[2] == hits
