"""Durations as users write them."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd

from ..errors import ParameterError


def seconds(value: str | timedelta, param: str = "duration") -> float:
    """Seconds of a string with a unit ('30m', '1h') or of a time delta; bare numbers have no unit and raise."""
    if isinstance(value, timedelta):
        return float(value.total_seconds())
    if not isinstance(value, str) or not any(c.isalpha() for c in value):
        raise ParameterError(f"{param} needs a unit, as in '30m' or '1800s'; got {value!r}")
    try:
        return float(pd.Timedelta(value).total_seconds())
    except ValueError as error:
        raise ParameterError(f"{param}: {value!r} is no duration ({error})") from error
