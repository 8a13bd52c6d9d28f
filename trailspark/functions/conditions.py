"""Condition trees over path metrics."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParameterError
from .metrics import BULK, normal

COMPARE: dict[str, Callable] = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def leaves(node: dict | list) -> list[dict]:
    """All leaves of a tree, left to right; a list stands for an and."""
    if isinstance(node, list):
        node = {"op": "and", "args": node}
    op = node.get("op")
    if op in ("and", "or", "not"):
        args = node.get("args")
        args = [args] if isinstance(args, dict) else list(args or ())
        if not args or op == "not" and len(args) != 1:
            raise ParameterError(f"{op} takes {'one argument' if op == 'not' else 'arguments'}")
        return [leaf for a in args for leaf in leaves(a)]
    if op not in COMPARE and op != "in":
        raise ParameterError(f"unknown op {op!r}")
    if normal({k: node[k] for k in ("metric", "metric_args") if k in node})["metric"] in BULK:
        raise ParameterError(f"{node['metric']} has many columns and can't be compared")
    return [node]


def _primitive(v):
    if isinstance(v, bool):
        return int(v)
    if not isinstance(v, (int, float, str)):
        raise ParameterError(f"a condition compares with a number, a string or a boolean, got {v!r}")
    return v


def compile_condition(node: dict | list, column_of: Callable[[dict], str]) -> Column:
    if isinstance(node, list):
        node = {"op": "and", "args": node}
    op = node["op"]
    if op in ("and", "or", "not"):
        args = node["args"]
        parts = [compile_condition(a, column_of) for a in ([args] if isinstance(args, dict) else args)]
        if op == "not":
            return ~parts[0]
        return reduce(operator.and_ if op == "and" else operator.or_, parts)
    value = F.col(f"`{column_of(node)}`")
    is_flag = node["metric"] == "matches_pattern"
    if is_flag:
        value = value.cast("int")
    if op == "in":
        options = node.get("value", node.get("args"))
        if not isinstance(options, (list, tuple)) or not options:
            raise ParameterError("in takes a list of values")
        return value.isin(*(_primitive(v) for v in options))
    return COMPARE[op](value, F.lit(_primitive(node.get("value"))))
