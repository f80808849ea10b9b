"""Conditions of rules as Columns that are never null.

A leaf compares a field with a value: a null field fits nothing but !=, values of another kind fit nothing but
!=, severities compare by rank. The text form has one level: NOT before a condition, AND or OR between them,
and with any AND all conditions are joined by AND.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwatch.functions.checks import valid_regex
from loomwatch.functions.severity import SEVERITIES, rank

CONDITION = re.compile(r'^\s*(NOT\s+)?(?:event\.)?(\w+)\s*(==|!=|>=|<=|>|<|\b(?:contains|in|matches)\b)\s*("(?:[^"]*)"|\S.*?)\s*$', re.IGNORECASE)


def leaf(df: DataFrame, field: str, op: str, value: Any) -> Column:
    if field not in df.columns:
        return F.lit(op == "!=")
    kind, c = df.schema[field].dataType, F.col(field)
    numeric, text, array = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
    fits = (numeric and isinstance(value, int | float) and not isinstance(value, bool)) or (text and isinstance(value, str)) or (isinstance(kind, T.BooleanType) and isinstance(value, bool))
    no = F.lit(False)
    if op in ("==", "!="):
        equal = c.eqNullSafe(F.lit(value)) if fits else no
        return equal if op == "==" else ~equal
    if op in (">", ">=", "<", "<="):
        if not fits:
            return no
        v = F.lit(value)
        if text and value.lower() in SEVERITIES:
            plain, ranked = (c, v), (rank(c, None), F.lit(SEVERITIES.index(value.lower())))
            pairs = [F.when(ranked[0].isNotNull(), _ordered(op, *ranked)).otherwise(_ordered(op, *plain))]
        else:
            pairs = [_ordered(op, c, v)]
        return F.coalesce(*pairs, no)
    if op == "contains":
        if array:
            return F.coalesce(F.array_contains(c, value), no)
        return F.coalesce(F.contains(c, F.lit(value)), no) if text and isinstance(value, str) else no
    if op == "in":
        return F.coalesce(c.isin(*value), no) if isinstance(value, list | tuple | set) and value else no
    if op == "matches":
        return F.coalesce(c.cast("string").rlike(value), no) if isinstance(value, str) and valid_regex(value) else no
    raise ValueError(f"no such operator: {op}")


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def tree(op: str, parts: list[Column]) -> Column:
    """and, or, not of conditions; without parts false; not takes the first."""
    if not parts:
        return F.lit(False)
    if op == "not":
        return ~parts[0]
    return reduce(lambda a, b: a & b if op == "and" else a | b, parts)


def value_of(text: str) -> Any:
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def condition(df: DataFrame, text: str) -> Column:
    """The Column of ``WHEN ... THEN ...``; ValueError for what is no condition."""
    body = re.sub(r"(?is)^\s*WHEN\b|\bTHEN\b.*$", "", text).strip()
    if not body:
        raise ValueError("no condition")
    word = "and" if re.search(r"(?i)\bAND\b", body) else "or"
    parts = []
    for piece in re.split(r"(?i)\b(?:AND|OR)\b", body):
        m = CONDITION.match(piece)
        if not m:
            raise ValueError(f"no condition: {piece.strip()}")
        made = leaf(df, m[2], m[3].lower(), value_of(m[4]))
        parts.append(~made if m[1] else made)
    return tree(word, parts)
