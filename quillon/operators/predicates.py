"""Conditions without subqueries as columns.

A comparison with NULL is never true but for IS and IS NOT.  Conditions hold no negation
other than the operators' own, so Spark's three-valued logic keeps the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.ast import And, Column, Condition, Exists, Literal, Or, Parameter, Simple, Value


def value(v: Value, df: DataFrame) -> SparkColumn:
    if isinstance(v, Parameter):
        raise ValueError(f"parameter {v.anchor}.{'.'.join(v.path)} is not bound")
    if isinstance(v, Column):
        if v.name not in df.columns:
            raise ValueError(f"unknown column {v.name!r}")
        return df[v.name]
    return F.lit(v.value)


def escape_like(text: str) -> str:
    """A LIKE pattern that matches ``text`` itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def _pattern(v: Value) -> str:
    if not isinstance(v, Literal) or not isinstance(v.value, str):
        raise ValueError("a LIKE pattern must be a literal text")
    if (len(v.value) - len(v.value.rstrip("\\"))) % 2:
        raise ValueError("a LIKE pattern must not end with an escape")
    return v.value


def _kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "other"


def _check_kind(left: Value, right: Value, df: DataFrame) -> None:
    """Texts, numbers and booleans are not compared with each other: Spark would cast them silently."""
    for a, b in ((left, right), (right, left)):
        if isinstance(a, Column) and a.name in df.columns and isinstance(b, Literal) and b.value is not None:
            kind = df.schema[a.name].dataType.simpleString()
            have = "bool" if kind == "boolean" else "text" if kind == "string" else "number" if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal") else "other"
            for x in b.value if isinstance(b.value, tuple) else (b.value,):
                if x is not None and "other" not in (have, _kind(x)) and have != _kind(x):
                    raise TypeError(f"{a.name} is {kind}; {x!r} is not")


def _constant(op: str, a: Any, b: Any) -> bool | None:
    """The result for two literals, where Python can give it."""
    if op in ("IS", "IS NOT"):
        return ((a == b) and _kind(a) == _kind(b)) == (op == "IS")
    if a is None or (b is None and "IN" not in op):
        return False
    if op in ("=", "!="):
        return (a == b) == (op == "=")
    if op in ("IN", "NOT IN"):
        return (a in b) == (op == "IN")
    if op in ("<", ">", "<=", ">=") and _kind(a) == _kind(b):
        return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return None


def simple(c: Simple, df: DataFrame) -> SparkColumn:
    if isinstance(c.left, Literal) and isinstance(c.right, Literal):
        known = _constant(c.op, c.left.value, c.right.value)
        if known is not None:
            return F.lit(known)
    _check_kind(c.left, c.right, df)
    if c.op in ("IN", "NOT IN"):
        if not isinstance(c.right, Literal) or not isinstance(c.right.value, (tuple, list)):
            raise ValueError(f"{c.op} needs a literal list")
        left = value(c.left, df)
        # NULL in the list equals nothing, and leaves NOT IN to the other items.
        items = [x for x in c.right.value if x is not None]
        inside = left.isin(items) if items else F.lit(False)
        return left.isNotNull() & (inside if c.op == "IN" else ~inside)
    left = value(c.left, df)
    if c.op.endswith("LIKE"):
        found = (left.ilike if "ILIKE" in c.op else left.like)(_pattern(c.right))
        return ~found if c.op.startswith("NOT") else found
    right = value(c.right, df)
    if c.op == "IS":
        return left.eqNullSafe(right)
    if c.op == "IS NOT":
        return ~left.eqNullSafe(right)
    return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[c.op]


def predicate(c: Condition | None, df: DataFrame, flags: dict[int, SparkColumn] | None = None) -> SparkColumn:
    """The condition over ``df``; ``flags`` has a column for each subquery in it, by id()."""
    if c is None:
        return F.lit(True)
    if isinstance(c, Simple):
        return simple(c, df)
    if isinstance(c, Exists):
        if not flags or id(c) not in flags:
            raise ValueError("a subquery needs the compiler")
        return flags[id(c)]
    arms = [predicate(x, df, flags) for x in c.conditions]
    if isinstance(c, And):
        return reduce(lambda a, b: a & b, arms, F.lit(True)) if arms else F.lit(True)
    assert isinstance(c, Or)
    return reduce(lambda a, b: a | b, arms) if arms else F.lit(False)


def key_lookup(c: Condition | None, key: tuple[str, ...]) -> dict[str, Any] | None:
    """The key's values if ANDed equalities fix all of it."""
    fixed: dict[str, Any] = {}
    for arm in c.conditions if isinstance(c, And) else (c,):
        if isinstance(arm, Simple) and arm.op == "=":
            for a, b in ((arm.left, arm.right), (arm.right, arm.left)):
                if isinstance(a, Column) and isinstance(b, Literal):
                    fixed[a.name] = b.value
    return {k: fixed[k] for k in key} if all(k in fixed for k in key) else None


def compatible(a: dict[str, Any], b: dict[str, Any]) -> bool:
    """Whether two sets of equalities can hold for one row."""
    return all(b[k] == v for k, v in a.items() if k in b)


def key_matches(columns: Iterable[str], key: Sequence[str]) -> bool:
    """Whether some columns are exactly a key's, in any order."""
    return sorted(columns) == sorted(key)
