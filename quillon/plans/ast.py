"""The query language: a small tree, its JSON form, normal form, identity and read set."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from typing import Any, Union

#: Fixed by the wire format.
SIMPLE_OPS = ("=", "!=", "IS", "IS NOT", "<", ">", "<=", ">=", "LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE", "IN", "NOT IN")


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Column:
    name: str


@dataclass(frozen=True)
class Parameter:
    """A value bound before execution: ``anchor`` names the source, ``path`` leads into it."""

    anchor: str
    path: tuple[str, ...]


Value = Union[Literal, Column, Parameter]


@dataclass(frozen=True)
class Simple:
    op: str
    left: Value
    right: Value

    def __post_init__(self):
        if self.op not in SIMPLE_OPS:
            raise ValueError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class And:
    conditions: tuple["Condition", ...]


@dataclass(frozen=True)
class Or:
    conditions: tuple["Condition", ...]


@dataclass(frozen=True)
class Related:
    """A child query and the equal fields that tie it to its parent."""

    parent_field: tuple[str, ...]
    child_field: tuple[str, ...]
    subquery: "Query"

    def __post_init__(self):
        if not self.parent_field or len(self.parent_field) != len(self.child_field):
            raise ValueError("a correlation needs as many child as parent fields, and one at least")


@dataclass(frozen=True)
class Exists:
    related: Related
    negated: bool = False
    #: Resolve to a literal before execution; see rewrite.resolve_scalars.
    scalar: bool = False
    #: Whether the child's rows look up their parents; None leaves it to the planner.
    flip: bool | None = None


Condition = Union[Simple, And, Or, Exists]


@dataclass(frozen=True)
class Start:
    row: tuple[tuple[str, Any], ...]
    exclusive: bool = True


@dataclass(frozen=True)
class Query:
    table: str
    alias: str | None = None
    where: Condition | None = None
    related: tuple[Related, ...] = ()
    start: Start | None = None
    limit: float | None = None
    order_by: tuple[tuple[str, str], ...] = ()
    schema: str | None = field(default=None, compare=True)


# --- building by hand -----------------------------------------------------------------


def cmp(column: str, op: str, value: Any) -> Simple:
    return Simple(op, Column(column), value if isinstance(value, (Literal, Column, Parameter)) else Literal(value))


def all_of(*conditions: Condition) -> And:
    return And(tuple(conditions))


def any_of(*conditions: Condition) -> Or:
    return Or(tuple(conditions))


def exists(parent: str | tuple[str, ...], child: str | tuple[str, ...], subquery: Query, negated: bool = False, scalar: bool = False) -> Exists:
    return Exists(related(parent, child, subquery), negated, scalar)


def related(parent: str | tuple[str, ...], child: str | tuple[str, ...], subquery: Query) -> Related:
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Related(as_tuple(parent), as_tuple(child), subquery)


# --- JSON -----------------------------------------------------------------------------


def _value_from(v: dict) -> Value:
    if v["type"] == "literal":
        return Literal(tuple(v["value"]) if isinstance(v["value"], list) else v["value"])
    if v["type"] == "column":
        return Column(v["name"])
    if v["type"] == "static":
        path = v["field"] if isinstance(v["field"], list) else [v["field"]]
        return Parameter(v["anchor"], tuple(path))
    raise ValueError(f"unknown value type {v['type']!r}")


def _value_to(v: Value) -> dict:
    if isinstance(v, Literal):
        return {"type": "literal", "value": list(v.value) if isinstance(v.value, tuple) else v.value}
    if isinstance(v, Column):
        return {"type": "column", "name": v.name}
    return {"type": "static", "anchor": v.anchor, "field": v.path[0] if len(v.path) == 1 else list(v.path)}


def condition_from_dict(c: dict) -> Condition:
    kind = c["type"]
    if kind == "simple":
        return Simple(c["op"], _value_from(c["left"]), _value_from(c["right"]))
    if kind in ("and", "or"):
        return (And if kind == "and" else Or)(tuple(map(condition_from_dict, c["conditions"])))
    if kind == "correlatedSubquery":
        if c["op"] not in ("EXISTS", "NOT EXISTS"):
            raise ValueError(f"unknown operator {c['op']!r}")
        return Exists(_related_from(c["related"]), c["op"] == "NOT EXISTS", bool(c.get("scalar")), c.get("flip"))
    raise ValueError(f"unknown condition type {kind!r}")


def _condition_to(c: Condition) -> dict:
    if isinstance(c, Simple):
        return {"type": "simple", "op": c.op, "left": _value_to(c.left), "right": _value_to(c.right)}
    if isinstance(c, Exists):
        out = {"type": "correlatedSubquery", "related": _related_to(c.related), "op": "NOT EXISTS" if c.negated else "EXISTS"}
        return out | ({"scalar": True} if c.scalar else {}) | ({} if c.flip is None else {"flip": c.flip})
    return {"type": "and" if isinstance(c, And) else "or", "conditions": [_condition_to(x) for x in c.conditions]}


def _related_from(r: dict) -> Related:
    return Related(tuple(r["correlation"]["parentField"]), tuple(r["correlation"]["childField"]), from_json(r["subquery"]))


def _related_to(r: Related) -> dict:
    return {"correlation": {"parentField": list(r.parent_field), "childField": list(r.child_field)}, "subquery": to_dict(r.subquery)}


def from_json(source: str | dict) -> Query:
    d = json.loads(source) if isinstance(source, str) else source
    start = d.get("start")
    return Query(
        table=d["table"],
        alias=d.get("alias"),
        where=condition_from_dict(d["where"]) if d.get("where") else None,
        related=tuple(map(_related_from, d.get("related") or ())),
        start=Start(tuple(start["row"].items()), bool(start["exclusive"])) if start else None,
        limit=d.get("limit"),
        order_by=tuple((f, direction) for f, direction in d.get("orderBy") or ()),
        schema=d.get("schema"),
    )


def to_dict(q: Query) -> dict:
    out: dict[str, Any] = {"schema": q.schema} if q.schema else {}
    out["table"] = q.table
    if q.alias:
        out["alias"] = q.alias
    if q.where is not None:
        out["where"] = _condition_to(q.where)
    if q.related:
        out["related"] = [_related_to(r) for r in q.related]
    if q.start:
        out["start"] = {"row": dict(q.start.row), "exclusive": q.start.exclusive}
    if q.limit is not None:
        out["limit"] = q.limit
    if q.order_by:
        out["orderBy"] = [list(o) for o in q.order_by]
    return out


def to_json(q: Query) -> str:
    return json.dumps(to_dict(q), separators=(",", ":"), ensure_ascii=False)


# --- normal form, identity, read set ---------------------------------------------------


def normalise_condition(c: Condition | None) -> Condition | None:
    """Nested ANDs and ORs of one kind made flat, empty ANDs and single arms unwrapped, arms sorted."""
    if c is None or isinstance(c, Simple):
        return c
    if isinstance(c, Exists):
        return replace(c, related=replace(c.related, subquery=normalise(c.related.subquery)))
    kind, arms = type(c), []
    for arm in map(normalise_condition, c.conditions):
        if isinstance(arm, kind):
            arms.extend(arm.conditions)
        elif arm is not None:
            arms.append(arm)
    if len(arms) == 1:
        return arms[0]
    if not arms and kind is And:
        return None
    return kind(tuple(sorted(set(arms), key=lambda x: json.dumps(_condition_to(x), sort_keys=True))))


def normalise(q: Query) -> Query:
    hops = sorted((replace(r, subquery=normalise(r.subquery)) for r in dedupe_related(q.related)), key=lambda r: (r.subquery.alias or "", json.dumps(_related_to(r), sort_keys=True)))
    return replace(q, where=normalise_condition(q.where), related=tuple(hops))


def dedupe_related(hops: tuple[Related, ...]) -> tuple[Related, ...]:
    """Of hops with one alias the last wins, in the first's place; those without one all stay."""
    place: dict[str, int] = {}
    out: list[Related] = []
    for r in hops:
        alias = r.subquery.alias
        if alias is not None and alias in place:
            out[place[alias]] = r
        else:
            if alias is not None:
                place[alias] = len(out)
            out.append(r)
    return tuple(out)


def query_hash(q: Query) -> str:
    """The same for queries that differ only in how their conditions are written."""
    return _base36(to_json(normalise(q)))


def named_query_hash(name: str, args: list) -> str:
    return _base36(json.dumps([name, args], separators=(",", ":"), sort_keys=True))


def _base36(text: str) -> str:
    n, out = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big"), ""
    while n:
        n, digit = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + out
    return out or "0"


def correlated(c: Condition | None) -> list[Exists]:
    """All EXISTS and NOT EXISTS of a condition, at this level."""
    if isinstance(c, Exists):
        return [c]
    return [x for arm in c.conditions for x in correlated(arm)] if isinstance(c, (And, Or)) else []


def read_set(q: Query) -> set[str]:
    """Names of the tables a query reads."""
    out = {q.table}
    for r in [*q.related, *(e.related for e in correlated(q.where))]:
        out |= read_set(r.subquery)
    return out


def invalidated(queries: dict[str, Query], changed: set[str]) -> list[str]:
    """Names of the queries that a change of these tables can affect."""
    return [name for name, q in queries.items() if read_set(q) & changed]


def complete_ordering(q: Query, key_of) -> Query:
    """Orderings, here and in all subqueries, ended with the key columns they lack."""

    def hop(r: Related) -> Related:
        return replace(r, subquery=complete_ordering(r.subquery, key_of))

    def condition(c: Condition | None) -> Condition | None:
        if isinstance(c, Exists):
            return replace(c, related=hop(c.related))
        return replace(c, conditions=tuple(map(condition, c.conditions))) if isinstance(c, (And, Or)) else c

    named = {f for f, _ in q.order_by}
    order = (*q.order_by, *((k, "asc") for k in key_of(q.table) if k not in named))
    return replace(q, order_by=order, where=condition(q.where), related=tuple(map(hop, q.related)))
