"""The compiler against a plain restatement of the language, on small tables with NULLs and ties."""

from __future__ import annotations

import random
from functools import cmp_to_key

import pytest

from quillon.operators import diff as d
from quillon.operators import views
from quillon.operators.predicates import escape_like, key_lookup
from quillon.plans import rewrite
from quillon.plans.ast import And, Column, Exists, Or, Query, Simple, Start, all_of, any_of, cmp, complete_ordering, correlated, dedupe_related, exists, from_json, named_query_hash, normalise, query_hash, read_set, related, to_json
from quillon.plans.compiler import Compiler
from quillon.sources.catalog import Catalog, NameMapper, TableSpec

TABLES = {
    "p": (("id", "a", "t"), ("id",), [(1, 1, "x"), (2, None, "y"), (3, 2, None), (4, 1, "x_1"), (5, 2, "X%\\"), (6, 3, "line\nbreak"), (7, None, None)]),
    "c": (("id", "pid", "v"), ("id",), [(1, 1, 5), (2, 1, None), (3, 2, 5), (4, None, 1), (5, 4, 5), (6, 1, 5), (7, 5, 2), (8, 4, None), (9, 2, 2)]),
}


@pytest.fixture(scope="module")
def catalog(spark):
    out = Catalog(spark)
    kinds = {"p": "id int, a int, t string", "c": "id int, pid int, v int"}
    for name, (_, key, rows) in TABLES.items():
        out.add(TableSpec(name, key), spark.createDataFrame(rows, kinds[name]))
    return out


# --- the restatement ---


def like(text, pattern, fold):
    import re

    if fold:
        text, pattern = text.lower(), pattern.lower()
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def meets(c, row):
    if c is None:
        return True
    if isinstance(c, And):
        return all(meets(x, row) for x in c.conditions)
    if isinstance(c, Or):
        return any(meets(x, row) for x in c.conditions)
    if isinstance(c, Exists):
        return bool(rows_of(c.related.subquery, (c.related, row))) != c.negated
    a, b = (row.get(v.name) if isinstance(v, Column) else v.value for v in (c.left, c.right))
    if c.op in ("IS", "IS NOT"):
        return (a == b) == (c.op == "IS")
    if a is None or b is None:
        return False
    if c.op in ("IN", "NOT IN"):
        return (a in b) == (c.op == "IN")
    if "LIKE" in c.op:
        return like(a, b, "ILIKE" in c.op) != c.op.startswith("NOT")
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[c.op]


def compare(order, prefix_of=None):
    def f(x, y):
        for name, direction in order:
            if prefix_of is not None and name not in prefix_of:
                break
            a, b = x[name], y[name]
            n = 0 if a == b else -1 if a is None else 1 if b is None else (a > b) - (a < b)
            if n:
                return -n if direction == "desc" else n
        return 0

    return f


def rows_of(q, parent=None):
    names, key, data = TABLES[q.table]
    out = [dict(zip(names, r)) for r in data]
    if parent:
        r, row = parent
        out = [x for x in out if all(row[p] is not None and x[c] == row[p] for p, c in zip(r.parent_field, r.child_field))]
    out = [x for x in out if meets(q.where, x)]
    order = [*q.order_by, *((k, "asc") for k in key if k not in {f for f, _ in q.order_by})]
    out.sort(key=cmp_to_key(compare(order)))
    if q.start:
        bound = dict(q.start.row)
        f = compare(order, bound)
        out = [x for x in out if f(x, bound) > 0 or not q.start.exclusive and f(x, bound) == 0]
    return out if q.limit is None else out[: max(0, int(q.limit))]


def results_of(q):
    out = set()

    def walk(q, rows):
        out.update((q.table, x["id"]) for x in rows)
        for r in [*dedupe_related(q.related), *(e.related for e in correlated(q.where) if not e.negated)]:
            for x in rows:
                walk(r.subquery, rows_of(r.subquery, (r, x)))

    walk(q, rows_of(q))
    return out


def nested_of(q, rows):
    out = []
    for x in rows:
        tree = dict(x)
        for i, r in enumerate(dedupe_related(q.related)):
            tree[r.subquery.alias or f"{r.subquery.table}_{i}"] = nested_of(r.subquery, rows_of(r.subquery, (r, x)))
        out.append(tree)
    return out


# --- random queries ---


def random_condition(r, table, depth):
    names = TABLES[table][0]
    kind = r.random()
    if depth and kind < 0.35:
        arms = [random_condition(r, table, depth - 1) for _ in range(r.randrange(0, 4))]
        return (all_of if r.random() < 0.5 else any_of)(*arms)
    if depth and kind < 0.6:
        other = "c" if table == "p" else "p"
        fields = ("id", "pid") if table == "p" else ("pid", "id")
        if r.random() < 0.2:
            other, fields = table, ("a", "a") if table == "p" else ("v", "v")
        return exists(*fields, random_query(r, other, depth - 1, False), negated=r.random() < 0.4)
    if table == "p" and kind < 0.75:
        return cmp("t", r.choice(["LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE"]), r.choice(["x%", "_", "x\\_%", "%\\%%", "%e%", "X", "%\\\\"]))
    name = r.choice([n for n in names if n != "t"])
    op = r.choice(["=", "!=", "<", ">", "<=", ">=", "IS", "IS NOT", "IN", "NOT IN"])
    if op.endswith("IN"):
        return cmp(name, op, tuple(r.choices([1, 2, 3, None], k=r.randrange(0, 3))))
    if r.random() < 0.2:
        return Simple(op, Column(name), Column(r.choice([n for n in names if n != "t"])))
    return cmp(name, op, r.choice([1, 2, 5, None]))


def random_query(r, table, depth, may_relate=True):
    names = [n for n in TABLES[table][0] if n != "t"]
    order = tuple((n, r.choice(["asc", "desc"])) for n in r.sample(names, r.randrange(0, 3)))
    start = None
    if order and r.random() < 0.35:
        start = Start(tuple((n, r.choice([1, 2, 5, None])) for n, _ in order[: r.randrange(1, len(order) + 1)]), r.random() < 0.5)
    hops = ()
    if may_relate and depth and r.random() < 0.7:
        fields, other = (("id", "pid"), "c") if table == "p" else (("pid", "id"), "p")
        hops = tuple(related(*fields, random_query(r, other, depth - 1)) for _ in range(r.randrange(1, 3)))
    return Query(table, where=random_condition(r, table, depth) if r.random() < 0.8 else None, related=hops, start=start, limit=r.choice([None, None, 0, 1, 2, 3.7]), order_by=order)


def plain(x):
    return [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in (x.asDict() if hasattr(x, "asDict") else x).items()} if hasattr(x, "asDict") or isinstance(x, dict) else x


@pytest.mark.parametrize("seed", range(25))
def test_random_queries(catalog, seed):
    q = random_query(random.Random(seed), "p" if seed % 3 else "c", 2)
    c = Compiler(catalog)
    assert [x.asDict() for x in c.rows(q, ordered=True).collect()] == rows_of(q)
    got = {(x["table"], int(x["row_key"].split(":")[1].rstrip("}"))) for x in c.result_set(q).collect()}
    assert got == results_of(q)
    assert plain(c.nested(q).collect()) == nested_of(q, rows_of(q))
    assert from_json(to_json(q)) == q
    assert rows_of(normalise(q)) == rows_of(q)


def test_covering_is_sound():
    r, hits = random.Random(5), 0
    for _ in range(1500):
        a, b = (Query("p", where=random_condition(r, "p", 1)) for _ in range(2))
        if rewrite.covers(a, b):
            hits += 1
            assert {x["id"] for x in rows_of(b)} <= {x["id"] for x in rows_of(a)}, (a, b)
    assert hits > 20


def test_like_errors_and_escape(catalog):
    with pytest.raises(ValueError):
        Compiler(catalog).rows(Query("p", where=cmp("t", "LIKE", "x\\")))
    assert [x["id"] for x in Compiler(catalog).rows(Query("p", where=cmp("t", "LIKE", escape_like("X%\\")))).collect()] == [5]
    with pytest.raises(TypeError):
        Compiler(catalog).rows(Query("p", where=cmp("a", "=", "1")))


def test_identity_and_read_set():
    a = Query("p", where=all_of(cmp("a", "=", 1), all_of(cmp("id", "<", 5))))
    b = Query("p", where=all_of(cmp("id", "<", 5), cmp("a", "=", 1)))
    assert query_hash(a) == query_hash(b) != query_hash(Query("p"))
    assert named_query_hash("q", [1]) != named_query_hash("q", [2])
    q = Query("p", where=exists("id", "pid", Query("c")), related=(related("id", "pid", Query("d")),))
    assert read_set(q) == {"p", "c", "d"}
    done = complete_ordering(q, lambda t: ("id",))
    assert done.order_by == (("id", "asc"),) and done.where.related.subquery.order_by == (("id", "asc"),)
    assert key_lookup(all_of(cmp("id", "=", 3), cmp("a", ">", 1)), ("id",)) == {"id": 3}


def test_permissions(catalog):
    q = Query("p", where=exists("id", "pid", Query("c")))
    assert rewrite.permitted(q, None) == q
    assert Compiler(catalog).rows(rewrite.permitted(q, {"p": (cmp("id", ">", 0),)})).count() == 0  # c has no rules
    both = rewrite.permitted(q, {"p": (cmp("id", "=", 1), cmp("id", "=", 2)), "c": (cmp("v", "=", 5),)})
    assert {x["id"] for x in Compiler(catalog).rows(both).collect()} == {1, 2}
    assert rewrite.simplify(all_of(cmp("a", "=", 1), any_of())) == rewrite.NEVER


def test_scalars(catalog):
    def q(child_id, negated):
        return Query("p", where=Exists(related("id", "pid", Query("c", where=cmp("id", "=", child_id))), negated, scalar=True))

    def ids(x):
        new, companions = rewrite.resolve_scalars(x, catalog)
        assert len(companions) == 1
        return {r["id"] for r in Compiler(catalog).rows(new).collect()}

    assert ids(q(3, False)) == {2}
    assert ids(q(3, True)) == {1, 3, 4, 5, 6, 7}
    assert ids(q(4, True)) == ids(q(99, True)) == set()  # NULL, or no row: never true


def test_diff_round_trip(spark):
    old = spark.createDataFrame([("t", "1", "a"), ("t", "2", "b"), ("t", "3", None)], "table string, row_key string, row string")
    new = spark.createDataFrame([("t", "1", "a"), ("t", "2", "B"), ("t", "4", "d")], old.schema)
    changes = d.diff(old, new)
    assert {(x["kind"], x["row_key"]) for x in changes.collect()} == {("edit", "2"), ("remove", "3"), ("add", "4")}
    assert sorted(map(tuple, d.apply_diff(old, changes).collect())) == sorted(map(tuple, new.collect()))


def test_names():
    m = NameMapper({"issue": ("issues", {"ownerId": "owner_id"})})
    assert m.table("issue") == "issues" and m.column("issue", "ownerId") == "owner_id"
    assert m.inverse().column("issues", "owner_id") == "ownerId"
    with pytest.raises(KeyError):
        m.column("issue", "nope")


def test_view_records(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("t", "1", "a", 1, {"q": 1}), ("t", "2", "a", 1, {"q": 1, "r": 1}), ("t", "3", "a", 1, {"q": 1}), ("t", "4", "a", 1, None)], "table string, row_key string, row_version string, patch_version int, refs map<string,bigint>")
    new = spark.createDataFrame([("t", "1", "a", {"q": 1}, "{}"), ("t", "3", "b", {"q": 2}, "{}"), ("t", "5", "a", {"q": 1}, "{}"), ("t", "4", "a", {"q": 1}, "{}")], "table string, row_key string, row_version string, refs map<string,bigint>, row string")
    got = {x["row_key"]: x for x in views.receive(rows, new, F.lit(2), ["q"]).collect()}
    assert {k: (x["op"], x["patch_version"]) for k, x in got.items()} == {"1": (None, 1), "2": (None, 1), "3": ("put", 2), "5": ("put", 2), "4": ("put", 1)}
    assert got["2"]["refs"] == {"r": 1} and got["3"]["refs"] == {"q": 2}
    gone = {x["row_key"]: x["op"] for x in views.receive(rows, new.limit(0), F.lit(2), ["q", "r"]).collect()}
    assert gone == {"1": "del", "2": "del", "3": "del", "4": None}
    assert views.clamp_ttl("1h") == 600_000 and views.parse_ttl("none") == 0 and views.compare_ttl("forever", "10m") == 1
    assert [views.encode_version(n) for n in (0, 10, 35, 36)] == ["00", "0a", "0z", "110"]
    assert all(views.decode_version(views.encode_version(n)) == n for n in (0, 5, 36, 10**15))
    assert sorted(views.encode_version(n) for n in (5, 40, 36**3)) == [views.encode_version(n) for n in (5, 40, 36**3)]
