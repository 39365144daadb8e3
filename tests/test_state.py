"""Stores, writes, records, sources, sketches and plans, in small."""

from __future__ import annotations

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import mutations, views
from quillon.operators.predicates import key_matches
from quillon.plans import planner, rewrite
from quillon.plans.ast import Query, all_of, any_of, cmp, exists, from_json, related, to_json
from quillon.plans.compiler import Compiler
from quillon.sources import copy_format
from quillon.sources.catalog import Catalog, MemoryTable, NameMapper, TableSpec, discover, initial_snapshot
from quillon.sources.store import Conflict, Storage, Store

# --- store ---


def test_store_by_one_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path), most_deltas=2)
    rows = lambda v=None: sorted(map(tuple, store.read(store.manifest(v), "t").collect()))
    df = lambda *r: spark.createDataFrame(list(r), "id int, v string")
    first, other = store.next(store.manifest()), store.next(store.manifest())
    first.put("t", df((1, "a"), (2, "b")), ["id"])
    other.put("t", df((9, "z")), ["id"])
    first.publish()
    with pytest.raises(Conflict):
        other.publish()
    assert rows() == [(1, "a"), (2, "b")] and store.versions() == [0]
    for i in range(3):  # with the third they are as large as the base, and the frame is written whole
        draft = store.next(store.manifest())
        draft.change("t", spark.createDataFrame([(2,), (3 + i,)], "id int"), df((3 + i, "c")))
        draft.publish()
    assert rows() == [(1, "a"), (3, "c"), (4, "c"), (5, "c")] and rows(0) == [(1, "a"), (2, "b")]
    assert len(store.manifest().frames["t"]["paths"]) == 1
    assert store.vacuum() > 0 and store.versions() == [3] and len(rows()) == 4


def test_small_deltas_are_merged_beside_a_large_base(spark, tmp_path):
    store = Store(spark, str(tmp_path), most_deltas=2)
    draft = store.next(store.manifest())
    draft.put("t", spark.range(50_000).selectExpr("id", "uuid() AS v").coalesce(1), ["id"])
    draft.publish()
    base = store.manifest().frames["t"]["paths"][0]
    for i in range(4):
        draft = store.next(store.manifest())
        draft.change("t", spark.createDataFrame([(7,), (10 + i,)], "id long"), spark.createDataFrame([(10 + i, f"new{i}")] + [(7, "back")] * (i == 2), "id long, v string"))
        draft.publish()
    paths = store.manifest().frames["t"]["paths"]
    assert paths[0] == base and len(paths) == 3
    now = store.read(store.manifest(), "t")
    assert now.count() == 49_999 and {x["id"]: x["v"] for x in now.where("v LIKE 'new%' OR v = 'back'").collect()} == {10 + i: f"new{i}" for i in range(4)}


def test_operator_storage(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, b = Storage(store, "g", "take"), Storage(store, "g", "join")
    a.set("x/1", {"n": 1})
    a.set("x/2", [2])
    a.set("y", None)
    a.flush()
    b.flush()
    a.delete("x/2")
    a.set("x/3", 3)
    a.flush()
    again = Storage(store, "g", "take")
    assert again.scan("x/") == [("x/1", {"n": 1}), ("x/3", 3)] and again.get("x/2", 0) == 0 and Storage(store, "g", "join").scan() == []


# --- writes ---


def replayed(rows, ops):
    """One mutation after the other: {id: v}, and the failed ones."""
    failed = []
    for m in sorted({o[4] for o in ops}):
        trial, ok = dict(rows), True
        for i, v, op, _, mine in sorted(ops, key=lambda o: o[3]):
            if mine != m:
                continue
            if op == "insert" and i in trial:
                ok = False
            elif op in ("insert", "upsert"):
                trial[i] = v
            elif op == "update" and i in trial and v is not None:
                trial[i] = v
            elif op == "delete":
                trial.pop(i, None)
        if ok:
            rows = trial
        else:
            failed.append(m)
    return rows, failed


@pytest.mark.parametrize("seed", range(3))
def test_transactions(spark, seed):
    from quillon.streaming import cdc

    r = random.Random(seed)
    base = {i: i for i in range(4)}
    ops = [(r.randrange(8), r.choice([None, 50 + p]), r.choice(["insert", "upsert", "update", "delete"]), p, p // 3) for p in range(24)]
    ops = [(i, 99 if op in ("insert", "upsert") and v is None else v, op, p, m) for i, v, op, p, m in ops]
    want, failed = replayed(base, ops)
    table = spark.createDataFrame(list(base.items()), "id int, v int").coalesce(1)
    feed, gone = mutations.transactions(table, spark.createDataFrame(ops, "id int, v int, _op string, _pos long, mutation_id int").coalesce(1), ["id"], 1)
    assert sorted(x[0] for x in gone.collect()) == failed
    assert dict(map(tuple, cdc.apply_changes(table, feed, ["id"]).collect())) == want


def test_tasks_follow_the_operations(spark):
    n = 1_200_000
    table = spark.range(n).withColumn("v", F.lit(1))
    ops = table.select("id", F.lit(2).alias("v"), F.lit("update").alias("_op"), F.col("id").alias("_pos"))
    feed, errors = mutations.crud(table, ops, ["id"], 1)
    each = feed.where("v = 2").groupBy(F.spark_partition_id()).count().collect()
    assert sum(x["count"] for x in each) == n and max(x["count"] for x in each) < n // 5
    assert errors.isEmpty()


def test_rate_limit(spark):
    """Against calls decided one by one; refused ones do not count."""
    r = random.Random(2)
    calls = sorted({(r.choice("abc"), r.randrange(5000)) for _ in range(300)})
    want, counts = {}, {}
    for who, t in sorted(calls, key=lambda c: c[1]):
        here, before = counts.get((who, t // 1000), 0), counts.get((who, t // 1000 - 1), 0)
        want[who, t] = here + before * (1000 - t % 1000) / 1000 < 5
        counts[who, t // 1000] = here + want[who, t]
    df = spark.createDataFrame(calls, "who string, t long").repartition(5)
    assert {(x["who"], x["t"]): x["allowed"] for x in mutations.rate_limited(df, ["who"], "t", 1000, 5).collect()} == want
    assert not any(x["allowed"] for x in mutations.rate_limited(df, ["who"], "t", 1000, 0).collect())
    with pytest.raises(ValueError, match="size"):
        mutations.rate_limited(df, ["who"], "t", 0, 5)


def test_pushes(spark):
    schema = "client string, connection string, revision int, arrived int, mutations array<int>, schema_version int, user string, url string, stop boolean"
    rows = [("a", "w", 1, 3, [3], 1, "u", None, False), ("a", "w", 1, 1, [1, 2], 1, "u", None, None), ("b", "w", 1, 2, [4], 1, "u", "x", False), ("b", "w", 1, 4, [5], 2, "u", "x", False), ("a", "w", 2, 5, [6], 1, "u", None, False), (None, None, None, 6, None, None, None, None, True), ("a", "w", 1, 7, [7], 1, "u", None, False)]
    batches, conflicts = mutations.push_batches(spark.createDataFrame(rows, schema))
    assert {(x["client"], x["revision"]): x["mutations"] for x in batches.collect()} == {("a", 1): [1, 2, 3], ("a", 2): [6]}
    assert [x["client"] for x in conflicts.collect()] == ["b"]


# --- records ---


def test_versions():
    assert views.one_after(None) == ("00", 0) and views.one_after(("01", 0)) == ("01", 1)
    order = [None, ("00", 0), ("00", 1), ("01", 0), ("110", 0)]
    for i, a in enumerate(order):
        for j, b in enumerate(order):
            assert views.compare_versions(a, b) == (i > j) - (i < j)
    assert views.later_version(("01", 0), None) == ("01", 0) and views.later_version(("01", 0), ("01", 2)) == ("01", 2)


def test_desires(spark):
    have = spark.createDataFrame([("a", "q", 1000.0, None, 1), ("a", "r", 1000.0, 5, 1), ("b", "q", 700.0, None, 1)], "client string, query string, ttl double, inactivated_at long, version int")
    asked = spark.createDataFrame([("a", "q", 900.0), ("a", "r", 10.0), ("b", "q", -1.0), ("c", "s", None)], "client string, query string, ttl double")
    after, patches = views.put_desires(have, asked, F.lit(2))
    assert {(x["client"], x["query"]) for x in patches.collect()} == {("a", "r"), ("b", "q"), ("c", "s")}
    assert {tuple(x) for x in after.collect()} == {("a", "q", 1000.0, None, 1), ("a", "r", 10.0, None, 2), ("b", "q", 600_000.0, None, 2), ("c", "s", 300_000.0, None, 2)}
    with pytest.raises(ValueError, match="reserved"):
        views.put_desires(have, asked, F.lit(2), internal=["s"])
    after, patches = views.delete_desires(have, asked.where("query <> 's'"), F.lit(3), now=9)
    assert {tuple(x) for x in after.collect()} == {("a", "q", 1000.0, 9, 3), ("a", "r", 1000.0, 5, 1), ("b", "q", 700.0, 9, 3)} and patches.count() == 2
    after, _ = views.clear_desires(have, "a", F.lit(3))
    assert {(x["client"], x["query"]) for x in after.collect()} == {("a", "r"), ("b", "q")}


def test_purge_and_trim(spark):
    groups = spark.createDataFrame([("a", 1, False), ("b", 5, False), ("c", 90, False), ("d", 2, True), ("e", 40, True)], "group string, last_active long, deleted boolean")
    kids = {"rows": spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "group string, n int")}
    after, kept, left = views.purge(groups, kids, 100, 50, 1, 97)
    assert {(x["group"], x["deleted"]) for x in after.collect()} == {("b", False), ("c", False), ("e", True)}
    assert {x["group"] for x in kept["rows"].collect()} == {"b", "c"} and left.first()[0] == 1
    assert views.next_purge(25, 60_000, 10, 11, 25, 60_000) == (50, 60_000) and views.next_purge(50, 60_000, 11, 3, 25, 60_000) == (50, 60_000)
    assert views.next_purge(50, 60_000, 3, 0, 25, 60_000) == (50, 120_000) and views.next_purge(50, 900_000, None, 0, 25, 60_000) == (50, 960_000)
    log, cursors = spark.createDataFrame([(i, "q") for i in range(5)], "seq int, query string"), spark.createDataFrame([("x", 2), ("y", 4)], "client string, seq long")
    assert [x["seq"] for x in views.trimmed(log, cursors).orderBy("seq").collect()] == [2, 3, 4] and views.trimmed(log, cursors.limit(0)).isEmpty()


def test_pokes(spark):
    none = spark.createDataFrame([], "op string, table string, row_key string, row string")
    assert views.pokes(none, "00", "01").isEmpty()
    frames = [json.loads(x["body"]) for x in views.pokes(none, "00", "01", force=True).collect()]
    assert {"pokeStart": {"pokeID": "01", "baseCookie": "00"}} in frames and {"pokeEnd": {"pokeID": "01", "cookie": "01"}} in frames


# --- sources ---


def test_discovered_database(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:quillon;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        run = connection.createStatement().execute
        for sql in ("CREATE TABLE app.t (id INT PRIMARY KEY, code VARCHAR(9) NOT NULL UNIQUE, v DOUBLE)", "CREATE TABLE app.u (code VARCHAR(9) NOT NULL UNIQUE)", "CREATE TABLE app.keyless (x INT)", "CREATE TABLE app.blank (id BIGINT PRIMARY KEY)"):
            run(sql)
        run("INSERT INTO app.t VALUES " + ", ".join(f"({i * 3}, 'c{i}', {i}.5)" for i in range(20)))
    finally:
        connection.close()
    found = {f.spec.name: f for f in discover(spark, url, "APP")}
    assert {n: (f.spec.primary_key, f.spec.unique_keys, f.ranged_by) for n, f in found.items()} == {"T": (("ID",), (("CODE",),), "ID"), "U": (("CODE",), (), None), "BLANK": (("ID",), (), "ID")}
    df = initial_snapshot(spark, url, found["T"], "APP", 4)
    assert df.rdd.getNumPartitions() == 4 and {(x["ID"], x["CODE"]) for x in df.collect()} == {(i * 3, f"c{i}") for i in range(20)}
    assert initial_snapshot(spark, url, found["BLANK"], "APP").isEmpty() and initial_snapshot(spark, url, found["U"], "APP").isEmpty()


def test_memory_table(spark):
    t = MemoryTable(spark, TableSpec("t", ("id",)), "id int, v string", [(1, "a")])
    t.push("add", (2, "b"))
    t.push("edit", (3, "c"), old=(1, "a"))
    t.push("remove", (2, "b"))
    assert t.find_by_key(id=3) == (3, "c") and t.find_by_key(id=1) is None
    assert Compiler(Catalog(spark).add(t.spec, t.fetch)).rows(Query("t", where=cmp("v", "=", "c"))).count() == 1
    for bad in (("add", (3, "x")), ("remove", (9, "x"))):
        with pytest.raises(ValueError):
            t.push(*bad)


def test_renamed_query():
    names = NameMapper({"a": ("b", {"x": "y", "z": "w"})})
    q = Query("a", where=any_of(cmp("x", "=", 1), exists("x", "z", Query("a", where=cmp("z", "<", 2)))), related=(related("z", "x", Query("a")),), order_by=(("z", "desc"),))
    assert names.inverse().query(names.query(q)) == q and names.query(q).table == "b" and '"x"' not in to_json(names.query(q))
    with pytest.raises(KeyError):
        names.query(Query("a", where=cmp("nothing", "=", 1)))
    assert key_matches(["b", "a"], ("a", "b")) and not key_matches(["a"], ("a", "b"))


def test_text_copy(spark):
    lines = ["1\tplain\tt\t{1,2,NULL}\t2020-01-02\t\\\\x00ff", "2\ta\\tb\\nc\\\\d\\x41\\101\\q\tf\t{}\t\\N\t\\N", "3\t\\N\t\\N\t\\N\t\\N\t\\N", "4\t\t\\N\t\\N\t\\N\t\\N", "\\."]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(x) for x in copy_format.decode_text(df, "id int, s string, b boolean, a array<int>, d date, y binary").orderBy("id").collect()]
    assert got[0][:4] == (1, "plain", True, [1, 2, None]) and str(got[0][4]) == "2020-01-02" and bytes(got[0][5]) == b"\x00\xff"
    assert got[1][:4] == (2, "a\tb\nc\\dAAq", False, []) and got[2] == (3, None, None, None, None, None) and got[3][1] == ""
    with pytest.raises(Exception, match="fields expected"):
        copy_format.decode_text(spark.createDataFrame([("1\t2",)], "value string"), "id int").collect()


def test_binary_copy(spark):
    field = lambda b: struct.pack(">i", -1) if b is None else struct.pack(">i", len(b)) + b
    number = struct.pack(">hhHhhhh", 3, 1, 0x4000, 2, 1, 2345, 6700)  # -12345.67
    array = struct.pack(">iiIii", 1, 1, 23, 2, 1) + field(struct.pack(">i", 7)) + field(None)
    rows = [[struct.pack(">q", 5), "é".encode(), number, array, struct.pack(">q", 86_400_000_000), b"\1"], [struct.pack(">q", -6), None, None, struct.pack(">iiI", 0, 0, 23), None, b"\0"]]
    data = copy_format.SIGNATURE + struct.pack(">ii", 0, 0) + b"".join(struct.pack(">h", len(r)) + b"".join(map(field, r)) for r in rows) + struct.pack(">h", -1)
    schema = "id bigint, s string, n decimal(12,2), a array<int>, t timestamp_ntz, b boolean"
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    got = copy_format.decode_binary(df, ["int8", "text", "numeric", "int4[]", "timestamp", "bool"], schema).collect()
    assert [str(x["n"]) for x in got] == ["-12345.67", "None"] and [x["a"] for x in got] == [[7, None], []]
    assert [(x["id"], x["s"], x["b"]) for x in got] == [(5, "é", True), (-6, None, False)] and str(got[0]["t"]) == "2000-01-02 00:00:00"
    with pytest.raises(ValueError, match="binary copy"):
        list(copy_format.binary_rows(b"nothing", ["int8"]))
    with pytest.raises(ValueError, match="reader"):
        copy_format.reader("point")


# --- statistics ---


def test_digest():
    r = random.Random(1)
    values = [r.gauss(0, 10) for _ in range(30_000)]
    parts = [stats.Digest(200).add(values[i::7]) for i in range(7)]
    d = parts[0]
    for p in parts[1:]:
        d.merge(stats.Digest.from_json(p.to_json()))
    ordered = sorted(values)
    assert d.count() == len(values) and len(d.means) <= 201 and d.quantile(0) == ordered[0] and d.quantile(1) == ordered[-1]
    for q in (0.001, 0.1, 0.5, 0.9, 0.999):
        rank = sum(v <= d.quantile(q) for v in values) / len(values)
        assert abs(rank - q) < 0.01 and abs(d.cdf(ordered[int(q * len(values))]) - q) < 0.01
    empty = stats.Digest.from_json(stats.Digest().to_json())
    assert math.isnan(empty.quantile(0.5)) and math.isnan(empty.cdf(1)) and stats.Digest().add([math.nan]).count() == 0
    assert [stats.Digest().add([4, 4]).cdf(x) for x in (3, 4, 5)] == [0, 1, 1]


def test_copies(spark, sf, tmp_path):
    found = stats.copied(spark.read.parquet(f"{sf}/nation.parquet"), "nation", lambda df: df.write.parquet(str(tmp_path / "n")), clock=iter([1.0, 1.5]).__next__)
    assert found == {"table": "nation", "rows": 25, "bytes": found["bytes"], "ms": 500} and found["bytes"] > 0
    assert stats.copy_report([found, found]) == {"tables": 2, "rows": 50, "bytes": 2 * found["bytes"], "ms": 500}


def test_nearest_rank_of_odd_data(spark):
    rows = [("a", None), ("a", 1.0), ("b", 7.0), ("b", 7.0), (None, 3.0), ("c", None)] + [("d", float(i % 10)) for i in range(1000)]
    got = {x["g"]: tuple(x)[1:] for x in stats.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", by=["g"]).collect()}
    assert got == {"a": (1, 1, 1, 1, 1, 1), "b": (7, 7, 7, 7, 7, 2), None: (3, 3, 3, 3, 3, 1), "d": (0, 4, 7, 9, 9, 1000)}


# --- rights, names, plans ---


@pytest.mark.parametrize(
    ("document", "where"),
    [
        ({"schema": {}}, "permissions"), ({"permissions": None}, "permissions"), ({"tables": []}, "tables"), ({"tables": {"t": {"row": {"select": {}}}}}, "tables.t.row.select"),
        ({"tables": {"t": {"row": {"select": [["deny", {}]]}}}}, "select"), ({"tables": {"t": {"row": {"insert": [["allow", {"type": "literal", "value": 1}]]}}}}, "insert"),
        ({"tables": {"t": {"cell": {"c": {"update": {"preMutation": [["allow", {"type": "what"}]]}}}}}}, "preMutation"),
    ],
)
def test_broken_permission_documents(document, where):
    with pytest.raises(ValueError, match=where):
        rewrite.permission_document(json.dumps(document))


def test_permission_documents():
    assert rewrite.permission_document({}) == (None, {}) and rewrite.permission_document({"permissions": {"tables": {}}}) == ({}, {})
    reading, writing = rewrite.permission_document({"tables": {"t": {}}})
    assert reading == {"t": ()} and writing["t"]["row"].insert is None


def test_named_queries():
    now = [0.0]
    names = rewrite.NamedQueries(seconds=5, clock=lambda: now[0])
    names.define("q", lambda x: Query("t", limit=x))
    names.define("bad", lambda: 1 / 0)
    wanted = [("1", "q", [3]), ("2", "bad", []), ("3", "none", [])]
    first = names.transform(wanted, {"user": "u"})
    assert [x["id"] for x in first["queries"]] == ["1"] and [(x["id"], x["error"]) for x in first["errors"]] == [("2", "app"), ("3", "unknown")] and not first["cached"]
    assert names.transform(wanted[:1], {"user": "u"})["cached"] and not names.transform(wanted[:1], {"user": "v"})["cached"]
    now[0] = 6
    assert not names.transform(wanted[:1], {"user": "u"})["cached"]
    assert rewrite.cache_key("1", {"h": {"a": 1, "b": 2}}) == rewrite.cache_key("1", {"h": {"b": 2, "a": 1}}) != rewrite.cache_key("2", {"h": {"a": 1, "b": 2}})


def test_plans():
    rows = {"p": 1000.0, "c": 5000.0, "few": 2.0}
    kept = {"c": 5000.0, "few": 2.0, "p": 1000.0}
    levels = lambda q, given: planner.Level(rows[q.table], 1.0 if given else kept[q.table])
    fanout = lambda table, columns: 5.0 if table == "c" else 1.0
    few, many = exists("id", "pid", Query("few")), exists("id", "pid", Query("c"))
    assert planner.best_flips(Query("p", where=few), levels, fanout)[0] == {(0,)}
    assert planner.best_flips(Query("p", where=many), levels, fanout)[0] == frozenset()
    assert planner.best_flips(Query("p", where=all_of(few, many)), levels, fanout)[0] == {(0,)}
    again = exists("id", "pid", Query("few"))
    rows_of = lambda q, *flips: planner.estimate(q, frozenset(flips), levels, fanout).rows
    one, either = Query("p", where=few), Query("p", where=any_of(few, again))
    assert rows_of(either) == rows_of(one)  # one pass tries the branches in turn
    assert rows_of(either, (0,), (1,)) == 2 * rows_of(one, (0,))  # each is a fetch of its own, and they sum up
    assert planner.flippable(Query("p", where=exists("id", "pid", Query("c"), negated=True))) == []
    deep = Query("p", where=exists("id", "pid", Query("c", where=few)))
    assert planner.flippable(deep) == [(0,), (0, 0)]
    marked = planner.marked(deep, frozenset({(0, 0)}))
    assert from_json(to_json(marked)) == marked and marked.where.flip is False and marked.where.related.subquery.where.flip is True
    nine = Query("p", where=all_of(*[few] * 10))
    assert planner.best_flips(nine, levels, fanout)[0] == frozenset()
    assert planner.translated(frozenset("ab"), ("b", "x"), ("y", "z")) == {"y"} and planner.translated(frozenset("q"), ("b",), ("y",)) is None
    assert planner.merged(None, frozenset("a")) == planner.merged(frozenset("a"), None) == {"a"} and planner.merged(None, None) is None
    assert planner.sort_cost(1) == 0 and planner.sort_cost(8) == pytest.approx(2.4) and planner.semi_selectivity(0.5, 2) == 0.75


def test_flipped_join_gives_the_same_rows(spark, sf):
    from quillon.sources.catalog import parquet_catalog

    catalog = parquet_catalog(spark, sf)
    q = Query("customer", where=all_of(cmp("c_acctbal", ">", 0.0), exists("c_custkey", "o_custkey", Query("orders", where=cmp("o_totalprice", ">", 250000.0)))))
    plain, turned = (Compiler(catalog).rows(planner.marked(q, f)) for f in (frozenset(), frozenset({(0,)})))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, turned.collect())) and turned.columns == plain.columns
