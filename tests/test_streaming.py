"""Change capture and live queries: replayed changes end where recomputation does."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import ordering
from quillon.plans.ast import Query, Start, any_of, cmp, exists, related
from quillon.plans.compiler import Compiler
from quillon.sources.catalog import TableSpec
from quillon.sources.store import Draft
from quillon.streaming import cdc
from quillon.streaming.live import LiveQueries, over_budget, replication_lag, stream_progress

SCHEMA = "id int, v int, u string, _version long, _pos long, _op string, _old_id int"


def final(base, changes):
    """Plain replay: {id: (v, u)}; a unique u is taken from whoever had it."""
    rows = {i: (v, u) for i, v, u in base}
    for i, v, u, _, _, op, old in sorted(changes, key=lambda c: c[3:5]):
        if op == "truncate":
            rows.clear()
        elif op == "delete":
            rows.pop(i, None)
        else:
            if op == "update" and old is not None:
                rows.pop(old, None)
            rows[i] = (v, u)
    return rows


def random_changes(r, n, version):
    out = []
    for pos in range(n):
        op = r.choices(["insert", "update", "delete", "truncate"], [4, 4, 3, 0.2])[0]
        i = r.randrange(8)
        old = r.randrange(8) if op == "update" and r.random() < 0.3 else None
        out.append((i, r.randrange(100), None, version, pos, op, old))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_apply_matches_replay(spark, seed):
    r = random.Random(seed)
    base = [(i, 0, None) for i in range(5)]
    changes = [c for v in (1, 2, 3) for c in random_changes(r, 6, v)]
    feed = spark.createDataFrame(changes, SCHEMA)
    got = cdc.apply_changes(spark.createDataFrame(base, "id int, v int, u string"), feed, ["id"])
    assert {x["id"]: (x["v"], x["u"]) for x in got.collect()} == final(base, changes)


def test_unique_key_and_rollback(spark):
    base = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, None)], "id int, v int, u string")
    feed = spark.createDataFrame([(4, 4, "a", 1, 0, "insert", None), (5, 5, "b", 2, 0, "insert", None), (5, 5, "b", 2, 1, "rollback", None), (6, 6, None, 3, 0, "insert", None)], SCHEMA)
    got = cdc.apply_changes(base, cdc.committed(feed), ["id"], [["u"]])
    assert {x["id"] for x in got.collect()} == {2, 3, 4, 6}


def test_log_and_ddl(spark):
    feed = spark.createDataFrame([(1, 1, "a", 1, 0, "insert", None), (1, 2, "a", 2, 0, "update", None), (2, 1, "b", 2, 1, "insert", None), (2, 1, "b", 3, 0, "delete", None)], SCHEMA)
    log = cdc.change_log(feed, "t", ["id"])
    assert {(x["row_key"], x["version"], x["op"]) for x in log.collect()} == {('{"id":1}', 2, "s"), ('{"id":2}', 3, "d")}
    now = cdc.apply_changes(spark.createDataFrame([], "id int, v int, u string"), feed, ["id"])
    assert {(x["row_key"], x["op"]) for x in cdc.catch_up(log, now, ["id"], 2).collect()} == {('{"id":2}', "d")}
    tables = cdc.apply_ddl({"t": now}, {"tag": "add-column", "table": "t", "column": "w", "type": "long", "default": 7})
    tables = cdc.apply_ddl(tables, {"tag": "update-column", "table": "t", "column": "v", "new": "vv", "type": "string"})
    tables = cdc.apply_ddl(tables, {"tag": "rename-table", "table": "t", "new": "s"})
    assert tables["s"].dtypes == [("id", "int"), ("vv", "string"), ("u", "string"), ("w", "bigint")]
    assert cdc.schema_drift(now.schema, tables["s"].schema) == ["missing vv", "missing w", "extra v"]


T_SPEC, C_SPEC = TableSpec("t", ("id",)), TableSpec("c", ("id",))
C_SCHEMA = "id int, tid int, _version long, _pos long, _op string"


def live_with_tables(spark, folder, **kw):
    live = LiveQueries(spark, str(folder), {"t": T_SPEC, "c": C_SPEC}, **kw)
    live.load("t", spark.createDataFrame([(i, i * 10, None) for i in range(6)], "id int, v int, u string"))
    live.load("c", spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, tid int"))
    return live


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def recomputed(live, q):
    return rows(Compiler(live.catalog()).result_set(q))


QUERIES = {
    "plain": Query("t", where=cmp("v", ">", 20)),
    "top": Query("t", order_by=(("v", "desc"),), limit=2),
    "after": Query("t", where=cmp("v", "<", 90), start=Start((("id", 0),)), order_by=(("id", "asc"),), limit=3),
    "tree": Query("t", where=exists("id", "tid", Query("c", where=cmp("id", ">", 3))), related=(related("id", "tid", Query("c", limit=1)),)),
    "none": Query("t", where=any_of(exists("id", "tid", Query("c"), negated=True), cmp("v", ">", 70))),
    "deep": Query("c", where=exists("tid", "id", Query("t", where=exists("id", "tid", Query("c", where=cmp("id", ">", 6))))), related=(related("tid", "id", Query("t")),), limit=4),
}


def child_changes(r, n, version):
    out = []
    for pos in range(n):
        out.append((r.randrange(12), r.randrange(7), version, pos, r.choices(["insert", "update", "delete"], [3, 3, 2])[0]))
    return out


def test_live_equals_recomputed(spark, tmp_path):
    """Random commits to two tables: results and patches are those of computing everything anew."""
    live, r = live_with_tables(spark, tmp_path, most_deltas=2, clock=lambda: 0.0), random.Random(3)
    held = {}
    for name, q in QUERIES.items():
        assert rows(live.add(name, q).drop("kind")) == rows(live.result(name)) == recomputed(live, q)
        assert live.add(name, q).count() == 0  # again: nothing new
        held[name] = {x[:2]: x for x in rows(live.result(name))}
    for version in range(1, 3):
        feeds = {}
        if version != 2:
            changes = [c for c in random_changes(r, 5, version) if c[5] != "truncate"]
            feeds["t"] = spark.createDataFrame(changes, SCHEMA).coalesce(1)
        feeds["c"] = spark.createDataFrame(child_changes(r, 4, version), C_SCHEMA).coalesce(1)
        out = live.advance(feeds)
        for name, q in QUERIES.items():
            assert rows(live.result(name)) == recomputed(live, q), name
            if name in out.patches:  # patches lead from the old rows to the new
                for x in out.patches[name].collect():
                    was = held[name].pop((x["table"], x["row_key"]), None)
                    assert (was is None) == (x["kind"] == "add")
                    if x["kind"] != "remove":
                        held[name][x["table"], x["row_key"]] = (x["table"], x["row_key"], x["row"])
            assert sorted(held[name].values(), key=str) == rows(live.result(name)), name
    gone = live.remove("top")
    assert gone.where("kind <> 'remove'").isEmpty() and "top" not in live.queries()


def insert(spark, i, v, version=1):
    return spark.createDataFrame([(i, v, None, version, 0, "insert", None)], SCHEMA)


def test_replay_and_restart(spark, tmp_path):
    """A batch again changes nothing and tells the same; another process goes on where the last ended."""
    live = live_with_tables(spark, tmp_path)
    live.add("plain", QUERIES["plain"])
    first = live.advance({"t": insert(spark, 9, 99)}, ("feed", 3))
    before = live.manifest().version
    again = live.advance({"t": insert(spark, 9, 99)}, ("feed", 3))
    assert live.manifest().version == before == first.version == again.version
    assert rows(first.patches["plain"]) == rows(again.patches["plain"])
    assert live.advance({"t": insert(spark, 9, 1)}, ("feed", 2)).patches == {}  # older still
    other = LiveQueries(spark, str(tmp_path), {"t": T_SPEC, "c": C_SPEC})
    assert list(other.queries()) == ["plain"] and other.manifest().version == before
    other.advance({"t": insert(spark, 10, 50, 2)}, ("feed", 4))
    assert rows(live.result("plain")) == recomputed(live, QUERIES["plain"])
    assert {x["row_key"] for x in live.since(first.version - 1).collect()} == {'{"id":9}', '{"id":10}'}
    live.store.vacuum()
    assert rows(other.result("plain")) == recomputed(other, QUERIES["plain"])


@pytest.mark.parametrize("step", ["put", "change", "keep", "publish"])
def test_killed_at_any_step(spark, tmp_path, monkeypatch, step):
    """What a version has written before it fails is never seen, and the same batch then succeeds."""
    live = live_with_tables(spark, tmp_path)
    live.add("top", QUERIES["top"])
    before, version = rows(live.result("top")), live.manifest().version
    kind = "truncate" if step == "put" else "insert"
    feed = spark.createDataFrame([(7, 1, None, 1, 0, kind, None), (8, 1, None, 1, 1, "insert", None), (1, 5, None, 1, 2, "update", None)], SCHEMA)
    original = getattr(Draft, step)

    def fails(self, *a, **k):
        if step != "publish":
            original(self, *a, **k)
        raise OSError("killed")

    monkeypatch.setattr(Draft, step, fails)
    with pytest.raises(OSError):
        live.advance({"t": feed}, ("feed", 0))
    monkeypatch.setattr(Draft, step, original)
    assert live.manifest().version == version and rows(live.result("top")) == before
    live.advance({"t": feed}, ("feed", 0))
    assert live.manifest().version == version + 1 and rows(live.result("top")) == recomputed(live, QUERIES["top"])


def test_resets(spark, tmp_path):
    """Why a query starts afresh: truncation, schema, scalar, permissions, time."""
    ticks = iter(range(10**6))
    live = live_with_tables(spark, tmp_path, clock=lambda: float(next(ticks)))
    scalar = Query("t", where=exists("v", "tid", Query("c", where=cmp("id", "=", 1)), scalar=True))
    live.add("scalar", scalar)
    live.add("plain", QUERIES["plain"])
    child = spark.createDataFrame([(1, 30, 1, 0, "update")], C_SCHEMA)
    assert live.advance({"c": child}).resets == {"scalar": "scalar-subquery"}
    assert [x["row_key"] for x in live.result("scalar").collect()] == ['{"id":3}']
    assert over_budget(60, 100, 0, 4) and not over_budget(60, 130, 0, 4) and over_budget(131, 130, 3, 4)
    assert not over_budget(49, 1, 0, 4) and not over_budget(999, 1, 4, 5) and not over_budget(999, 1, 0, 0)
    slow = live_with_tables(spark, tmp_path / "slow", clock=iter(x * 0.001 if x < 5 else x * 100.0 for x in range(10**6)).__next__)
    for n in ("plain", "none"):
        slow.add(n, QUERIES[n])
    assert set(slow.advance({"t": insert(spark, 9, 99)}).resets.values()) == {"advancement-timeout"}
    assert all(rows(slow.result(n)) == recomputed(slow, QUERIES[n]) for n in ("plain", "none"))
    cut = spark.createDataFrame([(0, 0, None, 2, 0, "truncate", None)], SCHEMA)
    assert live.advance({"t": cut}).resets == {"scalar": "truncation", "plain": "truncation"} and live.result("plain").isEmpty()
    out = live.alter({"tag": "add-column", "table": "t", "column": "w", "type": "int", "default": 1})
    assert set(out.resets.values()) == {"schema-change"} and "w" in live.catalog().table("t").columns
    live.advance({"t": spark.createDataFrame([(5, 50, None, 2, 3, 0, "insert", None)], "id int, v int, u string, w int, _version long, _pos long, _op string, _old_id int")})
    assert live.result("plain").count() == 1
    out = live.set_rules({}, {"plain": QUERIES["plain"]})
    assert out.resets == {"plain": "permissions-change"} and [x["kind"] for x in out.patches["plain"].collect()] == ["remove"]
    out = live.alter({"tag": "drop-table", "table": "c"})
    assert out.resets == {"scalar": "schema-change"} and list(live.queries()) == ["plain"]


def test_commits(spark, tmp_path, monkeypatch):
    """A batch of writes holds or fails as a whole, and is judged again when another came first."""
    live = live_with_tables(spark, tmp_path)
    live.add("plain", QUERIES["plain"])
    ops = "id int, v int, u string, _op string, _pos long"
    out, errors = live.commit("t", spark.createDataFrame([(20, 99, None, "insert", 0), (3, 99, None, "insert", 1)], ops))
    assert out is None and [(x["id"], x["_pos"]) for x in errors.collect()] == [(3, 1)] and live.catalog().table("t").count() == 6
    out, errors = live.commit("t", spark.createDataFrame([(20, 99, None, "insert", 0), (3, None, None, "delete", 1), (3, 77, None, "insert", 2)], ops))
    assert errors.isEmpty() and {(x["kind"], x["row_key"]) for x in out.patches["plain"].collect()} == {("add", '{"id":20}'), ("edit", '{"id":3}')}
    other, tried = LiveQueries(spark, str(tmp_path), live.specs), []
    advance = LiveQueries.advance

    def meets_another(self, feeds, position=None, expect=None):
        if not tried:
            tried.append(expect)
            advance(other, {"t": insert(spark, 21, 5, 9)})
        return advance(self, feeds, position, expect)

    monkeypatch.setattr(LiveQueries, "advance", meets_another)
    out, errors = live.commit("t", spark.createDataFrame([(21, 6, None, "insert", 0)], ops))
    assert out is None and errors.count() == 1  # the other's insert is there now


def test_two_tables_followed_at_once(spark, tmp_path):
    live = live_with_tables(spark, tmp_path / "state")
    live.add("tree", QUERIES["tree"])
    streams = []
    for name, schema in (("t", SCHEMA), ("c", C_SCHEMA)):
        folder = str(tmp_path / name)
        data = [(30, 1, None, 1, 0, "insert", None)] if name == "t" else [(40, 30, 1, 0, "insert")]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(folder)
        streams.append(live.follow(name, cdc.feed_stream(spark, folder, schema, 1), str(tmp_path / f"{name}-checkpoint"), availableNow=True))
    for x in streams:
        x.awaitTermination()
    assert rows(live.result("tree")) == recomputed(live, QUERIES["tree"]) and live.catalog().table("t").count() == 7
    assert '{"id":30}' in {x["row_key"] for x in live.result("tree").collect()}


def test_one_stream_of_several_tables(spark, tmp_path):
    """A parent and its child come in one batch and are one version; unknown tables are left out."""
    live = live_with_tables(spark, tmp_path / "state")
    live.add("tree", QUERIES["tree"])
    version, folder, schema = live.manifest().version, str(tmp_path / "feed"), "_table string, _row string, _old string, _version long, _pos long, _op string"
    changes = [("t", '{"id":30,"v":1}', None, 1, 0, "insert"), ("c", '{"id":40,"tid":30}', None, 1, 1, "insert"), ("t", '{"id":31,"v":0}', '{"id":0}', 1, 2, "update"), ("other", "{}", None, 1, 3, "insert")]
    spark.createDataFrame(changes, schema).coalesce(1).write.parquet(folder)
    live.follow_all(cdc.feed_stream(spark, folder, schema), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert live.manifest().version == version + 1 and rows(live.result("tree")) == recomputed(live, QUERIES["tree"])
    assert {x["row_key"] for x in live.patches(version + 1)["tree"].collect()} >= {'{"id":30}', '{"id":40}'}
    assert {x["id"] for x in live.catalog().table("t").collect()} == {1, 2, 3, 4, 5, 30, 31}


def test_stream(spark, tmp_path):
    live = LiveQueries(spark, str(tmp_path / "state"), {"t": T_SPEC})
    live.load("t", spark.createDataFrame([(1, 1, None)], "id int, v int, u string"))
    live.add("all", Query("t", where=cmp("v", ">", 0)))
    folder = str(tmp_path / "feed")
    for version in (1, 2, 3):
        spark.createDataFrame([(version, version * 5, None, version, 0, "insert", None)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        source = cdc.subscription(spark, folder, SCHEMA, 0)
        live = LiveQueries(spark, str(tmp_path / "state"), {"t": T_SPEC})  # a new process each time
        stream = live.follow("t", source, str(tmp_path / "checkpoint"), availableNow=True)
        stream.awaitTermination()
        assert stream_progress(stream)["rows"] >= 1
    assert {(x["id"], x["v"]) for x in live.catalog().table("t").collect()} == {(1, 5), (2, 10), (3, 15)}
    assert live.result("all").count() == 3


def test_lag(spark):
    beats = spark.createDataFrame([("a", 1, 3, 9), ("a", 20, 25, 26), ("a", 40, None, None), ("b", 5, None, None)], "stream string, sent_ms long, commit_ms long, received_ms long")
    got = {x["stream"]: tuple(x)[1:] for x in replication_lag(beats, 100).collect()}
    assert got == {"a": (20, 5, 6, 60), "b": (None, None, None, 95)}


# --- frames of a replication stream ---


def frame(seq, tag, **kw):
    return ("s", seq, json.dumps({"tag": tag, **{k: json.dumps(v) if k in ("new", "old") else v for k, v in kw.items()}}))


def test_frames(spark):
    frames = [
        frame(0, "relation", id=1, table="t"), frame(1, "relation", id=2, table="c"), frame(2, "origin"),
        frame(3, "begin", version=1), frame(4, "insert", relation=1, new={"id": 1, "v": 5}), frame(5, "insert", relation=2, new={"id": 7}), frame(6, "commit"),
        frame(7, "begin", version=2), frame(8, "insert", relation=1, new={"id": 2, "v": 6}), frame(9, "rollback"),
        frame(10, "begin", version=3), frame(11, "update", relation=1, new={"id": 3, "v": 7}, old={"id": 1}), frame(12, "message", prefix="ddl", content="{}"),
        frame(13, "truncate", relations=[2, 1]), frame(14, "relation", id=1, table="c"), frame(15, "insert", relation=1, new={"id": 8}), frame(16, "commit"),
        frame(17, "begin", version=4), frame(18, "delete", relation=2, old={"id": 8}), frame(19, "begin", version=5), frame(20, "commit"), frame(21, "insert", relation=1, new={"id": 9}),
        frame(22, "nonsense"), frame(23, "begin", version=6), frame(24, "insert", relation=99, new={}), frame(25, "insert", relation=1, new={"id": 10}),
    ]
    df = spark.createDataFrame(frames, "stream string, seq long, body string").repartition(4)
    feeds, ddl, errors = cdc.from_frames(df, {"t": "id int, v int", "c": "id int"}, {"t": ["id"], "c": ["id"]})
    of = lambda t: [(x["_version"], x["_pos"], x["_op"], x["id"], x["_old_id"]) for x in feeds[t].orderBy("_pos").collect()]
    assert of("t") == [(1, 4, "insert", 1, None), (3, 11, "update", 3, 1), (3, 13, "truncate", None, None)]
    assert of("c")[:3] == [(1, 5, "insert", 7, None), (3, 13, "truncate", None, None), (3, 15, "insert", 8, None)]
    assert [(x["seq"], x["version"]) for x in ddl.collect()] == [(12, 3)]
    assert {(x["seq"], x["reason"]) for x in errors.collect()} == {(19, "begin inside a transaction"), (21, "outside a transaction"), (22, "unknown frame"), (24, "relation not defined")}


def _random_frames(seed):
    r, out = random.Random(seed), []
    for stream, n in (("a", 90), ("b", 40), ("c", 3)):
        seq = r.choice([-5, 10**12])
        for i in range(n):
            seq += r.choice([1, 1, 7, 1000])
            tag = r.choices(["begin", "commit", "rollback", "relation", "insert", "delete", "truncate", "message", "other"], [12, 11, 3, 8, 30, 10, 4, 5, 1])[0]
            more = {"begin": {"version": i}, "relation": {"id": r.choice([1, 2, 3]), "table": r.choice("tc")}, "insert": {"relation": r.choice([1, 2, 3, None]), "new": {"id": i}}}
            more |= {"delete": {"relation": r.choice([1, 2]), "old": {"id": i}}, "truncate": {"relations": r.choice([[1, 2], [3], [], [9, 1]])}, "message": {"prefix": r.choice(["ddl", "x"]), "content": "{}"}}
            out.append((stream, *frame(seq, tag, **more.get(tag, {}))[1:]))
    r.shuffle(out)
    return out


def _decode(frames):
    """What from_frames gives, one frame after the other."""
    rows, ddl, errors, state = [], [], [], {}
    for stream, seq, body in sorted(frames):
        m, s = json.loads(body), state.setdefault(stream, {"open": None, "defs": {}, "rows": []})
        tag = m["tag"]
        if tag == "begin":
            if s["open"] is not None:
                errors.append((stream, seq, "begin inside a transaction"))
            s["open"], s["rows"] = m["version"], []
        elif tag == "relation":
            s["defs"][m["id"]] = m["table"]
        elif tag == "message":
            ddl += [(stream, seq, s["open"])] if m["prefix"] == "ddl" else []
        elif tag == "other":
            errors.append((stream, seq, "unknown frame"))
        elif s["open"] is None:
            errors.append((stream, seq, "outside a transaction"))
        elif tag in ("commit", "rollback"):
            rows += s["rows"] if tag == "commit" else []
            s["open"], s["rows"] = None, []
        else:
            for relation in m.get("relations", [m.get("relation")]):
                if relation in s["defs"]:
                    s["rows"].append((s["defs"][relation], s["open"], seq, tag, json.loads(m.get("new") or m.get("old") or "{}").get("id")))
                else:
                    errors.append((stream, seq, "relation not defined"))
    return sorted(map(str, rows)), sorted(map(str, ddl)), sorted(errors)


@pytest.mark.parametrize("block", [7, 10_000])
def test_frames_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(cdc, "BLOCK_FRAMES", block)
    monkeypatch.setattr(ordering, "TASK_ROWS", 4 * block)
    frames = _random_frames(6)
    df = spark.createDataFrame(frames, "stream string, seq long, body string").repartition(3)
    feeds, ddl, errors = cdc.from_frames(df, {"t": "id int", "c": "id int"}, {"t": ["id"], "c": ["id"]})
    rows, changes, wrong = _decode(frames)
    assert len(rows) > 5 and changes and {x[2] for x in wrong} == {"begin inside a transaction", "outside a transaction", "relation not defined", "unknown frame"}
    assert sorted(str((t, x["_version"], x["_pos"], x["_op"], x["id"])) for t in feeds for x in feeds[t].collect()) == rows
    assert sorted(str((x["stream"], x["seq"], x["version"])) for x in ddl.collect()) == changes
    assert sorted(map(tuple, errors.collect())) == wrong


def _largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_no_task_has_a_whole_stream(spark):
    n = 600_000
    body = F.when(F.col("id") == 0, '{"tag": "relation", "id": 1, "table": "t"}').when(F.col("id") == 1, '{"tag": "begin", "version": 7}').when(F.col("id") == n - 1, '{"tag": "commit"}')
    frames = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("seq"), F.coalesce(body, F.lit('{"tag": "insert", "relation": 1, "new": "{}"}')).alias("body"))
    feed = cdc.from_frames(frames, {"t": "id int"}, {"t": ["id"]})[0]["t"]
    assert feed.where("_version = 7").count() == n - 3 and _largest_task(feed) < n // 2


def test_no_task_has_a_whole_streams_errors(spark):
    n = 600_000
    frames = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("seq"), F.lit('{"tag": "insert", "relation": 1}').alias("body"))
    errors = cdc.from_frames(frames, {}, {})[2]
    assert errors.where("reason = 'outside a transaction'").count() == n and _largest_task(errors) < n // 2


def test_row_keys():
    assert cdc.key_columns("default", ["a"], ["b"]) == ("a",) and cdc.key_columns("full", [], ["b"]) == ("b",)
    for args in (("nothing", [], ["b"]), ("full", ["a"], [])):
        with pytest.raises(ValueError, match="primary key"):
            cdc.key_columns(*args)
    with pytest.raises(ValueError, match="identity"):
        cdc.key_columns("other", ["a"], [])


def test_snapshot_diff_with_unique_keys_and_resets(spark):
    before = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id int, v int, u string")
    feed = spark.createDataFrame([(3, 3, "a", 5, 0, "insert", None)], SCHEMA)
    after = cdc.apply_changes(before, feed, ["id"], [["u"]])
    log = cdc.change_log(feed, "t", ["id"])
    got = {(x["kind"], x["row_key"]) for x in cdc.snapshot_diff(before, after, log, ["id"], 4, [["u"]]).collect()}
    assert got == {("add", '{"id":3}'), ("remove", '{"id":1}')}
    with pytest.raises(cdc.ResetNeeded, match="schema-change of t"):
        cdc.snapshot_diff(before, after, log.unionByName(cdc.ddl_log(spark, "t", 6)), ["id"], 4)
    assert cdc.reset_reasons(log.unionByName(cdc.ddl_log(spark, "t", 6)), 6).isEmpty()
    assert cdc.can_resume(log, 4) and not cdc.can_resume(log, 3)


def test_releases(spark):
    acks = spark.createDataFrame([("x", "a", 1), ("x", "b", 5), ("x", "a", 9), ("y", "a", 1), ("z", "a", 1), ("z", "b", 2), ("z", "c", 3), ("z", "d", 4)], "message string, subscriber string, at long")
    at = lambda now, n=3: {x["message"]: x["released"] for x in cdc.releases(acks, n, 10, now).collect()}
    assert at(14) == {"x": False, "y": False, "z": True} and at(15) == {"x": True, "y": False, "z": True}
    assert not at(3, 4)["z"] and at(4, 4)["z"] and not at(13, 5)["z"] and at(14, 5)["z"]


def test_held_back(spark):
    sizes = [0, 50, 99, 100, 90, 81, 80, 99, 120, 10]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "stream string, at long, bytes long")
    got = [x["held"] for x in cdc.held_back(df, 100).orderBy("at").collect()]
    assert got == [False, False, False, True, True, True, False, False, True, False]


def test_backfill_is_completed(spark):
    live = spark.createDataFrame([(1, "x", 5)], "id int, c string, _v_c int")
    assert cdc.backfill_completed(live, ["c"]).columns == ["id", "c"]
