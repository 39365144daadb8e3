"""More registered queries: live state, writes, replication frames, records, rights and plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import mutations, views
from quillon.operators.predicates import key_lookup
from quillon.plans import planner, rewrite
from quillon.plans.ast import Query, all_of, any_of, cmp, complete_ordering, exists, from_json, invalidated, normalise, query_hash, related, to_json
from quillon.plans.compiler import Compiler
from quillon.queries import BIG_SQL, BY_PRICE, CHANGED_SQL, C_COLUMNS, C_SQL, O_COLUMNS, O_SQL, TOP, WATCHED, changed_orders, compiler, desires, diff_sql, has_big, register
from quillon.sources.catalog import Catalog, MemoryTable, NameMapper, TableSpec, contents_and_version, parquet_catalog, sampled
from quillon.sources.copy_format import decode_text
from quillon.sources.store import Store, shared_folder
from quillon.streaming import cdc
from quillon.streaming.live import LiveQueries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet_catalog(spark, sf_dir).table(name)


# --- live queries ---------------------------------------------------------------------------

DEAR = Query("customer", where=exists("c_custkey", "o_custkey", Query("orders", where=cmp("o_totalprice", ">", 250000.0))))
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice")


def live_orders(spark: SparkSession, sf_dir: str, queries: dict[str, Query]) -> LiveQueries:
    live = LiveQueries(spark, shared_folder(spark), {"orders": TableSpec("orders", ("o_orderkey",)), "customer": TableSpec("customer", ("c_custkey",))})
    live.load("orders", table(spark, sf_dir, "orders").select(*ORDER_COLUMNS))
    live.load("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    for name, q in queries.items():
        live.add(name, q)
    return live


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order deleted, every fifth of the rest updated."""
    orders, after = table(spark, sf_dir, "orders"), changed_orders(spark, sf_dir).where("o_orderkey % 5 = 0")
    gone = orders.where("o_orderkey % 7 = 0").select(*ORDER_COLUMNS, F.lit("delete").alias("_op"))
    feed = gone.unionByName(after.select(*ORDER_COLUMNS, F.lit("update").alias("_op")))
    return feed.withColumn("_version", F.lit(1).cast("long")).withColumn("_pos", F.col("o_orderkey").cast("long"))


def _dear_sql(orders: str) -> str:
    return f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)"


LIVE_SQL = f"""SELECT 'watched' AS query, kind, row_key FROM ({diff_sql("SELECT * FROM orders WHERE o_totalprice > 150000", f"SELECT * FROM {CHANGED_SQL} WHERE o_totalprice > 150000")})
UNION ALL SELECT 'top', kind, row_key FROM ({diff_sql("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", f"SELECT * FROM {CHANGED_SQL} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")})
UNION ALL SELECT 'dear', CASE WHEN a.c_custkey IS NULL THEN 'add' ELSE 'remove' END, '{{"c_custkey":' || coalesce(a.c_custkey, b.c_custkey) || '}}'
FROM ({_dear_sql("orders")}) a FULL OUTER JOIN ({_dear_sql(CHANGED_SQL + " AS x")}) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL
UNION ALL (WITH a AS (SELECT * FROM orders WHERE o_totalprice > 250000), b AS (SELECT * FROM {CHANGED_SQL} WHERE o_totalprice > 250000)
SELECT 'dear', CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN b.o_orderkey IS NULL THEN 'remove' ELSE 'edit' END, '{{"o_orderkey":' || coalesce(a.o_orderkey, b.o_orderkey) || '}}'
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice)"""


@register("live_advance", LIVE_SQL)
def _advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit through the store: patches of a plain, a limited and a subquery's query, the batch given twice."""
    live, out = live_orders(spark, sf_dir, {"watched": WATCHED, "top": TOP, "dear": DEAR}), None
    for _ in range(2):
        done = live.advance({"orders": order_feed(spark, sf_dir)}, ("feed", 0))
    for name, p in done.patches.items():
        one = p.select(F.lit(name).alias("query"), "kind", "row_key")
        out = one if out is None else out.unionByName(one)
    return out


@register("live_result", f"SELECT '{{\"o_orderkey\":' || o_orderkey || '}}' AS row_key FROM {CHANGED_SQL} WHERE o_totalprice > 150000")
def _live_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as another process finds it after a commit."""
    live = live_orders(spark, sf_dir, {"watched": WATCHED})
    live.advance({"orders": order_feed(spark, sf_dir)})
    return LiveQueries(spark, live.store.folder, live.specs).result("watched").select("row_key")


@register("live_commit", "SELECT 1 AS attempt, TRUE AS failed, 0 AS patches UNION ALL SELECT 2, FALSE, (SELECT count(*) FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 50 = 0)")
def _commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes with an insert of a row that is there fail as a whole; without it they go through."""
    live = live_orders(spark, sf_dir, {"watched": WATCHED})
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(*ORDER_COLUMNS, F.lit("delete").alias("_op"), F.col("o_orderkey").alias("_pos"))
    there = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 1").limit(1).select(*ORDER_COLUMNS, F.lit("insert").alias("_op"), F.lit(-1).cast("long").alias("_pos"))
    bad, _ = live.commit("orders", orders.unionByName(there))
    good, _ = live.commit("orders", orders)
    return spark.createDataFrame([(1, bad is None, 0), (2, good is None, good.patches["watched"].count())], "attempt int, failed boolean, patches long")


@register("live_truncation", "SELECT 'truncation' AS reason, count(*) AS n FROM orders WHERE o_totalprice > 150000")
def _truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_orders(spark, sf_dir, {"watched": WATCHED})
    feed = order_feed(spark, sf_dir).limit(1).withColumn("_op", F.lit("truncate"))
    out = live.advance({"orders": feed})
    return out.patches["watched"].where("kind = 'remove'").agg(F.count(F.lit(1)).alias("n")).select(F.lit(out.resets["watched"]).alias("reason"), "n")


@register("live_removed", "SELECT 'remove' AS kind, '{\"o_orderkey\":' || o_orderkey || '}' AS row_key FROM orders WHERE o_totalprice > 150000")
def _removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_orders(spark, sf_dir, {"watched": WATCHED}).remove("watched").select("kind", "row_key")


@register("invalidated", "SELECT * FROM (VALUES ('customer', 'a'), ('customer', 'b'), ('orders', 'b'), ('orders', 'c')) v(changed, query)")
def _invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which queries a change of a table can affect."""
    queries = {"a": Query("customer"), "b": Query("customer", where=has_big), "c": Query("part", related=(related("p_partkey", "o_orderkey", Query("orders")),))}
    return spark.createDataFrame([(t, q) for t in ("customer", "orders", "nation") for q in invalidated(queries, {t})], "changed string, query string")


@register("stored_versions", f"SELECT 0 AS version, count(*) AS n FROM orders UNION ALL SELECT 1, count(*) FROM {CHANGED_SQL}")
def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame before and after a delta, each read as its version has it."""
    store, orders = Store(spark, shared_folder(spark)), table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    draft = store.next(store.manifest())
    draft.put("orders", orders, ["o_orderkey"])
    draft.publish()
    draft = store.next(store.manifest())
    keys, rows = cdc.table_delta(orders, order_feed(spark, sf_dir), ["o_orderkey"])
    draft.change("orders", keys, rows)
    draft.publish()
    count = lambda v: store.read(store.manifest(v), "orders").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "n")
    return count(0).unionByName(count(1))


# --- change frames -----------------------------------------------------------------------------


@register("frames", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id // 10 % 3 <> 2) WHERE n = 1 AND event_type <> 'error'")
def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in transactions of ten, every third rolled back, decoded and applied."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 10).alias("txn"))
    row = F.to_json(F.struct("user_id", "event_id"))
    rows = events.select(
        (F.col("event_id") * 10 + 5).alias("seq"),
        F.to_json(F.struct(F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("tag"), F.lit(7).alias("relation"), row.alias("new"), row.alias("old"))).alias("body"),
    )
    txns = events.select("txn").distinct()
    begins = txns.select((F.col("txn") * 100).alias("seq"), F.to_json(F.struct(F.lit("begin").alias("tag"), F.col("txn").alias("version"))).alias("body"))
    ends = txns.select((F.col("txn") * 100 + 99).alias("seq"), F.to_json(F.struct(F.when(F.col("txn") % 3 == 2, "rollback").otherwise("commit").alias("tag"))).alias("body"))
    relation = spark.createDataFrame([(-1, json.dumps({"tag": "relation", "id": 7, "table": "users"}))], "seq long, body string")
    frames = rows.unionByName(begins).unionByName(ends).unionByName(relation).withColumn("stream", F.lit("main"))
    feeds, _, _ = cdc.from_frames(frames, {"users": "user_id bigint, event_id bigint"}, {"users": ["user_id"]})
    feed = feeds["users"]
    return cdc.apply_changes(feed.select("user_id", "event_id").limit(0), feed.drop("_old_user_id"), ["user_id"])


@register("frame_errors", "SELECT event_id AS seq, 'outside a transaction' AS reason FROM events")
def _frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.lit("insert").alias("tag"), F.lit(1).alias("relation")))
    frames = table(spark, sf_dir, "events").select(F.lit("main").alias("stream"), F.col("event_id").alias("seq"), body.alias("body"))
    return cdc.from_frames(frames, {}, {})[2].select("seq", "reason")


@register("key_change", "SELECT CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_totalprice FROM orders")
def _key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that give every ninth order another key."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    feed = orders.where("o_orderkey % 9 = 0").withColumn("_old_o_orderkey", F.col("o_orderkey")).withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    feed = feed.withColumn("_version", F.lit(1).cast("long")).withColumn("_pos", F.col("o_orderkey")).withColumn("_op", F.lit("update"))
    return cdc.apply_changes(orders, feed, ["o_orderkey"])


@register("unique_keys", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey > o.o_orderkey)")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order robs the others of the unique customer key."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    feed = orders.withColumn("_version", F.lit(1).cast("long")).withColumn("_pos", F.col("o_orderkey")).withColumn("_op", F.lit("insert"))
    return cdc.apply_changes(orders.limit(0), feed, ["o_orderkey"], [["o_custkey"]]).select("o_orderkey")


@register("ddl", "SELECT o_orderkey AS id, o_totalprice::VARCHAR IS NOT NULL AS priced, 7 AS extra FROM orders")
def _ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, renamed, retyped and dropped, the table renamed."""
    tables = {"orders": table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)}
    for change in (
        {"tag": "add-column", "table": "orders", "column": "extra", "type": "int", "default": 7}, {"tag": "update-column", "table": "orders", "column": "o_orderkey", "new": "id"},
        {"tag": "update-column", "table": "orders", "column": "o_totalprice", "type": "string"}, {"tag": "drop-column", "table": "orders", "column": "o_custkey"},
        {"tag": "create-index", "table": "orders"}, {"tag": "rename-table", "table": "orders", "new": "sales"},
    ):
        tables = cdc.apply_ddl(tables, change)
    return tables["sales"].select("id", F.col("o_totalprice").isNotNull().alias("priced"), "extra")


@register("schema_drift", "SELECT * FROM (VALUES ('missing total'), ('extra o_totalprice'), ('o_custkey: bigint, not string')) v(drift)")
def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    want = have.withColumnRenamed("o_totalprice", "total").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return spark.createDataFrame([(x,) for x in cdc.schema_drift(have.schema, want.schema)], "drift string")


@register("released", "SELECT user_id AS message, count(*) AS acked, count(*) >= 5 OR (count(*) >= 3 AND 5000 - max(seen) >= 500) AS released FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE event_id <= 5000 GROUP BY 1, 2) GROUP BY user_id")
def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    acks = table(spark, sf_dir, "events").select(F.col("user_id").alias("message"), F.col("event_type").alias("subscriber"), F.col("event_id").alias("at"))
    return cdc.releases(acks, 5, 500, 5000)


# --- sources and columns -----------------------------------------------------------------------


@register("all_columns", "SELECT * FROM supplier")
def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).rows(Query("supplier"))


@register("version_clamp", "SELECT o_orderkey, greatest(CASE WHEN o_orderkey % 2 = 0 THEN '05' ELSE '0a' END, '07') AS version FROM orders")
def _clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("_0_version", F.when(F.col("o_orderkey") % 2 == 0, "05").otherwise("0a"))
    catalog = Catalog(spark).add(TableSpec("orders", ("o_orderkey",), min_row_version="07"), orders)
    return contents_and_version(Compiler(catalog).rows(Query("orders"))).select("contents.o_orderkey", "version")


@register("capped_sample", "SELECT least(count(*), 1000) AS capped, count(*) AS whole FROM orders")
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    count = lambda df: F.lit(df.count())
    return spark.range(1).select(count(sampled(orders, cap=1000)).alias("capped"), count(sampled(orders, 1.0)).alias("whole"))


@register("key_lookup", C_SQL + "c_custkey = 7")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that fix a key, and the one row found by it in memory."""
    where = all_of(cmp("c_custkey", "=", 7), cmp("c_acctbal", "<", 1e9))
    rows = [tuple(r) for r in table(spark, sf_dir, "customer").select(*C_COLUMNS.split()).where("c_custkey < 50").collect()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "customer").select(*C_COLUMNS.split()).schema.fields)
    memory = MemoryTable(spark, TableSpec("customer", ("c_custkey",)), schema, rows)
    found = memory.find_by_key(**key_lookup(where, ("c_custkey",)))
    return spark.createDataFrame([found], schema)


@register("renamed_query", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)")
def _renamed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = NameMapper({"account": ("customer", {"id": "c_custkey", "balance": "c_acctbal"}), "sale": ("orders", {"buyer": "o_custkey", "total": "o_totalprice"})})
    q = Query("account", where=all_of(cmp("balance", ">", 5000.0), exists("id", "buyer", Query("sale", where=cmp("total", ">", 180000.0)))), order_by=(("id", "asc"),))
    return compiler(spark, sf_dir).rows(names.query(q)).select("c_custkey")


@register("copy_text", "SELECT p_partkey, nullif(p_name, '') AS p_name, p_size, p_retailprice FROM part")
def _copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as lines of a bulk copy, read again."""
    part = table(spark, sf_dir, "part")
    name = F.regexp_replace(F.regexp_replace("p_name", r"\\", r"\\\\"), "\t", r"\\t")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), name, F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    return decode_text(part.select(line.alias("value")), "p_partkey bigint, p_name string, p_size int, p_retailprice double")


# --- trees, rights, plans ------------------------------------------------------------------------


@register("json_round_trip", C_SQL + BIG_SQL)
def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).rows(from_json(to_json(Query("customer", where=has_big)))).select(*C_COLUMNS.split())


LONG_WAY = all_of(any_of(cmp("o_orderstatus", "=", "F")), all_of(all_of(), cmp("o_totalprice", ">", 100000.0)), cmp("o_orderstatus", "=", "F"))
SHORT_WAY = all_of(cmp("o_totalprice", ">", 100000.0), cmp("o_orderstatus", "=", "F"))


@register("normalised", O_SQL + "o_orderstatus = 'F' AND o_totalprice > 100000")
def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).rows(normalise(Query("orders", where=LONG_WAY))).select(*O_COLUMNS.split())


@register("query_hash", "SELECT TRUE AS same_written, FALSE AS same_other")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (query_hash(Query("orders", where=w)) for w in (LONG_WAY, SHORT_WAY, cmp("o_orderstatus", "=", "F")))
    return spark.createDataFrame([(a == b, a == c)], "same_written boolean, same_other boolean")


@register("complete_ordering", "SELECT * FROM (VALUES ('orders', 'o_totalprice desc, o_orderkey asc'), ('customer', 'c_custkey asc')) v(tbl, ordering)")
def _ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = complete_ordering(Query("orders", order_by=BY_PRICE, related=(related("o_custkey", "c_custkey", Query("customer")),)), parquet_catalog(spark, sf_dir).key)
    text = lambda q: ", ".join(f"{f} {d}" for f, d in q.order_by)
    return spark.createDataFrame([(x.table, text(x)) for x in (q, q.related[0].subquery)], "tbl string, ordering string")


@register("covering", "SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, TRUE), (4, TRUE), (5, FALSE)) v(pair, covered)")
def _covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, top = Query("orders", where=cmp("o_totalprice", ">", 100.0)), Query("orders", order_by=BY_PRICE, limit=10)
    narrow = Query("orders", where=all_of(cmp("o_totalprice", ">", 200.0), cmp("o_orderstatus", "=", "F")))
    pairs = [(wide, narrow), (narrow, wide), (top, Query("orders", order_by=BY_PRICE, limit=5)), (Query("orders"), top), (top, Query("orders"))]
    return spark.createDataFrame([(i, rewrite.covers(a, b)) for i, (a, b) in enumerate(pairs, 1)], "pair int, covered boolean")


DOCUMENT = json.dumps({
    "tables": {
        "customer": {"row": {"select": [["allow", {"type": "simple", "op": ">", "left": {"type": "column", "name": "c_acctbal"}, "right": {"type": "literal", "value": 5000}}], ["allow", {"type": "literal", "value": False}]]}},
        "orders": {
            "row": {"insert": [["allow", {"type": "simple", "op": "=", "left": {"type": "column", "name": "o_orderstatus"}, "right": {"type": "literal", "value": "O"}}]], "delete": [["allow", {"type": "literal", "value": True}]],
                    "update": {"postMutation": [["allow", {"type": "simple", "op": "<", "left": {"type": "column", "name": "o_totalprice"}, "right": {"type": "literal", "value": 90000}}]]}},
            "cell": {"o_custkey": {"insert": [["allow", {"type": "simple", "op": "<", "left": {"type": "column", "name": "o_custkey"}, "right": {"type": "literal", "value": 700}}]], "delete": [["allow", {"type": "simple", "op": ">", "left": {"type": "column", "name": "o_custkey"}, "right": {"type": "literal", "value": 300}}]]}},
        },
    }
})


@register("permission_document", C_SQL + "c_acctbal > 5000")
def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading, _ = rewrite.permission_document(DOCUMENT)
    return compiler(spark, sf_dir).rows(rewrite.permitted(Query("customer"), reading)).select(*C_COLUMNS.split())


for _action, _phase, _where in (("insert", "after", "o_orderstatus = 'O' AND o_custkey < 700"), ("update", "after", "FALSE"), ("delete", "before", "o_custkey > 300")):

    @register(f"write_rules_{_action}", O_SQL + _where)
    def _write(spark: SparkSession, sf_dir: str, action: str = _action, phase: str = _phase) -> DataFrame:
        """A row's rule and a touched cell's; a cell without a rule for the action denies it."""
        _, writing = rewrite.permission_document(DOCUMENT)
        rules = [writing["orders"]["row"], writing["orders"]["cell"]["o_custkey"]]
        return mutations.allowed(table(spark, sf_dir, "orders"), rules, action, phase).select(*O_COLUMNS.split())


@register("named_query", C_SQL + "c_acctbal > 8000")
def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query by name and argument, transformed twice, the second time from memory."""
    names = rewrite.NamedQueries()
    names.define("rich", lambda least: Query("customer", where=cmp("c_acctbal", ">", least)))
    first, again = (names.transform([("q1", "rich", [8000.0])], {"user": "u", "headers": h}) for h in ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}))
    assert not first["cached"] and again["cached"]
    return compiler(spark, sf_dir).rows(from_json(to_json(from_json(json.dumps(again["queries"][0]["tree"]))))).select(*C_COLUMNS.split())


@register("group_queries", "SELECT (user_id % 40)::VARCHAR AS client, max(event_id) AS last FROM events WHERE user_id % 7 = 3 GROUP BY 1")
def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that tells a group's clients their last mutations, over a table of such."""
    events = table(spark, sf_dir, "events")
    held = events.groupBy((F.col("user_id") % 7).cast("string").alias("clientGroupID"), (F.col("user_id") % 40).cast("string").alias("clientID")).agg(F.max("event_id").alias("lastMutationID"))
    key, _ = rewrite.group_tables("app")["app.clients"]
    catalog = Catalog(spark).add(TableSpec("app.clients", key), held)
    return Compiler(catalog).rows(rewrite.group_queries("app", "3")["last_mutations"]).select(F.col("clientID").alias("client"), F.col("lastMutationID").alias("last"))


@register("planned_flip", C_SQL + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000)")
def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few orders lead to few customers, so the planner turns the join round; the rows are the same."""
    q = planner.plan(Query("customer", where=exists("c_custkey", "o_custkey", Query("orders", where=cmp("o_totalprice", ">", 280000.0)))), parquet_catalog(spark, sf_dir))
    return compiler(spark, sf_dir).rows(q).select(*C_COLUMNS.split())


@register("flipped_join", C_SQL + BIG_SQL)
def _flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).rows(planner.marked(Query("customer", where=has_big), frozenset({(0,)}))).select(*C_COLUMNS.split())


@register("rows_read", "SELECT 'customer' AS tbl, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n_read, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n_synced")
def _rows_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.analyze(Query("customer", where=cmp("c_acctbal", ">", 0.0)), parquet_catalog(spark, sf_dir))
    return spark.createDataFrame([(t, found["read"][t], found["synced"].get(t, 0)) for t in found["read"]], "tbl string, n_read long, n_synced long")


@register("digest", "SELECT count(*)::DOUBLE AS n, TRUE AS median_near, TRUE AS tail_near, TRUE AS share_near FROM orders")
def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mergeable sketch of all prices, within a thousandth of the ranks asked for."""
    orders = table(spark, sf_dir, "orders")
    d = stats.Digest.from_json(stats.digest(orders, "o_totalprice").to_json())
    rank = lambda x: orders.where(F.col("o_totalprice") <= x).count() / d.count()
    near = [abs(rank(d.quantile(0.5)) - 0.5) < 1e-3, abs(rank(d.quantile(0.999)) - 0.999) < 1e-3, abs(rank(150000.0) - d.cdf(150000.0)) < 1e-3]
    return spark.createDataFrame([(d.count(), *near)], "n double, median_near boolean, tail_near boolean, share_near boolean")


# --- writes ---------------------------------------------------------------------------------------


@register(
    "batch_in_order",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 0""",
)
def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row deleted, inserted again and updated within one batch; every third deleted at last, every third set to NULL."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    price, none = F.col("o_totalprice"), F.lit(None).cast("double")
    steps = [("delete", none, None), ("insert", price, None), ("update", price + 1, ["o_totalprice"])]
    ops = None
    for i, (op, value, columns) in enumerate(steps):
        one = orders.select("o_orderkey", value.alias("o_totalprice"), F.lit(op).alias("_op"), (F.col("o_orderkey") * 10 + i).alias("_pos"), F.lit(columns).cast("array<string>").alias("_set") if columns is None else F.array(*map(F.lit, columns)).alias("_set"))
        ops = one if ops is None else ops.unionByName(one)
    third = orders.where("o_orderkey % 3 = 0").select("o_orderkey", none.alias("o_totalprice"), F.lit("delete").alias("_op"), (F.col("o_orderkey") * 10 + 5).alias("_pos"), F.lit(None).cast("array<string>").alias("_set"))
    nulls = orders.where("o_orderkey % 3 = 1").select("o_orderkey", none.alias("o_totalprice"), F.lit("update").alias("_op"), (F.col("o_orderkey") * 10 + 5).alias("_pos"), F.array(F.lit("o_totalprice")).alias("_set"))
    feed, _ = mutations.crud(orders, ops.unionByName(third).unionByName(nulls), ["o_orderkey"], 1)
    return cdc.apply_changes(orders, feed, ["o_orderkey"])


@register("failed_batch", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 2) AS errors, 0 AS changes")
def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    kind = F.element_at(F.array(*map(F.lit, ("delete", "update", "insert", "upsert"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    feed, errors = mutations.crud(orders, orders.withColumn("_op", kind).withColumn("_pos", F.col("o_orderkey")), ["o_orderkey"], 1)
    return spark.createDataFrame([(errors.count(), feed.count())], "errors long, changes int")


@register("transactions", "SELECT o_custkey AS mutation_id FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 40 = 0)")
def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutation for each customer deletes its orders; those that also insert one that is there fail."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    op = F.when(F.col("o_orderkey") % 40 == 0, "insert").otherwise("delete")
    ops = orders.withColumn("_op", op).withColumn("_pos", F.col("o_custkey") * 10_000_000 + F.col("o_orderkey")).withColumn("mutation_id", F.col("o_custkey"))
    return mutations.transactions(orders, ops, ["o_orderkey"], 1)[1]


@register("push_batches", "SELECT user_id AS client, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS mutations FROM events WHERE event_id < 5000 GROUP BY user_id HAVING count(DISTINCT event_type) = 1")
def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pushes of their users, who must keep to one type; the queue ends at event 5000."""
    pushes = table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("arrived"), F.array("event_id").alias("mutations"), "event_type", (F.col("event_id") == 5000).alias("stop"))
    batches, _ = mutations.push_batches(pushes, ["client"], ["event_type"])
    return batches.select("client", F.array_join(F.transform("mutations", lambda m: m.cast("string")), ",").alias("mutations"))


@register(
    "rate_limited",
    """WITH RECURSIVE e AS (SELECT event_type, event_id, (event_id // 100) AS w, (event_id % 100) AS past, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE event_id < 1000),
r AS (SELECT event_type, event_id, n, w, 1 AS here, 0 AS before, TRUE AS allowed FROM e WHERE n = 1
UNION ALL SELECT x.event_type, x.event_id, x.n, x.w, x.h + CASE WHEN x.h + x.b * (1 - x.past / 100.0) < 8 THEN 1 ELSE 0 END, x.b, x.h + x.b * (1 - x.past / 100.0) < 8
FROM (SELECT e.*, CASE WHEN e.w = r.w THEN r.here ELSE 0 END AS h, CASE WHEN e.w = r.w THEN r.before WHEN e.w = r.w + 1 THEN r.here ELSE 0 END AS b FROM r JOIN e ON e.event_type = r.event_type AND e.n = r.n + 1) x)
SELECT event_id, allowed FROM r""",
)
def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight calls of a type in a sliding window of a hundred, over the first thousand events, as the SQL's recursion allows."""
    return mutations.rate_limited(table(spark, sf_dir, "events").where("event_id < 1000"), ["event_type"], "event_id", 100, 8).select("event_id", "allowed")


# --- records ---------------------------------------------------------------------------------------


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(client, query, ttl, inactivated_at, version): desires with some inactive."""
    d = desires(spark, sf_dir).select("client", "query", F.col("ttl").cast("double").alias("ttl"), "inactivated_at", F.lit(1).alias("version"))
    return d.withColumn("inactivated_at", F.when(F.col("client") % 3 == 0, F.col("inactivated_at"))).withColumn("ttl", F.lit(1000.0))


@register("put_desires", "SELECT DISTINCT user_id % 50 AS client, event_type AS query FROM events WHERE (user_id % 50) % 3 = 0 AND NOT (event_type = 'click' AND user_id % 50 = 3) UNION ALL SELECT 900, 'click'")
def _put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked for again: the inactive ones and a new client's change, the others do not."""
    have = wanted(spark, sf_dir)
    asked = have.select("client", "query", F.lit(500.0).alias("ttl")).unionByName(spark.createDataFrame([(900, "click", None)], "client long, query string, ttl double"))
    return views.put_desires(have, asked, F.lit(2))[1].select("client", "query")


@register("delete_desires", "SELECT query, count(*) FILTER (WHERE inactive) AS inactive, count(*) AS n FROM (SELECT DISTINCT event_type AS query, user_id % 50 AS client, (user_id % 50) % 3 = 0 AND NOT (event_type = 'click' AND user_id % 50 = 3) OR user_id % 50 = 7 AS inactive FROM events WHERE user_id % 50 <> 8 OR (user_id % 50) % 3 = 0) GROUP BY query")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client 7 lets its queries go for now, client 8 for good."""
    have = wanted(spark, sf_dir)
    after, _ = views.delete_desires(have, have.where("client = 7"), F.lit(2), now=99)
    after, _ = views.clear_desires(after, 8, F.lit(2))
    return after.groupBy("query").agg(F.count("inactivated_at").alias("inactive"), F.count(F.lit(1)).alias("n"))


@register("last_patches", "SELECT row_key, CASE WHEN v = 50 THEN 'clear' WHEN v % 2 = 0 THEN 'update' ELSE 'del' END AS op FROM (SELECT user_id::VARCHAR AS row_key, max(event_id) AS v FROM events WHERE event_id > 50 GROUP BY 1 UNION ALL SELECT NULL, 50)")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches by event, of each row the last, all before a clear void."""
    events = table(spark, sf_dir, "events")
    cleared, op = F.col("event_id") == 50, F.when(F.col("event_id") % 2 == 0, "put").otherwise("del")
    patches = events.select(F.lit("users").alias("table"), F.when(~cleared, F.col("user_id").cast("string")).alias("row_key"), F.col("event_id").alias("patch_version"), F.when(cleared, "clear").otherwise(op).alias("op"))
    return views.constrained(patches, merge=True).select("row_key", "op")


@register("ttl_forms", "SELECT * FROM (VALUES (1000.0, '1s'), (300000.0, '5m'), (3600000.0, '1h'), (1500.0, '1500'), (-1.0, 'forever'), (0.0, 'none'), (86400000.0, '1d')) v(ms, form)")
def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [(float(ms), f if isinstance(f := views.normalise_ttl(ms), str) else str(f)) for ms in (1000, 300_000, 3_600_000, 1500, -1, 0, 86_400_000)]
    return spark.createDataFrame(forms, "ms double, form string")


@register("purged", "SELECT client_group AS grp, n FROM (SELECT user_id % 20 AS client_group, max(event_id) AS last, count(*) AS n, row_number() OVER (ORDER BY max(event_id), user_id % 20) AS r FROM events GROUP BY 1) WHERE r > 5")
def _purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five groups idle longest lose their rows."""
    events = table(spark, sf_dir, "events").withColumn("group", F.col("user_id") % 20)
    groups = events.groupBy("group").agg(F.max("event_id").alias("last_active")).withColumn("deleted", F.lit(False))
    _, kept, _ = views.purge(groups, {"rows": events.select("group", "event_id")}, 10**9, 0, 5, 10**9)
    return kept["rows"].groupBy(F.col("group").alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@register("drained", "SELECT c.client, e.event_id AS seq FROM events e JOIN (VALUES (1, 'click', 200), (1, 'view', 200), (2, 'purchase', 500)) c(client, query, seq) ON c.query = e.event_type AND e.event_id >= c.seq")
def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clients of a group read what they have not read of the queries they want."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("query"))
    cursors = spark.createDataFrame([(1, 200), (2, 500)], "client int, seq long")
    want = spark.createDataFrame([(1, "click", None), (1, "view", None), (2, "purchase", None), (2, "click", 5), (3, "click", None)], "client int, query string, inactivated_at long")
    return views.drain(log, cursors, want)[0].select("client", "seq")


@register("poke_frames", "SELECT count(*) AS n_rows, 1 AS starts, 1 AS ends FROM orders WHERE o_totalprice > 150000")
def _pokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a result in frames of about a hundred."""
    rows = compiler(spark, sf_dir).result_set(WATCHED).withColumn("op", F.lit("put"))
    frames = views.pokes(rows, None, "01", 100)
    held = F.size(F.from_json(F.get_json_object("body", "$.pokePart.rowsPatch"), "array<string>"))
    return frames.agg(F.sum(F.when(F.col("part") > 0, held)).alias("n_rows"), F.sum(F.col("body").contains("pokeStart").cast("int")).cast("int").alias("starts"), F.sum(F.col("body").contains("pokeEnd").cast("int")).cast("int").alias("ends"))


@register("flushed_records", "SELECT event_type AS query, user_id % 50 AS client FROM events WHERE event_type <> 'click' GROUP BY 1, 2 UNION SELECT 'click', 3")
def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desires flushed, some removed in a second flush, and loaded."""
    records = views.Records(Store(spark, shared_folder(spark)))
    d = desires(spark, sf_dir).select(F.lit("g").alias("group"), "client", "query", "ttl")
    first = records.flush({"desires": d})
    records.flush({}, {"desires": d.where("query = 'click' AND client <> 3")}, expect=first)
    return records.load("desires").select("query", "client")
