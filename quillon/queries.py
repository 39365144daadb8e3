"""The registered queries of the relational engine and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import diff as d
from quillon.operators import mutations, views
from quillon.plans import rewrite
from quillon.plans.ast import Column, Literal, Parameter, Query, Simple, Start, all_of, any_of, cmp, exists, from_json, related
from quillon.plans.compiler import Compiler
from quillon.sources.catalog import NameMapper, parquet_catalog, with_overlay
from quillon.streaming import cdc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def simple_query(name: str, query: Query, columns: str, sql: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query's own rows, a few columns of them, against ``sql``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Compiler(parquet_catalog(spark, sf_dir)).rows(query)
        return (change(df) if change else df).select(*columns.split())

    register(name, sql)(run)


def compiler(spark: SparkSession, sf_dir: str) -> Compiler:
    return Compiler(parquet_catalog(spark, sf_dir))


# --- predicates -------------------------------------------------------------------------

O_COLUMNS = "o_orderkey o_custkey o_orderstatus o_totalprice"
O_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "
for name, condition, where in (
    ("eq", cmp("o_orderstatus", "=", "O"), "o_orderstatus = 'O'"),
    ("ne", cmp("o_orderstatus", "!=", "O"), "o_orderstatus <> 'O'"),
    ("lt", cmp("o_totalprice", "<", 50000.0), "o_totalprice < 50000"),
    ("gt", cmp("o_totalprice", ">", 50000.0), "o_totalprice > 50000"),
    ("le", cmp("o_custkey", "<=", 100), "o_custkey <= 100"),
    ("ge", cmp("o_custkey", ">=", 100), "o_custkey >= 100"),
    ("in_list", cmp("o_custkey", "IN", (1, 5, 7, 11)), "o_custkey IN (1, 5, 7, 11)"),
    ("not_in_list", cmp("o_orderstatus", "NOT IN", ("O", "F")), "o_orderstatus NOT IN ('O', 'F')"),
    ("literal_left", Simple("<", Literal(200000.0), Column("o_totalprice")), "200000 < o_totalprice"),
    ("column_right", Simple(">", Column("o_orderkey"), Column("o_custkey")), "o_orderkey > o_custkey"),
    ("and_or_tree", all_of(any_of(cmp("o_orderstatus", "=", "F"), cmp("o_totalprice", ">", 150000.0)), cmp("o_custkey", "<", 500)), "(o_orderstatus = 'F' OR o_totalprice > 150000) AND o_custkey < 500"),
    ("empty_or", any_of(), "FALSE"),
    ("empty_and", all_of(), "TRUE"),
):
    simple_query(name, Query("orders", where=condition), O_COLUMNS, O_SQL + where)

P_COLUMNS, P_SQL = "p_partkey p_name p_brand p_type", "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE "
for name, op, pattern, where in (
    ("like", "LIKE", "%1_", "p_brand LIKE '%1_'"),
    ("not_like", "NOT LIKE", "Brand#1%", "p_brand NOT LIKE 'Brand#1%'"),
    ("ilike", "ILIKE", "BRAND#_2", "p_brand ILIKE 'BRAND#_2'"),
    ("not_ilike", "NOT ILIKE", "bRAND#%3", "p_brand NOT ILIKE 'bRAND#%3'"),
):
    simple_query(name, Query("part", where=cmp("p_brand", op, pattern)), P_COLUMNS, P_SQL + where)


def nulled(name: str, condition: Simple, where: str) -> None:
    """The data has no NULL, so one status is made NULL on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = parquet_catalog(spark, sf_dir)
        orders = catalog.table("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
        return Compiler(catalog.with_tables({"orders": orders})).rows(Query("orders", where=condition)).select("o_orderkey", "o_orderstatus")

    register(name, f"SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus FROM orders) WHERE {where}")(run)


nulled("is_null", cmp("o_orderstatus", "IS", None), "o_orderstatus IS NULL")
nulled("is_not_null", cmp("o_orderstatus", "IS NOT", None), "o_orderstatus IS NOT NULL")
nulled("is_value", cmp("o_orderstatus", "IS", "F"), "o_orderstatus IS NOT DISTINCT FROM 'F'")
nulled("is_not_value", cmp("o_orderstatus", "IS NOT", "F"), "o_orderstatus IS DISTINCT FROM 'F'")
nulled("ne_null", cmp("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'")
nulled("not_in_null", cmp("o_orderstatus", "NOT IN", ("F",)), "o_orderstatus NOT IN ('F')")
nulled("not_in_empty", cmp("o_orderstatus", "NOT IN", ()), "o_orderstatus IS NOT NULL")

# --- order, cursor, limit ----------------------------------------------------------------

BY_PRICE = (("o_totalprice", "desc"),)
BY_CUSTOMER = (("o_custkey", "asc"), ("o_totalprice", "desc"))
simple_query("order_limit", Query("orders", order_by=BY_PRICE, limit=25), O_COLUMNS, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
simple_query("limit_zero", Query("orders", limit=0), O_COLUMNS, O_SQL + "FALSE")
simple_query("start_exclusive", Query("orders", start=Start((("o_custkey", 50),), True), order_by=BY_CUSTOMER, limit=40), O_COLUMNS, O_SQL + "o_custkey > 50 ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 40")
simple_query("start_inclusive", Query("orders", start=Start((("o_custkey", 50),), False), order_by=BY_CUSTOMER, limit=40), O_COLUMNS, O_SQL + "o_custkey >= 50 ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 40")
simple_query(
    "start_two_columns", Query("orders", start=Start((("o_custkey", 50), ("o_totalprice", 90000.0)), True), order_by=BY_CUSTOMER, limit=40), O_COLUMNS,
    O_SQL + "o_custkey > 50 OR o_custkey = 50 AND o_totalprice < 90000 ORDER BY o_custkey, o_totalprice DESC, o_orderkey LIMIT 40",
)
simple_query("reverse_page", Query("orders", start=Start((("o_orderkey", 1000),), True), order_by=(("o_orderkey", "desc"),), limit=30), O_COLUMNS, O_SQL + "o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 30")

# --- subqueries --------------------------------------------------------------------------

C_COLUMNS, C_SQL = "c_custkey c_name c_acctbal", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE "
BIG = Query("orders", where=cmp("o_totalprice", ">", 180000.0))
CLICKS = Query("events", where=all_of(cmp("event_type", "=", "purchase"), cmp("value", ">", 50.0)))
BIG_SQL = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000)"
CLICKS_SQL = "EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase' AND value > 50)"
has_big, has_clicks = exists("c_custkey", "o_custkey", BIG), exists("c_custkey", "user_id", CLICKS)
no_big = exists("c_custkey", "o_custkey", BIG, negated=True)
simple_query("exists", Query("customer", where=has_big), C_COLUMNS, C_SQL + BIG_SQL)
simple_query("not_exists", Query("orders", where=exists("o_orderkey", "l_orderkey", Query("lineitem"), negated=True)), O_COLUMNS, O_SQL + "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
simple_query("exists_compound", Query("nation", where=exists(("n_nationkey", "n_regionkey"), ("s_nationkey", "s_suppkey"), Query("supplier"))), "n_nationkey n_name", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey = n_regionkey)")
simple_query("or_of_exists", Query("customer", where=any_of(has_big, has_clicks)), C_COLUMNS, C_SQL + f"{BIG_SQL} OR {CLICKS_SQL}")
simple_query("or_of_not_exists", Query("customer", where=any_of(no_big, cmp("c_acctbal", ">", 9000.0))), C_COLUMNS, C_SQL + f"NOT {BIG_SQL} OR c_acctbal > 9000")
simple_query("and_with_or_of_exists", Query("customer", where=all_of(cmp("c_acctbal", ">", 1000.0), any_of(has_big, has_clicks), cmp("c_nationkey", "<", 15))), C_COLUMNS, C_SQL + f"c_acctbal > 1000 AND ({BIG_SQL} OR {CLICKS_SQL}) AND c_nationkey < 15")
NESTED = exists("r_regionkey", "n_regionkey", Query("nation", where=exists("n_nationkey", "c_nationkey", Query("customer", where=exists("c_custkey", "o_custkey", Query("orders", where=cmp("o_totalprice", ">", 300000.0)))))))
simple_query(
    "nested_exists", Query("region", where=NESTED), "r_regionkey r_name",
    "SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)))",
)
simple_query("self_join", Query("nation", where=exists("n_regionkey", "n_regionkey", Query("nation", where=cmp("n_nationkey", "<", 3)))), "n_nationkey n_name", "SELECT n_nationkey, n_name FROM nation x WHERE EXISTS (SELECT 1 FROM nation y WHERE y.n_regionkey = x.n_regionkey AND y.n_nationkey < 3)")
simple_query("exists_limit_zero", Query("customer", where=exists("c_custkey", "o_custkey", Query("orders", limit=0))), C_COLUMNS, C_SQL + "FALSE")
simple_query("exists_start", Query("customer", where=exists("c_custkey", "o_custkey", Query("orders", start=Start((("o_orderkey", 3000),), False)))), C_COLUMNS, C_SQL + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey >= 3000)")


@register("scalar_exists", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 3)")
def _scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = parquet_catalog(spark, sf_dir)
    q = Query("customer", where=exists("c_nationkey", "n_nationkey", Query("nation", where=cmp("n_nationkey", "=", 3)), scalar=True))
    return Compiler(catalog).rows(rewrite.resolve_scalars(q, catalog)[0]).select("c_custkey", "c_name")


# --- related rows -------------------------------------------------------------------------

RICH = Query("customer", where=cmp("c_acctbal", ">", 5000.0), order_by=(("c_acctbal", "desc"),), limit=50)
RICH_SQL = "WITH c AS (SELECT * FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50) "


def hop(q: Query, n: int, columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: compiler(spark, sf_dir).flat(q)[n][2].select(*columns.split())


def with_orders(**more) -> Query:
    return Query(RICH.table, where=RICH.where, order_by=RICH.order_by, limit=RICH.limit, related=(related("c_custkey", "o_custkey", Query("orders", alias="orders", **more)),))


register("related_flat", RICH_SQL + "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)")(hop(with_orders(), 1, "o_orderkey o_custkey o_totalprice"))
register("related_limit_per_parent", RICH_SQL + "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) WHERE n <= 3")(hop(with_orders(order_by=BY_PRICE, limit=3), 1, "o_orderkey o_custkey o_totalprice"))
register(
    "related_start_per_parent",
    RICH_SQL + "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice < 100000 AND o_custkey IN (SELECT c_custkey FROM c)) WHERE n <= 2",
)(hop(with_orders(order_by=BY_PRICE, start=Start((("o_totalprice", 100000.0),), True), limit=2), 1, "o_orderkey o_custkey o_totalprice"))

FIVE = Query("region", where=cmp("r_name", "<", "B"), related=(related("r_regionkey", "n_regionkey", Query("nation", related=(related("n_nationkey", "c_nationkey", Query("customer", related=(related("c_custkey", "o_custkey", Query("orders", related=(related("o_orderkey", "l_orderkey", Query("lineitem")),))),))),))),))
register(
    "five_hop",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'B'",
)(hop(FIVE, 4, "l_orderkey l_linenumber l_partkey l_quantity"))


@register(
    "related_nested",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
c AS (SELECT * FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 50)
SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey || ':' || n_items, ',' ORDER BY n) FROM (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items FROM o) x WHERE o_custkey = c_custkey AND n <= 3), '') AS orders FROM c""",
)
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = related("o_orderkey", "l_orderkey", Query("lineitem", alias="items"))
    q = with_orders(order_by=BY_PRICE, limit=3, related=(items,))
    shown = F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit(":"), F.size(o["items"]).cast("string")))
    return compiler(spark, sf_dir).nested(q, ordered=False).select("c_custkey", F.array_join(shown, ",").alias("orders"))


FLAGSHIP = from_json(
    """{"table": "customer", "where": {"type": "and", "conditions": [
  {"type": "simple", "op": ">", "left": {"type": "column", "name": "c_acctbal"}, "right": {"type": "literal", "value": 0.0}},
  {"type": "correlatedSubquery", "op": "EXISTS", "related": {"correlation": {"parentField": ["c_custkey"], "childField": ["o_custkey"]},
    "subquery": {"table": "orders", "where": {"type": "and", "conditions": [
      {"type": "simple", "op": "=", "left": {"type": "column", "name": "o_orderstatus"}, "right": {"type": "literal", "value": "O"}},
      {"type": "simple", "op": ">", "left": {"type": "column", "name": "o_totalprice"}, "right": {"type": "literal", "value": 100000.0}}]}}}}]},
  "related": [{"correlation": {"parentField": ["c_custkey"], "childField": ["o_custkey"]}, "subquery": {"table": "orders", "alias": "orders", "orderBy": [["o_orderdate", "desc"]], "limit": 3}}],
  "orderBy": [["c_acctbal", "desc"]], "limit": 20}"""
)


@register(
    "flagship",
    """WITH c AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 100000) ORDER BY c_acctbal DESC, c_custkey LIMIT 20),
o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT c_custkey, c_acctbal, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) FROM o WHERE o_custkey = c_custkey AND n <= 3) AS last_orders FROM c""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compiler(spark, sf_dir).nested(FLAGSHIP)
    return rows.select("c_custkey", "c_acctbal", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("last_orders"))


@register("result_set", "SELECT 'customer' AS \"table\", '{\"c_custkey\":' || c_custkey || '}' AS row_key FROM customer WHERE " + BIG_SQL + " UNION ALL SELECT 'orders', '{\"o_orderkey\":' || o_orderkey || '}' FROM orders WHERE o_totalprice > 180000")
def _result_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).result_set(Query("customer", where=has_big)).select("table", "row_key")


# --- rewriting ------------------------------------------------------------------------------

RULES = {
    "customer": (Simple("=", Column("c_nationkey"), Parameter("authData", ("nation",))), cmp("c_acctbal", ">", 9500.0)),
    "orders": (cmp("o_orderstatus", "=", "F"),),
}


@register("permission_rewrite", C_SQL + "(c_nationkey = 7 OR c_acctbal > 9500) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 180000)")
def _permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rewrite.bind(rewrite.permitted(Query("customer", where=has_big), RULES), {"authData": {"nation": 7}})
    return compiler(spark, sf_dir).rows(q).select(*C_COLUMNS.split())


@register("deny_all", "SELECT n_nationkey, n_name FROM nation WHERE FALSE")
def _deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler(spark, sf_dir).rows(rewrite.permitted(Query("nation"), RULES)).select("n_nationkey", "n_name")


@register("missing_claim", C_SQL + "c_acctbal > 9500")
def _claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = rewrite.bind(rewrite.permitted(Query("customer"), RULES), {"authData": {}})
    return compiler(spark, sf_dir).rows(q).select(*C_COLUMNS.split())


@register("write_rules", O_SQL + "o_orderstatus = 'F' AND o_totalprice < 50000")
def _write_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = mutations.WriteRules(update_before=(cmp("o_orderstatus", "=", "F"),))
    cell = mutations.WriteRules(update_before=(cmp("o_totalprice", "<", 50000.0),))
    return mutations.allowed(parquet_catalog(spark, sf_dir).table("orders"), [row, cell], "update", "before").select(*O_COLUMNS.split())


# --- differences -----------------------------------------------------------------------------


def changed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order gone, every fifth of the rest dearer: the second of two versions."""
    orders = parquet_catalog(spark, sf_dir).table("orders").where("o_orderkey % 7 <> 0")
    return orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 100000.0).otherwise(F.col("o_totalprice")))


CHANGED_SQL = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 100000 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"
WATCHED = Query("orders", where=cmp("o_totalprice", ">", 150000.0))
TOP = Query("orders", order_by=BY_PRICE, limit=100)


def diffed(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = parquet_catalog(spark, sf_dir)
        after = Compiler(catalog.with_tables({"orders": changed_orders(spark, sf_dir)})).result_set(q)
        return d.diff(Compiler(catalog).result_set(q), after).select("kind", "table", "row_key")

    return run


def diff_sql(old: str, new: str) -> str:
    return f"""WITH a AS ({old}), b AS ({new})
SELECT CASE WHEN a.o_orderkey IS NULL THEN 'add' WHEN b.o_orderkey IS NULL THEN 'remove' ELSE 'edit' END AS kind, 'orders' AS "table", '{{"o_orderkey":' || coalesce(a.o_orderkey, b.o_orderkey) || '}}' AS row_key
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice"""


register("diff_add_remove_edit", diff_sql("SELECT * FROM orders WHERE o_totalprice > 150000", f"SELECT * FROM {CHANGED_SQL} WHERE o_totalprice > 150000"))(diffed(WATCHED))
register("advance_topn", diff_sql("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", f"SELECT * FROM {CHANGED_SQL} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"))(diffed(TOP))


@register("advance_direct", f"SELECT o_orderkey, o_totalprice FROM {CHANGED_SQL} WHERE o_totalprice > 150000")
def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = parquet_catalog(spark, sf_dir)
    touched = catalog.table("orders").where("o_orderkey % 7 = 0 OR o_orderkey % 5 = 0").select("o_orderkey")
    after = changed_orders(spark, sf_dir).where("o_orderkey % 5 = 0")
    return d.advance_direct(Compiler(catalog).rows(WATCHED), touched, after, ["o_orderkey"], WATCHED.where).select("o_orderkey", "o_totalprice")


@register("exists_flip", f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def _flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = parquet_catalog(spark, sf_dir)
    return d.affected_parents(catalog.table("customer"), catalog.table("orders").where("o_orderkey % 7 = 0"), ["c_custkey"], ["o_custkey"]).select("c_custkey")


@register("overlay", f"SELECT o_orderkey, o_totalprice FROM {CHANGED_SQL}")
def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet_catalog(spark, sf_dir).table("orders")
    after = changed_orders(spark, sf_dir).where("o_orderkey % 5 = 0")
    return with_overlay(orders, after, orders.where("o_orderkey % 7 = 0 OR o_orderkey % 5 = 0"), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@register("or_branches_once", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 100000")
def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compiler(spark, sf_dir)
    arms = [Query("orders", where=cmp("o_orderstatus", "=", "F")), Query("orders", where=cmp("o_totalprice", ">", 100000.0))]
    return d.union_distinct([c.rows(q) for q in arms], ["o_orderkey"]).select("o_orderkey")


@register(
    "signature_drift",
    "SELECT TRUE AS same_again, FALSE AS same_without_one, (SELECT count(*) FROM customer WHERE " + BIG_SQL + ") + (SELECT count(*) FROM orders WHERE o_totalprice > 180000) AS n",
)
def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result set's fingerprint, in another order and with a row missing."""
    rows = compiler(spark, sf_dir).result_set(Query("customer", where=has_big))
    whole, again, less = (d.signature(df).first() for df in (rows, rows.repartition(7), rows.where(~F.col("row_key").eqNullSafe(F.lit(rows.agg(F.min("row_key")).first()[0])))))
    return spark.createDataFrame([(whole == again, whole == less, whole["n"])], "same_again boolean, same_without_one boolean, n long")


# --- change capture ----------------------------------------------------------------------------


def user_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes of their user's last state; errors delete it."""
    events = parquet_catalog(spark, sf_dir).table("events")
    return events.select(
        "user_id", "event_id", "event_type", "value", (F.col("event_id") / 100).cast("long").alias("_version"), F.col("event_id").alias("_pos"),
        F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("_op"),
    )


USER = ("user_id",)
LAST_SQL = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE {})"


@register("cdc_apply", f"SELECT user_id, event_id, event_type FROM {LAST_SQL.format('TRUE')} WHERE n = 1 AND event_type <> 'error'")
def _cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = user_feed(spark, sf_dir)
    base = feed.drop(*cdc.META).limit(0)
    return cdc.apply_changes(base, feed, USER).select("user_id", "event_id", "event_type")


@register("change_log_compact", f"SELECT '{{\"user_id\":' || user_id || '}}' AS row_key, event_id AS pos, CASE WHEN event_type = 'error' THEN 'd' ELSE 's' END AS op FROM {LAST_SQL.format('TRUE')} WHERE n = 1")
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.change_log(user_feed(spark, sf_dir), "users", USER).select("row_key", "pos", "op")


@register("catchup_between", f"SELECT '{{\"user_id\":' || user_id || '}}' AS row_key, CASE WHEN event_type = 'error' THEN 'd' ELSE 's' END AS op FROM {LAST_SQL.format('event_id >= 3000 AND event_id < 6000')} WHERE n = 1")
def _catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = cdc.upto(user_feed(spark, sf_dir), 29, 59)
    now = cdc.apply_changes(feed.drop(*cdc.META).limit(0), feed, USER)
    return cdc.catch_up(cdc.change_log(feed, "users", USER), now, USER, 29, 59).select("row_key", "op")


@register("cdc_truncate", f"SELECT user_id, event_id FROM {LAST_SQL.format('event_id > 500')} WHERE n = 1 AND event_type <> 'error'")
def _truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = user_feed(spark, sf_dir)
    feed = feed.withColumn("_op", F.when(F.col("event_id") == 500, "truncate").otherwise(F.col("_op")))
    return cdc.apply_changes(feed.drop(*cdc.META).where("event_id < 300").dropDuplicates(["user_id"]), feed, USER).select("user_id", "event_id")


@register("backfill_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet_catalog(spark, sf_dir).table("orders").select("o_orderkey", "o_orderpriority")
    wrote = F.col("o_orderkey") % 3 == 0
    live = orders.select("o_orderkey", F.when(wrote, "live").alias("o_orderpriority"), F.when(wrote, 7).alias("_v_o_orderpriority"))
    return cdc.merge_backfill(live, orders.withColumn("_v_o_orderpriority", F.lit(5)), ["o_orderkey"], ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


# --- view records --------------------------------------------------------------------------------


def order_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table, row_key, query, n): orders wanted by two queries, some counts cancelling out."""
    orders = parquet_catalog(spark, sf_dir).table("orders")
    base = orders.select(F.lit("orders").alias("table"), F.col("o_orderkey").cast("string").alias("row_key"), "o_orderkey", "o_totalprice", "o_orderstatus")
    a = base.where("o_totalprice > 100000").withColumn("query", F.lit("dear")).withColumn("n", F.lit(1).cast("long"))
    b = base.where("o_orderstatus = 'F'").withColumn("query", F.lit("filled")).withColumn("n", F.lit(2).cast("long"))
    c = base.where("o_totalprice > 100000 AND o_orderkey % 2 = 0").withColumn("query", F.lit("dear")).withColumn("n", F.lit(-1).cast("long"))
    return a.unionByName(b).unionByName(c).select("table", "row_key", "query", "n")


@register(
    "ref_counts",
    """SELECT o_orderkey::VARCHAR AS row_key, concat_ws(',', CASE WHEN o_totalprice > 100000 AND o_orderkey % 2 <> 0 THEN 'dear=1' END, CASE WHEN o_orderstatus = 'F' THEN 'filled=2' END) AS refs
FROM orders WHERE o_totalprice > 100000 OR o_orderstatus = 'F'""",
)
def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.array_sort(F.map_entries("refs")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return views.merge_refs(order_refs(spark, sf_dir)).select("row_key", F.coalesce(F.array_join(entries, ","), F.lit("")).alias("refs"))


@register(
    "patches_since",
    """SELECT CASE WHEN o_totalprice > 100000 AND o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'del' ELSE 'put' END AS op, o_orderkey::VARCHAR AS row_key FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus = 'F') AND o_orderkey % 10 > 4""",
)
def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.merge_refs(order_refs(spark, sf_dir)).withColumn("patch_version", F.col("row_key").cast("long") % 10)
    return views.patches_since(rows, F.lit(4)).select("op", "row_key")


def desires(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parquet_catalog(spark, sf_dir).table("events")
    return events.groupBy(F.col("event_type").alias("query"), (F.col("user_id") % 50).alias("client")).agg(F.max("event_id").alias("inactivated_at"), F.max("value").alias("ttl")).withColumn(
        "inactivated_at", F.when((F.col("query") == "click") & (F.col("client") == 3), None).otherwise(F.col("inactivated_at"))
    )


DESIRES_SQL = "(SELECT event_type AS query, user_id % 50 AS client, CASE WHEN event_type = 'click' AND user_id % 50 = 3 THEN NULL ELSE max(event_id) END AS inactivated_at, max(value) AS ttl FROM events GROUP BY 1, 2, user_id % 50, event_type)"


@register("ttl_inactive", f"SELECT query, max(inactivated_at + CASE WHEN ttl < 0 OR ttl > 600000 THEN 600000 ELSE ttl END) AS expires FROM {DESIRES_SQL} GROUP BY query HAVING bool_and(inactivated_at IS NOT NULL)")
def _ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.inactive_queries(desires(spark, sf_dir)).select("query", "expires")


@register("query_references", f"SELECT query, count(DISTINCT client) AS clients FROM {DESIRES_SQL} WHERE inactivated_at IS NULL GROUP BY query")
def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.query_references(desires(spark, sf_dir))


# --- statistics -----------------------------------------------------------------------------------


@register("histogram", "SELECT CASE WHEN o_totalprice < 1 THEN 0 ELSE floor(log2(o_totalprice))::INT + 1 END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_histogram(parquet_catalog(spark, sf_dir).table("orders"), "o_totalprice")


@register("nearest_rank", "SELECT o_orderstatus, min(o_totalprice) AS min, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.75) AS p75, quantile_disc(o_totalprice, 0.99) AS p99, max(o_totalprice) AS max, count(*) AS n FROM orders GROUP BY 1")
def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(parquet_catalog(spark, sf_dir).table("orders"), "o_totalprice", by=["o_orderstatus"])


@register("fanout_stats", "SELECT quantile_disc(n, 0.5)::DOUBLE AS fanout, count(*) AS keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_fanout(parquet_catalog(spark, sf_dir).table("orders"), ["o_custkey"])


@register("cdf", "SELECT x, (SELECT avg(CASE WHEN o_totalprice <= x THEN 1.0 ELSE 0.0 END) FROM orders) AS share FROM (VALUES (50000.0::DOUBLE), (100000.0::DOUBLE), (200000.0::DOUBLE)) v(x)")
def _cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cdf(parquet_catalog(spark, sf_dir).table("orders"), "o_totalprice", [50000.0, 100000.0, 200000.0])


@register("copy_totals", "SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet_catalog(spark, sf_dir)
    return stats.copy_totals({t: c.table(t) for t in ("customer", "orders")})


@register(
    "sliding_window_rate",
    """WITH c AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2)
SELECT c.event_type, c.n, c.n + coalesce(p.n, 0) * 0.5::DOUBLE AS weighted FROM c LEFT JOIN c p ON p.event_type = c.event_type AND p.d = c.d - INTERVAL 1 DAY""",
)
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.sliding_rate(parquet_catalog(spark, sf_dir).table("events"), "ts", ["event_type"]).select("event_type", "n", "weighted")


@register("mutation_order", "SELECT o_custkey::VARCHAR AS client, o_orderkey AS mutation_id, CASE WHEN o_orderkey <= 100 THEN 'seen' WHEN o_orderkey = 100 + row_number() OVER (PARTITION BY o_custkey, o_orderkey > 100 ORDER BY o_orderkey) THEN 'apply' ELSE 'gap' END AS state FROM orders")
def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet_catalog(spark, sf_dir).table("orders")
    sent = orders.select(F.col("o_custkey").cast("string").alias("client"), F.col("o_orderkey").alias("mutation_id"))
    last = orders.select(F.col("o_custkey").cast("string").alias("client")).distinct().withColumn("last_id", F.lit(100))
    return mutations.mutation_order(sent, last)


@register("crud_batch", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'delete' ELSE 'update' END AS op FROM orders WHERE o_orderkey % 4 <> 2 UNION ALL SELECT o_orderkey + 100000000, 'insert' FROM orders WHERE o_orderkey % 4 IN (2, 3)")
def _crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four operations on rows that are there (no inserts, which would fail the batch) and on rows that are not."""
    table = parquet_catalog(spark, sf_dir).table("orders").select("o_orderkey", "o_totalprice")
    kind = F.element_at(F.array(*map(F.lit, ("delete", "update", "insert", "upsert"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    ops = table.withColumn("_op", kind).withColumn("_pos", F.col("o_orderkey"))
    far = ops.withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    feed, _ = mutations.crud(table, ops.where("_op <> 'insert'").unionByName(far), ["o_orderkey"], 1)
    return feed.select("o_orderkey", F.col("_op").alias("op"))


@register(
    "transitions",
    f"""WITH d AS {DESIRES_SQL}, b AS (SELECT DISTINCT query FROM d WHERE inactivated_at IS NULL), a AS (SELECT DISTINCT query FROM d WHERE client < 2)
SELECT coalesce(b.query, a.query) AS query, CASE WHEN b.query IS NULL THEN 'hydrate' ELSE 'remove' END AS action FROM b FULL OUTER JOIN a ON a.query = b.query WHERE a.query IS NULL OR b.query IS NULL""",
)
def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = desires(spark, sf_dir)
    return views.transitions(now, now.where("client < 2").withColumn("inactivated_at", F.lit(None).cast("long")))


@register(
    "receive_rows",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderkey % 7 <> 0 AS had, o_orderkey % 5 <> 0 AS got, o_orderkey % 3 = 0 AS changed FROM orders)
SELECT o_orderkey::VARCHAR AS row_key, CASE WHEN had AND NOT got THEN 'del' WHEN got AND (NOT had OR changed) THEN 'put' END AS op, CASE WHEN got AND had AND NOT changed THEN 1 ELSE 2 END AS patch_version
FROM o WHERE had OR got""",
)
def _receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of most orders under one query; the query runs again, with some rows gone, new or changed."""
    orders = parquet_catalog(spark, sf_dir).table("orders")
    refs = F.create_map(F.lit("q"), F.lit(1).cast("long")).alias("refs")
    base = orders.select(F.lit("orders").alias("table"), F.col("o_orderkey").cast("string").alias("row_key"), "o_orderkey", F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("row"))
    rows = base.where("o_orderkey % 7 <> 0").select("table", "row_key", F.lit("a").alias("row_version"), F.lit(1).alias("patch_version"), refs)
    version = F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise("a").alias("row_version")
    updates = base.where("o_orderkey % 5 <> 0").select("table", "row_key", version, refs, "row")
    return views.receive(rows, updates, F.lit(2), ["q"]).select("row_key", "op", "patch_version")


@register("snapshot_diff", """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'remove' ELSE 'edit' END AS kind, '{"o_orderkey":' || o_orderkey || '}' AS row_key FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0""")
def _snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, after = parquet_catalog(spark, sf_dir).table("orders"), changed_orders(spark, sf_dir)
    touched = orders.where("o_orderkey % 7 = 0 OR o_orderkey % 5 = 0")
    gone = F.col("o_orderkey") % 7 == 0
    feed = touched.select(*orders.columns, F.lit(3).cast("long").alias("_version"), F.col("o_orderkey").alias("_pos"), F.when(gone, "delete").otherwise("update").alias("_op"))
    log = cdc.change_log(feed, "orders", ["o_orderkey"])
    return cdc.snapshot_diff(orders, after, log, ["o_orderkey"], 2).select("kind", "row_key")


@register("renamed", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000")
def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = NameMapper({"customer": ("account", {"c_custkey": "id", "c_acctbal": "balance"})})
    rows = compiler(spark, sf_dir).rows(Query("customer", where=cmp("c_acctbal", ">", 5000.0)))
    return names.rename("customer", rows).select("id", "balance")


@register("messages", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages of a change stream, decoded and applied."""
    events = parquet_catalog(spark, sf_dir).table("events")
    tag = F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("tag")
    new, old = F.struct("user_id", "event_id").alias("new"), F.struct(F.col("user_id").cast("string").alias("user_id")).alias("old")
    sent = events.select(F.to_json(F.struct(F.lit(1).alias("version"), F.col("event_id").alias("pos"), tag, new, old)).alias("value"))
    feed = cdc.from_messages(sent, "user_id: bigint, event_id: bigint", USER)
    return cdc.apply_changes(feed.select("user_id", "event_id").limit(0), feed, USER)
