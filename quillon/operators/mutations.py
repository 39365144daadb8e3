"""Writes: batches of row operations, who may do them, and how often."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ordering import dealt
from quillon.operators.predicates import predicate
from quillon.plans.ast import Condition, Or


def fold_ops(table: DataFrame, ops: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """``ops`` with ``kind``, what each of them does: insert, update, delete, none or error, and the row after it.

    ``ops`` has the table's columns, ``_op``, ``_pos`` and, if wanted, ``_set``: the names of
    the columns that an update changes, to NULL too.  Without it an update changes those that
    are not NULL.  An operation sees what earlier ones of its key have done: whether the row
    is there follows from the last that wrote or deleted it, and a column's value from the
    last that set it, so running windows decide all of a key's operations without gathering them.
    ``rows``, how many both have, says how many tasks share them.
    """
    data = [c for c in table.columns if c not in key]
    have = table.select(*key, *[F.col(c).alias(f"__old_{c}") for c in data], F.lit(True).alias("__there"))
    j = dealt(ops, rows, *key).join(dealt(have, rows, *key), list(key), "left")
    order = Window.partitionBy(*key).orderBy("_pos")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    op = F.col("_op")
    left = F.when(op.isin("insert", "upsert"), True).when(op == "delete", False)
    j = j.withColumn("__was", F.coalesce(F.last(left, True).over(before), "__there", F.lit(False)))
    kind = F.when((op == "insert") & F.col("__was"), "error").when(op.isin("update", "delete") & ~F.col("__was"), "none")
    kind = kind.when(op == "upsert", F.when(F.col("__was"), "update").otherwise("insert")).when(op.isin("insert", "update", "delete"), op).otherwise("error")
    j = j.withColumn("kind", kind)
    done = ~F.col("kind").isin("none", "error")
    values = {}
    for c in data:
        named = F.coalesce(F.array_contains("_set", F.lit(c)), F.col(c).isNotNull()) if "_set" in ops.columns else F.col(c).isNotNull()
        given = F.when(done & (op == "delete"), F.struct(F.lit(None).cast(table.schema[c].dataType).alias("v")))
        given = given.when(done & ((op != "update") | named), F.struct(F.col(c).alias("v")))
        last = F.last(given, True).over(upto)
        values[c] = F.when(last.isNull(), F.col(f"__old_{c}")).otherwise(last["v"])
    extra = [c for c in ops.columns if c not in (*table.columns, "_op", "_pos", "_set")]
    return j.select(*key, *[values[c].alias(c) for c in data], "_pos", "kind", *extra)


def _rows(table: DataFrame, ops: DataFrame) -> int:
    return table.select(F.lit(1).alias("n")).unionAll(ops.select(F.lit(1).alias("n"))).count()


def _feed(each: DataFrame, columns: Sequence[str], version: int) -> DataFrame:
    done = each.where("kind NOT IN ('none', 'error')")
    return done.select(*columns, F.lit(version).cast("long").alias("_version"), F.col("_pos").cast("long").alias("_pos"), F.col("kind").alias("_op"))


def crud(table: DataFrame, ops: DataFrame, key: Sequence[str], version: int) -> tuple[DataFrame, DataFrame]:
    """A batch of insert, upsert, update and delete operations: (change feed, errors).

    Operations run in order of ``_pos``, each on what the earlier ones left (see ``fold_ops``).
    An insert of a row that is there is an error, and so is an unknown operation; with any
    error, (key..., _pos) in the second frame, the feed is empty: the batch fails as a whole.
    Updates and deletes of a missing row do nothing.
    """
    each = fold_ops(table, ops, key, _rows(table, ops))
    errors = each.where("kind = 'error'").select(*key, "_pos")
    failed = errors.limit(1).select(F.lit(True).alias("__failed"))  # one row at most
    return _feed(each, table.columns, version).join(F.broadcast(failed), F.lit(True), "left_anti"), errors


def transactions(table: DataFrame, ops: DataFrame, key: Sequence[str], version: int, mutation: str = "mutation_id") -> tuple[DataFrame, DataFrame]:
    """Many mutations in order, each of which holds or fails as a whole: (change feed, failed mutations).

    ``_pos`` orders all operations, those of one mutation together.  A mutation that fails has
    done nothing, so later ones are judged without it.  Every round finds the failures whose
    keys no earlier suspect has touched, which are certain; rounds grow with chains of
    mutations that fail one because of another, not with their number.
    """
    gone, rows = ops.select(mutation).limit(0), _rows(table, ops)
    while True:
        each = fold_ops(table, ops.join(gone, mutation, "left_anti"), key, rows)
        suspects = each.where("kind = 'error'").select(mutation).distinct().withColumn("__suspect", F.lit(1))
        marked = each.join(suspects, mutation, "left").withColumn("__suspect", F.coalesce("__suspect", F.lit(0)))
        count = lambda *by: F.coalesce(F.sum("__suspect").over(Window.partitionBy(*by).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # Earlier operations of the same mutation do not make a failure less certain.
        sure = marked.withColumn("__others", count(*key) - count(*key, mutation)).where("kind = 'error' AND __others = 0").select(mutation).distinct()
        if sure.isEmpty():
            return _feed(each, table.columns, version), gone
        gone = gone.unionByName(sure)


@dataclass(frozen=True)
class WriteRules:
    """Conditions any of which allows a write; None allows nothing."""

    insert: tuple[Condition, ...] | None = None
    update_before: tuple[Condition, ...] | None = None
    update_after: tuple[Condition, ...] | None = None
    delete: tuple[Condition, ...] | None = None


def allowed(df: DataFrame, rules: Sequence[WriteRules | None], action: str, phase: str) -> DataFrame:
    """The rows of ``df`` that the table's rules and all touched cells' rules let through.

    An insert is judged by the new row, a delete by the old, an update by both.
    """
    name = {("insert", "after"): "insert", ("update", "before"): "update_before", ("update", "after"): "update_after", ("delete", "before"): "delete"}.get((action, phase))
    if name is None:
        return df
    if not rules:
        return df.limit(0)
    for r in rules:
        conditions = getattr(r, name) if r else None
        df = df.where(predicate(Or(tuple(conditions or ())), df))
    return df


def mutation_order(sent: DataFrame, last: Mapping[str, int] | DataFrame) -> DataFrame:
    """``sent`` (client, mutation_id) with ``state``: apply, seen (already done) or gap (an error)."""
    last = sent.sparkSession.createDataFrame(list(last.items()), "client string, last_id long") if isinstance(last, Mapping) else last
    w = Window.partitionBy("client").orderBy("mutation_id")
    j = sent.join(last, "client", "left").withColumn("last_id", F.coalesce("last_id", F.lit(0)))
    fresh = F.col("mutation_id") > F.col("last_id")
    nth = F.sum(fresh.cast("int")).over(w)
    state = F.when(~fresh, "seen").when(F.col("mutation_id") == F.col("last_id") + nth, "apply").otherwise("gap")
    return j.select("client", "mutation_id", state.alias("state"))


def push_batches(pushes: DataFrame, connection: Sequence[str] = ("client", "connection", "revision"), same: Sequence[str] = ("schema_version", "user", "url")) -> tuple[DataFrame, DataFrame]:
    """Queued pushes combined by connection: (batches, conflicts).

    ``pushes`` has the connection's columns, ``arrived`` (its place in the queue), ``mutations``
    (an array) and what all pushes of a connection must have the same.  A batch has all
    mutations in order of arrival and ``first_arrived``; a push with ``stop`` true ends the
    queue for all that arrived after it.  Connections whose pushes disagree are conflicts.
    """
    if "stop" in pushes.columns:
        end = pushes.where("stop").agg(F.min("arrived").alias("__end"))
        pushes = pushes.where("NOT coalesce(stop, false)").join(F.broadcast(end), F.col("__end").isNull() | (F.col("arrived") < F.col("__end"))).drop("__end", "stop")  # one row
    parts = F.transform(F.array_sort(F.collect_list(F.struct("arrived", "mutations"))), lambda p: p["mutations"])
    agree = [F.size(F.collect_set(F.struct(c))) == 1 for c in same]
    together = agree[0] if agree else F.lit(True)
    for a in agree[1:]:
        together = together & a
    grouped = pushes.groupBy(*connection).agg(F.flatten(parts).alias("mutations"), F.min("arrived").alias("first_arrived"), *[F.min(c).alias(c) for c in same], together.alias("__agree"))
    return grouped.where("__agree").drop("__agree"), grouped.where("NOT __agree").select(*connection, "first_arrived")


def rate_limited(calls: DataFrame, by: Sequence[str], at_ms: str, window_ms: int, most: int, order: str | None = None) -> DataFrame:
    """``calls`` with ``allowed``: whether the limit of ``most`` calls in a sliding window lets each one through.

    A call counts what was allowed so far in its own window, aligned to its size, and what the
    window before allowed by the share of it that the sliding window still covers.  Refused
    calls do not count.  Each answer depends on those before it, so a key's calls pass one
    task in order, of which it keeps two counts and no rows.
    """
    if window_ms <= 0:
        raise ValueError("a window has a positive size")
    ordered = calls.repartition(*by).sortWithinPartitions(*by, at_ms, *([order] if order else []))
    keys, at = [calls.columns.index(c) for c in by], calls.columns.index(at_ms)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, window, here, before = None, 0, 0, 0
        for batch in batches:
            out = []
            for key, t in zip(zip(*(batch.column(i).to_pylist() for i in keys), strict=True), batch.column(at).to_pylist(), strict=True):
                mine, past = divmod(t, window_ms)
                if key != held or mine != window:
                    before = here if key == held and mine == window + 1 else 0
                    held, window, here = key, mine, 0
                out.append(here + before * (1 - past / window_ms) < most)
                here += out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*batch.schema.names, "allowed"])

    return ordered.mapInArrow(decide, T.StructType([*calls.schema.fields, T.StructField("allowed", T.BooleanType())]))


def sliding_rate(events: DataFrame, ts: str, by: Sequence[str], window: str = "1 day", seconds: int = 86_400) -> DataFrame:
    """(by..., window_start, n, weighted) where ``weighted`` at a window's middle adds half the window before."""
    counts = events.groupBy(*by, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("window_start"), "n")
    w = Window.partitionBy(*by).orderBy("window_start")
    adjacent = F.lag("window_start").over(w) == F.col("window_start") - F.expr(f"INTERVAL {seconds} SECONDS")
    before = F.when(adjacent, F.lag("n").over(w)).otherwise(0)
    return counts.withColumn("weighted", F.col("n") + F.coalesce(before, F.lit(0)) * F.lit(0.5))
