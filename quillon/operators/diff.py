"""Result sets compared, kept up to date and fingerprinted.

A result set has the columns (table, row_key, row), a row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.predicates import predicate
from quillon.plans.ast import Condition


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, table, row_key, row): add, remove or edit.  One join; rows that stay the same vanish.

    An edit that crosses a condition or a limit shows as an add or a remove by itself.
    """
    a = before.select("table", "row_key", F.col("row").alias("old"), F.lit(True).alias("was"))
    b = after.select("table", "row_key", F.col("row").alias("new"), F.lit(True).alias("is"))
    both = a.join(b, ["table", "row_key"], "full_outer").where("was IS NULL OR `is` IS NULL OR NOT (old <=> new)")
    kind = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "remove").otherwise("edit")
    return both.select(kind.alias("kind"), "table", "row_key", F.coalesce("new", "old").alias("row"))


def apply_diff(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The result set after ``changes``."""
    kept = before.join(changes.select("table", "row_key"), ["table", "row_key"], "left_anti")
    return kept.unionByName(changes.where("kind <> 'remove'").select("table", "row_key", "row"))


def removal(before: DataFrame) -> DataFrame:
    """All of a result set leaves, with the query it belonged to."""
    return before.select(F.lit("remove").alias("kind"), "table", "row_key", "row")


def advance_direct(previous: DataFrame, touched: DataFrame, after: DataFrame, key: Sequence[str], where: Condition | None) -> DataFrame:
    """Rows of a query without limit, cursor or subqueries once some keys have changed.

    ``touched`` has the changed keys, ``after`` what these rows are now.  Only the changes
    are filtered; the other rows are kept as they were.
    """
    kept = previous.join(touched.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(after.where(predicate(where, after)).select(*previous.columns))


def affected_parents(parents: DataFrame, changed_children: DataFrame, parent_field: Sequence[str], child_field: Sequence[str]) -> DataFrame:
    """Parents whose related rows or existence may have changed: those of a changed child's key."""
    keys = changed_children.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(child_field)]).distinct()
    return parents.join(keys, [parents[p] == keys[f"__k{i}"] for i, p in enumerate(parent_field)], "left_semi")


def signature(rows: DataFrame) -> DataFrame:
    """(signature, n): an order-free fingerprint of a result set's keys, to notice drift."""
    return rows.agg(F.coalesce(F.bit_xor(F.xxhash64("table", "row_key")), F.lit(0).cast("long")).alias("signature"), F.count(F.lit(1)).alias("n"))


def union_distinct(branches: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Branches of an OR joined again, a row once."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.dropDuplicates(list(key))
