"""Total orders, keyset cursors and limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Ordering = Sequence[tuple[str, str]]

#: Rows that a task of ``dealt`` gets on average.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` by a hash of ``by``, in tasks whose number follows ``rows``; few rows are left where they are.

    Adaptive execution would make tasks fewer by their compressed bytes, of which narrow rows
    have so few that a task comes to sort millions; it keeps to a number that is given.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def reversed_order(order: Ordering) -> Ordering:
    return [(f, "asc" if d == "desc" else "desc") for f, d in order]


def sort_columns(df: DataFrame, order: Ordering) -> list[Column]:
    """NULL comes before everything ascending, and after it descending."""
    return [df[f].desc_nulls_last() if d == "desc" else df[f].asc_nulls_first() for f, d in order]


def cursor(df: DataFrame, order: Ordering, row: Mapping[str, Any], exclusive: bool) -> Column:
    """Rows after the bound ``row`` (or at it, if not exclusive).

    Only the leading sort columns that the bound names are compared.  A first conjunct on
    the leading column alone can be pushed to the files' statistics.
    """
    prefix = []
    for f, d in order:
        if f not in row:
            break
        prefix.append((f, d))
    if not prefix:
        raise ValueError("a start row must name the leading sort column")

    def literal(f: str) -> Column:
        return F.lit(row[f]).cast(df.schema[f].dataType)

    def beyond(f: str, d: str) -> Column:
        c = df[f]
        if d == "asc":
            return c.isNotNull() if row[f] is None else c > literal(f)
        return F.lit(False) if row[f] is None else c.isNull() | (c < literal(f))

    def at(f: str) -> Column:
        return df[f].isNull() if row[f] is None else df[f] == literal(f)

    arms = []
    for i, (f, d) in enumerate(prefix):
        arms.append(reduce(lambda a, b: a & b, [at(g) for g, _ in prefix[:i]] + [beyond(f, d)]))
    if not exclusive:
        arms.append(reduce(lambda a, b: a & b, [at(g) for g, _ in prefix]))
    out = reduce(lambda a, b: a | b, arms)
    f, d = prefix[0]
    if row[f] is not None:
        out = (df[f] >= literal(f) if d == "asc" else df[f].isNull() | (df[f] <= literal(f))) & out
    return out


def whole_limit(n: float | None) -> int | None:
    """A limit arrives as a number: cut to an integer, 0 at least."""
    return None if n is None else max(0, int(n))


def first_rows(df: DataFrame, order: Ordering, limit: int) -> DataFrame:
    """The first rows of the whole, as a top-N without a full sort."""
    return df.limit(0) if limit == 0 else df.orderBy(*sort_columns(df, order)).limit(limit)


def first_of_each(df: DataFrame, by: Sequence[str], order: Ordering, limit: int, rank: str | None = None) -> DataFrame:
    """The first rows of every group; ranks are cut before the shuffle and after it."""
    if limit == 0:
        return df.limit(0)
    window = Window.partitionBy(*[df[c] for c in by]).orderBy(*sort_columns(df, order))
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= limit)
    return out if rank else out.drop(name)
