"""Queries as DataFrames.

Order of evaluation: table, cursor, conditions, order and limit, then related rows.  A
subquery's existence is a semi or anti join where it must hold, and a flag joined from its
distinct keys where it stands under OR.  Everything stays lazy and declarative, so that
Catalyst sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.diff import affected_parents
from quillon.operators.ordering import cursor, first_of_each, first_rows, sort_columns, whole_limit
from quillon.operators.predicates import predicate
from quillon.plans.ast import And, Condition, Exists, Query, Related, correlated, dedupe_related
from quillon.sources.catalog import Catalog, row_key


class Compiler:
    def __init__(self, catalog: Catalog, watch: Callable[[str, DataFrame], DataFrame] | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df):
        """``watch`` is shown what is left of a table after each level's cursor and plain conditions.

        ``cut`` may store what later levels use several times, so that plans do not grow with depth.
        """
        self.catalog, self.watch, self.cut = catalog, watch, cut

    def order(self, q: Query) -> list[tuple[str, str]]:
        named = {f for f, _ in q.order_by}
        return [*q.order_by, *((k, "asc") for k in self.catalog.key(q.table) if k not in named)]

    # --- rows of one level ---

    def candidates(self, q: Query, base: DataFrame | None = None) -> DataFrame:
        """The table's rows past the cursor that meet the conditions; neither ordered nor limited."""
        df = self.catalog.table(q.table) if base is None else base
        if q.start:
            df = df.where(cursor(df, self.order(q), dict(q.start.row), q.start.exclusive))
        return self.filtered(df, q.where, q.table)

    def filtered(self, df: DataFrame, where: Condition | None, table: str | None = None) -> DataFrame:
        arms = where.conditions if isinstance(where, And) else () if where is None else (where,)
        plain = [c for c in arms if not correlated(c)]
        if plain:
            df = df.where(predicate(And(tuple(plain)), df))  # before any join
        if self.watch and table:
            df = self.watch(table, df)
        for c in arms:
            if isinstance(c, Exists):
                df = self.semi(df, c)
            elif isinstance(c, And):
                df = self.filtered(df, c)
            elif correlated(c):
                df = self.under_or(df, c)
        return df

    def child_keys(self, r: Related) -> DataFrame | None:
        """The child's rows as key columns ``__k0..``; None if a limit of 0 leaves no rows."""
        q = r.subquery
        if whole_limit(q.limit) == 0:
            return None
        child = self.candidates(q)
        return child.select(*[child[c].alias(f"__k{i}") for i, c in enumerate(r.child_field)])

    def semi(self, df: DataFrame, e: Exists) -> DataFrame:
        keys = self.child_keys(e.related)
        if keys is None:
            return df if e.negated else df.limit(0)
        if e.flip and not e.negated:
            # The child's distinct keys look up their parents; a key is there once, so no row doubles.
            keys = keys.distinct()
            return keys.join(df, [df[p] == keys[f"__k{i}"] for i, p in enumerate(e.related.parent_field)]).select(*[df[c] for c in df.columns])
        on = [df[p] == keys[f"__k{i}"] for i, p in enumerate(e.related.parent_field)]
        return df.join(keys, on, "left_anti" if e.negated else "left_semi")

    def under_or(self, df: DataFrame, c: Condition) -> DataFrame:
        columns, flags, names = df.columns, {}, []
        for n, e in enumerate(correlated(c)):
            keys, name = self.child_keys(e.related), f"__found{n}"
            if keys is None:
                flags[id(e)] = F.lit(e.negated)
                continue
            keys = keys.select(*[F.col(k).alias(f"{k}_{n}") for k in keys.columns], F.lit(True).alias(name)).distinct()
            df = df.join(keys, [df[p] == keys[f"__k{i}_{n}"] for i, p in enumerate(e.related.parent_field)], "left")
            flags[id(e)] = F.col(name).isNull() if e.negated else F.col(name).isNotNull()
            names.append(name)
        return df.where(predicate(c, df, flags)).select(*columns)

    def rows(self, q: Query, ordered: bool = False) -> DataFrame:
        """The query's own rows, limited; sorted too if ``ordered``."""
        df, limit = self.candidates(q), whole_limit(q.limit)
        if limit is not None:
            return first_rows(df, self.order(q), limit)
        return df.orderBy(*sort_columns(df, self.order(q))) if ordered else df

    # --- related rows ---

    def children(self, parents: DataFrame, r: Related, rank: str | None = None) -> DataFrame:
        """The child rows of any of the parents, limited per parent key; with their ``rank`` if it is named."""
        keys = parents.select(*[parents[p].alias(f"__p{i}") for i, p in enumerate(r.parent_field)]).distinct()
        child = self.candidates(r.subquery)
        child = child.join(keys, [child[c] == keys[f"__p{i}"] for i, c in enumerate(r.child_field)], "left_semi")
        limit = whole_limit(r.subquery.limit)
        if limit is None and rank is None:
            return child
        if limit == 0 and rank:
            return child.limit(0).withColumn(rank, F.lit(0))
        return first_of_each(child, r.child_field, self.order(r.subquery), (1 << 31) - 1 if limit is None else limit, rank)

    def flat(self, q: Query) -> list[tuple[str, str, DataFrame]]:
        """(path, table, rows) of the root and of every related hop, in order of the tree."""
        return self._hops(q, self.rows(q), q.table, exists_too=False)

    def _hops(self, q: Query, rows: DataFrame, path: str, exists_too: bool) -> list[tuple[str, str, DataFrame]]:
        out = [(path, q.table, rows)]
        hops = [(r.subquery.alias or f"{r.subquery.table}_{i}", r) for i, r in enumerate(dedupe_related(q.related))]
        if exists_too:
            hops += [(f"exists_{i}", e.related) for i, e in enumerate(correlated(q.where)) if not e.negated]
        for name, r in hops:
            out += self._hops(r.subquery, self.children(rows, r), f"{path}.{name}", exists_too)
        return out

    def by_root(self, q: Query, roots: DataFrame) -> DataFrame:
        """(root_key, table, row_key, row): what each of some root rows brings into the result set.

        A row that several roots reach is there for each of them, so one root's part can be
        replaced without the others.
        """
        key = self.catalog.key(q.table)
        out = None
        for table, rows in self._rooted(q, roots.withColumn("__root", row_key(key)), stored=True):
            columns = [c for c in rows.columns if c != "__root"]
            one = rows.select(F.col("__root").alias("root_key"), F.lit(table).alias("table"), row_key(self.catalog.key(table)).alias("row_key"), F.to_json(F.struct(*columns)).alias("row"))
            out = one if out is None else out.unionByName(one)
        return out.dropDuplicates(["root_key", "table", "row_key"])

    def _rooted(self, q: Query, rows: DataFrame, stored: bool = False) -> list[tuple[str, DataFrame]]:
        hops = [*dedupe_related(q.related), *(e.related for e in correlated(q.where) if not e.negated)]
        rows = rows if stored or not hops else self.cut(rows)
        out = [(q.table, rows)]
        for r in hops:
            child = self.children(rows.drop("__root"), r)
            keys = rows.select("__root", *[F.col(p).alias(f"__p{i}") for i, p in enumerate(r.parent_field)]).distinct()
            below = child.join(keys, [child[c] == keys[f"__p{i}"] for i, c in enumerate(r.child_field)]).select(*[child[c] for c in child.columns], "__root")
            out += self._rooted(r.subquery, below)
        return out

    def affected(self, q: Query, changed: Mapping[str, DataFrame]) -> DataFrame | None:
        """Rows of the query's table whose part in the result may have changed; None if surely none.

        ``changed`` has, for some tables, old and new images of the rows that changed.  A
        changed child leads to its parents, at any depth.
        """
        out = changed.get(q.table)
        for r in [*q.related, *(e.related for e in correlated(q.where))]:
            below = self.affected(r.subquery, changed)
            if below is not None:
                parents = self.cut(affected_parents(self.catalog.table(q.table), below, r.parent_field, r.child_field))
                out = parents if out is None else out.unionByName(parents)
        return out

    def result_set(self, q: Query, exists_children: bool = True) -> DataFrame:
        """All rows a client of the query holds, once each: (table, row_key, row as JSON).

        Related rows count and, if asked for, those that EXISTS conditions found.
        """
        by_table: dict[str, DataFrame] = {}
        for _, table, rows in self._hops(q, self.rows(q), q.table, exists_children):
            by_table[table] = by_table[table].unionByName(rows) if table in by_table else rows
        out = None
        for table, rows in by_table.items():
            key = self.catalog.key(table)
            one = rows.dropDuplicates(list(key)).select(F.lit(table).alias("table"), row_key(key).alias("row_key"), F.to_json(F.struct(*rows.columns)).alias("row"))
            out = one if out is None else out.unionByName(one)
        return out

    def nested(self, q: Query, ordered: bool = True) -> DataFrame:
        """The root's rows, with one array of structs for each related hop, at any depth."""
        df = self._with_arrays(self.rows(q), q)
        return df.orderBy(*sort_columns(df, self.order(q))) if ordered else df

    def _with_arrays(self, rows: DataFrame, q: Query) -> DataFrame:
        for i, r in enumerate(dedupe_related(q.related)):
            name = r.subquery.alias or f"{r.subquery.table}_{i}"
            # Arrays sort by their structs' first field, the rank, which a limit has made already.
            ranked = self.children(rows, r, rank="__rank")
            columns = ranked.columns
            full = self._with_arrays(ranked, r.subquery)
            shown = [c for c in full.columns if c != "__rank"]
            keys = [F.col(c).alias(f"__c{j}") for j, c in enumerate(r.child_field)]
            grouped = full.select(*keys, F.struct("__rank", *shown).alias("__row")).groupBy(*[f"__c{j}" for j in range(len(keys))])
            arrays = grouped.agg(F.transform(F.array_sort(F.collect_list("__row")), lambda x: F.struct(*[x[c].alias(c) for c in shown])).alias(name))
            assert set(columns) <= {*shown, "__rank"}
            rows = rows.join(arrays, [rows[p] == arrays[f"__c{j}"] for j, p in enumerate(r.parent_field)], "left").drop(*[f"__c{j}" for j in range(len(keys))])
            rows = rows.withColumn(name, F.coalesce(name, F.array().cast(arrays.schema[name].dataType)))
        return rows


def unlimited(q: Query) -> bool:
    """Whether changed rows alone decide how the result changes: no limit, cursor, relation or subquery."""
    return q.limit is None and q.start is None and not q.related and not correlated(q.where)


def fanout(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean rows for each value: what a join on these columns multiplies by."""
    keyed = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    return keyed.groupBy(*columns).count().agg(F.avg("count").alias("fanout"), F.count(F.lit(1)).alias("keys"))
