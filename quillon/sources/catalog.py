"""Tables by name: schema, keys, renamings and where their rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.ast import Column as ColumnName
from quillon.plans.ast import Condition, Exists, Query, Related, Simple, Value

#: Fixed by the replicated tables' format.
VERSION_COLUMN = "_0_version"


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: tuple[str, ...]
    unique_keys: tuple[tuple[str, ...], ...] = ()
    min_row_version: str | None = None


@dataclass
class Catalog:
    """What a query's table names stand for.  Frames are lazy; nothing is read here."""

    spark: SparkSession
    specs: dict[str, TableSpec] = field(default_factory=dict)
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def add(self, spec: TableSpec, frame: DataFrame | Callable[[], DataFrame]) -> Catalog:
        if not spec.primary_key:
            raise ValueError(f"{spec.name} has no key; rows without one cannot be tracked")
        self.specs[spec.name] = spec
        self.frames[spec.name] = frame if callable(frame) else lambda: frame
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise KeyError(f"unknown table {name!r}")
        df, least = self.frames[name](), self.specs[name].min_row_version
        if least is not None and VERSION_COLUMN in df.columns:
            df = df.withColumn(VERSION_COLUMN, F.greatest(VERSION_COLUMN, F.lit(least)))
        return df

    def key(self, name: str) -> tuple[str, ...]:
        return self.specs[name].primary_key

    def with_tables(self, frames: Mapping[str, DataFrame]) -> Catalog:
        """The same tables, some read from elsewhere: another version, or an overlay."""
        out = Catalog(self.spark, dict(self.specs), dict(self.frames))
        for name, frame in frames.items():
            out.frames[name] = lambda frame=frame: frame
        return out


#: Keys of the driver's tables.  lineitem has no short key: all its columns together are unique.
DRIVER_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
}


def parquet_catalog(spark: SparkSession, folder: str, keys: Mapping[str, Sequence[str]] = DRIVER_KEYS) -> Catalog:
    """A catalog over ``folder/<table>.parquet``; a file is opened when a query first names it."""
    out = Catalog(spark)
    for name, key in keys.items():
        out.add(TableSpec(name, tuple(key)), lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"))
    return out


def jdbc_snapshot(spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple[int, int], partitions: int, **options: str) -> DataFrame:
    """A first copy of a database's table, read by ranges of a column in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", partition_column)
    reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.options(**options).load()


@dataclass(frozen=True)
class Found:
    """A table as a database describes it."""

    spec: TableSpec
    columns: tuple[tuple[str, str], ...]
    #: A whole-number key column, by whose ranges the table is read in parallel; None if it has none.
    ranged_by: str | None


def discover(spark: SparkSession, url: str, schema: str | None = None, user: str = "", password: str = "") -> list[Found]:
    """Tables of a database with their primary and unique keys, from its own description.

    Tables without either have no key to follow their rows by; they are left out.
    """
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, user, password)

    def rows(result, *names: str) -> list[tuple]:
        out = []
        while result.next():
            out.append(tuple(result.getString(n) for n in names))
        return out

    try:
        meta, out = connection.getMetaData(), []
        kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        for owner, name in rows(meta.getTables(None, schema, None, kinds), "TABLE_SCHEM", "TABLE_NAME"):
            columns = tuple(rows(meta.getColumns(None, owner, name, None), "COLUMN_NAME", "TYPE_NAME"))
            primary = [c for _, c in sorted((int(n), c) for c, n in rows(meta.getPrimaryKeys(None, owner, name), "COLUMN_NAME", "KEY_SEQ"))]
            indexes: dict[str, list] = {}
            for index, n, c in rows(meta.getIndexInfo(None, owner, name, True, False), "INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME"):
                if c:
                    indexes.setdefault(index, []).append((int(n), c))
            unique = [tuple(c for _, c in sorted(v)) for _, v in sorted(indexes.items())]
            key = tuple(primary) or (unique[0] if unique else ())
            unique = [u for u in unique if u != key]
            if key:
                whole = [c for c, t in columns if c in key and t.upper() in ("SMALLINT", "INTEGER", "INT", "BIGINT", "INT4", "INT8")]
                out.append(Found(TableSpec(name, key, tuple(unique)), columns, whole[0] if whole else None))
        return out
    finally:
        connection.close()


def initial_snapshot(spark: SparkSession, url: str, found: Found, schema: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A discovered table's first copy, read by even ranges of its whole-number key if it has one."""
    name = f"{schema}.{found.spec.name}" if schema else found.spec.name
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if found.ranged_by is None:
        return reader.option("dbtable", name).load()
    column = found.ranged_by
    ends = reader.option("query", f"SELECT min({column}) AS lo, max({column}) AS hi FROM {name}").load().first()
    if ends[0] is None:
        return spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", name).load()
    return jdbc_snapshot(spark, url, name, column, (int(ends[0]), int(ends[1]) + 1), partitions, **options)


class MemoryTable:
    """Rows held by the driver, for tests and for rules' own tables: pushed to, looked up by key, read as a frame."""

    def __init__(self, spark: SparkSession, spec: TableSpec, schema: str, rows: Iterable[tuple] = ()):
        self.spark, self.spec, self.schema = spark, spec, schema
        self.names = spark.createDataFrame([], schema).columns
        self.rows: dict[tuple, tuple] = {}
        for r in rows:
            self.push("add", r)

    def _key(self, row: Sequence) -> tuple:
        return tuple(row[self.names.index(k)] for k in self.spec.primary_key)

    def push(self, kind: str, row: tuple, old: tuple | None = None) -> None:
        """add, remove or edit; what does not fit the rows that are there is an error."""
        key, before = self._key(row), self._key(old if old is not None else row)
        if kind == "add" and key in self.rows or kind != "add" and before not in self.rows:
            raise ValueError(f"{kind} of {key}: the row is {'there' if kind == 'add' else 'not there'}")
        if kind != "add":
            del self.rows[before]
        if kind != "remove":
            self.rows[key] = tuple(row)

    def find_by_key(self, **key) -> tuple | None:
        return self.rows.get(tuple(key[k] for k in self.spec.primary_key))

    def fetch(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.rows.values()), self.schema)


def sampled(df: DataFrame, rate: float | None = None, cap: int | None = None, seed: int = 0) -> DataFrame:
    """A Bernoulli sample and a cap, for trying a copy out."""
    df = df.sample(rate, seed) if rate is not None and rate < 1 else df
    return df if cap is None else df.limit(cap)


def with_overlay(base: DataFrame, after: DataFrame, touched: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``touched`` keys replaced by ``after``: a commit not yet written."""
    return base.join(touched.select(*key).distinct(), list(key), "left_anti").unionByName(after)


def contents_and_version(df: DataFrame) -> DataFrame:
    """(contents, version): each row without its version column, and that."""
    data = [c for c in df.columns if c != VERSION_COLUMN]
    version = F.col(VERSION_COLUMN) if VERSION_COLUMN in df.columns else F.lit(None).cast("string")
    return df.select(F.struct(*data).alias("contents"), version.alias("version"))


def row_key(key: Iterable[str]):
    """A canonical text of a row's key: JSON with the columns in name order."""
    return F.to_json(F.struct(*sorted(key)))


class NameMapper:
    """Client names of tables and columns, and what the server calls them."""

    def __init__(self, tables: Mapping[str, tuple[str, Mapping[str, str]]]):
        self.tables = {t: (server, dict(columns)) for t, (server, columns) in tables.items()}

    def table(self, name: str) -> str:
        return self._of(name)[0]

    def column(self, table: str, name: str) -> str:
        columns = self._of(table)[1]
        if name not in columns:
            raise KeyError(f"unknown column {name!r} of {table!r}")
        return columns[name]

    def _of(self, table: str) -> tuple[str, dict[str, str]]:
        if table not in self.tables:
            raise KeyError(f"unknown table {table!r}")
        return self.tables[table]

    def rename(self, table: str, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(self._of(table)[1])

    def query(self, q: Query) -> Query:
        """The query in the server's names, at every level; an unknown name is an error."""

        def value(v: Value, table: str) -> Value:
            return replace(v, name=self.column(table, v.name)) if isinstance(v, ColumnName) else v

        def hop(r: Related, table: str) -> Related:
            below = r.subquery.table
            return Related(tuple(self.column(table, f) for f in r.parent_field), tuple(self.column(below, f) for f in r.child_field), self.query(r.subquery))

        def condition(c: Condition, table: str) -> Condition:
            if isinstance(c, Simple):
                return replace(c, left=value(c.left, table), right=value(c.right, table))
            if isinstance(c, Exists):
                return replace(c, related=hop(c.related, table))
            return replace(c, conditions=tuple(condition(x, table) for x in c.conditions))

        return replace(
            q,
            table=self.table(q.table),
            where=None if q.where is None else condition(q.where, q.table),
            related=tuple(hop(r, q.table) for r in q.related),
            start=None if q.start is None else replace(q.start, row=tuple((self.column(q.table, f), v) for f, v in q.start.row)),
            order_by=tuple((self.column(q.table, f), d) for f, d in q.order_by),
        )

    def inverse(self) -> NameMapper:
        return NameMapper({server: (t, {s: c for c, s in columns.items()}) for t, (server, columns) in self.tables.items()})

    @staticmethod
    def identity(tables: Mapping[str, Iterable[str]]) -> NameMapper:
        return NameMapper({t: (t, {c: c for c in columns}) for t, columns in tables.items()})
