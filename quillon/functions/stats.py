"""Statistics: histograms, percentiles, sketches, fan-out, copies, and what a query has read."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.plans.ast import Query
from quillon.plans.compiler import Compiler
from quillon.sources.catalog import Catalog


def log_bucket(c: Column) -> Column:
    """0 for values below 1, and k for values from 2 ** (k - 1) to below 2 ** k."""
    return F.when(c < 1, 0).otherwise(F.floor(F.log2(c)).cast("int") + 1)


def log_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(log_bucket(F.col(column).cast("double")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def nearest_rank(df: DataFrame, column: str, shares: Sequence[float] = (0.5, 0.75, 0.99), by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Least, greatest and percentiles that are values of the data, exactly.

    A sketch, whose ranks are at most ``n / accuracy`` off, gives two values about each
    percentile between which it must lie.  What is below is counted, and only the values
    between them, some thousandths of a group, are sorted.  NULLs do not count.
    """
    df = df.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("__v"))
    around = [min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in shares for side in (-1, 1)]
    cuts = df.groupBy(*by).agg(F.percentile_approx("__v", around, accuracy).alias("__q"), F.count(F.lit(1)).alias("n"), F.min("__v").alias("min"), F.max("__v").alias("max"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        """By group, NULL being one; a side of one row for each group."""
        b = b.withColumnsRenamed({c: f"__by_{c}" for c in by})
        on = [a[c].eqNullSafe(b[f"__by_{c}"]) for c in by]
        return a.join(b, on or F.lit(True)).drop(*[f"__by_{c}" for c in by])

    rows, each = joined(df, cuts.select(*by, "__q")), range(len(shares))
    low, high = (lambda i: F.col("__q")[2 * i]), (lambda i: F.col("__q")[2 * i + 1])
    below = rows.groupBy(*by).agg(F.array(*[F.count(F.when(F.col("__v") < low(i), 1)) for i in each]).alias("__below"))
    between = F.array_compact(F.array(*[F.when((F.col("__v") >= low(i)) & (F.col("__v") <= high(i)), F.lit(i)) for i in each]))
    near = rows.select(*by, "__v", F.explode(between).alias("__i")).groupBy(*by, "__i", "__v").agg(F.count(F.lit(1)).alias("__held"))
    upto = Window.partitionBy(*by, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)).cast("long") for p in shares])
    totals = joined(cuts.select(*by, "n", "min", "max", wanted.alias("__rank")), below)
    placed = joined(near.withColumn("__upto", F.sum("__held").over(upto)), totals)
    end, rank = F.col("__below")[F.col("__i")] + F.col("__upto"), F.col("__rank")[F.col("__i")]
    hit = placed.where((rank <= end) & (rank > end - F.col("__held")))
    names = [f"p{round(p * 100)}" for p in shares]
    found = hit.groupBy(*by).agg(*[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(names[i]) for i in each], *[F.first(c).alias(c) for c in ("min", "max", "n")])
    return found.select(*by, "min", *names, "max", "n")


class Digest:
    """A mergeable sketch of a distribution: centroids that are fine at the ends and coarse in the middle.

    A centroid covers so much of the ranks that the scale function asin(2q - 1) grows by no
    more than a step; ``compression`` bounds how many there are.
    """

    def __init__(self, compression: int = 1000, means: Sequence[float] = (), weights: Sequence[float] = (), least: float = math.inf, most: float = -math.inf):
        self.compression, self.least, self.most = compression, least, most
        self.means, self.weights = np.asarray(means, np.float64), np.asarray(weights, np.float64)

    def add(self, values: Sequence[float], weights: Sequence[float] | None = None) -> Digest:
        x = np.asarray(values, np.float64)
        w = np.ones(len(x)) if weights is None else np.asarray(weights, np.float64)
        keep = ~np.isnan(x) & (w > 0)
        x, w = x[keep], w[keep]
        if len(x):
            self.least, self.most = min(self.least, x.min()), max(self.most, x.max())
            self._squeeze(np.r_[self.means, x], np.r_[self.weights, w])
        return self

    def merge(self, other: Digest) -> Digest:
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        self._squeeze(np.r_[self.means, other.means], np.r_[self.weights, other.weights])
        return self

    def _squeeze(self, means: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(means, kind="stable")
        means, weights = means[order], weights[order]
        if len(means) > self.compression:
            # Values whose ranks' middle falls into one step of the scale become one centroid.
            middle = (np.cumsum(weights) - weights / 2) / weights.sum()
            step = np.floor((np.arcsin(2 * middle - 1) / np.pi + 0.5) * self.compression)
            first = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
            total = np.add.reduceat(weights, first)
            means, weights = np.add.reduceat(means * weights, first) / total, total
        self.means, self.weights = means, weights

    def count(self) -> float:
        return float(self.weights.sum())

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and the ranks at which they are taken to lie."""
        at = np.cumsum(self.weights) - self.weights / 2
        return np.r_[self.least, self.means, self.most], np.r_[0.0, at, self.weights.sum()]

    def quantile(self, q: float) -> float:
        """NaN of nothing; between centroids the value grows evenly."""
        if not len(self.means) or math.isnan(q):
            return math.nan
        values, at = self._ends()
        return float(np.interp(min(max(q, 0.0), 1.0) * self.weights.sum(), at, values))

    def cdf(self, x: float) -> float:
        """The share of values up to ``x``."""
        if not len(self.means):
            return math.nan
        if x < self.least or x >= self.most:
            return float(x >= self.most)
        values, at = self._ends()
        return float(np.interp(x, values, at) / self.weights.sum())

    def to_json(self) -> str:
        """A flat list: compression, then the means and weights of the centroids in turn, the least and the greatest value."""
        pairs = np.c_[self.means, self.weights].ravel().tolist()
        return json.dumps([self.compression, *pairs, *([self.least, self.most] if len(self.means) else [])])

    @staticmethod
    def from_json(text: str) -> Digest:
        compression, *rest = json.loads(text)
        if not rest:
            return Digest(compression)
        return Digest(compression, rest[:-2:2], rest[1:-2:2], rest[-2], rest[-1])


def digest(df: DataFrame, column: str, compression: int = 1000, groups: int = 200) -> Digest:
    """One digest of a column: each task's are merged in ``groups`` tasks, whose own come to the driver."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Digest(compression)
        for batch in batches:
            d.add(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([d.to_json()])], names=["d"])

    def merge(table: pa.Table) -> pa.Table:
        d = Digest(compression)
        for text in table["d"].to_pylist():
            d.merge(Digest.from_json(text))
        return pa.table({"d": [d.to_json()]})

    parts = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double")).mapInArrow(one, "d string")
    merged = parts.withColumn("g", F.pmod(F.xxhash64("d"), F.lit(groups))).groupBy("g").applyInArrow(merge, "d string")
    out = Digest(compression)
    for r in sorted(r["d"] for r in merged.collect()):
        out.merge(Digest.from_json(r))
    return out


def quantiles(df: DataFrame, column: str, shares: Sequence[float], compression: int = 1000) -> DataFrame:
    """Percentiles from a mergeable sketch, within 1 / compression of their rank."""
    return df.agg(F.percentile_approx(column, list(shares), compression).alias("quantiles"))


def cdf(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """The share of values at or below each point, in one pass."""
    shares = [F.avg((F.col(column) <= x).cast("double")) for x in points]
    row = F.array(*[F.struct(F.lit(float(x)).alias("x"), s.alias("share")) for x, s in zip(points, shares, strict=True)])
    return df.where(F.col(column).isNotNull()).agg(row.alias("points")).select(F.inline("points"))


def column_fanout(df: DataFrame, columns: Sequence[str], default: float = 3.0) -> DataFrame:
    """(fanout, keys): median rows of a value other than NULL; the default for a table without any."""
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    counts = known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("double"), F.lit(default)).alias("fanout"), F.count(F.lit(1)).alias("keys"))


def copy_totals(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every table copied."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def copied(df: DataFrame, table: str, write: Callable[[DataFrame], None], clock: Callable[[], float] = time.monotonic) -> dict:
    """Copies a table and says how: its name, rows, bytes of its source files and milliseconds."""
    seen, began = Observation(f"copy of {table}"), clock()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    spent, jvm = (clock() - began) * 1000, df.sparkSession._jvm
    size, conf = 0, df.sparkSession._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return {"table": table, "rows": seen.get["rows"], "bytes": size, "ms": spent}


def copy_report(copies: Sequence[dict]) -> dict:
    """All copies together; their time is that of the longest, as they run at once."""
    out = {k: sum(c[k] for c in copies) for k in ("rows", "bytes")}
    return {"tables": len(copies), **out, "ms": max((c["ms"] for c in copies), default=0)}


def analyze(q: Query, catalog: Catalog) -> dict:
    """The inspector's answer: rows read of each table by each level, rows of the result by table, and the plan.

    Read are the rows that a level's own conditions and cursor let through, counted while
    the query runs; those above them are what the files' statistics could not skip.
    """
    seen: list[tuple[str, Observation]] = []

    def watch(table: str, df: DataFrame) -> DataFrame:
        seen.append((table, Observation(f"{table} {len(seen)}")))
        return df.observe(seen[-1][1], F.count(F.lit(1)).alias("rows"))

    result = Compiler(catalog, watch).result_set(q)
    began = time.monotonic()
    synced = {r["table"]: r["count"] for r in result.groupBy("table").count().collect()}
    read: dict[str, int] = {}
    for table, o in seen:
        read[table] = read.get(table, 0) + o.get.get("rows", 0)
    plan = Compiler(catalog).result_set(q)._jdf.queryExecution().simpleString()
    return {"read": read, "synced": synced, "ms": (time.monotonic() - began) * 1000, "plan": plan}
