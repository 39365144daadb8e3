"""Queries kept up to date from change feeds, by Structured Streaming.

Everything lives in a versioned store (``sources/store.py``): tables, each query's tree and
result, and the patches of every version.  One commit is one version: table deltas, result
deltas, patches and the stream positions they came from are published together or not at
all.  A batch that is replayed finds its position published and does nothing; a process
that starts again goes on from the latest version; of two writers one wins and the other
begins anew on what the first has left.

A result is kept by root row: what each root brings into it.  A commit leads from the
changed rows, through relations and subqueries, to the roots they may affect, and only
these are evaluated again.  Under a limit the roots that were in, and those affected, compete;
only if fewer than the limit are sure to be before what lies outside is the table read,
from the last sure row on.  What is written is what has changed.

A query starts afresh, with the reason told, when a table it reads was truncated or changed
its columns, a scalar subquery's value or the permissions changed, or when advancing would
take longer than computing its result did.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import mutations
from quillon.operators.diff import diff
from quillon.operators.ordering import cursor, first_rows, whole_limit
from quillon.operators.views import constrained
from quillon.plans.ast import Condition, Query, from_json, invalidated, query_hash, read_set, to_dict
from quillon.plans.compiler import Compiler
from quillon.plans.rewrite import permitted, resolve_scalars
from quillon.sources.catalog import Catalog, TableSpec, row_key
from quillon.sources.store import Conflict, Draft, Manifest, Store
from quillon.streaming.cdc import apply_changes, apply_ddl, committed, split_feed, table_delta

#: Fixed by the advance policy: a short advance is always finished, and so is one that is this far.
LEAST_BUDGET_MS, NEARLY_DONE = 50.0, 0.8


def over_budget(spent_ms: float, hydration_ms: float, done: int, of: int) -> bool:
    """Whether what is left of an advance had better be computed afresh.

    Its time is what the results took to compute; half of that if not more than half is done.
    """
    if not of or done / of >= NEARLY_DONE or spent_ms <= LEAST_BUDGET_MS:
        return False
    allowance = hydration_ms / 2 if 2 * done <= of else hydration_ms
    return spent_ms > allowance


@dataclass
class Advance:
    """What a version has changed: patches by query, and why some began afresh."""

    version: int
    patches: dict[str, DataFrame] = field(default_factory=dict)
    resets: dict[str, str] = field(default_factory=dict)


class LiveQueries:
    """State in ``folder``, which driver and executors must share; see the module."""

    def __init__(self, spark: SparkSession, folder: str, specs: Mapping[str, TableSpec], clock: Callable[[], float] = time.monotonic, most_deltas: int = 8):
        self.spark, self.specs, self.clock = spark, dict(specs), clock
        self.store = Store(spark, folder, most_deltas)

    # --- reading ---

    def manifest(self, version: int | None = None) -> Manifest:
        return self.store.manifest(version)

    def catalog(self, m: Manifest | None = None) -> Catalog:
        m = m or self.manifest()
        out = Catalog(self.spark)
        for name, spec in self.specs.items():
            if f"table/{name}" in m.frames:
                out.add(spec, lambda name=name: self.store.read(m, f"table/{name}"))
        return out

    def queries(self, m: Manifest | None = None) -> dict[str, Query]:
        return {n: from_json(q["tree"]) for n, q in (m or self.manifest()).meta.get("queries", {}).items()}

    def result(self, name: str, m: Manifest | None = None) -> DataFrame:
        """(table, row_key, row), a row once."""
        m = m or self.manifest()
        return self.store.read(m, f"result/{name}").select("table", "row_key", "row").dropDuplicates(["table", "row_key"])

    def patches(self, version: int) -> dict[str, DataFrame]:
        """(kind, table, row_key, row) of each query that a version has changed."""
        paths = self.manifest(version).meta.get("paths", {})
        return {n.removeprefix("patch/"): self.spark.read.parquet(f"{self.store.folder}/{p}/rows") for n, p in paths.items()}

    def since(self, after: int, until: int | None = None) -> DataFrame | None:
        """(query, kind, table, row_key, row, patch_version): the last patch of each row for who has seen ``after``."""
        out = None
        for v in self.store.versions():
            if after < v and (until is None or v <= until):
                for name, p in self.patches(v).items():
                    one = p.select(F.lit(name).alias("query"), "kind", "table", "row_key", "row", F.lit(v).alias("patch_version"))
                    out = one if out is None else out.unionByName(one)
        if out is None:
            return None
        return constrained(out.withColumn("op", F.when(F.col("kind") == "remove", "del").otherwise("put")), by=("query", "table", "row_key")).drop("op")

    # --- changing what is there ---

    def load(self, table: str, df: DataFrame) -> None:
        """A table's first copy."""
        draft = self.store.next(self.manifest())
        draft.meta["paths"] = {}
        draft.put(f"table/{table}", df, self.specs[table].primary_key)
        draft.publish()

    def add(self, name: str, q: Query) -> DataFrame:
        """Registers a query, computes it, and returns its rows as adds.  The same query again changes nothing."""
        m = self.manifest()
        known = m.meta.get("queries", {}).get(name)
        if known and known["hash"] == query_hash(q):
            return self.result(name, m).limit(0).select(F.lit("add").alias("kind"), "table", "row_key", "row")
        draft = self.store.next(m)
        draft.meta["paths"] = {}
        self._hydrate(draft, name, q)
        m = draft.publish()
        return self.result(name, m).select(F.lit("add").alias("kind"), "table", "row_key", "row")

    def remove(self, name: str) -> DataFrame:
        """Forgets a query; its rows as removes."""
        m = self.manifest()
        out = self.result(name, m).select(F.lit("remove").alias("kind"), "table", "row_key", "row")
        draft = self.store.next(m)
        draft.meta["paths"] = {}
        del draft.meta["queries"][name]
        draft.drop(f"result/{name}")
        draft.publish()
        return out

    def set_rules(self, rules: Mapping[str, tuple[Condition, ...]] | None, originals: Mapping[str, Query]) -> Advance:
        """New reading rights: every query is restricted anew and starts afresh."""
        return self._restart({n: permitted(q, rules) for n, q in originals.items()}, "permissions-change")

    def alter(self, change: Mapping) -> Advance:
        """One schema change of a table that is loaded; a version of its own.

        Queries that read the table start afresh; without it they lose their rows and are forgotten.
        """
        m = self.manifest()
        tables = {n: self.store.read(m, f"table/{n}") for n in self.specs if f"table/{n}" in m.frames}
        after = apply_ddl(tables, change)
        touched = {n for n in {*tables, *after} if after.get(n) is not tables.get(n)}
        draft = self.store.next(m)
        draft.meta["paths"] = {}
        draft.meta.setdefault("log", []).append({"version": draft.version, "table": change.get("table", ""), "op": "r"})
        for n in touched:
            if n not in after:
                draft.drop(f"table/{n}")
                self.specs.pop(n, None)
            else:
                if n not in self.specs:
                    self.specs[n] = replace(self.specs[change["table"]], name=n) if change["tag"] == "rename-table" else TableSpec(n, tuple(change["key"]))
                draft.put(f"table/{n}", after[n], self.specs[n].primary_key)
        out = Advance(draft.version)
        for name in invalidated(self.queries(m), touched):
            q = self.queries(m)[name]
            if read_set(q) <= {t.removeprefix("table/") for t in draft.frames}:
                self._again(draft, out, name, q, "schema-change", m)
            else:  # a table it reads is gone, and so is the query
                draft.keep(f"patch/{name}", self.result(name, m).select(F.lit("remove").alias("kind"), "table", "row_key", "row"))
                del draft.meta["queries"][name]
                draft.drop(f"result/{name}")
                out.resets[name] = "schema-change"
        draft.meta["resets"] = out.resets
        draft.publish()
        return self._told(out)

    def advance(self, feeds: Mapping[str, DataFrame], position: tuple[str, int] | None = None, expect: int | None = None) -> Advance:
        """Applies one commit's changes as one version; what it changed.

        ``position`` names a stream and its batch: a batch at or before the published position
        of its stream was applied already, and its own patches are given again if it was the
        last.  ``expect`` is the version that the changes were made for: if another has been
        published since, Conflict.
        """
        m = self.manifest()
        if expect is not None and m.version != expect:
            raise Conflict(f"version {m.version}, not {expect}")
        positions = m.meta.get("positions", {})
        if position and positions.get(position[0], {}).get("batch", -1) >= position[1]:
            at = positions[position[0]]
            return Advance(at["version"], self.patches(at["version"]), self.manifest(at["version"]).meta.get("resets", {})) if at["batch"] == position[1] else Advance(at["version"])
        draft = self.store.next(m)
        draft.meta["paths"] = {}
        before, changed, truncated = self.catalog(m), {}, set()
        for table, feed in feeds.items():
            self._apply(draft, m, table, committed(feed), changed, truncated)
        now = self._draft_catalog(draft)
        out = Advance(draft.version)
        affected = invalidated(self.queries(m), set(feeds))
        held = m.meta.get("queries", {})
        began, total = self.clock(), sum(held[n]["ms"] for n in affected)
        slow = False
        for done, name in enumerate(affected):
            q, reads = from_json(held[name]["tree"]), read_set(from_json(held[name]["tree"]))
            slow = slow or over_budget((self.clock() - began) * 1000, total, done, len(affected))
            scalars = held[name].get("scalars")
            if reads & truncated:
                self._again(draft, out, name, q, "truncation", m)
            elif scalars is not None and to_dict(resolve_scalars(q, now)[0]) != scalars:
                self._again(draft, out, name, q, "scalar-subquery", m)
            elif slow:
                self._again(draft, out, name, q, "advancement-timeout", m)
            else:
                self._step(draft, out, name, from_json(scalars) if scalars is not None else q, before, now, changed, m)
        if position:
            draft.meta.setdefault("positions", {})[position[0]] = {"batch": position[1], "version": draft.version}
        draft.meta["resets"] = out.resets
        draft.publish()
        return self._told(out)

    def commit(self, table: str, ops: DataFrame, retries: int = 10) -> tuple[Advance | None, DataFrame]:
        """A batch of row operations, all or none: (what it changed, errors).

        Made for the version that it read; if another commit came first, it is judged again on
        what that has left.  With errors nothing is changed and the first part is None.
        """
        for attempt in range(retries):
            m = self.manifest()
            feed, errors = mutations.crud(self.store.read(m, f"table/{table}"), ops, self.specs[table].primary_key, m.version + 1)
            if not errors.isEmpty():
                return None, errors
            try:
                return self.advance({table: feed}, expect=m.version), errors
            except Conflict:
                if attempt == retries - 1:
                    raise
        raise ValueError("a commit needs one try at least")

    def follow(self, table: str, feed: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts a stream that advances with every micro-batch of one table's feed.

        Streams of several tables may run at once: versions are given out by the store, and a
        batch that meets another's commit is applied on top of it.
        """
        return self._stream(feed, lambda batch: {table: batch}, f"{table}@{checkpoint}", checkpoint, trigger)

    def follow_all(self, feed: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The same for a feed of several tables (see ``cdc.split_feed``): what a batch changes in all of them is one version."""

        def parts(batch: DataFrame) -> dict[str, DataFrame]:
            m, batch = self.manifest(), committed(batch)  # a rollback counts for all tables
            named = {r[0] for r in batch.select("_table").distinct().collect()} & set(self.specs)  # tables, of which there are few
            schemas = {t: m.frames[f"table/{t}"]["schema"] for t in sorted(named) if f"table/{t}" in m.frames}
            return split_feed(batch, schemas, {t: self.specs[t].primary_key for t in schemas})

        return self._stream(feed, parts, checkpoint, checkpoint, trigger)

    def _stream(self, feed: DataFrame, parts: Callable[[DataFrame], dict[str, DataFrame]], name: str, checkpoint: str, trigger: dict) -> StreamingQuery:
        def one(batch: DataFrame, batch_id: int) -> None:
            held = batch.persist()  # read several times
            try:
                if held.isEmpty():
                    return
                for attempt in range(20):
                    try:
                        self.advance(parts(held), position=(name, batch_id))
                        return
                    except Conflict:
                        if attempt == 19:
                            raise
            finally:
                held.unpersist()

        trigger = trigger or {"processingTime": "1 second"}
        return feed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    # --- one version's parts ---

    def _draft_catalog(self, draft: Draft) -> Catalog:
        return self.catalog(Manifest(draft.version, draft.frames, draft.meta))

    def _told(self, out: Advance) -> Advance:
        out.patches = self.patches(out.version)
        return out

    def _apply(self, draft: Draft, m: Manifest, table: str, feed: DataFrame, changed: dict, truncated: set) -> None:
        """A table's delta, and old and new images of the rows it touches."""
        spec, name = self.specs[table], f"table/{table}"
        base = self.store.read(m, name)
        if not feed.where("_op = 'truncate'").isEmpty():
            draft.put(name, apply_changes(base, feed, spec.primary_key, spec.unique_keys), spec.primary_key)
            truncated.add(table)
            return
        keys, rows = table_delta(base, feed, spec.primary_key, spec.unique_keys)
        written = draft.change(name, keys, rows)
        new = draft.read(name).join(written, list(spec.primary_key), "left_semi")
        changed[table] = draft.scratch(base.join(written, list(spec.primary_key), "left_semi").unionByName(new))

    def _hydrate(self, draft: Draft, name: str, q: Query) -> None:
        """A query's whole result, and how long it took."""
        began, catalog = self.clock(), self._draft_catalog(draft)
        resolved, companions = resolve_scalars(q, catalog)
        compiler = Compiler(catalog, cut=draft.scratch)
        draft.put(f"result/{name}", compiler.by_root(resolved, draft.scratch(compiler.rows(resolved))), ("root_key",))
        scalars = to_dict(resolved) if companions or to_dict(resolved) != to_dict(q) else None
        draft.meta.setdefault("queries", {})[name] = {"tree": to_dict(q), "hash": query_hash(q), "ms": (self.clock() - began) * 1000, "scalars": scalars}

    def _again(self, draft: Draft, out: Advance, name: str, q: Query, reason: str, m: Manifest) -> None:
        """A result computed afresh; the difference is its patch."""
        old = self.result(name, m)
        self._hydrate(draft, name, q)
        new = draft.read(f"result/{name}").select("table", "row_key", "row").dropDuplicates(["table", "row_key"])
        draft.keep(f"patch/{name}", diff(old, new))
        out.resets[name] = reason

    def _restart(self, queries: Mapping[str, Query], reason: str) -> Advance:
        m = self.manifest()
        draft = self.store.next(m)
        draft.meta["paths"] = {}
        out = Advance(draft.version)
        for name, q in queries.items():
            self._again(draft, out, name, q, reason, m)
        draft.meta["resets"] = out.resets
        draft.publish()
        return self._told(out)

    def _step(self, draft: Draft, out: Advance, name: str, q: Query, before: Catalog, now: Catalog, changed: Mapping[str, DataFrame], m: Manifest) -> None:
        """A result advanced by the roots that the changes may affect."""
        compiler, key = Compiler(now, cut=draft.scratch), self.specs[q.table].primary_key
        touched = compiler.affected(q, changed)
        if touched is None:
            return
        keys = draft.scratch(touched.select(*key).distinct())
        old = self.store.read(m, f"result/{name}")
        candidates = draft.scratch(compiler.candidates(q, now.table(q.table).join(keys, list(key), "left_semi")))
        left = keys.select(row_key(key).alias("root_key"))
        limit = whole_limit(q.limit)
        if limit is None:
            roots = candidates
        else:
            roots, left = self._first(compiler, q, limit, old, candidates, left, now, draft.scratch)
        parts = draft.scratch(compiler.by_root(q, roots))
        draft.change(f"result/{name}", left, parts)
        new = draft.read(f"result/{name}")
        # Only rows that a replaced root had or has can differ.
        had = old.join(left, "root_key", "left_semi")
        rows = draft.scratch(had.select("table", "row_key").unionByName(parts.select("table", "row_key")).distinct())
        of = lambda df: df.join(rows, ["table", "row_key"], "left_semi").select("table", "row_key", "row").groupBy("table", "row_key").agg(F.max("row").alias("row"))
        draft.keep(f"patch/{name}", diff(of(old), of(new)))

    def _first(self, compiler: Compiler, q: Query, limit: int, old: DataFrame, candidates: DataFrame, touched: DataFrame, now: Catalog, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(roots to evaluate, root keys to replace) of a limited query.

        Roots that were in and are not touched stay in order; touched ones compete with them.
        If as many as the limit stand before the last that was in, or nothing was outside, the
        table need not be read.  Otherwise rows from the last sure one on fill up.
        """
        key, order = self.specs[q.table].primary_key, compiler.order(q)
        table = now.table(q.table)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        in_old = old.where(F.col("table") == q.table).where("row_key = root_key")
        was = cut(in_old.select("root_key", F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("root_key", "r.*"))  # ``limit`` rows at most
        # Rows are read from the table again, as JSON does not hold every type exactly.
        parsed_keys = was.select(*key)
        kept_keys = parsed_keys.join(candidates.select(*key), list(key), "left_anti").withColumn("root_key", row_key(key)).join(touched, "root_key", "left_anti").select(*key)
        stay = table.join(F.broadcast(kept_keys), list(key), "left_semi")
        pool = cut(stay.unionByName(candidates))
        bound = first_rows(was.drop("root_key"), [(f, "desc" if d == "asc" else "asc") for f, d in order], 1).first()
        full = bound is not None and was.count() >= limit
        if full:
            row = bound.asDict()
            inside = pool.where(~cursor(pool, order, {f: row[f] for f, _ in order}, True))
            if inside.limit(limit).count() < limit:
                beyond = compiler.candidates(q)
                beyond = first_rows(beyond.where(cursor(beyond, order, {f: row[f] for f, _ in order}, True)), order, limit)
                pool = inside.unionByName(beyond).dropDuplicates(list(key))
            else:
                pool = inside
        roots = cut(first_rows(pool, order, limit))
        gone = was.select("root_key").join(roots.select(row_key(key).alias("root_key")), "root_key", "left_anti")
        entered = roots.select(row_key(key).alias("root_key")).join(was.select("root_key"), "root_key", "left_anti")
        replaced = cut(touched.unionByName(gone).unionByName(entered).distinct())
        roots = cut(roots.withColumn("__rk", row_key(key)).join(replaced.withColumnRenamed("root_key", "__rk"), "__rk", "left_semi").drop("__rk"))
        return roots, replaced


def serving_lag(patches: DataFrame, sent: str = "sent_ms", committed_at: str = "commit_ms", by: str = "query") -> DataFrame:
    """Least, median, 75th, 99th percentile and greatest delay, by query."""
    from quillon.functions.stats import nearest_rank

    return nearest_rank(patches.withColumn("lag", F.col(sent) - F.col(committed_at)), "lag", by=[by])


def replication_lag(beats: DataFrame, now_ms: int, sent: str = "sent_ms", committed_at: str = "commit_ms", seen: str = "received_ms", by: str = "stream") -> DataFrame:
    """(stream, last_sent, commit_lag, total_lag, waiting): of each stream's heartbeats, the last that came back.

    A beat is sent into the source with its time, committed there and received here.  The one
    sent last that was received gives the lags; one still under way, ``waiting`` ms by now, means
    that the lag is at least that.
    """
    arrived = F.col(seen).isNotNull()
    last = F.max(F.when(arrived, F.struct(F.col(sent), F.col(committed_at), F.col(seen)))).alias("b")
    open_ = F.min(F.when(~arrived, F.col(sent))).alias("open")
    return beats.groupBy(by).agg(last, open_).select(
        by, F.col(f"b.{sent}").alias("last_sent"), (F.col(f"b.{committed_at}") - F.col(f"b.{sent}")).alias("commit_lag"),
        (F.col(f"b.{seen}") - F.col(f"b.{sent}")).alias("total_lag"), (F.lit(now_ms) - F.col("open")).alias("waiting"),
    )


def stream_progress(query: StreamingQuery) -> dict:
    """Rows, batches and time of a running stream's last step, and how far its source is ahead."""
    p = query.lastProgress
    if not p:
        return {"batch": -1, "rows": 0, "ms": 0}
    return {"batch": p["batchId"], "rows": p["numInputRows"], "ms": p.get("batchDuration", 0)}
