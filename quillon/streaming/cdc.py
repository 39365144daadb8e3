"""Change capture: a table's change feed, its log, and versioned snapshots.

A feed has the table's columns and
``_version`` (commit), ``_pos`` (order inside it), ``_op`` (insert, update, delete, truncate,
backfill) and, for updates that change the key, ``_old_<key>``.  Transactions that were
rolled back are marked by ``_op = 'rollback'`` on any row of their version.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.ordering import TASK_ROWS, dealt
from quillon.sources.catalog import VERSION_COLUMN, row_key

META = ("_version", "_pos", "_op")
#: Frames of a block, and blocks of a stream at most: from some 130 million frames on, blocks grow instead.
BLOCK_FRAMES, MOST_BLOCKS = TASK_ROWS // 8, 4096
TOUCHING = ("insert", "update", "delete", "truncate")
BOUNDS = ("begin", "commit", "rollback")


def feed_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A feed's files as a stream; at most so many at a time, so that a backlog is worked off in steps."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def from_messages(messages: DataFrame, row_schema: str, key: Sequence[str], body: str = "value") -> DataFrame:
    """JSON messages ``{version, pos, tag, new, old}`` as a feed; ``old`` has the former key of an update."""
    old = ", ".join(f"{k}: string" for k in key)
    parsed = messages.select(F.from_json(body, f"version bigint, pos bigint, tag string, new struct<{row_schema}>, old struct<{old}>").alias("m")).select("m.*")
    row = parsed.schema["new"].dataType
    kinds = {f.name: f.dataType for f in row.fields}
    # A delete names its row by the old key alone.
    columns = [(F.coalesce(f"new.{c}", F.col(f"old.{c}").cast(kinds[c])) if c in key else F.col(f"new.{c}")).alias(c) for c in kinds]
    return parsed.select(*columns, F.col("version").alias("_version"), F.col("pos").alias("_pos"), F.col("tag").alias("_op"), *[F.col(f"old.{k}").cast(kinds[k]).alias(f"_old_{k}") for k in key])


def committed(feed: DataFrame) -> DataFrame:
    """Without the transactions that were rolled back."""
    undone = feed.where("_op = 'rollback'").select("_version").distinct()
    return feed.where("_op <> 'rollback'").join(undone, "_version", "left_anti")


def _blocks(frames: DataFrame) -> tuple[Column, int, bool]:
    """(a frame's block, number of frames, whether a stream has several blocks).

    A block is a range of a stream, in its order.  Long streams are cut at quantiles from a
    sketch: where that is decides how much a task gets, not what comes out.
    """
    long = F.col("n") > BLOCK_FRAMES
    sizes = frames.groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(long.alias("long"), F.when(long, F.col("stream")).alias("stream")).agg(F.sum("n").alias("n")).collect()
    blocks = {x["stream"]: min(-(-x["n"] // BLOCK_FRAMES), MOST_BLOCKS) for x in sizes if x["long"]}
    n, bounds = sum(x["n"] for x in sizes), set()
    if not blocks:
        return F.lit(0), n, False
    most, named = max(blocks.values()), F.col("stream").isin([s for s in blocks if s is not None])
    cut = frames.where(named | F.col("stream").isNull() if None in blocks else named)
    for x in cut.groupBy("stream").agg(F.percentile_approx("seq", [i / most for i in range(1, most)], 20 * most).alias("at")).collect():
        k = blocks[x["stream"]]
        bounds |= {(x["stream"], x["at"][i * most // k - 1]) for i in range(1, k)} if x["at"] else set()
    ordered = sorted(bounds, key=lambda b: (b[0] is not None, b))
    held = F.from_json(F.lit(json.dumps([{"stream": s, "seq": q} for s, q in ordered])), f"array<struct<stream: {frames.schema['stream'].dataType.simpleString()}, seq: bigint>>")
    here = F.struct("stream", F.col("seq").cast("bigint").alias("seq"))
    # A binary search for the number of bounds up to the frame.
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(ordered).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= here, at + step).otherwise(at)), n, True


def _relations() -> Column:
    """The relations that a frame defines or touches."""
    return F.when(F.col("tag") == "relation", F.array("id")).otherwise(F.coalesce("relations", F.array("relation")))


def _carried(placed: DataFrame, n: int) -> DataFrame:
    """Frames from outside a block that decide about its own, one of each kind.

    On side -1, before its first frame: the begin of a transaction that is open there, and
    the definitions of the relations in it.  On side 1, after its last: a commit, if that is
    the next bound.  They follow from a row for each block, and for each relation in it.
    """
    tag, seq = F.col("tag"), F.col("seq")
    bound, begin = F.when(tag.isin(*BOUNDS), seq), F.when(tag == "begin", seq)
    ends = placed.groupBy("stream", "__block").agg(
        F.max(bound).alias("last"), F.max(begin).alias("begun"), F.max_by("version", begin).alias("version"), F.min(bound).alias("first"), F.min(F.when(tag == "commit", seq)).alias("done")
    )
    over = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    some = F.col("last").isNotNull()
    before = F.last(F.when(some, F.struct("last", "begun", "version")), True).over(over("stream", order=F.asc("__block")))
    after = F.last(F.when(some, F.struct("first", "done")), True).over(over("stream", order=F.desc("__block")))
    around = ends.select("stream", "__block", before.alias("b"), after.alias("a"))
    begins = around.where("b.begun = b.last").select("stream", "__block", F.lit(-1).alias("__side"), F.col("b.begun").alias("seq"), F.lit("begin").alias("tag"), "b.version")
    commits = around.where("a.done = a.first").select("stream", "__block", F.lit(1).alias("__side"), F.col("a.done").alias("seq"), F.lit("commit").alias("tag"))
    at = ("stream", "__block", "__relation")
    met = placed.where(tag.isin(*TOUCHING)).withColumn("__relation", F.explode(_relations())).select(*at).distinct()
    defs = dealt(placed.where("tag = 'relation' AND table IS NOT NULL").withColumnRenamed("id", "__relation"), n, "stream", "__block").groupBy(*at).agg(F.max_by("table", "seq").alias("table"))
    known = met.unionByName(defs, allowMissingColumns=True).groupBy(*at).agg(F.max("table").alias("table"))
    known = known.withColumn("table", F.last("table", True).over(over("stream", "__relation", order=F.asc("__block")))).where("table IS NOT NULL")
    definitions = known.select("stream", "__block", F.lit(-1).alias("__side"), F.lit("relation").alias("tag"), F.col("__relation").alias("id"), "table")
    return begins.unionByName(commits, allowMissingColumns=True).unionByName(definitions, allowMissingColumns=True)


def from_frames(frames: DataFrame, schemas: Mapping[str, str], keys: Mapping[str, Sequence[str]]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Frames of a replication stream as feeds: (feed by table, schema changes, errors).

    ``frames`` has ``stream``, ``seq`` (order in it) and ``body``, JSON with a ``tag``:
    begin (version), commit, rollback, relation (id, table), insert (relation, new), update
    (relation, new, old), delete (relation, old), truncate (relations), message (prefix,
    content: a schema change under the prefix ``ddl``), and origin and type, which carry no
    rows.  A frame belongs to the last begin before it and to the last definition of its
    relation; only transactions with a commit count.

    Errors are (stream, seq, reason): a begin in a transaction, a row, commit or rollback
    outside of one, an unknown tag, and a relation that was not defined.

    No task sorts a stream: it is cut into blocks, which are put in order each by itself,
    between the few frames of other blocks that decide about them.
    """
    kind = "struct<tag: string, version: bigint, id: bigint, table: string, relation: bigint, relations: array<bigint>, new: string, old: string, prefix: string, content: string>"
    block, n, several = _blocks(frames)
    placed = frames.select("stream", "seq", block.alias("__block"), F.lit(0).alias("__side"), F.from_json("body", kind).alias("m")).select("stream", "seq", "__block", "__side", "m.*")
    if several:
        placed = placed.unionByName(_carried(placed, n), allowMissingColumns=True)
    by = ["stream", "__block"] if several else ["stream"]
    placed = dealt(placed, n, *by)
    before = Window.partitionBy(*by).orderBy("__side", "seq").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.desc("__side"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    tag, own = F.col("tag"), F.col("__side") == 0
    opened = F.when(tag == "begin", F.struct(F.col("seq").alias("at"), F.col("version").alias("version"))).when(tag.isin("commit", "rollback"), F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("version")))
    framed = placed.withColumn("__within", F.last(opened, True).over(before))
    inside = F.coalesce(F.col("__within.at").isNotNull(), F.lit(False))
    rows = (*TOUCHING, "commit", "rollback")
    reason = F.when(tag.isNull() | ~tag.isin(*rows, "begin", "relation", "message", "origin", "type"), "unknown frame").when((tag == "begin") & inside, "begin inside a transaction").when(tag.isin(*rows) & ~inside, "outside a transaction")
    # A transaction counts if its next bound is a commit.
    next_bound = F.last(F.when(tag.isin(*BOUNDS), tag), True).over(after)
    touched = framed.withColumn("__next", next_bound).where((own & tag.isin(*TOUCHING) & inside) | (tag == "relation")).withColumn("__relation", F.explode(_relations()))
    # The definition that was last before the frame.
    upto = Window.partitionBy(*by, "__relation").orderBy("__side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    named = touched.withColumn("__table", F.last(F.when(tag == "relation", F.col("table")), True).over(upto)).where("tag <> 'relation'")
    undefined = named.where("__table IS NULL").select("stream", "seq", F.lit("relation not defined").alias("reason"))
    errors = framed.where(own & reason.isNotNull()).select("stream", "seq", reason.alias("reason")).unionByName(undefined)
    whole = named.where("__next = 'commit'")
    feeds = {}
    for table, schema in schemas.items():
        one = whole.where(F.col("__table") == table).select(F.col("__within.version").alias("_version"), F.col("seq").alias("_pos"), F.col("tag").alias("_op"), F.from_json("new", schema).alias("n"), F.from_json("old", schema).alias("o"))
        columns = [f.name for f in one.schema["n"].dataType.fields]
        data = [(F.coalesce(f"n.{c}", f"o.{c}") if c in keys[table] else F.col(f"n.{c}")).alias(c) for c in columns]
        feeds[table] = one.select(*data, "_version", "_pos", "_op", *[F.col(f"o.{k}").alias(f"_old_{k}") for k in keys[table]])
    changes = framed.where(own & (tag == "message") & (F.col("prefix") == "ddl")).select("stream", "seq", F.col("__within.version").alias("version"), "content")
    return feeds, changes, errors


def split_feed(feed: DataFrame, schemas: Mapping[str, str], keys: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One feed of several tables as a feed for each.

    ``feed`` has ``_table``, ``_row`` and, for updates of a key, ``_old`` (JSON), besides
    ``_version``, ``_pos`` and ``_op``.  Rows of tables that are not asked for are left out.
    """
    out = {}
    for table, schema in schemas.items():
        row, old = F.from_json("_row", schema).alias("n"), F.from_json(F.col("_old") if "_old" in feed.columns else F.lit(None).cast("string"), schema).alias("o")
        one = feed.where(F.col("_table") == table).select("_version", "_pos", "_op", row, old)
        columns = [f.name for f in one.schema["n"].dataType.fields]
        out[table] = one.select(*[F.col(f"n.{c}").alias(c) for c in columns], "_version", "_pos", "_op", *[F.col(f"o.{k}").alias(f"_old_{k}") for k in keys[table]])
    return out


def key_columns(identity: str, declared: Sequence[str], primary_key: Sequence[str], table: str = "") -> tuple[str, ...]:
    """The columns that name a row in a change, by the table's replica identity.

    default, index and nothing use the columns that the stream declares, full the primary key.
    """
    if identity not in ("default", "index", "full", "nothing"):
        raise ValueError(f"unknown replica identity {identity!r}")
    out = tuple(primary_key if identity == "full" else declared)
    if not out:
        raise ValueError(f"{table or 'a table'} without a primary key or unique index cannot be replicated")
    return out


def subscription(spark: SparkSession, folder: str, schema: T.StructType | str, after: int, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the changes that a subscriber at version ``after`` has not seen."""
    return feed_stream(spark, folder, schema, files_per_trigger).where(F.col("_version") > after)


def can_resume(log: DataFrame, after: int) -> bool:
    """Whether a subscriber at ``after`` can catch up from the log, or must copy everything again."""
    first = log.agg(F.min("version")).first()[0]
    return first is None or after >= first - 1


def releases(acks: DataFrame, subscribers: int, padding_ms: int, now: int) -> DataFrame:
    """(message, acked, released): messages that may go on at ``now``.

    ``acks`` has (message, subscriber, at).  All subscribers release at once; more than half
    do when no other has followed for ``padding_ms``, so that a slow one does not hold the
    stream up for good.
    """
    first = acks.where(F.col("at") <= now).groupBy("message", "subscriber").agg(F.min("at").alias("at"))
    found = first.groupBy("message").agg(F.count(F.lit(1)).alias("acked"), F.max("at").alias("__last"))
    settled = (F.col("acked") >= subscribers // 2 + 1) & (F.lit(now) - F.col("__last") >= padding_ms)
    return found.select("message", "acked", ((F.col("acked") >= subscribers) | settled).alias("released"))


def held_back(backlog: DataFrame, high: int = 16 * 1024 * 1024, low_ratio: float = 0.8) -> DataFrame:
    """``backlog`` (stream, at, bytes) with ``held``: whether the stream's producers wait.

    They do from when the backlog reaches ``high`` until it has fallen to ``low_ratio`` of that.
    """
    high = max(high, 1)
    low = int(high * min(max(low_ratio, 0.0), 1.0))
    turned = F.when(F.col("bytes") >= high, True).when(F.col("bytes") <= low, False)
    sofar = Window.partitionBy("stream").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return backlog.withColumn("held", F.coalesce(F.last(turned, True).over(sofar), F.lit(False)))


def upto(feed: DataFrame, after: int | None = None, until: int | None = None) -> DataFrame:
    """Versions above ``after`` and up to ``until``: what a subscriber has not seen."""
    df = feed if after is None else feed.where(F.col("_version") > after)
    return df if until is None else df.where(F.col("_version") <= until)


def key_events(feed: DataFrame, key: Sequence[str]) -> DataFrame:
    """One set or delete for each key a change touches: (version, pos, step, op, key..., row).

    An update that changes the key deletes the old one first.
    """
    columns = [c for c in feed.columns if c not in META and not c.startswith("_old_")]
    row = F.struct(*columns)
    old = [f"_old_{k}" for k in key if f"_old_{k}" in feed.columns]
    keyed = feed.where("_op <> 'truncate'")
    sets = keyed.select("_version", "_pos", F.lit(1).alias("_step"), F.when(F.col("_op") == "delete", "d").otherwise("s").alias("_kind"), *key, row.alias("_row"))
    if len(old) != len(key):
        return sets
    moved = keyed.where("_op = 'update'").where(" OR ".join(f"(_old_{k} IS NOT NULL AND NOT (_old_{k} <=> {k}))" for k in key))
    gone = moved.select("_version", "_pos", F.lit(0).alias("_step"), F.lit("d").alias("_kind"), *[F.coalesce(f"_old_{k}", k).alias(k) for k in key], F.lit(None).cast(sets.schema["_row"].dataType).alias("_row"))
    return sets.unionByName(gone)


def _when() -> Column:
    return F.struct("_version", "_pos", "_step")


def _last_truncate(feed: DataFrame) -> DataFrame:
    return feed.where("_op = 'truncate'").agg(F.max(F.struct("_version", "_pos")).alias("__cut")).where("__cut IS NOT NULL")  # one row or none


def latest_events(feed: DataFrame, key: Sequence[str]) -> DataFrame:
    """The last event of each key, none from before the last truncation."""
    cut = F.broadcast(_last_truncate(feed))
    events = key_events(feed, key).join(cut, F.struct("_version", "_pos") <= F.col("__cut"), "left_anti")
    last = F.max_by(F.struct("_version", "_pos", "_kind", "_row"), _when())
    return events.groupBy(*key).agg(last.alias("e")).select(*key, "e.*")


def _sets(base: DataFrame, last: DataFrame, unique_keys: Sequence[Sequence[str]]) -> DataFrame:
    """The rows that the last events leave, with their version and position."""
    data = [c for c in base.columns if c != VERSION_COLUMN]
    stamp = [F.col("_version").cast(base.schema[VERSION_COLUMN].dataType).alias(VERSION_COLUMN)] if VERSION_COLUMN in base.columns else []
    sets = last.where("_kind = 's'").select(*[F.col(f"_row.{c}").alias(c) for c in data], *stamp, "_version", "_pos")
    for unique in unique_keys:
        # Among new rows the last with a value keeps it.
        w = Window.partitionBy(*unique).orderBy(F.col("_version").desc(), F.col("_pos").desc())
        nulls = " OR ".join(f"{c} IS NULL" for c in unique)
        sets = sets.withColumn("__n", F.row_number().over(w)).where(f"__n = 1 OR {nulls}").drop("__n")
    return sets


def table_delta(base: DataFrame, feed: DataFrame, key: Sequence[str], unique_keys: Sequence[Sequence[str]] = ()) -> tuple[DataFrame, DataFrame]:
    """What a feed without truncations changes: (keys that are replaced, their rows as they are now).

    Keys whose row is gone have no row: deleted ones, and those that another row robbed of a
    unique key's value.
    """
    last = latest_events(feed, key)
    sets = _sets(base, last, unique_keys)
    keys = last.select(*key)
    for unique in unique_keys:
        keys = keys.unionByName(base.join(sets.select(*unique).distinct(), list(unique), "left_semi").select(*key))
    return keys.distinct(), sets.select(*base.columns)


def apply_changes(base: DataFrame, feed: DataFrame, key: Sequence[str], unique_keys: Sequence[Sequence[str]] = ()) -> DataFrame:
    """The table after the feed.  The last write of a key wins; a missing row's update inserts it.

    A row that another, later write robs of a unique key's value is gone.  The version of
    the last change is kept in ``_0_version`` if the table has that column.
    """
    last = latest_events(feed, key)
    sets = _sets(base, last, unique_keys)
    # A truncation leaves nothing of the base: an empty side, which costs no pass over it.
    kept = base.join(F.broadcast(_last_truncate(feed)), F.lit(True), "left_anti").join(last.select(*key), list(key), "left_anti")
    for unique in unique_keys:
        kept = kept.join(sets.select(*unique).distinct(), list(unique), "left_anti")  # old rows give way
    return kept.select(*base.columns).unionByName(sets.select(*base.columns))


def change_log(feed: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """(version, pos, table, row_key, op) with the last op of each key, or t for a truncation."""
    rows = latest_events(feed, key).select("_version", "_pos", F.lit(table).alias("table"), row_key(key).alias("row_key"), F.col("_kind").alias("op"))
    cut = _last_truncate(feed).select("__cut._version", "__cut._pos", F.lit(table).alias("table"), F.lit("").alias("row_key"), F.lit("t").alias("op"))
    return rows.unionByName(cut).withColumnsRenamed({"_version": "version", "_pos": "pos"})


def compact(log: DataFrame, after: int, until: int | None = None) -> DataFrame:
    """The last op of each key in (after, until]."""
    window = log.where(F.col("version") > after)
    window = window if until is None else window.where(F.col("version") <= until)
    last = F.max_by(F.struct("version", "pos", "op"), F.struct("version", "pos"))
    return window.groupBy("table", "row_key").agg(last.alias("e")).select("table", "row_key", "e.*")


def catch_up(log: DataFrame, snapshot: DataFrame, key: Sequence[str], after: int, until: int | None = None) -> DataFrame:
    """(table, row_key, op, row): each changed key's row as it is now, or its deletion."""
    rows = snapshot.select(row_key(key).alias("row_key"), F.to_json(F.struct(*snapshot.columns)).alias("row"))
    joined = compact(log, after, until).join(rows, "row_key", "left")
    return joined.select("table", "row_key", F.when(F.col("row").isNull(), "d").otherwise("s").alias("op"), "row")


def reset_reasons(log: DataFrame, after: int = -1) -> DataFrame:
    """(table, op, reason): tables whose queries must start afresh since ``after``."""
    reason = F.when(F.col("op") == "t", "truncation").otherwise("schema-change")
    return log.where((F.col("version") > after) & F.col("op").isin("t", "r")).select("table", "op", reason.alias("reason")).distinct()


def ddl_log(spark: SparkSession, table: str, version: int, pos: int = 0) -> DataFrame:
    """A schema change's row of the change log; it takes a version of its own."""
    return spark.createDataFrame([(version, pos, table, "", "r")], "version long, pos long, table string, row_key string, op string")


def merge_backfill(live: DataFrame, backfill: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns filled in from a copy that may be older than live writes.

    Both have the key, the columns and, for each, ``_v_<column>``: the version that wrote
    it.  Of every column the later write stays, the live one of equals; keys gone from
    ``live`` stay gone.
    """
    b = backfill.select(*[F.col(k).alias(f"__b_{k}") for k in key], *[F.col(c).alias(f"__b_{c}") for c in columns], *[F.col(f"_v_{c}").alias(f"__bv_{c}") for c in columns])
    j = live.join(b, [live[k] == b[f"__b_{k}"] for k in key], "left")
    newer = {c: F.col(f"__bv_{c}").isNotNull() & (F.col(f"_v_{c}").isNull() | (F.col(f"__bv_{c}") > F.col(f"_v_{c}"))) for c in columns}
    out = []
    for name in live.columns:
        c = name.removeprefix("_v_")
        source = f"__bv_{c}" if name.startswith("_v_") else f"__b_{c}"
        out.append(F.when(newer[c], F.col(source)).otherwise(live[name]).alias(name) if c in newer else live[name])
    return j.select(*out)


def backfill_completed(live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table once a copy is through: from here on live writes alone count, so versions by column go."""
    return live.drop(*[f"_v_{c}" for c in columns])


class ResetNeeded(Exception):
    """Row changes alone do not lead from one snapshot to the other."""


def snapshot_diff(before: DataFrame, after: DataFrame, log: DataFrame, key: Sequence[str], since: int, unique_keys: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(kind, key..., old, new) of the keys changed after ``since``; only their rows are compared.

    Rows that had a unique key's value which a changed row has now count as changed too.  With
    a truncation or a schema change in between, ResetNeeded.
    """
    why = reset_reasons(log, since).first()
    if why:
        raise ResetNeeded(f"{why['reason']} of {why['table']}")
    keys = compact(log, since).select("row_key")
    for unique in unique_keys:
        now = after.withColumn("row_key", row_key(key)).join(keys, "row_key", "left_semi").select(*unique).distinct()
        keys = keys.unionByName(before.join(now, list(unique), "left_semi").select(row_key(key).alias("row_key")))
    keys = keys.distinct()
    pick = lambda df, name: df.withColumn("row_key", row_key(key)).join(keys, "row_key", "left_semi").select("row_key", F.struct(*before.columns).alias(name))
    j = pick(before, "old").join(pick(after, "new"), "row_key", "full_outer").where("NOT (old <=> new)")
    kind = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("edit")
    return j.select(kind.alias("kind"), "row_key", "old", "new")


# --- schema changes -----------------------------------------------------------------------


def apply_ddl(tables: dict[str, DataFrame], change: Mapping) -> dict[str, DataFrame]:
    """The tables after one schema change; each makes queries that read the table start afresh."""
    out, tag = dict(tables), change["tag"]
    if tag == "create-table":
        spark = change["spark"]
        out[change["table"]] = spark.createDataFrame([], change["schema"])
    elif tag == "drop-table":
        del out[change["table"]]
    elif tag == "rename-table":
        out[change["new"]] = out.pop(change["table"])
    elif tag == "add-column":
        out[change["table"]] = out[change["table"]].withColumn(change["column"], F.lit(change.get("default")).cast(change["type"]))
    elif tag == "update-column":
        df = out[change["table"]]
        if change.get("type"):
            df = df.withColumn(change["column"], F.col(change["column"]).cast(change["type"]))
        out[change["table"]] = df.withColumnRenamed(change["column"], change.get("new", change["column"]))
    elif tag == "drop-column":
        out[change["table"]] = out[change["table"]].drop(change["column"])
    elif tag not in ("create-index", "drop-index", "update-table-metadata"):  # these change no rows
        raise ValueError(f"unknown change {tag!r}")
    return out


def schema_drift(have: T.StructType, want: T.StructType) -> list[str]:
    """What differs between a replica's schema and the published one."""
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (have, want))
    return [f"missing {n}" for n in b if n not in a] + [f"extra {n}" for n in a if n not in b] + [f"{n}: {a[n]}, not {b[n]}" for n in a if n in b and a[n] != b[n]]
