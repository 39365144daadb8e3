"""View records: what each client group holds, by whom it is wanted, and what to send.

``rows`` has (table, row_key, row_version, patch_version, refs), refs being a map from query
to count, or NULL for a row that was sent once and is gone.  Versions are compared as they
are: structs (state, config) field by field.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.store import Conflict, Store

#: Fixed by the protocol, in milliseconds.
DEFAULT_TTL, MAX_TTL = 300_000, 600_000
UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "y": 31_536_000_000}


# --- ttl --------------------------------------------------------------------------------


def parse_ttl(ttl: str | float) -> float:
    """Milliseconds; -1 is forever."""
    if isinstance(ttl, (int, float)):
        if ttl != ttl:
            return 0
        return -1 if ttl < 0 or ttl == float("inf") else ttl
    if ttl in ("none", "forever"):
        return 0 if ttl == "none" else -1
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhdy])", ttl)
    if not m:
        raise ValueError(f"bad ttl {ttl!r}")
    return float(m[1]) * UNITS[m[2]]


def clamp_ttl(ttl: str | float) -> float:
    ms = parse_ttl(ttl)
    return MAX_TTL if ms < 0 or ms > MAX_TTL else ms


def compare_ttl(a: str | float, b: str | float) -> int:
    x, y = ((float("inf") if t < 0 else t) for t in (parse_ttl(a), parse_ttl(b)))
    return (x > y) - (x < y)


def normalise_ttl(ttl: str | float) -> str | float:
    """The shortest way to write a time in milliseconds; texts stay as they are."""
    if isinstance(ttl, str):
        return ttl
    if ttl <= 0:
        return "forever" if ttl < 0 else "none"
    plain = _number(ttl)
    shortest = min((f"{_number(ttl / ms)}{unit}" for unit, ms in reversed(UNITS.items())), key=len)
    return shortest if len(shortest) < len(plain) else ttl


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(float(x))


def clamped(ttl: Column) -> Column:
    return F.when((ttl < 0) | (ttl > MAX_TTL), MAX_TTL).otherwise(ttl)


# --- desires ----------------------------------------------------------------------------


def put_desires(desires: DataFrame, wanted: DataFrame, version: Column, internal: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Clients ask for queries: (desires after, patches).

    ``desires`` has (client, query, ttl, inactivated_at, version), ``wanted`` (client, query,
    ttl), a NULL time being the default.  A pair changes, and is told as a put, if it is new,
    was inactive, or is asked for longer than before; all others stay as they are.  Internal
    queries cannot be asked for.
    """
    if internal and not wanted.where(F.col("query").isin(*internal)).isEmpty():
        raise ValueError(f"{sorted(internal)} are reserved")
    asked = F.coalesce(F.col("ttl").cast("double"), F.lit(float(DEFAULT_TTL)))
    longest = F.when(asked < 0, float("inf")).otherwise(asked)
    new = wanted.groupBy("client", "query").agg(F.max(longest).alias("__new"), F.lit(True).alias("__wanted"))
    old = desires.withColumn("__had", F.lit(True))
    j = old.join(new, ["client", "query"], "full_outer")
    had = F.when(F.col("ttl") < 0, float("inf")).otherwise(F.col("ttl").cast("double"))
    needed = F.coalesce(F.col("__wanted"), F.lit(False)) & (F.col("__had").isNull() | F.col("inactivated_at").isNotNull() | (F.col("__new") > had))
    j = j.withColumn("__needed", needed)
    kind = {f.name: f.dataType for f in desires.schema.fields}
    after = j.select(
        "client", "query", F.when(F.col("__needed"), F.least("__new", F.lit(float(MAX_TTL)))).otherwise(F.col("ttl").cast("double")).cast(kind["ttl"]).alias("ttl"),
        F.when(~F.col("__needed"), F.col("inactivated_at")).alias("inactivated_at"), F.when(F.col("__needed"), version).otherwise(F.col("version")).alias("version"),
    )
    return after, j.where("__needed").select(F.lit("put").alias("op"), "client", "query", version.alias("version"))


def delete_desires(desires: DataFrame, unwanted: DataFrame, version: Column, now: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clients let queries go: (desires after, patches).

    With ``now`` a pair becomes inactive and its time begins to run; without, it is
    forgotten.  Pairs that are not there, or inactive already, change nothing.
    """
    hit = unwanted.select("client", "query").distinct().withColumn("__hit", F.lit(True))
    j = desires.join(hit, ["client", "query"], "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)) & F.col("inactivated_at").isNull())
    patches = j.where("__hit").select(F.lit("del").alias("op"), "client", "query", version.alias("version"))
    if now is None:
        return j.where("NOT __hit").select(*desires.columns), patches
    kind = desires.schema["inactivated_at"].dataType
    changed = {"inactivated_at": F.lit(now).cast(kind), "ttl": clamped(F.col("ttl")).cast(desires.schema["ttl"].dataType), "version": version}
    return j.select(*[(F.when(F.col("__hit"), changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in desires.columns]), patches


def clear_desires(desires: DataFrame, client: str, version: Column) -> tuple[DataFrame, DataFrame]:
    """A client lets all of its queries go and they are forgotten."""
    return delete_desires(desires, desires.where(F.col("client") == client), version)


def query_references(desires: DataFrame) -> DataFrame:
    """(query, clients): how many clients want each query; one without any is to be removed."""
    return desires.where("inactivated_at IS NULL").groupBy("query").agg(F.count_distinct("client").alias("clients"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query, action): hydrate what has its first client now, remove what has lost its last."""
    b, a = query_references(before).select("query", F.lit(1).alias("was")), query_references(after).select("query", F.lit(1).alias("is"))
    both = b.join(a, "query", "full_outer").where("was IS NULL OR `is` IS NULL")
    return both.select("query", F.when(F.col("was").isNull(), "hydrate").otherwise("remove").alias("action"))


def inactive_queries(desires: DataFrame) -> DataFrame:
    """(query, inactivated_at, ttl, expires) of queries that no client keeps active.

    Of the clients the one whose time ends last decides; the soonest end comes first when sorted.
    """
    ttl = clamped(F.col("ttl"))
    state = F.struct((F.col("inactivated_at") + ttl).alias("expires"), F.col("inactivated_at"), ttl.alias("ttl"))
    found = desires.groupBy("query").agg(F.bool_and(F.col("inactivated_at").isNotNull()).alias("idle"), F.max(state).alias("s")).where("idle")
    return found.select("query", "s.inactivated_at", "s.ttl", "s.expires")


def next_eviction(desires: DataFrame) -> DataFrame:
    return inactive_queries(desires).agg(F.min("expires").alias("expires"))


# --- reference counts --------------------------------------------------------------------


def merge_refs(counts: DataFrame, keys: Sequence[str] = ("table", "row_key")) -> DataFrame:
    """Counts by row and query summed; (keys, refs) with what is not 0, NULL if nothing above 0 is left."""
    summed = counts.groupBy(*keys, "query").agg(F.sum("n").alias("n"))
    some = F.filter(F.collect_list(F.struct("query", "n")), lambda x: x["n"] != 0)
    grouped = summed.groupBy(*keys).agg(F.array_sort(some).alias("e"))
    return grouped.select(*keys, F.when(F.exists("e", lambda x: x["n"] > 0), F.map_from_entries("e")).alias("refs"))


def combined(a: Column, b: Column, removed: Sequence[str] = ()) -> Column:
    """Map ``a`` without the removed queries plus map ``b``; NULL if no count above 0 is left."""
    empty = F.expr("map()").cast("map<string,bigint>")
    gone = [F.lit(q) for q in removed]
    left = F.map_filter(F.coalesce(a, empty), lambda k, v: ~k.isin(*removed)) if gone else F.coalesce(a, empty)
    both = F.map_filter(F.map_zip_with(left, F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), lambda k, v: v != 0)
    return F.when(F.exists(F.map_values(both), lambda v: v > 0), both)


def receive(rows: DataFrame, updates: DataFrame, version: Column, executed: Sequence[str] = ()) -> DataFrame:
    """The records after queries have run, with what to send for each row.

    ``updates`` has (table, row_key, row_version, refs, row); ``executed`` names the queries
    that ran or were removed, whose old references no longer count.  Returns the record's
    columns and ``op``: put, del or NULL; an unchanged row keeps its patch version.
    """
    old = rows.select("table", "row_key", F.col("row_version").alias("ov"), F.col("patch_version").alias("op_v"), F.col("refs").alias("orefs"), F.lit(True).alias("had"))
    new = updates.select("table", "row_key", F.col("row_version").alias("nv"), F.col("refs").alias("nrefs"), "row", F.lit(True).alias("got"))
    j = old.join(new, ["table", "row_key"], "full_outer").withColumn("refs", combined(F.col("orefs"), F.col("nrefs"), executed))
    same = F.col("had").isNotNull() & F.col("ov").eqNullSafe(F.col("nv"))
    touched = F.col("got").isNotNull()
    gone = F.col("refs").isNull()
    patch = F.when(touched & ~gone & same, F.col("op_v")).when(~touched & ~gone, F.col("op_v")).when(~touched & F.col("orefs").isNull(), F.col("op_v")).otherwise(version)
    op = F.when(touched & ~gone & (F.col("orefs").isNull() | ~same), "put").when(gone & F.col("orefs").isNotNull(), "del")
    return j.select("table", "row_key", F.coalesce("nv", "ov").alias("row_version"), patch.alias("patch_version"), "refs", op.alias("op"), "row")


def patches_since(rows: DataFrame, base: Column) -> DataFrame:
    """(op, table, row_key, patch_version) that bring a client at ``base`` up to date."""
    return rows.where(F.col("patch_version") > base).select(F.when(F.col("refs").isNull(), "del").otherwise("put").alias("op"), "table", "row_key", "patch_version")


def constrained(patches: DataFrame, merge: bool = False, by: Sequence[str] = ("table", "row_key")) -> DataFrame:
    """The last patch of each row, by version; with ``merge`` a put of a known row is an update.

    A ``clear`` (a patch without a row) makes all patches up to its version void and stays
    itself; a row's own clear comes with a NULL key.
    """
    clear = patches.where("op = 'clear'").agg(F.max("patch_version").alias("__cleared"))  # one row
    left = patches.join(F.broadcast(clear), F.lit(True)).where(F.col("__cleared").isNull() | (F.col("patch_version") > F.col("__cleared")) | ((F.col("op") == "clear") & (F.col("patch_version") == F.col("__cleared")))).drop("__cleared")
    w = Window.partitionBy(*by).orderBy(F.col("patch_version").desc())
    last = left.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return last.withColumn("op", F.when(F.col("op") == "put", "update").otherwise(F.col("op"))) if merge else last


def for_client(patches: DataFrame, desires: DataFrame, client: str) -> DataFrame:
    """Patches of the queries that one client wants; ``patches`` say by ``query`` whose they are."""
    wanted = desires.where((F.col("client") == client) & F.col("inactivated_at").isNull()).select("query").distinct()
    return patches.join(wanted, "query", "left_semi")


def drain(log: DataFrame, cursors: DataFrame, desires: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each client of a group has not read: (changes by client, cursors after).

    ``log`` has ``seq`` and ``query`` besides the changes, a commit's under one seq;
    ``cursors`` has (client, seq): all below it was read.  A client without a cursor starts at
    the log's end.  Of its unread changes it gets those of queries that it wants.
    """
    head = log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).cast("long").alias("__head"))  # one row
    active = desires.where("inactivated_at IS NULL").select("client", "query").distinct()
    unread = log.join(active, "query").join(cursors.withColumnRenamed("seq", "__from"), "client").where(F.col("seq") >= F.col("__from")).drop("__from")
    clients = cursors.select("client").unionByName(desires.select("client")).distinct()
    return unread, clients.join(F.broadcast(head), F.lit(True)).select("client", F.col("__head").alias("seq"))


def trimmed(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The log without what every cursor has passed; empty if there is no cursor."""
    least = cursors.agg(F.min("seq").alias("__least"))  # one row
    return log.join(F.broadcast(least), F.col("seq") >= F.col("__least"), "left_semi")


def pokes(patches: DataFrame, base: str | None, target: str, rows_a_part: int = 1000, force: bool = False) -> DataFrame:
    """(poke_id, part, body) JSON frames that bring a client from ``base`` to ``target``.

    A start with part 0, the patches in parts of bounded size, and an end with the new
    cookie as the last part (NULL sorts after all).  No frames without patches, unless forced.
    """
    spark, row = patches.sparkSession, ["op", "table", "row_key", "row"]
    some = patches.select(*[c for c in row if c in patches.columns])
    ends = spark.createDataFrame(
        [(target, 0, f'{{"pokeStart":{{"pokeID":"{target}","baseCookie":{"null" if base is None else chr(34) + base + chr(34)}}}}}'), (target, None, f'{{"pokeEnd":{{"pokeID":"{target}","cookie":"{target}"}}}}')],
        "poke_id string, part long, body string",
    )
    if not force:
        ends = ends.join(F.broadcast(some.limit(1).select(F.lit(1).alias("__any"))), F.lit(True), "left_semi")
    # Numbered by hash, so that no task sees all patches; a part holds about so many.
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / rows_a_part), F.lit(1))
    n = some.agg(parts.cast("long").alias("__parts"))  # one row
    placed = some.join(F.broadcast(n), F.lit(True)).withColumn("part", F.pmod(F.xxhash64("table", "row_key"), "__parts") + 1)
    body = F.to_json(F.struct(F.struct(F.lit(target).alias("pokeID"), F.array_sort(F.collect_list(F.struct(*some.columns))).alias("rowsPatch")).alias("pokePart")))
    return ends.unionByName(placed.groupBy("part").agg(body.alias("body")).select(F.lit(target).alias("poke_id"), "part", "body"))


def purge(instances: DataFrame, children: dict[str, DataFrame], now: int, idle_ms: int, most: int, tombstone_ms: int) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """One round of collecting idle groups: (instances after, their rows after, what is left to do).

    ``instances`` has (group, last_active, deleted).  The ``most`` that are idle longest lose
    their rows in all ``children`` and become tombstones; tombstones older than
    ``tombstone_ms`` go.  ``children`` have the column ``group``.
    """
    idle = instances.where(~F.col("deleted") & (F.col("last_active") < now - idle_ms))
    victims = idle.orderBy("last_active", "group").limit(most).select("group")
    kept = {name: df.join(victims, "group", "left_anti") for name, df in children.items()}
    marked = instances.join(victims.withColumn("__gone", F.lit(True)), "group", "left")
    after = marked.withColumn("deleted", F.col("deleted") | F.coalesce("__gone", F.lit(False))).drop("__gone")
    after = after.where(~(F.col("deleted") & (F.col("last_active") < now - tombstone_ms)))
    left = idle.join(victims, "group", "left_anti").agg(F.count(F.lit(1)).alias("purgeable"))
    return after.select(*instances.columns), kept, left


#: The longest pause between two rounds, in milliseconds (fixed by the schedule).
MAX_PURGE_PAUSE = 960_000


def next_purge(batch: int, pause_ms: int, left_before: int | None, left: int, first_batch: int, first_pause_ms: int) -> tuple[int, int]:
    """(groups of the next round, pause before it).

    A backlog that has grown all the same makes rounds larger by ``first_batch``; while any is
    left the pause is the first one, and it doubles each time nothing is.
    """
    grown = left_before is not None and left > left_before
    return batch + first_batch * grown, first_pause_ms if left else min(2 * pause_ms, MAX_PURGE_PAUSE)


# --- versions ----------------------------------------------------------------------------


def encode_version(n: int) -> str:
    """Base 36 after its length less one, so that texts sort as the numbers do."""
    if n < 0:
        raise ValueError("a version is not negative")
    digits, rest = "", n
    while rest or not digits:
        rest, d = divmod(rest, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    if len(digits) > 36:
        raise ValueError("a version has 36 digits at most")
    return "0123456789abcdefghijklmnopqrstuvwxyz"[len(digits) - 1] + digits


def decode_version(text: str) -> int:
    if len(text) < 2 or int(text[0], 36) != len(text) - 2:
        raise ValueError(f"bad version {text!r}")
    return int(text[1:], 36)


def encode_cookie(state: str, config: int = 0) -> str:
    return f"{state}:{encode_version(config)}" if config else state


def decode_cookie(text: str | None) -> tuple[str, int]:
    if text is None:
        return ("00", 0)
    state, _, config = text.partition(":")
    decode_version(state)
    return state, decode_version(config) if config else 0


Version = tuple[str, int]


def one_after(version: Version | None) -> Version:
    """The next version of the configuration; the first of all has none yet."""
    return ("00", 0) if version is None else (version[0], version[1] + 1)


def compare_versions(a: Version | None, b: Version | None) -> int:
    """-1, 0 or 1; no version is before all."""
    x, y = a or ("", -1), b or ("", -1)
    return (x > y) - (x < y)


def later_version(a: Version, b: Version | None) -> Version:
    return b if b is not None and compare_versions(b, a) > 0 else a


# --- the records as stored ----------------------------------------------------------------

#: The frames of a group's record and their keys.
RECORD = {
    "instances": ("group",),
    "clients": ("group", "client"),
    "queries": ("group", "query"),
    "desires": ("group", "client", "query"),
    "rows": ("group", "table", "row_key"),
}


class Records:
    """View records in a versioned store: one flush is one version, whole or not at all."""

    def __init__(self, store: Store):
        self.store = store

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        m = self.store.manifest(version)
        return self.store.read(m, name) if name in m.frames else None

    def version(self) -> int:
        return self.store.manifest().version

    def flush(self, changes: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None, expect: int | None = None) -> int:
        """Upserts ``changes`` and removes the keys in ``removed``, by frame; the new version.

        ``expect`` is the version that the changes were made for; Conflict if another owner
        has flushed since.
        """
        m, removed = self.store.manifest(), removed or {}
        if expect is not None and m.version != expect:
            raise Conflict(f"version {m.version}, not {expect}")
        draft = self.store.next(m)
        for name in {*changes, *removed}:
            key, rows, gone = list(RECORD[name]), changes.get(name), removed.get(name)
            if name not in m.frames:
                if rows is not None:
                    draft.put(name, rows, key)
                continue
            keys = [df.select(*key) for df in (rows, gone) if df is not None]
            keys = keys[0] if len(keys) == 1 else keys[0].unionByName(keys[1])
            draft.change(name, keys, rows if rows is not None else self.store.read(m, name).limit(0))
        return draft.publish().version
