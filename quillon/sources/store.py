"""Frames kept by version: a base and the deltas since, published by one file a version.

A version is a small JSON manifest that names the segments of every frame.  It is written
to a file of its own and renamed into place, which succeeds for one writer only; what a
writer that failed or lost has left is named by no manifest and so never read.  Readers
take the latest manifest, or an older one.  Nothing is kept in the driver's memory, so a
restart goes on where the last published version ended.

A delta names the keys it replaces and holds their rows as they are now (none for a key
that is gone; several where a key stands for a group of rows).  Writing costs what has
changed.  After ``most_deltas`` deltas they are merged into one; only when that has grown to
a quarter of the base is the frame written whole again, so every row is rewritten a bounded
number of times however large the base is.
"""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


_ONE_AT_A_TIME = threading.Lock()


class Conflict(Exception):
    """Another writer has published the version first."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session gets one of its own, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
    return f"{folder}/quillon-{uuid.uuid4().hex}"


class Files:
    """Whole small files in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a new file, whole or not at all; Conflict if it is there."""
        self.fs.mkdirs(self._path(name).getParent())
        draft = self._path(f"{name}.{uuid.uuid4().hex}.draft")
        sink = self.fs.create(draft)
        sink.write(bytearray(text.encode()))
        sink.close()
        with _ONE_AT_A_TIME:  # a local disk's rename replaces; shared file systems refuse
            taken = self.fs.exists(self._path(name)) or not self.fs.rename(draft, self._path(name))
        if taken:
            self.fs.delete(draft, False)
            raise Conflict(name)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder)))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()


@dataclass
class Manifest:
    """What one version consists of."""

    version: int
    #: Of each frame: key columns, schema and paths; the first path is the base, others are deltas.
    frames: dict[str, dict]
    #: Anything else that belongs to the version: JSON values by name.
    meta: dict


class Store:
    """See the module.  One writer at a time succeeds for a version; any number may read."""

    def __init__(self, spark: SparkSession, folder: str, most_deltas: int = 8):
        self.spark, self.folder, self.most_deltas = spark, folder, most_deltas
        self.files = Files(spark, folder)

    def versions(self) -> list[int]:
        return [int(n[2:-5]) for n in self.files.names("versions") if n.startswith("v=") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest, or the given, version; version -1 is the empty store."""
        if version is None:
            version = max(self.versions(), default=-1)
        if version < 0:
            return Manifest(-1, {}, {})
        held = json.loads(self.files.read(f"versions/v={version:012d}.json"))
        return Manifest(version, held["frames"], held["meta"])

    def read(self, m: Manifest, name: str) -> DataFrame:
        return self._chain(m.frames[name], m.frames[name]["paths"])

    def _chain(self, frame: dict, paths: Sequence[str]) -> DataFrame:
        """The rows of segments, each giving way to the keys of later ones."""
        rows = lambda path: self.spark.read.schema(frame["schema"]).parquet(f"{self.folder}/{path}/rows")
        out = rows(paths[0])
        for path in paths[1:]:
            out = out.join(self._keys(path), frame["key"], "left_anti").unionByName(rows(path))
        return out

    def _keys(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{path}/keys")

    def rows_of(self, m: Manifest, name: str, keys: DataFrame) -> DataFrame:
        """The rows with some keys; the filter goes to each segment."""
        return self.read(m, name).join(keys, m.frames[name]["key"], "left_semi")

    def next(self, m: Manifest) -> Draft:
        return Draft(self, m)

    def vacuum(self, keep: int = 1) -> int:
        """Removes segments that none of the last ``keep`` versions names, and their manifests; returns how many."""
        versions = sorted(self.versions())
        old, kept = versions[:-keep], versions[-keep:]
        live = {p.split("/")[1] for v in kept for f in self.manifest(v).frames.values() for p in f["paths"]}
        live |= {p.split("/")[1] for v in kept for p in self.manifest(v).meta.get("paths", {}).values()}
        gone = [n for n in self.files.names("segments") if n not in live]
        for v in old:
            self.files.remove(f"versions/v={v:012d}.json")
        for n in gone:
            self.files.remove(f"segments/{n}")
        return len(gone)


class Draft:
    """The version after a manifest, until it is published."""

    def __init__(self, store: Store, before: Manifest):
        self.store, self.before = store, before
        self.version = before.version + 1
        self.frames, self.meta = dict(before.frames), json.loads(json.dumps(before.meta))
        self._own = f"scratch/{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, path: str, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.store.folder}/{path}/{part}")

    def _segment(self) -> str:
        return f"segments/{self.version:012d}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, key: Sequence[str]) -> None:
        """The whole frame."""
        path = self._segment()
        self._write(df, path, "rows")
        self.frames[name] = {"key": list(key), "schema": _ddl(df), "paths": [path]}

    def change(self, name: str, keys: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows of ``keys`` are now ``rows``; many deltas become one, or large ones part of the base.

        Returns the keys as written.
        """
        frame, path = self.frames[name], self._segment()
        self._write(keys.select(*frame["key"]).distinct(), path, "keys")
        self._write(rows, path, "rows")
        base, *deltas = paths = [*frame["paths"], path]
        self.frames[name] = frame | {"paths": paths}
        written = self.store._keys(path)
        if len(deltas) <= self.store.most_deltas:
            return written
        if 4 * sum(map(self.store.files.size, deltas)) > self.store.files.size(base):
            self.put(name, self.read(name), frame["key"])
            return written
        merged, every = self._segment(), self.store._keys(deltas[0])
        for d in deltas[1:]:
            every = every.unionByName(self.store._keys(d))
        self._write(every.distinct(), merged, "keys")
        self._write(self.store._chain(frame, deltas), merged, "rows")
        self.frames[name] = frame | {"paths": [base, merged]}
        return written

    def drop(self, name: str) -> None:
        self.frames.pop(name, None)

    def keep(self, label: str, df: DataFrame) -> DataFrame:
        """A frame of this version alone, such as its patches; found again by its label in ``meta['paths']``."""
        path = self._segment()
        self._write(df, path, "rows")
        self.meta.setdefault("paths", {})[label] = path
        return self.store.spark.read.parquet(f"{self.store.folder}/{path}/rows")

    def scratch(self, df: DataFrame) -> DataFrame:
        """A frame computed once for this draft's own use; gone once the draft is published."""
        path = f"{self.store.folder}/{self._own}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.store.spark.read.schema(_ddl(df)).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.store.read(Manifest(self.version, self.frames, self.meta), name)

    def publish(self) -> Manifest:
        """All of it at once, or Conflict and nothing."""
        text = json.dumps({"frames": self.frames, "meta": self.meta})
        self.store.files.publish(f"versions/v={self.version:012d}.json", text)
        self.store.files.remove(self._own)
        return Manifest(self.version, self.frames, self.meta)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Storage:
    """What operators remember: JSON values by key, in a namespace of a client group and an operator.

    Reads see what was written before in the same namespace; ``flush`` publishes all that
    was written since the last one as one version.
    """

    def __init__(self, store: Store, group: str, operator: str):
        self.store, self.name = store, f"storage/{group}/{operator}"
        m = store.manifest()
        held = store.read(m, self.name).collect() if self.name in m.frames else []
        self.values = {r["key"]: json.loads(r["value"]) for r in held}
        self.changed: set[str] = set()

    def set(self, key: str, value) -> None:
        self.values[key] = value
        self.changed.add(key)

    def get(self, key: str, default=None):
        return self.values.get(key, default)

    def delete(self, key: str) -> None:
        if self.values.pop(key, None) is not None:
            self.changed.add(key)

    def scan(self, prefix: str = "") -> list[tuple]:
        """Keys with a prefix, in order, and their values."""
        return [(k, self.values[k]) for k in sorted(self.values) if k.startswith(prefix)]

    def flush(self) -> None:
        if not self.changed:
            return
        spark, m = self.store.spark, self.store.manifest()
        rows = [(k, json.dumps(self.values[k])) for k in sorted(self.changed) if k in self.values]
        frame, draft = spark.createDataFrame(rows, "key string, value string"), self.store.next(m)
        if self.name in m.frames:
            draft.change(self.name, spark.createDataFrame([(k,) for k in sorted(self.changed)], "key string"), frame)
        else:
            draft.put(self.name, frame, ["key"])
        draft.publish()
        self.changed.clear()
