"""Near-duplicate documents by one-permutation MinHash.

Every document's shingles are hashed once; the least hash of each of BANDS * ROWS equal
parts of the hash range is its signature, and an empty part borrows from the first filled
part of its own fixed random sequence (optimal densification).  Documents with the same
values in a band share a bucket.  Each bucket yields a star: edges from its smallest
document to the others.  Edges are confirmed on the full shingle sets, first each
document's edge to its smallest centre, then those edges that still join components.

A star can miss a link between two of its leaves.  Buckets whose members the stars have not
joined are therefore compared in blocks of bounded size, each pair in the first bucket
that it shares; blocks give out only the pairs that are similar enough, which are
confirmed too.  The blocks' work grows with the square of such a bucket, their output
does not.

Documents with equal shingle sets are first made one, so copies never meet as pairs.

A linked pair is missed only if it shares no bucket: at the similarity bound of 0.8 with
32 bands of 5 that is (1 - 0.8 ** 5) ** 32, 3 in a million, and less above.

Defined cases: null, empty and word-free texts have no shingles and link with nothing; a
text with fewer words than a shingle has its whole word sequence as one; very long texts
are read whole; repeated rows (equal doc_id) act as copies under that id; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._components import components, joined_components
from quillon.llm._store import give_back, stored

_U = np.uint64


@dataclass(frozen=True)
class NearSettings:
    shingle: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 80
    bands: int = 32
    rows: int = 5
    #: Probes of a bin's random sequence that are tried at once.
    probes: int = 64
    #: Documents of a block that are compared with those of another in one task.
    block: int = 1000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(dict):
    """Word -> 64-bit hash, remembered for the words a worker meets."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = value
        return value


def shingles(text: str | None, size: int, words: Words) -> np.ndarray:
    """The distinct hashes, ascending, of the text's word sequences of ``size``; of all its words if it has fewer."""
    found = text.encode().lower().split() if text else []  # bytes: only A-Z are lower-cased
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(words.__getitem__, found), _U, len(found))
    k = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, _U(k))
        for i in range(k):
            out = mixed(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class Signer:
    def __init__(self, s: NearSettings):
        self.s, self.bins = s, s.bands * s.rows
        self.turn = 0

    def probes(self, turn: int) -> np.ndarray:
        bins, n = np.arange(self.bins, dtype=_U)[:, None], np.arange(turn * self.s.probes, (turn + 1) * self.s.probes, dtype=_U)
        with np.errstate(over="ignore"):
            return (mixed(bins * _U(0x9E3779B97F4A7C15) + mixed(n + _U(1))) % _U(self.bins)).astype(np.int64)

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        part = ((hashes >> _U(32)) * _U(self.bins) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sign, filled = np.zeros(self.bins, _U), np.zeros(self.bins, bool)
        sign[part[first]], filled[part[first]] = hashes[first], True
        todo, turn = np.flatnonzero(~filled), 0
        while len(todo):
            if turn == 0:
                if not hasattr(self, "first_probes"):
                    self.first_probes = self.probes(0)
                probe = self.first_probes[todo]
            else:
                probe = self.probes(turn)[todo]
            hit = filled[probe]
            got = hit.any(axis=1)
            sign[todo[got]] = sign[probe[got, hit[got].argmax(axis=1)]]
            todo, turn = todo[~got], turn + 1
        with np.errstate(over="ignore"):
            rows = sign.reshape(self.s.bands, self.s.rows)
            key = np.arange(self.s.bands, dtype=_U)
            for i in range(self.s.rows):
                key = mixed(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
        return key


def _mapped(docs: DataFrame, schema: str, row: Callable[[], Callable]) -> DataFrame:
    """mapInArrow over (id, text), few texts at a time; ``row()`` makes a worker's function of texts."""
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = row()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *f(part.column(1).to_pylist())], names=names)
        del f
        give_back()

    return docs.mapInArrow(run, schema)


def with_links(reached: DataFrame, links: DataFrame) -> DataFrame:
    return reached if links.isEmpty() else stored(joined_components(reached, links))


def _missed(buckets: DataFrame, reached: DataFrame, sets: DataFrame, s: NearSettings, kind: str) -> DataFrame:
    """Pairs (a, b) of different components that a bucket holds and that seem similar enough.

    Sets are compared by 32 bits of their hashes and against a bound a little lower, so
    every true link is among the pairs.
    """
    placed = buckets.select("key", "id").join(reached.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("held")).where("x < y")
    split = split.select("key", F.ceil(F.col("held") / s.block).cast("int").alias("blocks"))
    members = stored(placed.join(split, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [np.unique((np.frombuffer(x.as_buffer(), _U) >> _U(32)).astype(np.uint32)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], names=["id", "short"])
        give_back()

    keys = members.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # a document has as many as bands
    brief = sets.join(keys.select("id"), "id", "left_semi").mapInArrow(short, f"id {kind}, short binary").join(keys, "id")
    met = members.join(brief, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "keys", "short")

    def compare(table: pa.Table) -> pa.Table:
        key, lo, hi = table["key"][0].as_py(), table["lo"][0].as_py(), table["hi"][0].as_py()
        ids, component, own = (table[c].to_pylist() for c in ("id", "component", "own"))
        names = {c: i for i, c in enumerate(set(component))}
        component, own = np.array([names[c] for c in component]), np.array(own)
        arrays = [np.frombuffer(x, np.uint32) for x in table["short"].to_pylist()]
        size = np.fromiter(map(len, arrays), np.int64, len(arrays))
        _, local = np.unique(np.concatenate(arrays), return_inverse=True)
        starts = np.r_[0, np.cumsum(size)[:-1]]
        before = [frozenset(k for k in v if k < key) for v in table["keys"].to_pylist()]
        marked, found = np.zeros(local.max() + 1, bool), []
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            fit = (component[rest] != component[i]) & (10 * np.minimum(size[rest], size[i]) >= (s.percent - 1) * np.maximum(size[rest], size[i]) / 10)
            fit &= (own[rest] == lo) & (own[i] == hi) | (own[rest] == hi) & (own[i] == lo)
            if not fit.any():
                continue
            mine = local[starts[i] : starts[i] + size[i]]
            marked[mine] = True
            shared = np.add.reduceat(marked[local[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
            marked[mine] = False
            for j in rest[fit & (100 * shared >= (s.percent - 1) * (size[rest] + size[i] - shared))].tolist():
                if before[i].isdisjoint(before[j]):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        kind_ = table.schema.field("id").type
        return pa.table({"a": pa.array([p for p, _ in found], kind_), "b": pa.array([q for _, q in found], kind_)})

    return met.groupBy("key", "lo", "hi").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearSettings = NearSettings()) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row."""
    s = settings
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign() -> Callable:
        words, signer = Words(), Signer(s)

        def f(batch: list) -> list[pa.Array]:
            n, marks, keys = [], [], []
            for text in batch:
                h = shingles(text, s.shingle, words)
                n.append(len(h))
                marks.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                # A single shingle is shared only by equal sets.
                keys.append(signer.bands(h).view(np.int64) if len(h) > 1 else None)
            return [pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return f

    signed = stored(_mapped(texts, f"id {kind}, n long, mark binary, keys array<long>", sign))
    classes = signed.where("mark is not null").groupBy("mark").agg(F.min("id").alias("rep"))
    # Any member's keys are the class's; its smallest document carries them.
    reps = signed.where("keys is not null").groupBy("mark").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = reps.select("id", "n", F.explode("keys").alias("key"))
    centre = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "c")
    buckets = stored(keyed.join(centre, "key").select("key", "id", "n", F.col("c.id").alias("cid"), F.col("c.n").alias("cn")))
    fits = 100 * F.least("n", "cn") >= s.percent * F.greatest("n", "cn")
    pairs = buckets.where("id <> cid").where(fits).select(F.col("cid").alias("a"), F.col("id").alias("b"), F.col("cn").alias("na"), F.col("n").alias("nb")).distinct()

    def full() -> Callable:
        words = Words()
        return lambda batch: [pa.array([shingles(t, s.shingle, words).tobytes() for t in batch], pa.binary())]

    members = buckets.select("id").distinct()
    sets = stored(_mapped(texts.join(members, "id", "left_semi").dropDuplicates(["id"]), f"id {kind}, shingles binary", full))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= s.percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        return stored(both.select("a", "b", "sa", "sb").mapInArrow(confirm, f"a {kind}, b {kind}"))

    # Each document's edge to its smallest centre joins most of what there is to join.
    nearest = buckets.where("id <> cid").where(fits).groupBy("id", "n").agg(F.min(F.struct("cid", "cn")).alias("c"))
    reached = stored(components(confirmed(nearest.select(F.col("c.cid").alias("a"), F.col("id").alias("b")))))
    side = lambda name: reached.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("NOT (coalesce(ca, a) <=> coalesce(cb, b))")
    reached = with_links(reached, confirmed(apart))
    reached = with_links(reached, confirmed(_missed(buckets, reached, sets, s, kind)))
    answer = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("id", "n", "mark").join(answer, "mark", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: NearSettings = NearSettings()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with the columns they came with.

    An id names a document: rows that share one stay or go together.  Rows with a null id stay.
    """
    gone = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, settings).where(~F.col("kept")).select(F.col(id_col).alias("__near_id"))
    return docs.join(gone, docs[id_col] == gone["__near_id"], "left_anti")
