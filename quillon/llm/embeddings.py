"""Near-duplicate vectors by spherical-cap filters.

A filter direction joins one codeword from each of two random codes, one for either half
of the coordinates.  A vector is list-decoded to all filters whose direction it exceeds a
threshold towards; vectors of one label and length that share a filter are compared in
double precision.  Each length that occurs has a code of its own, or a single filter where
no label has more than a few vectors of it.  A pair is counted in the smallest filter that
both have, so pairs need no deduplication, and equal vectors are first made one, with its
multiplicity.

Recall: the threshold gives ``list_size`` filters on average and every vector at least
``least_list``, so that pairs at the 0.98 bound share one with a probability measured in
tests/llm (above 0.999); none below the bound is linked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and those with a null label, link with nothing and are their own component; vectors of
different lengths do not link, those of equal length do, whatever other lengths occur;
equal vectors of one label link with each other; repeated rows (equal vec_id) count as
vectors each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._components import components
from quillon.llm._store import stored


@dataclass(frozen=True)
class CapSettings:
    threshold: float = 0.98
    list_size: int = 28
    least_list: int = 20
    #: Vectors of one filter that are compared at once; a filter with more is done block against block.
    block: int = 1500
    seed: int = 77
    #: Vectors of a label up to which a length has a single filter, in which all are compared.
    few: int = 64
    #: Codewords of each half at most; the filters are their pairs.
    most_codewords: int = 4096


def codes(dims: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two codes of unit codewords, for the first and the second half of the coordinates."""
    r = np.random.default_rng(seed)
    out = []
    for d in (dims // 2, dims - dims // 2):
        c = r.standard_normal((words, max(1, d)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return out[0], out[1]


def cap_bound(code: tuple[np.ndarray, np.ndarray], list_size: int, seed: int, vectors: int = 1000, draws: int = 8_000_000) -> float:
    """The score that ``list_size`` of all filters exceed, on average over random unit vectors.

    Estimated from random vectors, each with random filters; memory does not grow with the
    number of filters.
    """
    r, half = np.random.default_rng(seed + 1), code[0].shape[1]
    x = r.standard_normal((vectors, half + code[1].shape[1]))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words = len(code[0])
    keep = max(1, round(draws * min(1.0, list_size / (words * words))))
    top = np.empty(0)
    for _ in range(16):
        some = r.integers(0, vectors, 40)
        first, second = x[some, :half] @ code[0].T, x[some, half:] @ code[1].T
        v, i, j = (r.integers(0, n, draws // 16) for n in (len(some), words, words))
        top = np.concatenate([top, first[v, i] + second[v, j]])
        if len(top) > keep:
            top = np.partition(top, len(top) - keep)[len(top) - keep :]
    return float(top.min())


def decode(x: np.ndarray, code: tuple[np.ndarray, np.ndarray], bound: float, least_list: int) -> list[np.ndarray]:
    """The filters (i * words + j) of each unit vector, ascending.

    A pair of codewords exceeds the bound only if its first does so with the best second;
    of each vector only those first codewords are expanded.
    """
    half, words = x.shape[1] // 2, len(code[0])
    first, second = x[:, :half] @ code[0].T, x[:, half:] @ code[1].T
    out = []
    for s, t in zip(first, second, strict=True):
        need, best = bound, t.max()
        while True:
            near = np.flatnonzero(s + best >= need)
            i, j = np.nonzero(s[near, None] + t[None, :] >= need)
            if len(i) >= min(least_list, words * words):
                break
            top = np.sort((np.sort(s)[-least_list:, None] + np.sort(t)[None, -least_list:]).ravel())
            need = top[-min(least_list, len(top))]
        out.append(np.sort(near[i] * words + j).astype(np.int32))
    return out


def link_vectors(vectors: DataFrame, settings: CapSettings = CapSettings()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    s = settings
    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = stored(rows.where("usable").groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    lengths = classes.groupBy("label", F.size("x").alias("dims")).count().groupBy("dims").agg(F.max("count").alias("most")).where(F.col("most") > s.few)
    shapes = {}  # length: codewords, bound
    for dims, most in lengths.collect():
        # So many filters that a filter holds about 64 of a label's vectors.
        words = min(s.most_codewords, max(48, math.ceil(math.sqrt(most * s.list_size / 64))))
        shapes[dims] = words, cap_bound(codes(max(2, dims), words, s.seed), s.list_size, s.seed)

    def caps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
            raw, lists = [b""] * len(vectors), [np.zeros(1, np.int32)] * len(vectors)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims).tolist()
                x = np.array([vectors[i] for i in at], np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, v in zip(at, x, strict=True):
                    raw[i] = v.tobytes()
                if dims in shapes:
                    words, bound = shapes[dims]
                    if dims not in made:
                        made[dims] = codes(max(2, dims), words, s.seed)
                    found = decode(x if dims > 1 else np.pad(x, ((0, 0), (0, 1))), made[dims], bound, s.least_list)
                    for i, filters in zip(at, found, strict=True):
                        lists[i] = filters
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), batch.column(3), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "label", "dims", "x", "copies", "filters"])

    label_kind = vectors.schema["label"].dataType.simpleString()
    decoded = classes.select("rep", "label", "x", "copies").mapInArrow(caps, f"rep {id_kind}, label {label_kind}, dims int, x binary, copies long, filters array<int>")
    decoded = stored(decoded)
    keyed = decoded.withColumn("filter", F.explode("filters"))
    held = keyed.groupBy("label", "dims", "filter").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / s.block).cast("int"))
    met = keyed.join(held.select("label", "dims", "filter", "blocks"), ["label", "dims", "filter"])
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    # Block against block: a row goes to each pair of blocks that holds its own.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("*", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def compare(table: pa.Table) -> pa.Table:
        mine, lo, hi = table["filter"][0].as_py(), table["lo"][0].as_py(), table["hi"][0].as_py()
        order = np.argsort(np.array(table["rep"].to_pylist()), kind="stable")
        table = table.take(pa.array(order))
        ids, copies = np.array(table["rep"].to_pylist()), np.array(table["copies"].to_pylist())
        own = np.array(table["own"].to_pylist())
        lists = table["filters"].to_pylist()
        x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float64).reshape(len(ids), -1)
        links, nearest = np.zeros(len(ids), np.int64), np.arange(len(ids))
        sets = None
        for at in range(0, len(ids), 512):
            i, j = np.nonzero(x[at : at + 512] @ x.T >= s.threshold - 1e-9)
            i = i + at
            keep = (i < j) & ((own[i] == lo) & (own[j] == hi) | (own[i] == hi) & (own[j] == lo))
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= s.threshold
            i, j = i[exact], j[exact]
            sets = sets or [frozenset(f for f in v if f < mine) for v in lists]
            first = np.fromiter((sets[p].isdisjoint(sets[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):  # union by smallest
                while nearest[p] != p:
                    nearest[p] = nearest[nearest[p]]
                    p = nearest[p]
                while nearest[q] != q:
                    nearest[q] = nearest[nearest[q]]
                    q = nearest[q]
                nearest[max(p, q)] = min(p, q)
        hit = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[hit]).cast(table.schema.field("rep").type), "links": pa.array(links[hit]), "towards": pa.array(ids[nearest[hit]]).cast(table.schema.field("rep").type)})

    found = stored(
        met.select("label", "dims", "filter", "lo", "hi", "own", "rep", "copies", "x", "filters").groupBy("label", "dims", "filter", "lo", "hi").applyInArrow(compare, f"rep {id_kind}, links long, towards {id_kind}")
    )
    reached = components(found, "rep", "towards")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    answer = classes.select("label", "x", "rep", "copies").join(counts, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    answer = answer.select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("usable").join(answer, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
