"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte is removed if a string of ``length`` bytes covers it that also starts in a document
with a smaller id.  All strings of that length are held against each other, by way of the
suffixes they are found with:

1. Every string of ``length`` bytes has one anchor, the place in it where the hash of GRAM
   bytes is least.  The anchor depends on the string alone, so equal strings have it at
   the same offset.  Anchors lie some 14 bytes apart; each stands for the neighbouring
   strings that chose it.
2. The hashes at the anchors are exchanged, and those met in one document only are left
   out; a code for each goes back.  A collision lets a suffix through that has no partner,
   and so costs work but changes nothing.
3. For the others each batch of documents sorts the suffixes that start at the anchors, cut
   where the last string of the anchor ends and followed by what stands before the anchor.
   It sends them, each distinct one once with its smallest document, as front-coded runs to
   the range of their first GRAM bytes.  Ranges are even intervals of the hash of these
   bytes, so any number of them needs no sample and no table of borders.  First bytes that
   very many distinct suffixes share (a hot prefix) are split: their strings go one by one
   to the range of all their bytes.
4. A range merges its runs with a loser tree that compares stored common-prefix lengths,
   and reads characters only from where two suffixes are not yet known to agree.  Which
   strings are equal follows from these lengths: two suffixes with the same ``length - q``
   bytes from the anchor are neighbours in the merged order with no shorter common prefix
   between them, and likewise for the ``q`` bytes before it, in the order of these.  No hash
   takes part in this.
5. To a batch goes back, for each suffix it sent, which of its strings an earlier document
   of another batch has; what its own documents repeat, a batch knows itself.

Defined cases: a null or empty text is 0 bytes with nothing to remove; texts shorter than
``length`` lose nothing; documents with equal ids never repeat each other, and a null id
counts as larger than any; ids must be integers (other types raise a TypeError); very long
texts are processed in pieces that overlap, with the same result; an empty table gives an
empty result.  Only the columns asked for are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillon.llm._store import give_back, stored

_U = np.uint64


@dataclass(frozen=True)
class SuffixSettings:
    length: int = 50
    gram: int = 24
    #: Bytes of text in a batch, the unit that forms a sorted run.
    batch_bytes: int = 4_000_000
    #: Hashes that one task compares, and suffixes that one task merges, on average.
    part_hashes: int = 1_500_000
    range_suffixes: int = 120_000
    #: First bytes with more distinct suffixes than this are split by all bytes of their strings.
    hot_suffixes: int = 120_000
    #: Suffixes of a batch that are laid out and sorted at once.
    sort_suffixes: int = 150_000
    seed: int = 90001


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# --- batches of documents -------------------------------------------------------------


def freeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return packed(sink.getvalue().to_pybytes())


def thaw(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpacked(data)).read_all()


class Batch:
    """The documents of a frozen batch: columns id, text and what is carried."""

    def __init__(self, data: bytes):
        self.table = thaw(data)
        ids = self.table.column(0).to_pylist()
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        texts = [t.encode() if t else b"" for t in self.table.column(1).to_pylist()]
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)


# --- anchors --------------------------------------------------------------------------


class Anchors:
    """position, first and last string start, document, hash and mark of each anchor of a batch.

    The mark tells contexts with the same first bytes apart; it only serves to count them.
    """

    PIECE = 1 << 18

    def __init__(self, s: SuffixSettings):
        self.s = s
        r = np.random.default_rng(s.seed)
        self.table = r.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
        base, self.power = int(r.integers(1 << 40, 1 << 62)) | 1, {}
        self.base = _U(base)
        for n in range(1, s.gram + 1):
            self.power[n] = _U(pow(base, n, 1 << 64))

    def grams(self, raw: np.ndarray) -> np.ndarray:
        """A hash of the GRAM bytes from each position, built by doubling."""
        h, size, done, whole = self.table[raw], 1, 0, None
        while True:
            if self.s.gram & size:
                if whole is None:
                    whole = h
                else:
                    n = min(len(whole), len(h) - done)
                    whole = whole[:n] * self.power[size] + h[done : done + n]
                done += size
            if done == self.s.gram:
                break
            h = h[:-size] * self.power[size] + h[size:]
            size *= 2
        whole = whole[: len(raw) - self.s.gram + 1]
        whole = (whole ^ (whole >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return whole ^ (whole >> _U(32))

    def of(self, b: Batch) -> tuple[np.ndarray, ...]:
        """Arrays over the whole batch, in text order; positions count from the batch's start."""
        length, out = self.s.length, []
        for lo, hi in self._pieces(b):  # string starts lo..hi-1, valid or not
            raw = b.raw[lo : min(hi + length - 1, len(b.raw))]
            if len(raw) < length:
                continue
            h = self.grams(raw)
            key = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=_U)
            least, size, want = key, 1, length - self.s.gram + 1
            while size * 2 <= want:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < want:
                least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
            count = len(raw) - length + 1
            doc = np.searchsorted(b.ends, np.arange(lo, lo + count), side="right")
            start = np.flatnonzero(b.ends[doc] - np.arange(lo, lo + count) >= length)
            if not len(start):
                continue
            at = (least[start] & _U(0xFFFFFF)).astype(np.int64)
            cut = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
            first, last = np.r_[0, cut], np.r_[cut, len(start)] - 1
            a, x, y = at[first], start[first], start[last]
            mark = h[x] * _U(0x9E3779B97F4A7C15) ^ h[y + length - self.s.gram] * _U(0xC2B2AE3D27D4EB4F) ^ ((a - x) * 64 + y - a).astype(_U)
            out.append((a + lo, x + lo, y + lo, doc[x], h[a], mark))
        if not out:
            z = np.empty(0, np.int64)
            return z, z, z, z, np.empty(0, _U), np.empty(0, _U)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def whole(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of the ``length`` bytes from each position in ``at``."""
        h = np.zeros(len(at), _U)
        for i in range(self.s.length):
            h = h * self.base + self.table[raw[at + i]]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))

    def _pieces(self, b: Batch) -> list[tuple[int, int]]:
        return [(at, min(at + self.PIECE, len(b.raw))) for at in range(0, len(b.raw), self.PIECE)]


# --- front-coded runs and their merge --------------------------------------------------


def front_code(keys: np.ndarray) -> bytes:
    """Sorted distinct rows of bytes as common-prefix lengths and what follows them."""
    n, width = keys.shape
    same = np.zeros(n, np.uint8)
    if n > 1:
        same[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    rest = keys[np.arange(width)[None, :] >= same[:, None]]
    return packed(np.int64(n).tobytes() + same.tobytes() + rest.tobytes())


def front_decode(data: bytes, width: int) -> tuple[list[bytes], list[int]]:
    raw = unpacked(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    same = list(raw[8 : 8 + n])
    out, at, last = [], 8 + n, b""
    for k in same:
        upto = at + width - k
        last = last[:k] + raw[at:upto]
        out.append(last)
        at = upto
    return out, same


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; ``known`` bytes are known to agree and are not read."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge_runs(runs: Sequence[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """(run, common prefix with the one before) of all keys in sorted order, by a loser tree.

    Each stream carries how far its head agrees with the last key put out.  Of two heads the
    one that agrees further is the smaller; only when both agree equally far are bytes
    compared, and from there on.
    """
    k = len(runs)
    leaves = 1 << max(0, (k - 1).bit_length())
    keys = [r[0] for r in runs] + [[]] * (leaves - k)
    same = [r[1] for r in runs] + [[]] * (leaves - k)
    at = [0] * leaves
    head: list[bytes | None] = [x[0] if x else None for x in keys]
    agree = [0 if x else -1 for x in keys]  # -1: the stream is at its end and loses always
    loser = [0] * leaves

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        return settle(node, play(2 * node), play(2 * node + 1))

    def settle(node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node."""
        if agree[a] == agree[b] and agree[a] >= 0:
            x, y, known = head[a], head[b], agree[a]
            if known < width:
                n = width if x == y else common_prefix(x, y, known)
                if n < width and y[n] < x[n]:
                    agree[a] = n
                    a, b = b, a
                else:
                    agree[b] = n
        elif agree[a] < agree[b]:
            a, b = b, a
        loser[node] = b
        return a

    out_run, out_same = [], []
    win = play(1) if leaves > 1 else 0
    while agree[win] >= 0:
        out_run.append(win)
        out_same.append(agree[win])
        i = at[win] = at[win] + 1
        mine = keys[win]
        if i < len(mine):
            head[win], agree[win] = mine[i], same[win][i]
        else:
            head[win], agree[win] = None, -1
        node = (win + leaves) >> 1
        while node:
            other = loser[node]
            x, y = agree[win], agree[other]
            if x < y:
                loser[node], win = win, other
            elif x == y and 0 <= x < width:
                p, q = head[win], head[other]
                n = width if p == q else common_prefix(p, q, x)
                if n < width and q[n] < p[n]:
                    agree[win] = n
                    loser[node], win = win, other
                else:
                    agree[other] = n
            node >>= 1
    return out_run, out_same


# --- the smallest document of each string ----------------------------------------------


def backward_order(contexts: np.ndarray, group: np.ndarray, s: SuffixSettings) -> tuple[np.ndarray, np.ndarray]:
    """The order of the contexts by group and the bytes before the anchor, nearest first, and
    how many of these each has in common with the one before (-1 at a group's first)."""
    reach = s.length - s.gram
    before = contexts[:, s.length : s.length + reach]
    columns = np.zeros((len(contexts), -(-max(reach, 1) // 8) * 8), np.uint8)
    columns[:, :reach] = before
    words = columns.view(">u8").astype(_U)
    order = np.lexsort((*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group))
    same = np.full(len(contexts), -1, np.int64)
    if len(contexts) > 1:
        a, b = before[order[:-1]], before[order[1:]]
        unequal = a != b
        common = np.where(unequal.any(axis=1), unequal.argmax(axis=1), reach) if reach else np.zeros(len(a), np.int64)
        same[1:] = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, same


def smallest_documents(contexts: np.ndarray, same: np.ndarray, smallest: np.ndarray, s: SuffixSettings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number q of bytes before the anchor: (q, contexts with such a string, smallest document that has it).

    ``contexts`` are distinct and in merged order: the bytes around the anchor, then the
    numbers of bytes before it and from it on that are the context's; ``same`` has the common
    prefix of each with the one before.  Strings at q are equal if no prefix shorter than
    ``length - q`` parts their contexts in this order, and none shorter than q in the order
    of the bytes before the anchor.
    """
    reach, n = s.length - s.gram, len(contexts)
    group = np.cumsum(same < s.gram)
    shared = np.bincount(group)[group] > 1
    before, after = contexts[:, -2].astype(np.int64) - 1, contexts[:, -1].astype(np.int64) - 1
    order, backward = backward_order(contexts, group, s)
    for q in range(reach + 1):
        at = np.flatnonzero(shared & (q <= before) & (s.length - q <= after))
        if not len(at):
            continue
        behind = np.empty(n, np.int64)
        behind[order] = np.cumsum(backward < q)
        key = np.cumsum(same < s.length - q)[at] * (n + 1) + behind[at]
        by = np.argsort(key)
        edge = np.flatnonzero(np.r_[True, key[by[1:]] != key[by[:-1]]])
        least = np.empty(len(at), np.int64)
        least[by] = np.repeat(np.minimum.reduceat(smallest[at[by]], edge), np.diff(np.r_[edge, len(at)]))
        yield q, at, least


def earlier_strings(runs: list[dict], s: SuffixSettings) -> list[tuple[int, bytes]]:
    """(batch, for each key of its run the strings that a smaller document has, a bit for each q)."""
    width = 2 * s.length - s.gram + 2
    decoded = [front_decode(r["run"], width) for r in runs]
    run_of, same = merge_runs(decoded, width)
    run_of, same = np.array(run_of, np.int64), np.array(same, np.int64)
    if not len(run_of):
        return []
    same[0] = 0
    new = same < width
    context = np.cumsum(new) - 1
    # The i-th key that a run put out is its i-th key.
    by_run = np.argsort(run_of, kind="stable")
    flat = np.frombuffer(b"".join(k for keys, _ in decoded for k in keys), np.uint8).reshape(-1, width)
    contexts = flat[np.argsort(by_run, kind="stable")[new]]
    del flat, decoded
    context_of = context[by_run]  # in order of run and key
    mine = np.concatenate([np.frombuffer(unpacked(r["least"]), np.int64) for r in runs])
    smallest = np.full(len(contexts), np.iinfo(np.int64).max)
    np.minimum.at(smallest, context_of, mine)
    bits = np.zeros(len(mine), np.uint32)
    best = np.empty(len(contexts), np.int64)
    for q, at, least in smallest_documents(contexts, same[new], smallest, s):
        best[:] = smallest
        best[at] = least
        bits |= (best[context_of] < mine).astype(np.uint32) << np.uint32(q)
    # Strings at a q that no two contexts share are as old as their context.
    bits[smallest[context_of] < mine] = np.uint32((1 << (s.length - s.gram + 1)) - 1)
    out, edge = [], np.r_[0, np.cumsum(np.bincount(run_of, minlength=len(runs)))]
    for r, x, y in zip(runs, edge, edge[1:], strict=False):
        if bits[x:y].any():
            out.append((r["batch"], packed(bits[x:y].tobytes())))
    return out


# --- the operator ----------------------------------------------------------------------


def _repeats(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str], s: SuffixSettings) -> tuple[DataFrame, Callable[[bytes, list | None, list | None], tuple[Batch, np.ndarray]]]:
    """The batches of documents with what was found for them, and the function that tells from it which bytes go."""
    if s.length - s.gram >= 32 or s.gram > s.length:
        raise ValueError("gram must be at most length, and more than length - 32")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    columns = [id_col, text_col, *carry]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([freeze(pa.Table.from_batches(held))], pa.binary())], names=["size", "docs"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            start = 0
            for i, n in enumerate(sizes):
                if size + n > s.batch_bytes and (size or i > start):
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield row()
                    held, size, start = [], 0, i
                size += n
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield row()

    frozen = docs.select(*columns).mapInArrow(gather, "size long, docs binary").select(F.monotonically_increasing_id().alias("batch"), "size", "docs")
    frozen = stored(frozen)
    spacing = (s.length - s.gram + 2) / 2
    parts = max(1, round((frozen.agg(F.sum("size")).first()[0] or 0) / spacing / s.part_hashes))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(s)
        for batch in batches:
            for key, data in map(_values, zip(*batch.columns, strict=True)):
                b = Batch(data)
                _, _, _, doc, h, mark = find.of(b)
                unique, several, kinds = distinct_hashes(h, doc, mark)
                # The part is known from where a blob goes, so five bytes of a hash will do.
                print_, held = unique.view(np.uint8).reshape(-1, 8)[:, :5], (np.minimum(kinds, 127) + 128 * several).astype(np.uint8)
                part, edge = spans_of(part_of(unique, parts))
                rows = [(p, print_[x:y].tobytes(), held[x:y].tobytes()) for p, x, y in zip(part.tolist(), edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["batch", "part", "hashes", "held"],
                )
                give_back()

    def recur(table: pa.Table) -> pa.Table:
        keys, blobs = table["batch"].to_pylist(), table["hashes"].to_pylist()
        edge = np.cumsum([0, *(len(x) // 5 for x in blobs)])
        wide = np.zeros((edge[-1], 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
        every = wide.view("<u8").ravel()
        held = np.frombuffer(b"".join(table["held"].to_pylist()), np.uint8)
        del blobs, wide
        order = np.argsort(every)
        first = np.flatnonzero(np.r_[True, every[order[1:]] != every[order[:-1]]])
        ordered = held[order]
        size = np.diff(np.r_[first, len(order)])
        kinds = np.add.reduceat(ordered & 127, first, dtype=np.int64)
        again = (size > 1) | (np.maximum.reduceat(ordered, first) >= 128)
        code = np.empty(len(order), np.uint8)
        code[order] = np.repeat(np.where(again, np.where(kinds > s.hot_suffixes, 2, 1), 0).astype(np.uint8), size)
        reach = s.length - s.gram + 1
        n = int((held & 127)[code > 0].sum() + (reach - 1) * int((held & 127)[code == 2].sum()))
        codes = [packed(code[x:y].tobytes()) for x, y in zip(edge, edge[1:], strict=False)]
        part = table["part"][0].as_py()
        give_back()
        return pa.table({"batch": pa.array(keys, pa.int64()), "part": pa.array([part] * len(keys), pa.int64()), "n": pa.array([n] + [0] * (len(keys) - 1), pa.int64()), "codes": pa.array(codes, pa.binary())})

    met = frozen.select("batch", "docs").mapInArrow(hashes, "batch long, part long, hashes binary, held binary")
    codes = stored(met.groupBy("part").applyInArrow(recur, "batch long, part long, n long, codes binary"))
    ranges = max(1, round((codes.agg(F.sum("n")).first()[0] or 0) / s.range_suffixes))

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(s)
        for batch in batches:
            for key, data, found in map(_values, zip(*batch.columns, strict=True)):
                for part in batch_runs(Batch(data), find, found, parts, ranges, s):
                    rows = [(r, front_code(part.keys[x:y]), packed(part.least[x:y].tobytes())) for r, x, y in part.runs()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([key] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                        names=["range", "batch", "run", "least"],
                    )
                give_back()

    def merge(table: pa.Table) -> pa.Table:
        rows = earlier_strings(table.sort_by("batch").to_pylist(), s)
        at = table["range"][0].as_py()
        give_back()
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "range": pa.array([at] * len(rows), pa.int64()), "bits": pa.array([r[1] for r in rows], pa.binary())})

    def removed(data: bytes, found: list | None, earlier: list | None) -> tuple[Batch, np.ndarray]:
        """The batch, and which of its bytes go."""
        b, bits_of = Batch(data), {x["range"]: x["bits"] for x in earlier or ()}
        hit = np.zeros(len(b.raw) + 1, np.int32)
        for part in batch_runs(b, Anchors(s), found, parts, ranges, s):
            bits = np.zeros(len(part.keys), np.uint32)
            for r, x, y in part.runs():
                if r in bits_of:
                    bits[x:y] = np.frombuffer(unpacked(bits_of[r]), np.uint32)
            # A document after the key's smallest in this batch repeats all its strings.
            mine = np.where(b.ids[part.doc] > part.least[part.key], ~np.uint32(0), bits[part.key])
            for q in range(s.length - s.gram + 1):
                some = part.at[(mine >> np.uint32(q) & np.uint32(1) > 0) & (q <= part.before) & (s.length - q <= part.after)]
                hit[some - q] = 1
        hit = np.cumsum(hit[:-1], out=hit[:-1])
        gone = hit.copy()
        gone[s.length :] -= hit[: -s.length] if len(hit) > s.length else 0
        return b, gone > 0

    answers = stored(codes.groupBy("batch").agg(F.collect_list(F.struct("part", "codes")).alias("found")))
    known = frozen.select("batch", "docs").join(answers, "batch", "left")
    runs = known.mapInArrow(sort_runs, "range long, batch long, run binary, least binary")
    earlier = runs.groupBy("range").applyInArrow(merge, "batch long, range long, bits binary").groupBy("batch").agg(F.collect_list(F.struct("range", "bits")).alias("earlier"))
    return known.join(earlier, "batch", "left").select("docs", "found", "earlier"), removed


def _values(row: Sequence[pa.Scalar]) -> list:
    """A row's values, so that of a batch's large ones only those in use are copied."""
    return [x.as_py() for x in row]


def distinct_hashes(h: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's distinct hashes, ascending, whether more than one of its documents has each, and
    how many distinct marks there are with it."""
    if not len(h):
        return h, np.empty(0, np.bool_), np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, doc, mark = h[order], doc[order], mark[order]
    edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[edge, len(h)])
    kinds = np.ones(len(edge), np.int64)
    many = np.flatnonzero(np.repeat(size > 1, size))
    if len(many):
        group = np.repeat(np.arange(len(edge)), size)[many]
        by = np.lexsort((mark[many], group))
        group, mark = group[by], mark[many[by]]
        new = np.r_[True, (group[1:] != group[:-1]) | (mark[1:] != mark[:-1])]
        kinds[size > 1] = np.bincount(group[new], minlength=len(edge))[size > 1]
    return h[edge], np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), kinds


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each anchor's hash; ascending with it.

    An anchor's hash is the least of some 27, so hashes crowd towards 0: a share
    1 - (1 - x) ** 27 of them lies below x, which makes parts of equal sizes.
    """
    x = h.astype(np.float64) / 2.0**64
    return np.minimum(((1 - (1 - x) ** 27) * parts).astype(np.int64), parts - 1)


def spans_of(sorted_values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The distinct values, and where each begins, with the end of all."""
    if not len(sorted_values):
        return sorted_values, [0]
    edge = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[edge], [*edge.tolist(), len(sorted_values)]


@dataclass
class Part:
    """Suffixes of some ranges of a batch: members with their positions, and the distinct keys in order of range."""

    keys: np.ndarray
    where: np.ndarray  # range of each key
    least: np.ndarray  # smallest document of each key
    key: np.ndarray  # of each member
    at: np.ndarray
    before: np.ndarray
    after: np.ndarray
    doc: np.ndarray

    def runs(self) -> Iterator[tuple[int, int, int]]:
        where, edge = spans_of(self.where)
        yield from zip(where.tolist(), edge, edge[1:], strict=False)


def batch_runs(b: Batch, find: Anchors, found: list | None, parts: int, ranges: int, s: SuffixSettings) -> Iterator[Part]:
    """The batch's repeated suffixes, some ranges at a time."""
    at, first, last, doc, h, _ = find.of(b)
    if not len(at):
        return
    unique = np.unique(h)
    by_part = {x["part"]: x["codes"] for x in found or ()}
    code = np.concatenate([np.frombuffer(unpacked(by_part[p]), np.uint8) for p in spans_of(part_of(unique, parts))[0].tolist()])
    code = code[np.searchsorted(unique, h)]
    keep, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
    where = part_of(h[keep], ranges)
    at, first, last, doc, hot_rows = at[keep], first[keep], last[keep], doc[keep], (at[hot], first[hot], last[hot], doc[hot])
    if len(hot):  # string by string
        n = hot_rows[2] - hot_rows[1] + 1
        each = np.repeat(np.arange(len(hot)), n)
        start = hot_rows[1][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        spread = find.whole(b.raw, start).astype(np.float64) / 2.0**64 * ranges
        where = np.r_[where, np.minimum(spread.astype(np.int64), ranges - 1)]
        at, first, last, doc = np.r_[at, hot_rows[0][each]], np.r_[first, start], np.r_[last, start], np.r_[doc, hot_rows[3][each]]
    if not len(at):
        return
    by = np.argsort(where, kind="stable")
    values, edge = spans_of(where[by])
    x = 0
    while x < len(values):
        y = max(x + 1, int(np.searchsorted(edge, edge[x] + s.sort_suffixes, side="right")) - 1)
        some = by[edge[x] : edge[y]]
        yield sorted_part(b, where[some], at[some], first[some], last[some], doc[some], s)
        x = y


def sorted_part(b: Batch, where: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, s: SuffixSettings) -> Part:
    reach, width = s.length - s.gram, 2 * s.length - s.gram + 2
    before, after = at - first, last + s.length - at
    keys = np.zeros((len(at), width), np.uint8)
    raw, step = b.raw, np.arange(s.length)
    for x in range(0, len(at), 20_000):
        y = slice(x, x + 20_000)
        keys[y, : s.length] = np.where(step < after[y, None], raw[np.minimum(at[y, None] + step, len(raw) - 1)], 0)
        keys[y, s.length : s.length + reach] = np.where(step[:reach] < before[y, None], raw[np.maximum(at[y, None] - 1 - step[:reach], 0)], 0)
    keys[:, -2], keys[:, -1] = before + 1, after + 1
    order = np.argsort(keys.view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(where[order], kind="stable")]
    keys, where = keys[order], where[order]
    new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1) | (where[1:] != where[:-1])]
    edge = np.flatnonzero(new)
    least = np.minimum.reduceat(b.ids[doc[order]], edge)
    return Part(keys[new], where[new], least, np.cumsum(new) - 1, at[order], before[order], after[order], doc[order])


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found, earlier in map(_values, zip(*batch.columns, strict=True)):
                (b, gone), rows = removed(data, found, earlier), []
                for x, y in zip(b.starts.tolist(), b.ends.tolist(), strict=True):
                    g = gone[x:y]
                    n = int(g.sum())
                    kept = b.raw[x:y][~g] if n else b.raw[x:y]
                    rows.append((y - x, n, int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0, hashlib.sha256(kept.tobytes()).hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                kinds = [pa.int64()] * 3 + [pa.string()]
                ids = b.table.column(0).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    batches, removed = _repeats(docs, id_col, text_col, (), settings)
    return batches.mapInArrow(digest, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of their texts, columns as they came.

    A removal may begin or end inside a character; its remaining bytes go too, so that the
    text stays valid.  ``chars_col`` names a column that holds the text's length, if any.
    """
    carry = [c for c in docs.columns if c not in (id_col, text_col)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found, earlier in map(_values, zip(*batch.columns, strict=True)):
                b, gone = removed(data, found, earlier)
                old = b.table.column(1).to_pylist()
                new = [t if not gone[x:y].any() else b.raw[x:y][~gone[x:y]].tobytes().decode("utf-8", "ignore") for t, x, y in zip(old, b.starts.tolist(), b.ends.tolist(), strict=True)]
                columns = {name: b.table.column(i).combine_chunks() for i, name in enumerate(b.table.column_names)}
                columns[text_col] = pa.array(new, pa.string())
                if chars_col:
                    columns[chars_col] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(columns[chars_col].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in docs_columns], names=docs_columns)
                give_back()

    docs_columns = docs.columns
    batches, removed = _repeats(docs, id_col, text_col, carry, settings)
    return batches.mapInArrow(cut, docs.schema)
