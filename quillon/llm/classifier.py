"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A text is
compressed with each, block by block so that the dictionary and not the text's own past
does the work.  The difference of the compressed sizes, normalised by the text's own
size, is calibrated by logistic regression on other labelled documents and so becomes the
score; nothing else enters it.  Text that both dictionaries fit equally well, repetitive
text above all, has a difference near 0, which good text does not have.

Fitting uses a bounded sample: ``fit_docs`` labelled documents of each class for the
dictionaries and as many again for the calibration, taken by a seeded hash, and of a
long one at most ``fit_blocks`` evenly spaced blocks for its dictionary.  Scoring reads
every text whole.  Only text enters a score.

Defined cases: a null or empty text has sizes of 0 and gets the calibrated score of
those; labels other than 0 and 1, null labels and documents without text teach nothing;
a document labelled twice counts once for each row; with a class missing the score is the
share of good labels (0.5 without labels); repeated rows score alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import stored

#: Fixed by the contract.
FOLDS, THRESHOLD = 5, 0.3
BLOCK = 4096
#: Bytes added to a text's size, so that the difference of a very short one weighs less.
DAMP = 25


@dataclass(frozen=True)
class FitSettings:
    fit_docs: int = 2000
    fit_blocks: int = 2
    dictionary_bytes: int = 800_000
    level: int = 12
    seed: int = 40503


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Compressor:
    def __init__(self, good: bytes, bad: bytes, level: int):
        def packer(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level)
            return zstandard.ZstdCompressor(dict_data=d, write_content_size=False)

        self.good, self.bad = packer(good), packer(bad)

    def difference(self, text: str | None) -> float:
        """Of the compressed sizes, normalised: above 0 for what good text explains better."""
        good = bad = raw = 0
        for b in blocks(text):
            good += len(self.good.compress(b))
            bad += len(self.bad.compress(b))
            raw += len(b)
        return (bad - good) / (raw + DAMP)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content that zstandard's trainer picks from the samples; plain samples where it has too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def own_lines(pieces: list[tuple[int, int, bytes]]) -> dict[int, list[bytes]]:
    """The pieces of each class without lines that several documents share.

    A shared line tells of its source, not of quality, and would count for whichever
    dictionary happens to have it.
    """
    holders: dict[bytes, set[int]] = {}
    for _, doc, block in pieces:
        for line in block.split(b"\n"):
            holders.setdefault(line, set()).add(doc)
    out: dict[int, list[bytes]] = {0: [], 1: [], -1: []}
    for q, _, block in pieces:
        kept = b"\n".join(line for line in block.split(b"\n") if len(holders[line]) == 1)
        if kept:
            out[q].append(kept)
    return {q: sorted(v) for q, v in out.items()}


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Intercept and slope of a logistic regression (Newton, slightly ridged)."""
    mean, scale = x.mean(), x.std() or 1.0
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2
        step = np.linalg.solve(hessian, z.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = w[1] / scale
    return float(w[0] - slope * mean), float(slope)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    level: int

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> Model:
    """Learns from rows of ``labels`` whose crc32(doc_id) mod 5 is not 0; to the driver come bounded samples only."""
    s = settings
    usable = labels.where("quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if set(counts) != {0, 1}:
        share = (counts.get(1, 0) + 0.5 * (not counts)) / max(1, sum(counts.values()))
        return Model(b"", b"", math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0, s.level)
    picked = None
    for q in (0, 1):
        # The first half, by hash, is for the dictionary, the second for the calibration.
        part = usable.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(2 * s.fit_docs)
        picked = part if picked is None else picked.unionByName(part)
    rows = [(r["doc_id"], r["quality"]) for r in picked.collect()]
    half = {q: min(s.fit_docs, -(-counts[q] // 2)) for q in (0, 1)}
    seen, dealt = {0: 0, 1: 0}, []
    for doc_id, q in rows:
        dealt.append((doc_id, q, seen[q] < half[q]))
        seen[q] += 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(dealt, f"doc_id {kind}, quality int, teaches boolean")
    # At most 4 * fit_docs labels, so the join is a filter of the scan; its result is kept, as it is read twice.
    sample = stored(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_d, out_b = [], [], []
            for text, q, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = blocks(text)
                for i in sorted({len(parts) * k // s.fit_blocks for k in range(s.fit_blocks)} if parts else ()):
                    out_q.append(q)
                    out_d.append(doc)
                    out_b.append(parts[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int32()), pa.array(out_d, pa.int64()), pa.array(out_b, pa.binary())], names=["quality", "doc", "block"])

    # The documents for the calibration help to tell which lines are shared; quality -1 marks theirs.
    role = F.when(F.col("teaches"), F.col("quality")).otherwise(-1).alias("quality")
    pieces = sample.select("text", role, F.xxhash64("doc_id").alias("doc")).mapInArrow(cut, "quality int, doc long, block binary").collect()
    by = own_lines([(r["quality"], r["doc"], bytes(r["block"])) for r in pieces])
    good, bad = dictionary(by[1], s.dictionary_bytes), dictionary(by[0], s.dictionary_bytes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressor(good, bad, s.level)
        for batch in batches:
            found = [c.difference(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["d", "quality"])

    seen_rows = sample.where("not teaches").select("text", "quality").mapInArrow(measure, "d double, quality int").collect()
    if len({r["quality"] for r in seen_rows}) < 2:
        return Model(good, bad, math.log(counts[1] / counts[0]), 0.0, s.level)
    x, y = np.array([r["d"] for r in seen_rows]), np.array([r["quality"] for r in seen_rows], float)
    order = np.lexsort((y, x))
    intercept, slope = calibrate(x[order], y[order])
    # The sample holds the classes in equal numbers; the prior is that of all usable labels.
    prior = math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, intercept + prior, slope, s.level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressor(model.good, model.bad, model.level) if model.slope else None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0)
                p = model.probability(np.array([c.difference(t) if c else 0.0 for t in part.column(1).to_pylist()]))
                held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def train_and_score(docs: DataFrame, labels: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    return score(docs, fit(docs, labels, settings))
