"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source is dealt into shards by a seeded hash, and each shard's documents, in seeded
order, are one run of words.  Words are the seats: they go to the sources, and within a
source to its shards, by highest quotient ``weight / (2 * seats + 1)``, which yields integer
quotas, so that the smallest source and shard have theirs at any size of the corpus.  A
shard takes its quota as one run from a seeded start, round the end to the beginning and
through all its documents for each full pass, so a document is taken whole but where the
run begins or ends.

Runs start at blocks of equal size (a shard's last may be short), which follows from the total.

Defined cases: a null text has size 0 and is taken 0 times; sources are ordered by code
point with null last, and null is a source of its own; ties of quotients go to the
earlier source or shard; repeated rows (equal doc_id) are separate documents whose order
falls back on their size; an empty table gives an empty result; other columns are kept by
``mix_documents`` and not read by ``mix_plan``; helper columns carry a prefix that the
input's columns must not have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._store import give_back, stored

#: Fixed by the contract: weights repeat over the sources in code point order.
WEIGHTS = (5, 2, 1)
SPACE_PATTERN = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space: where a space, or the start, is followed by none."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " ", -1), lambda w: w != "")).cast("long")


def targets(sizes: Sequence[int], share: float = 1.5, cap: float = 2.0, weights: Sequence[int] = WEIGHTS) -> list[float]:
    """Words wanted of each source: by weight, but ``cap`` times its size at most; the excess is reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    limit = [Fraction(cap) * n for n in sizes]
    total = min(Fraction(share) * sum(sizes), sum(limit, Fraction(0)))
    out, free = [Fraction(0)] * len(sizes), [i for i in range(len(sizes)) if sizes[i]]
    while free:
        each = total / sum(weight[i] for i in free)
        over = [i for i in free if each * weight[i] > limit[i]]
        for i in over or free:
            out[i] = limit[i] if over else each * weight[i]
        if not over:
            break
        total -= sum(limit[i] for i in over)
        capped = set(over)
        free = [i for i in free if i not in capped]
    return [float(x) for x in out]


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotient w / (2k + 1), at most ``caps[i]`` each.

    All but a few seats follow from the divisor that gives nearly all of them at once; the
    last go one at a time from a heap, so the cost does not grow with the seats.
    """
    n = len(weights)
    seats, given = min(seats, sum(c for c, w in zip(caps, weights, strict=True) if w > 0)), [0] * n
    total = sum(weights)
    if not total or not seats:
        return given

    def at(divisor: float) -> list[int]:
        # A source has had every quotient w / (2k + 1) >= 1 / (2 * divisor), so k + 1/2 <= w * divisor.
        return [min(c, max(0, int(w * divisor + 0.5))) for w, c in zip(weights, caps, strict=True)]

    low, high = 0.0, (seats + n) / min(w for w in weights if w > 0)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(at(mid)) <= seats:
            low = mid
        else:
            high = mid
    given = at(low)
    queue = [(-w / (2 * given[i] + 1), i) for i, w in enumerate(weights) if w > 0 and given[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


@dataclass(frozen=True)
class MixSettings:
    share: float = 1.5
    cap: int = 2
    weights: tuple[int, ...] = WEIGHTS
    seed: int = 1847
    #: Blocks of the whole mix, at whose beginnings runs start; a block is so much of the total.
    blocks: int = 1 << 16
    #: Documents a shard holds on average, which bounds the rows that one task sorts.
    shard_docs: int = 2000
    #: Shards of a source at most; beyond it shards hold more documents.
    max_shards: int = 10_000
    #: Sources up to which their table is broadcast.
    broadcast_sources: int = 50_000


def _row_keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Two hashes that only rows of equal id, source and text share, nulls included."""
    return [F.xxhash64(id_col, source_col).alias("__mix_a"), F.xxhash64(F.lit(1), F.coalesce(F.col(text_col), F.lit(""))).alias("__mix_b")]


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """Per row: id, size, source_size, target, taken, and what is taken: whole passes and word ranges.

    The sizes are computed once and written to the checkpoint folder.  To the driver goes
    one row for each source and one for each shard, of ``shard_docs`` documents each; texts
    are not shuffled at all.
    """
    return _plan(docs, id_col, text_col, source_col, settings, [])


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, settings: MixSettings, keys: list[Column]) -> DataFrame:
    """The plan, with ``keys`` of the input's rows carried along."""
    spark, s = docs.sparkSession, settings
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *keys)
    carried = sized.columns[3:]
    sized = stored(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["size"] for r in totals], s.share, s.cap, s.weights)
    block = max(1, round(sum(want) / s.blocks))
    shards_of = [min(s.max_shards, max(1, -(-r["docs"] // s.shard_docs))) for r in totals]
    sources = spark.createDataFrame([(i, r["source"], r["size"], want[i], shards_of[i]) for i, r in enumerate(totals)], "k int, source string, source_size long, target double, shards int")
    if len(totals) <= s.broadcast_sources:
        sources = F.broadcast(sources)
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "id", "size", "k", "source_size", "target",
        F.pmod(F.xxhash64(F.lit(s.seed), "id"), "shards").cast("int").alias("shard"), *carried,
    )
    quotas = _quotas(dealt.groupBy("k", "shard").agg(F.sum("size").alias("size")).collect(), want, block, s)
    shard_rows = spark.createDataFrame(quotas, "k int, shard int, shard_size long, passes int, run_start long, run_length long")
    order = Window.partitionBy("k", "shard").orderBy(F.xxhash64(F.lit(s.seed + 1), "id"), "id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(shard_rows, ["k", "shard"], "left")
    start, end, n = F.col("end") - F.col("size"), F.col("end"), F.col("shard_size")
    stop = F.col("run_start") + F.col("run_length")
    # The run may pass the shard's end; its part beyond begins again at 0.
    ranges = [(F.greatest(start, F.col("run_start")), F.least(end, F.least(stop, n))), (start, F.least(end, stop - n))]
    parts = F.array(*[F.struct((a - start).alias("start"), (b - start).alias("end")) for a, b in ranges])
    parts = F.filter(parts, lambda p: p["end"] > p["start"])
    taken = F.col("passes") * F.col("size") + F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])
    return joined.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"),
        F.col("passes"), parts.alias("parts"), *carried,
    )


def _quotas(shards: list, want: list[float], block: int, s: MixSettings) -> list[tuple]:
    """(k, shard, size, whole passes, start and length in words of the extra run) of each shard."""
    by_source: dict[int, list] = {}
    for r in sorted(shards, key=lambda r: (r["k"], r["shard"])):
        by_source.setdefault(r["k"], []).append(r)
    keys = sorted(by_source)
    # Word by word, as a block may be larger than a source or a shard.
    words_of = sainte_lague([want[k] for k in keys], round(sum(want)), [s.cap * sum(r["size"] for r in by_source[k]) for k in keys])
    out = []
    for k, quota in zip(keys, words_of, strict=True):
        rows = by_source[k]
        each = sainte_lague([float(r["size"]) for r in rows], quota, [s.cap * r["size"] for r in rows])
        for r, words in zip(rows, each, strict=True):
            n = -(-r["size"] // block)  # its blocks; the last may be short
            passes, run = divmod(words, r["size"]) if n else (0, 0)
            start = (s.seed * 7919 + r["shard"] * 104729 + k * 1299709) % n * block if n else 0
            out.append((k, r["shard"], r["size"], passes, start, run))
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix itself, with the input's columns: a row for each whole pass and each range of words.

    Rows are found by hashes of id, source and text, so null ids and repeated rows come
    through; of rows equal in all three, each has one of their shares.
    """
    keys = _row_keys(id_col, text_col, source_col)
    key, named = ["__mix_a", "__mix_b"], docs.select("*", *keys)
    alike = Window.partitionBy(*key)
    plan = _plan(docs, id_col, text_col, source_col, settings, keys).withColumn("__mix_alike", F.count(F.lit(1)).over(alike))
    plan = plan.select(*key, "__mix_alike", "taken", F.struct("passes", "parts", "size").alias("__mix_share"))
    single = named.join(plan.where("__mix_alike = 1 AND taken > 0").select(*key, "__mix_share"), key)
    # The few rows with equals are numbered on both sides and meet by number, so that none gathers them.
    number = F.row_number().over(alike.orderBy("__mix_b")).alias("__mix_n")
    several = plan.where("__mix_alike > 1")
    equals = named.join(several.select(*key).distinct(), key, "left_semi").select("*", number)
    own = single.unionByName(equals.join(several.where("taken > 0").select(*key, "__mix_share", number), [*key, "__mix_n"]).drop("__mix_n"))
    size = F.col("__mix_share.size").alias("__mix_size")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("__mix_share.size").alias("end")), F.col("__mix_share.passes"))
    rows = own.withColumn("__mix_part", F.explode(F.concat(whole, "__mix_share.parts"))).select(*docs.columns, "__mix_part.start", "__mix_part.end", size)
    at, out_schema = docs.columns.index(text_col), docs.schema
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            first, last, size = (batch.column(len(docs_columns) + i).to_pylist() for i in range(3))
            new = [t if (a, b) == (0, n) else word_range(t, a, b) for t, a, b, n in zip(texts, first, last, size, strict=True)]
            columns = [batch.column(i) for i in range(len(docs_columns))]
            columns[at] = pa.array(new, pa.string())
            if counted is not None:
                columns[counted] = pa.array(map(len, new), pa.int64()).cast(columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)
        give_back()

    docs_columns = docs.columns
    return rows.mapInArrow(cut, out_schema)


def word_range(text: str, first: int, last: int) -> str:
    """The text from word ``first`` to before word ``last``, white space between words as it was."""
    raw = text.encode()
    words, at, spans = raw.split(), 0, []
    for w in words[:last]:
        at = raw.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return raw[spans[first][0] : spans[last - 1][1]].decode()
