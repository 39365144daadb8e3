"""Packing into optimal length buckets.

The global histogram of lengths goes through a dynamic program that chooses the bucket
boundaries with the least padding.  Inside a bucket, documents in seeded order fill
batches of ``token_budget // boundary`` slots, so that a padded batch keeps the budget.
A document longer than the budget is a batch of its own whatever the boundaries, so it
needs no padding and the program is exact over at most ``token_budget + 1`` lengths.

Defined cases: a null or empty text has length 0 and takes a slot like any other;
documents longer than the budget are not cut and stand in one more bucket, each with its
own length as ``bucket_length``; equal lengths and repeated rows are packed one by one,
ties in the seeded order being rows that are alike in id and length; an empty table gives
an empty result; of other columns only those named in ``carry`` are kept, which must not
be called like the result's own columns (a ValueError) but may be called anything else.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._store import stored
from quillon.llm.mixing import word_count

def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets over the histogram, with the least padding.

    cost(i, j) of lengths i..j-1 in one bucket is monotone in the sense that lets the best
    split points be found by divide and conquer, in O(buckets * n * log n).
    """
    order = np.argsort(lengths)
    at = np.maximum(np.asarray(lengths, np.float64)[order], 1)
    count = np.r_[0, np.cumsum(np.asarray(counts, np.float64)[order])]
    total = np.r_[0, np.cumsum(at * np.asarray(counts, np.float64)[order])]
    n = len(at)
    if not n:
        return []
    ends = np.arange(1, n + 1)
    best = at[ends - 1] * count[ends] - total[ends]
    best, splits = np.r_[0, best], [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + at[j - 1] * (count[j] - count[i]) - (total[j] - total[i])
            k = int(np.argmin(cost))
            new[j], split[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        splits.append(split)
    out, j = [], n
    for split in reversed(splits):
        if j:
            out.append(int(at[j - 1]))
            j = int(split[j])
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), token_budget: int = 16_384, buckets: int = 16, chunk_tokens: int = 1_000_000, max_chunks: int = 1_000_000, seed: int = 911) -> DataFrame:
    """``id, n_tokens, bucket, bucket_length, batch_id, slot`` and the carried columns, for each row.

    To the driver goes the histogram, of at most ``token_budget + 2`` rows.  A bucket is
    dealt into chunks of about ``chunk_tokens`` by a seeded hash, so its rows are numbered by
    many tasks at once; the chunks' sizes, not their rows, are summed up in order.  Carried texts are read once more
    for the result and shuffled once.
    """
    if clash := set(carry) & {id_col, "n_tokens", "bucket", "bucket_length", "batch_id", "slot"}:
        raise ValueError(f"carried columns are called like the result's own: {sorted(clash)}")
    spark = docs.sparkSession
    sized = stored(docs.select(F.col(id_col).alias("__pack_id"), word_count(F.col(text_col)).alias("__pack_n")))
    over = F.col("__pack_n") > token_budget
    histogram = sized.groupBy(F.when(~over, F.col("__pack_n")).alias("length")).count().collect()
    lengths, counts = [r["length"] for r in histogram if r["length"] is not None], [r["count"] for r in histogram if r["length"] is not None]
    bounds = optimal_boundaries(lengths, counts, buckets)
    held = [sum(c for n, c in zip(lengths, counts, strict=True) if lo < max(n, 1) <= hi) for lo, hi in zip([0, *bounds], bounds)]
    slots = [token_budget // b for b in bounds]
    held, slots = [*held, sum(r["count"] for r in histogram if r["length"] is None)], [*slots, 1]
    first = np.cumsum([0, *(-(-n // c) for n, c in zip(held, slots, strict=True))]).tolist()
    # Documents beyond the budget have any length; few share a chunk.
    chunks = [min(max_chunks, max(1, -(-n * b // chunk_tokens))) for n, b in zip(held, [*bounds, 4 * token_budget], strict=True)]
    rows = [(i, b, slots[i], first[i], chunks[i]) for i, b in enumerate([*bounds, None])]
    table = spark.createDataFrame(rows, "__pack_bucket int, __pack_bound long, __pack_slots int, __pack_first long, __pack_chunks int")
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + (F.col("__pack_n") > b).cast("int")
    bucket = F.when(over, F.lit(len(bounds))).otherwise(bucket).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("__pack_bucket", bucket).join(F.broadcast(table), "__pack_bucket")  # at most ``buckets + 1`` rows
        return placed.withColumn("__pack_chunk", F.pmod(F.xxhash64(F.lit(seed), "__pack_id"), "__pack_chunks"))

    key = ["__pack_bucket", "__pack_chunk"]
    earlier = Window.partitionBy("__pack_bucket").orderBy("__pack_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt(sized).groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__pack_before"))
    if carry:
        # explode keeps the optimizer from copying the count of words into every expression over it.
        sized = docs.select(F.col(id_col).alias("__pack_id"), *carry, F.explode(F.array(word_count(F.col(text_col)))).alias("__pack_n"))
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 1), "__pack_id"), "__pack_id", "__pack_n")
    ranked = dealt(sized).withColumn("__pack_rank", F.row_number().over(order) - 1).join(before, key)
    place = F.col("__pack_rank") + F.col("__pack_before")
    return ranked.select(
        F.col("__pack_id").alias(id_col), *carry, F.col("__pack_n").alias("n_tokens"), F.col("__pack_bucket").alias("bucket"),
        F.coalesce("__pack_bound", "__pack_n").alias("bucket_length"),
        (F.col("__pack_first") + F.floor(place / F.col("__pack_slots"))).cast("long").alias("batch_id"),
        F.pmod(place, F.col("__pack_slots")).cast("int").alias("slot"),
    )
