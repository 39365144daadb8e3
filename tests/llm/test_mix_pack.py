"""Mixing and packing."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm.mixing import MixSettings, _quotas, mix_documents, mix_plan, sainte_lague, targets, word_range
from quillon.llm.packing import optimal_boundaries, pack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if given[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def test_sainte_lague():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 7)
        weights = [float(r.randrange(0, 50)) for _ in range(n)]
        caps = [r.randrange(0, 40) for _ in range(n)]
        seats = r.randrange(0, 60)
        assert sainte_lague(weights, seats, caps) == highest_quotients(weights, seats, caps)


def test_targets():
    assert targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3] or sum(targets([100, 100, 100])) == pytest.approx(450)
    for sizes in ([100, 100, 100], [10, 1000, 5, 0, 70], [0, 0], [7]):
        t = targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * n + 1e-9 for x, n in zip(t, sizes))


def test_mix(docs, corpus, odd_docs):
    plan = mix_plan(docs)
    assert plan.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    rows = plan.collect()
    again = {r["doc_id"]: r["taken"] for r in mix_plan(docs.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}
    source = {i: s for i, _, _, s, _ in corpus}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    want = dict(zip(names, targets([total[s] for s in names])))
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == want[source[r["doc_id"]]] and 0 <= r["taken"] <= 2 * r["size"]
    for s in names:
        assert abs(sum(r["taken"] for r in rows if source[r["doc_id"]] == s) - want[s]) <= 2
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert counts == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert mix_plan(docs.limit(0)).count() == mix_documents(docs.limit(0)).count() == 0
    assert mix_plan(odd_docs).count() == odd_docs.count()


def test_mix_of_null_and_repeated_ids(odd_docs):
    rows = mix_plan(odd_docs).collect()
    mixed = mix_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    want, got = {}, {}
    for r in rows:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert want[None] > 0 and got == {i: n for i, n in want.items() if n}


def test_shards_and_blocks(docs):
    rows = mix_plan(docs, settings=MixSettings(shard_docs=5, blocks=300)).collect()
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
        assert r["taken"] <= 2 * r["size"]
    block = sum(t for _, t in by) / 300
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 0.05 * target + 12 * block


def quota_words(shards, settings):
    """Words taken of each source, given its shards' sizes, and the targets."""
    want = targets([sum(x) for x in shards])
    rows = [{"k": k, "shard": i, "size": n} for k, x in enumerate(shards) for i, n in enumerate(x)]
    taken = [0] * len(shards)
    for k, shard, n, passes, start, run in _quotas(rows, want, max(1, round(sum(want) / settings.blocks)), settings):
        assert 0 <= passes * n + run <= 2 * n == 2 * shards[k][shard] and 0 <= start <= n
        taken[k] += passes * n + run
    return taken, want


def test_blocks_larger_than_shards():
    """Short rows make shards smaller than half a block; their source still meets its target."""
    shards = [[2_000_000] * 800, [40_000] * 2500, [20_000] * 2500, [2_000_000] * 1600]
    taken, want = quota_words(shards, MixSettings())
    assert all(abs(t - w) <= 120_000 for t, w in zip(taken, want))


def test_sources_smaller_than_blocks(spark):
    shards = [[2_000_000] * 800, [20_000], [2_000_000] * 1600, [0, 300], [30_000, 30_000]]
    taken, want = quota_words(shards, MixSettings())
    assert all(abs(t - w) <= 2 for t, w in zip(taken, want))
    rows = [(i, "a b c d e f", "large") for i in range(400)] + [(400, "a b c", "small"), (401, "a b c d", None)]
    mix = mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), settings=MixSettings(blocks=100)).collect()
    taken = {r["doc_id"]: (r["taken"], r["target"]) for r in mix if r["doc_id"] >= 400}
    assert all(t > 0 and abs(t - w) <= 2 for t, w in taken.values())


def test_word_range():
    assert word_range("  a  bb\n é  d ", 1, 3) == "bb\n é"
    assert word_range("a a a", 1, 2) == "a"


def test_boundaries_are_optimal():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 40), r.randrange(1, 9)))
        counts = [r.randrange(1, 20) for _ in lengths]
        k = r.randrange(1, 5)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))

        best = min(padding([*x, lengths[-1]]) for m in range(min(k, len(lengths))) for x in itertools.combinations(lengths[:-1], m))
        got = optimal_boundaries(lengths, counts, k)
        assert len(got) <= k and padding(got) == best


def test_pack(docs, corpus, odd_docs):
    budget = 400
    rows = pack(docs, token_budget=budget, buckets=4, chunk_tokens=700, carry=["source"]).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_length"]
        batches.setdefault(r["batch_id"], []).append(r)
    for rs in batches.values():
        length = {r["bucket_length"] for r in rs}
        assert len(length) == 1 and sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert len(rs) * max(length) <= budget or len(rs) == 1 and length == {rs[0]["n_tokens"]}
    assert sorted(batches) == list(range(len(batches)))
    for bucket in {r["bucket"] for r in rows}:  # all but a bucket's last batch are full
        sizes = [len(rs) for _, rs in sorted(batches.items()) if rs[0]["bucket"] == bucket]
        assert len(set(sizes[:-1])) <= 1 and (len(sizes) == 1 or sizes[-1] <= sizes[0])
    assert pack(docs.limit(0)).count() == 0 and pack(odd_docs).count() == odd_docs.count()


def test_pack_of_rows_with_clashing_names(odd_docs, corpus):
    """Columns called like helpers come through as they were; those called like results are refused."""
    docs = odd_docs.withColumn("length", F.col("doc_id") * 10).withColumn("rank", F.lit("r")).withColumn("chunk", F.lit("c")).withColumn("before", F.lit("b"))
    rows = pack(docs, token_budget=300, carry=["text", "length", "rank", "chunk", "before"]).collect()
    assert len(rows) == docs.count() and {(r["rank"], r["chunk"], r["before"]) for r in rows} == {("r", "c", "b")}
    assert all(r["length"] == (None if r["doc_id"] is None else r["doc_id"] * 10) and r["n_tokens"] == len(WORD.findall(r["text"] or "")) for r in rows)
    assert len({(r["batch_id"], r["slot"]) for r in rows}) == len(rows)
    assert all(r["bucket_length"] == r["n_tokens"] for r in rows if r["n_tokens"] > 300)
    with pytest.raises(ValueError, match="slot"):
        pack(docs.withColumn("slot", F.lit(1)), carry=["slot"])


def test_pack_is_optimal(docs, corpus):
    """No other boundaries up to the budget, by brute force, need less padding."""
    budget = 130
    rows = pack(docs, token_budget=budget, buckets=3).collect()
    n = [x for x in (len(WORD.findall(t or "")) for _, t, *_ in corpus) if x <= budget]
    lengths = sorted({max(x, 1) for x in n})

    def padding(bounds):
        return sum(min(b for b in bounds if b >= x) - x for x in n)

    best = min(padding([*x, lengths[-1]]) for m in range(3) for x in itertools.combinations(lengths[:-1], m))
    assert sum(r["bucket_length"] - r["n_tokens"] for r in rows) == best
