"""The corpus pipeline, stage by stage against brute force, and the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quillon.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_documents import WORD, brute_removal, brute_rules, components, shingle_sets


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(staged):
    assert [n for n, *_ in staged] == ["quality_rules", "minhash_dedup", "suffix_dedup", "source_mixing", "length_packing"]
    columns = staged[0][1].columns
    assert all(after.columns == columns for _, _, after in staged[:-1])


def test_near_and_passages(staged):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in staged[1][1:])
    ids = sorted(before)
    sets = shingle_sets([(i, before[i]) for i in ids], 5)
    links = [(i, j) for j in range(len(ids)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert set(after) == {ids[i] for i, root in enumerate(components(len(ids), links)) if i == root}
    cut = {r["doc_id"]: r["text"] for r in staged[2][2].collect()}
    want = brute_removal([(i, t) for i, t in after.items()], 50)
    assert set(cut) == set(after)
    # A cut inside a character takes the rest of it too.
    assert all(want[i][0] - want[i][1] - len(t.encode()) in range(0, 4 * want[i][2] + 1) for i, t in cut.items())


def test_quality_rules(staged):
    """Exactly the documents that a plain reading of the rules rejects go."""
    before, after = staged[0][1].collect(), {r["doc_id"] for r in staged[0][2].collect()}
    for r in before:
        words, chars, symbols, dup, repeated = brute_rules(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        upper, lower = (sum(map(f, r["text"] or "")) for f in (str.isupper, str.islower))
        bad = words < 50 or 100 * repeated > 50 * words or 100 * symbols > 10 * words or 100 * dup > 50 * len(lines) or upper > 0.4 * max(1, upper + lower) or not 2 * words <= chars <= 20 * words
        assert (r["doc_id"] in after) != bad


def test_mix(staged):
    """Of each source its target, of each document twice its words at most, and runs of its own words."""
    before, mixed = staged[3][1].collect(), staged[3][2].collect()
    texts, source = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["source"] for r in before}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    held = [sum(n for i, n in size.items() if source[i] == s) for s in names]
    want = [0.0] * len(names)
    total, free = 1.5 * sum(held), [i for i, n in enumerate(held) if n]
    while free:  # what is over a source's cap is shared again by weight
        weight = {i: (5, 2, 1)[i % 3] for i in free}
        over = [i for i in free if total * weight[i] / sum(weight.values()) > 2 * held[i]]
        for i in over or free:
            want[i] = 2 * held[i] if over else total * weight[i] / sum(weight.values())
        total -= sum(want[i] for i in over)
        free = [i for i in free if i not in over] if over else []
    taken = {}
    for r in mixed:
        assert r["text"] in texts[r["doc_id"]] and r["source"] == source[r["doc_id"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert all(n <= 2 * size[i] for i, n in taken.items())
    for s, w in zip(names, want):
        assert abs(sum(n for i, n in taken.items() if source[i] == s) - w) <= 2


def test_pack(staged):
    """Each row once, batches within the budget, and no better boundaries by a plain dynamic program."""
    mixed, packed = staged[4][1].collect(), staged[4][2].collect()
    assert sorted((r["doc_id"], r["text"]) for r in packed) == sorted((r["doc_id"], r["text"]) for r in mixed)
    assert len({(r["batch_id"], r["slot"]) for r in packed}) == len(packed)
    budget, rows = 16_384, {}
    for r in packed:
        assert r["n_tokens"] == len(WORD.findall(r["text"])) <= r["bucket_length"]
        rows.setdefault(r["batch_id"], []).append(r)
    assert all(len(v) * v[0]["bucket_length"] <= budget or len(v) == 1 for v in rows.values())
    short = [r for r in packed if r["n_tokens"] <= budget]
    lengths = sorted({r["n_tokens"] for r in short})
    count = {n: sum(r["n_tokens"] == n for r in short) for n in lengths}
    cost = [[sum(count[x] * (lengths[j] - x) for x in lengths[i : j + 1]) for j in range(len(lengths))] for i in range(len(lengths))]
    best = cost[0]
    for _ in range(15):
        best = [min([best[j], *(best[i - 1] + cost[i][j] for i in range(1, j + 1))]) for j in range(len(lengths))]
    assert sum(r["bucket_length"] - r["n_tokens"] for r in short) == best[-1]


def test_run(spark, sf, staged):
    """The registered query gives what its stages give one by one, row for row."""
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(corpus_pipeline.run(spark, sf)) == rows(staged[-1][2])


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Null and repeated ids, null and empty texts and clashing columns go through all stages."""
    own = " ".join(f"only{i}here" for i in range(90))
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(own)))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or after.columns == docs.columns
        assert name == "length_packing" or not after.limit(1).isEmpty()
        docs = after
    assert any(r["text"] in own for r in docs.where("doc_id IS NULL").collect())


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in want.project(", ".join(columns)).fetchall())
