"""Document operators against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from quillon.llm.minhash import NearSettings, keep_one_of_each, near_duplicates
from quillon.llm.rules import RULES, Features, cascade_order, filter_documents, judge
from quillon.llm.suffix import SuffixSettings, dedup_digest, dedup_passages, front_code, front_decode, merge_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_sets(corpus, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, text, *_ in corpus:
        w = WORD.findall((text or "").translate(lower))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, corpus, size):
    sets = shingle_sets(corpus, size)
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(sets), links)
    got = {r["doc_id"]: r for r in near_duplicates(docs, settings=NearSettings(shingle=size)).collect()}
    assert {i: got[i]["component_id"] for i in got} == dict(enumerate(want))
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in got)


@pytest.mark.parametrize("size", [4, 9, 45, 180, 900, 1800])
def test_recall_of_the_bands_at_the_bound(size):
    """Pairs of exactly 0.8 similarity share a bucket, small sets and large ones alike."""
    import numpy as np

    from quillon.llm.minhash import Signer

    r, signer, missed = np.random.default_rng(size), Signer(NearSettings()), 0
    each = max(1, size // 9)  # 8 of 10 parts in common
    for _ in range(300):
        x = r.integers(0, 1 << 64, 10 * each, dtype=np.uint64)
        a, b = np.unique(x[: 9 * each]), np.unique(x[each:])
        missed += not (signer.bands(a) == signer.bands(b)).any()
    assert missed == 0


def test_links_that_the_first_star_misses(spark):
    """A path: the ends of a bucket's star are too far apart, neighbours are near enough."""
    text = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(6):
        rows.append((i, " ".join(text), "x"))
        text[i * 8 + 3] = f"new{i}"
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, extra string"), settings=NearSettings(shingle=1))
    assert {r["component_id"] for r in got.collect()} == {0}


def test_near_duplicates_odd_input(odd_docs, docs):
    rows = near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IS NULL").count() == 10


def brute_removal(corpus, length):
    first, out = {}, {}
    for i, text, *_ in sorted(corpus):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first.setdefault(raw[k : k + length], i) < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("settings", [SuffixSettings(), SuffixSettings(batch_bytes=3000, part_hashes=300, range_suffixes=60), SuffixSettings(length=30, gram=9, batch_bytes=9000, range_suffixes=100),
    SuffixSettings(batch_bytes=3000, range_suffixes=60, hot_suffixes=0, sort_suffixes=50), SuffixSettings(length=30, gram=9, batch_bytes=2000, range_suffixes=30, hot_suffixes=2)])
def test_repeated_passages(docs, corpus, settings):
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_digest(docs, settings=settings).collect()}
    assert got == brute_removal(corpus, settings.length)


def test_one_prefix_in_every_document(spark):
    """24 bytes that all documents have, each time in other surroundings, and some passages about them."""
    import random

    r = random.Random(5)
    prefix, rows = "the same twenty-four byt", []
    for i in range(300):
        around = ["".join(r.choices("abcdefgh ", k=r.randrange(30, 60))) for _ in range(4)]
        if i % 7 == 0 and rows:
            around[1], around[2] = rows[i // 2][1][-60:-10], around[2][:9] + rows[i // 3][1][:70]
        rows.append((i, prefix.join(around)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (20, 10**9):
        s = SuffixSettings(batch_bytes=1500, range_suffixes=100, hot_suffixes=hot)
        assert {r["doc_id"]: tuple(r)[1:] for r in dedup_digest(docs, settings=s).collect()} == brute_removal(rows, 50)


@pytest.mark.parametrize("seed", range(4))
def test_equal_strings_follow_from_the_order(seed):
    """Against all pairs of contexts, over two letters, so that nearly all prefixes are shared."""
    import random

    import numpy as np

    from quillon.llm.suffix import common_prefix, smallest_documents

    r, s = random.Random(seed), SuffixSettings(length=8, gram=3)
    made = set()
    for _ in range(120):
        before, after = r.randrange(0, 6), r.randrange(3, 9)
        if before + after >= 8:
            made.add(bytes(r.choices(b"ab", k=after)).ljust(8, b"\0") + bytes(r.choices(b"ab", k=before)).ljust(5, b"\0") + bytes([before + 1, after + 1]))
    keys = sorted(made)
    ids = np.array([r.randrange(1000) for _ in keys])
    same = np.array([0] + [common_prefix(a, b, 0) for a, b in zip(keys, keys[1:])])
    found = {(q, i): n for q, at, least in smallest_documents(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 15), same, ids, s) for i, n in zip(at.tolist(), least.tolist())}
    strings = {}
    for i, k in enumerate(keys):
        for q in range(6):
            if q <= k[-2] - 1 and 8 - q <= k[-1] - 1:
                strings.setdefault((q, k[: 8 - q], k[8 : 8 + q]), []).append(i)
    assert any(len(v) > 1 for v in strings.values())
    for (q, _, _), held in strings.items():
        for i in held:
            assert found.get((q, i), ids[i]) == min(ids[j] for j in held)


def test_ids_that_are_no_integers(spark):
    with pytest.raises(TypeError):
        dedup_digest(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_passages_cut_from_texts(odd_docs, docs, corpus):
    out = dedup_passages(odd_docs, chars_col="n_chars")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
    assert dedup_digest(docs.limit(0)).count() == 0
    # Documents with equal or null ids do not repeat each other.
    twice = docs.where("length(text) > 100").limit(3)
    same = twice.unionByName(twice).withColumn("doc_id", twice["doc_id"] * 0)
    assert {r["n_removed"] for r in dedup_digest(same).collect()} == {0}


def test_pieces_of_long_texts(docs, corpus, monkeypatch):
    from quillon.llm.suffix import Anchors, Batch, freeze

    import pyarrow as pa

    data = freeze(pa.table({"id": [i for i, *_ in corpus], "text": [t for _, t, *_ in corpus]}))

    def strings(piece):
        monkeypatch.setattr(Anchors, "PIECE", piece)
        at, first, last, doc, h, _ = Anchors(SuffixSettings()).of(Batch(data))
        return {(s, a, g) for a, f, e, g in zip(at, first, last, h) for s in range(f, e + 1)}

    assert strings(1 << 18) == strings(777)


def test_loser_tree():
    import random

    import numpy as np

    r, width = random.Random(3), 6
    for k in (1, 2, 3, 7):
        runs = [sorted({bytes(r.choices(b"ab", k=width)) for _ in range(r.randrange(0, 30))}) for _ in range(k)]
        decoded = [front_decode(front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, width)), width) if x else ([], []) for x in runs]
        assert [x for x, _ in decoded] == runs
        order, same = merge_runs(decoded, width)
        at, out = [0] * k, []
        for i in order:
            out.append(runs[i][at[i]])
            at[i] += 1
        assert out == sorted(x for run in runs for x in run)
        for a, b, n in zip(out, out[1:], same[1:]):
            assert a[:n] == b[:n] and (n == width or a[n] != b[n])


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(docs, corpus, odd_docs):
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    for i, text, *_ in corpus:
        want = brute_rules(text)
        assert tuple(got[i][1:6]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not any(rule.rejects(Features(text)) for rule in RULES))
    kept = filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in filter_documents(docs).collect()} == {i for i in got if got[i]["kept"]}
    assert judge(docs.limit(0)).count() == filter_documents(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(docs):
    order = cascade_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in RULES)


@pytest.mark.parametrize("seed", range(3))
def test_rule_features_on_random_texts(seed):
    import random

    r = random.Random(seed)
    for _ in range(60):
        text = "".join(r.choices("ab \n\t#é  |", k=r.randrange(0, 80)))
        f = Features(text)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute_rules(text)
