"""Token counts, chats, pages, the classifier and vectors."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat
from quillon.llm.classifier import FitSettings, train_and_score
from quillon.llm.embeddings import CapSettings, link_vectors
from quillon.llm.html import extract_pages, main_text
from quillon.llm.tokens import RankTable, count_tokens

P = pytest.importorskip("public_tokenizers")


def test_token_counts(docs, corpus, odd_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t, *_ in corpus]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (want[i] > 512) for i, t in enumerate(texts))
    assert count_tokens(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    assert count_tokens(odd_docs, P.path("byte_bpe_50k.json")).count() == odd_docs.count()


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    from quillon.llm.tokens import Counter, odd_characters

    path = P.path("byte_bpe_50k.json")
    library, counter, r = Tokenizer.from_file(path), Counter(path, odd_characters(path)), random.Random(1)
    alphabet = "ab'st  \n\té1²½Ⅷ日 ​\x1c\x85_-=😀́" + "<|endoftext|>"
    texts = ["".join(r.choices(alphabet, k=r.randrange(0, 60))) for _ in range(800)] + ["a" * 5000, "<|endoftext|>" * 3, "x<|endoftext|> y"]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x1F000)])) for _ in range(30)) for _ in range(300)]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_one_very_long_pre_token():
    """Tens of thousands of letters without a space, in time that allows such texts."""
    import time

    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    text = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyz", k=40_000))
    began = time.perf_counter()
    got = RankTable(path).count([text.encode(), b"a", text[:5000].encode()])
    assert time.perf_counter() - began < 20
    assert got.tolist() == [len(Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids) for x in (text, "a", text[:5000])]


def test_merges_take_lowest_ranks_first():
    table, r = RankTable(P.path("byte_bpe_50k.json")), random.Random(0)

    def one_by_one(raw):
        s = [int(table.first[b]) for b in raw]
        while len(s) > 1:
            ranks = table.pair_ranks(np.array(s[:-1]), np.array(s[1:]))
            i = int(ranks.argmin())
            if ranks[i] == table.none:
                break
            s[i : i + 2] = [int(table.result[ranks[i]])]
        return len(s)

    words = [bytes(r.choices(b"abeinost ", k=r.randrange(1, 30))) for _ in range(300)] + [b"aaaaaaa", b"a"]
    assert table.count(words).tolist() == [one_by_one(w) for w in words]


# --- chats ---


def test_template_language():
    render = chat.compile_template("{% for m in messages %}{% if loop.first %}[{% elif not loop.last and m.x == 'b' %}|{% else %}{{ ',' }}{% endif %}{{ m['x'] | upper }}{% endfor %}]")
    assert render([{"x": "a"}, {"x": "b"}, {"x": "c"}])[0] == "[A|B,C]"
    for bad in ("{{ a.__class__ }}", "{{ f() }}", "{% import x %}", "{{ a | nope }}", "{% if a %}", "{% endif %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    tree = chat.fold_block(chat.parse("{{ 'a' + 'b' }}{% if 1 == 2 %}x{% else %}c{% endif %}{% if not true or m %}d{% endif %}"))
    assert tree[0] == ("text", "abc") and tree[1][0] == "if" and len(tree) == 2


def test_escape_is_reversible():
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choices("<|\\>ab\n", k=r.randrange(0, 12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chats(spark):
    r, rows = random.Random(5), []
    for conv in range(12):
        for turn in range(r.randrange(1, 6)):
            text = r.choice([None, "", "plain", "<|im_end|>\n<|im_start|>assistant\nno", "a<", "<\\|", "ü\n"])
            rows.append((conv if conv else None, r.choice([turn, 0, None]), r.choice(["user", "assistant", "system", None, "a\nb"]), text, "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chats(df)
    got = {x["conv_id"]: x for x in chat.digest_chats(formatted).collect()}
    texts = {x["conv_id"]: x["formatted"] for x in formatted.collect()}
    by = {}
    for conv, turn, role, text, _ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (x["loss_chars"], x["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x["formatted_chars"] == len(texts[conv])
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


# --- pages ---

LONG = "Long enough to count as a paragraph of the main text of this page, by any measure that one could take."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<script>var a='<p>no</p>'</script>", ""),
        (f"<nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c<p>d&nbsp;&eacute;</article><footer>no</footer>", "T a & b c d é"),
        ("<article><p>x<div class='ad'>buy</div><aside>no</aside><form>f</form><p>y</article>", "x y"),
        ("<article><p>text <b>bold<p>next", "text bold next"),
        ("<article>a<section class='comments'><article>reader</article></section></article>", "a"),
        (f"<div class='menu'><a href=x>One</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div id='sidebar'>s</div><footer>f</footer>", f"{LONG} {LONG}"),
        (f"<header>Site</header><p>{LONG}</p><div class='cookie-notice'>ok?</div><style>p{{}}</style><!-- c --><p>{LONG}", f"{LONG} {LONG}"),
        ("<nav><ul><li><a>x</a><article><p>inside</p></article>", "inside"),
        ("<article><p>cut off &amp; <a href='", "cut off &"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


LINKS = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li><li><a href=3>Third source</a></li></ul>"
SOURCES = "First source Second source Third source"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p>{LINKS}<p>{LONG}</p></div>", f"{LONG} {LONG} {SOURCES} {LONG}"),
        (f"<div><p>{LONG}</p>{LINKS}<p>Short.</p>{LINKS}<p>{LONG}</p></div>", f"{LONG} {SOURCES} Short. {SOURCES} {LONG}"),
        (f"<div><p>{LONG}</p><p><a href=1>Linked</a></p><p>{LONG}</p></div>", f"{LONG} Linked {LONG}"),
        (f"<div>{LINKS}<p>{LONG}</p>{LINKS}</div>", LONG),
        (LINKS, ""),
        (f"<p>a</p>{LINKS}<p>b</p>{LINKS}", f"a {SOURCES} b"),
    ],
)
def test_lists_of_links_part_no_text(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Card</p></article><div><p>{LONG}</p></div>", f"{LONG} {LONG} Card {LONG}"),
        (f"<article><p>Card</p></article><div><p>{LONG}</p></div>{LINKS}", LONG),
        (f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><div><p>{LONG}</p></div>", f"T {LONG} {LONG}"),
        (f"<article><p>{LONG}</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG} {LONG}"),
        (f"<p>near</p><main><article><p>{LONG}</p></article><p>tail</p></main><p>near</p>", f"{LONG} tail"),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", LONG),
        (f"{LINKS}<article><p>{LONG}</p>{LINKS}</article>{LINKS}", f"{LONG} {SOURCES}"),
        (f"<p>Site</p>{LINKS}<article><h1>T</h1><p>b</p></article>{LINKS}<p>Imprint</p>", "T b"),
    ],
)
def test_marked_article_is_a_hint(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<article><h1 class='post-header'>Head</h1><p>{LONG}</p></article>", f"Head {LONG}"),
        (f"<article><p class='legal-analysis'>Law</p><p class=related>Kin</p><p>{LONG}</p></article>", f"Law Kin {LONG}"),
        (f"<main class='search-page'><p>{LONG}</p></main>", LONG),
        (f"<article><label>Label</label><div class='article-footer-note'>Note</div><p>{LONG}</p></article>", f"Label Note {LONG}"),
        (f"<article><p>{LONG}</p><div class='x comments'>c</div><div class=share>s</div><p class=ad>buy</p><form><label>no</label></form></article>", LONG),
        (f"<div class='page-footer-links'>f</div><p class='search-intro'>in</p><p>{LONG}</p>", f"in {LONG}"),
    ],
)
def test_styling_costs_an_article_nothing(html, want):
    assert main_text(html) == want


def test_lengths_decide_within_marks():
    """The same lines give the same text whether an article is marked or not."""
    r = random.Random(6)
    for _ in range(50):
        inner = "".join(f"<p>{'word ' * r.choice([1, 2, 30, 60])}</p>" for _ in range(r.randrange(1, 9)))
        if len(main_text(f"<div>{inner}</div>")) > 300:
            assert main_text(f"<article>{inner}</article>") == main_text(f"<div>{inner}</div>")


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</span>" * 100_000, "<span><article>" + "<div>" * 50_000 + "</span>" * 50_000, "<nav>" + "<article>" * 50_000, "<a '>" * 50_000 + '<b ">' * 50_001])
def test_time_is_linear_in_markup(page):
    import time

    began = time.perf_counter()
    main_text(page + "x")
    assert time.perf_counter() - began < 10


def test_pages(spark, sf):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in extract_pages(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|a|i|em)>", "", inside))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert extract_pages(pages.limit(0)).count() == 0


# --- classifier ---


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = (train_and_score(d, labels) for d in (docs, docs.withColumn("lang", F.lit("x")).repartition(7)))
    rows = {r["doc_id"]: r for r in a.collect()}
    assert len(rows) == docs.count() and rows == {r["doc_id"]: r for r in b.collect()}
    right = total = 0
    for r in labels.collect():
        x = rows[r["doc_id"]]
        assert x["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3)
        if x["held_out"]:
            total += 1
            right += x["predicted"] == r["quality"]
    assert right / total > 0.93


def test_score_is_the_calibrated_difference(spark):
    """Each score again, from the model's dictionaries and two numbers, with the compressor alone."""
    import zstandard

    from quillon.llm.classifier import fit, score

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels)
    size = {}
    for name, content in (("good", model.good), ("bad", model.bad)):
        c = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        size[name] = lambda raw, c=c: sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
    got = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    assert model.slope > 0
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        d = (size["bad"](raw) - size["good"](raw)) / (len(raw) + 25)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * d))), abs=1e-9)


def test_score_reads_text_alone(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in train_and_score(docs.withColumn("lang", F.lit(x)).withColumn("source", F.lit(x)), y).collect()} for x, y in (("x", labels), ("y", flipped)))
    assert a == b


def test_classifier_odd_input(docs, odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in train_and_score(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in train_and_score(docs, one).collect())
    few = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    assert train_and_score(odd_docs, few, FitSettings(fit_docs=5)).count() == odd_docs.count()
    assert train_and_score(docs.limit(0), few).count() == 0


# --- vectors ---


def brute_links(rows, bound=0.98):
    n = len(rows)
    x = [None if v is None or lab is None or len(v) != 16 or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, np.float64) for _, v, lab in rows]
    links, up = [0] * n, list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= bound:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


@pytest.mark.parametrize("block", [1500, 20])
def test_vectors(spark, block):
    r = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        base = r.standard_normal(16)
        for _ in range(r.integers(1, 5)):
            rows.append((len(rows), (base + r.standard_normal(16) * r.choice([0, 0.02, 0.1])).astype(np.float32).tolist(), int(r.integers(0, 2))))
    base = r.standard_normal(16)
    rows += [(len(rows) + i, (base + r.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1) for i in range(70)]
    odd = [None, [], [0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 15, [5.0] * 16, [1.0] * 16]
    rows += [(len(rows) + i, v, 1) for i, v in enumerate(odd)]
    rows += [(len(rows) + i, [1.0] * 16, None) for i in range(2)]
    links, root = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit(1))
    got = {x["vec_id"]: x for x in link_vectors(df, CapSettings(block=block)).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == links
    assert [got[i]["component_id"] for i in range(len(rows))] == root
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values())
    assert link_vectors(df.limit(0)).count() == 0


def test_vectors_of_other_lengths(spark):
    """A stray longer vector turns nothing off; vectors link within their label and length."""
    r, rows = np.random.default_rng(9), []
    for dims, pairs in ((16, 50), (17, 2), (3, 1), (1, 1)):
        for _ in range(pairs):
            v = r.standard_normal(dims).astype(np.float32).tolist()
            rows += [(len(rows), v, 1), (len(rows) + 1, [2.0 * c for c in v], 1)]
    strays = [([1.0] * 65, None), ([math.nan] * 65, 1), ([1.0] * 64, 1), ([0.0] * 80, 1)]
    rows += [(len(rows) + i, v, lab) for i, (v, lab) in enumerate(strays)]
    got = {x["vec_id"]: x for x in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    usable = len(rows) - len(strays)
    for i in range(len(rows)):
        paired = i < usable
        assert (got[i]["n_links"] > 0) == paired and got[i]["kept"] == (not paired or got[i]["component_id"] == i)
        assert not paired or len(rows[got[i]["component_id"]][1]) == len(rows[i][1])
    assert sum(got[i]["n_links"] == 1 for i in range(usable)) >= usable - 6


def test_recall_at_the_bound():
    """Pairs at exactly the bound: more than 99.9 in 100 share a filter."""
    from quillon.llm.embeddings import cap_bound, codes, decode

    r, s = np.random.default_rng(2), CapSettings()
    x = r.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((4000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * z
    for words in (48, 200, 1000):
        code = codes(64, words, s.seed)
        bound = cap_bound(code, s.list_size, s.seed)
        shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(decode(x, code, bound, s.least_list), decode(y, code, bound, s.least_list))]
        assert np.mean(shared) > 0.999
