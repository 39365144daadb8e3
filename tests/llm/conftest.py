from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """Small documents with copies, near copies, shared passages, nulls, empties and a long one."""
    r = random.Random(11)
    out: list[str | None] = [None, "", "   \n\t", "one", "One", "two words", "TWO words", "a b c", "x" * 60, "x" * 200]
    passage = " ".join(words(r, 30))
    for _ in range(25):
        base = words(r, r.randrange(20, 160))
        out.append(" ".join(base))
        for _ in range(r.randrange(0, 4)):
            near = list(base)
            for _ in range(r.randrange(0, 4)):
                near[r.randrange(len(near))] = "edit%d" % r.randrange(99)
            out.append("\n".join(near) if r.random() < 0.2 else " ".join(near))
        if r.random() < 0.4:
            out.append(" ".join(words(r, 10)) + " é " + passage + " ü " + " ".join(words(r, 10)))
    out += [passage, passage.upper(), "日本語 " * 80, "日本語 " * 80 + "ß", " ".join(words(r, 9000)), "aaaa " * 300, "#" * 90]
    r.shuffle(out)
    return [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Repeated rows, a null id and extra columns with names that operators use themselves."""
    more = docs.limit(5).unionByName(docs.limit(5)).withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(docs.where("doc_id < 5")).unionByName(more).select("*", *[F.lit(1).alias(c) for c in ("id", "n", "mark", "key", "batch", "size", "bucket_id", "rank", "held", "a")])
