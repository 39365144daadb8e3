"""Quality rules as a short-circuit cascade.

Each rule is a test on lazily computed features of one whole text.  On a bounded sample,
in the tasks that read it, the time and the rejections of every rule are measured; the
rules then run in order of rejections per second, and a document leaves at its first
rejection.  The order decides
only the work done: a document is kept if and only if no rule rejects it, so reruns agree.

Defined cases: a null or empty text has no words and is rejected (fewer than MIN_WORDS);
very long texts are read whole; ties between rules keep their listed order; repeated rows
are each judged; an empty table gives an empty result.  ``filter_documents`` returns the
input's own columns and adds none, so clashing names cannot arise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._store import give_back

#: Words are runs of anything but ASCII white space, which is how bytes.split() cuts.
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


class Features:
    """Of one text; each is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        word = np.fromiter((ids.setdefault(w, len(ids)) for w in self.words), np.int64, n)
        pair = word[:-1] * len(ids) + word[1:]
        if len(ids) >= 2_000_000:  # else three ids would not fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * len(ids) + word[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def upper_share(self) -> float:
        """Of the characters that have case."""
        upper = sum(map(str.isupper, self.text))
        lower = sum(map(str.islower, self.text))
        return upper / max(1, upper + lower)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda f: f.n_words < MIN_WORDS, True),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words, True),
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("duplicate_lines", lambda f: 100 * f.n_dup_lines > 50 * len(f.lines)),
    Rule("capitals", lambda f: f.upper_share > 0.4),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
)


def _each(batches: Iterator[pa.RecordBatch], step: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def cascade_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_docs: int = 400, sample_partitions: int = 8) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``sample_docs`` documents.

    At most ``sample_partitions`` partitions, spread evenly, measure their share where they
    are read; only a time and a count for each rule leave a task.
    """
    share = -(-sample_docs // sample_partitions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for part in _each(batches):
            for text in part.column(0).slice(0, share - seen).to_pylist():
                seen += 1
                for i, rule in enumerate(rules):
                    fresh, began = Features(text), time.perf_counter()
                    hits[i] += rule.rejects(fresh)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int64()), pa.array(spent), pa.array(hits, pa.int64())], names=["rule", "spent", "hits"])

    measured = docs.select(F.col(text_col).alias("text")).sample(0.1, seed=7).mapInArrow(measure, "rule long, spent double, hits long").rdd
    n = measured.getNumPartitions()
    chosen = sorted({n * i // sample_partitions for i in range(sample_partitions)}) if n else []
    spent, hits = [0.0] * len(rules), [0] * len(rules)
    for r in docs.sparkSession.sparkContext.runJob(measured, list, chosen):
        spent[r["rule"]] += r["spent"]
        hits[r["rule"]] += r["hits"]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -hits[i] / max(spent[i], 1e-9))]


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with; no shuffle."""
    order = cascade_order(docs, text_col, rules)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            keep = []
            for text in part.column(at).to_pylist():
                f = Features(text)
                keep.append(not any(rule.rejects(f) for rule in order))
            yield part.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, the five base figures, base_failed, kept and the rule that rejected first."""
    order = cascade_order(docs, text_col, rules)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            columns: list[list] = [[] for _ in range(8)]
            for text in part.column(1).to_pylist():
                f = Features(text)
                rejected = next((rule.name for rule in order if rule.rejects(f)), None)
                values = (*(getattr(f, x) for x in figures), any(r.rejects(f) for r in rules if r.base), rejected is None, rejected)
                for column, v in zip(columns, values, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, *figures, "base_failed", "kept", "rejected_by"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {', '.join(f'{x} long' for x in figures)}, base_failed boolean, kept boolean, rejected_by string")
