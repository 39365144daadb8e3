"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens by the vocabulary's own pattern.  Pre-tokens not seen
before by the worker are held as one ragged numpy array of symbols; every round finds
each sequence's lowest-rank pair and applies all of them at once, until no pair is
left.  What survives is counted, and the count is remembered for that pre-token.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); special
strings in a text count as one token each, which is the library's default; texts are
never truncated; repeated rows each give a row; an empty table gives an empty result.
Extra columns of the input are not read, so clashing names cannot arise.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens a worker remembers before it starts afresh (bounds its memory).
MEMO_ENTRIES = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankTable:
    """Merge ranks as sorted arrays, so that a batch of pairs is looked up at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for shown, b in byte_alphabet().items():
            self.first[b] = vocab[shown]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left * self.width + right
        order = np.argsort(key)
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = np.int64(len(pairs))
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], self.none)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence once all merges are done."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        ranks = self._ranks_at(np.arange(len(symbols)), symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            hit = (ranks == np.repeat(lowest, sizes)) & (ranks < self.none)
            # Of overlapping hits (a a a) the leftmost counts, then every other one.
            at = np.flatnonzero(hit)
            run_start = np.r_[True, np.diff(at) > 1][: len(at)]
            run_at = np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_at) % 2 == 0]
            symbols[at] = self.result[ranks[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            keep = np.repeat(lowest < self.none, sizes)  # finished sequences leave the batch
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # Only pairs with a new symbol have another rank.
            touched = np.zeros(len(symbols), bool)
            touched[now] = True
            touched[now[now > 0] - 1] = True
            again = np.flatnonzero(touched)
            ranks[again] = self._ranks_at(again, symbols, owner)
        return counts

    def _ranks_at(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each place; none at the end of a sequence."""
        out = np.full(len(at), self.none)
        some = np.flatnonzero(at + 1 < len(symbols))
        i = at[some]
        inside = owner[i] == owner[i + 1]
        i = i[inside]
        out[some[inside]] = self.pair_ranks(symbols[i], symbols[i + 1])
        return out


#: Unicode's White_Space characters (fixed values).
SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level vocabularies' pattern, for the standard library's engine, which is several
#: times faster than one with Unicode categories; letters come first, as they match most often.
PATTERN = rf" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@functools.lru_cache(maxsize=4)
def odd_characters(path: str) -> str:
    """The code points that the library's Unicode tables class otherwise than ours.

    Both split the same probe text; texts with such a character are later split by the
    library itself.
    """
    from tokenizers import Tokenizer

    split, pattern = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, re.compile(PATTERN)
    odd: set[int] = set()
    # Planes 4 to 13 are unassigned and 15 and 16 private in every version of the tables.
    points = [c for c in range(0xE0200) if not 0xD800 <= c < 0xE000 and not 0x40000 <= c < 0xE0000]
    for at in range(0, len(points), 20_000):
        block = points[at : at + 20_000]
        probe = "".join(f"a{c}1{c}." for c in map(chr, block))  # five characters a point
        theirs, ours = {x[1] for x in split(probe)}, {m.span() for m in pattern.finditer(probe)}
        odd.update(block[a // 5] for a, _ in theirs ^ ours)
    return "".join(map(chr, sorted(odd)))


class Counter:
    """Counts the tokens of whole texts; one per worker."""

    def __init__(self, path: str, odd: str):
        self.table, self.path, self.memo = RankTable(path), path, {}
        self.pattern, self.odd = re.compile(PATTERN), frozenset(odd)
        self.odd_ascii = frozenset(c for c in self.odd if c < "\x80")
        self.special = re.compile("|".join(re.escape(s) for s in self.table.specials)) if self.table.specials else None
        self._library = None

    def pieces(self, text: str) -> list[str]:
        if not self.odd.isdisjoint(text) if not text.isascii() else self.odd_ascii and not self.odd_ascii.isdisjoint(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        out, held, fresh = [], [], {}
        for text in texts:
            specials, parts = 0, (text,)
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                specials = len(parts) - 1
            pieces = [p for part in parts for p in self.pieces(part)] if len(parts) > 1 else self.pieces(text)
            known = list(map(self.memo.get, pieces))
            if None in known:
                fresh.update((p, None) for p, n in zip(pieces, known, strict=True) if n is None)
                held.append((len(out), pieces))
                out.append(specials)
                if sum(len(x) for _, x in held) > 200_000:
                    self._learn(fresh, held, out)
                    held, fresh = [], {}
            else:
                out.append(specials + sum(known))
        self._learn(fresh, held, out)
        return out

    def _learn(self, fresh: dict, held: list, out: list[int]) -> None:
        if fresh:
            new = list(fresh)
            learnt = dict(zip(new, self.table.count([p.encode() for p in new]).tolist(), strict=True))
            for at, pieces in held:
                out[at] += sum(n if (n := learnt.get(p)) is not None else self.memo[p] for p in pieces)
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo.update((p, n) for p, n in learnt.items() if len(p) <= 64)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; no shuffle."""
    odd = odd_characters(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, odd)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                n = counter.counts([t or "" for t in texts])
                size = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
