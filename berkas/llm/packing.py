"""Filling containers of fixed capacity with documents.

Large-item matching: a document above a third of the capacity shares its container with at most one other such document;
they are paired greedily, the largest with the largest that fits, and smaller documents then fill the remaining gaps,
largest first, each into the smallest gap that holds it. A document is split only if it alone exceeds the capacity: into
pieces of exactly the capacity and a rest, which is packed like a document.

Documents of one length are alike, so the packing is computed on the counts per length (at most `capacity` numbers, over
all documents) and comes out as ranges of ranks per length; every document then finds its container by its rank among
those of its length. The rank is taken in chunks, so a length that a third of all documents share is no bottleneck.

Edge cases: null and empty texts have no tokens and get no container (bin_id is null); a text of any length is read
whole; equal lengths are told apart by document number; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: the vocabulary file of a public tokenizer; on a cluster it has to lie at one path on all workers, or goes along with the
#: job (`--files`) and is named here. TOKENIZER_FILE in the environment of the driver names another.
TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A tokenizer of a vocabulary file, loaded once a process."""
    if path not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # the split pattern that the byte-level vocabulary was made with
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _ENCODERS[path] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _ENCODERS[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            _ENCODERS[path] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _ENCODERS[path]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text column, 0 for null."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = encoder(tokenizer)
        for s in batches:
            yield pd.Series(count(s.fillna("").to_list()), dtype="int32")

    return run(text)


class Packing:
    """Containers grouped by content: `ranges` has rows (size, rank_from, rank_to, bin_from, per_bin): the documents of a
    size with ranks in [rank_from, rank_to) lie in containers bin_from + (rank - rank_from) // per_bin."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.bins = 0
        self.ranges: list[tuple[int, int, int, int, int]] = []
        self.taken: dict[int, int] = {}
        self.gaps: list[int] = []
        self.free: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, number of bins)
        left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
        large = sorted(s for s in left if 3 * s > capacity)
        # partners: large sizes that may still have items, found by their place; places once empty are skipped for good
        below = list(range(len(large)))  # below[i]: the nearest place at or under i with items left, by path halving

        def holds(i: int) -> int:
            while i >= 0 and not left[large[i]]:
                below[i] = below[i] if below[i] < i else i - 1
                step = below[i]
                if step >= 0 and below[step] < step:
                    below[i] = below[step]
                i = below[i]
            return i

        top = len(large) - 1
        while (top := holds(top)) >= 0:
            a = large[top]
            i = holds(bisect.bisect_right(large, capacity - a) - 1)
            b = large[i] if i >= 0 else None
            if b is None:
                k = left[a]
                at = self._open(k)
                self._put(a, k, at, 1)
                self._gap(capacity - a, at, k)
                left[a] = 0
            elif b == a:
                k = left[a] // 2
                if k:
                    at = self._open(k)
                    self._put(a, 2 * k, at, 2)
                    self._gap(capacity - 2 * a, at, k)
                    left[a] -= 2 * k
                if left[a]:  # an odd one: with the next smaller large one, if any
                    i = holds(top - 1)
                    if i >= 0:
                        b = large[i]
                        at = self._open(1)
                        self._put(a, 1, at, 1)
                        self._put(b, 1, at, 1)
                        self._gap(capacity - a - b, at, 1)
                        left[b] -= 1
                    else:
                        at = self._open(1)
                        self._put(a, 1, at, 1)
                        self._gap(capacity - a, at, 1)
                    left[a] = 0
            else:
                k = min(left[a], left[b])
                at = self._open(k)
                self._put(a, k, at, 1)
                self._put(b, k, at, 1)
                self._gap(capacity - a - b, at, k)
                left[a] -= k
                left[b] -= k
        for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
            n = left[s]
            while n:
                i = bisect.bisect_left(self.gaps, s)
                if i < len(self.gaps):
                    g = self.gaps[i]
                    at, k = self._take(g)
                else:
                    g, k = capacity, -(-n // (capacity // s))
                    at = self._open(k)
                t = g // s  # an item fits best where its like has just made the gap smaller
                full = min(k, n // t)
                if full:
                    self._put(s, full * t, at, t)
                    self._gap(g - t * s, at, full)
                    n -= full * t
                if full < k:
                    rest = at + full
                    if n:
                        self._put(s, n, rest, n)
                        self._gap(g - n * s, rest, 1)
                        n, rest = 0, rest + 1
                    self._gap(g, rest, at + k - rest)

    def _open(self, k: int) -> int:
        at, self.bins = self.bins, self.bins + k
        return at

    def _put(self, size: int, n: int, at: int, per_bin: int) -> None:
        r = self.taken.get(size, 0)
        self.ranges.append((size, r, r + n, at, per_bin))
        self.taken[size] = r + n

    def _gap(self, g: int, at: int, k: int) -> None:
        if g > 0 and k > 0:
            if g not in self.free:
                bisect.insort(self.gaps, g)
                self.free[g] = []
            self.free[g].append((at, k))

    def _take(self, g: int) -> tuple[int, int]:
        got = self.free[g].pop()
        if not self.free[g]:
            del self.free[g]
            self.gaps.remove(g)
        return got


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens) of docs (doc_id, n_tokens): one piece, or several of a document above the
    capacity; a document without tokens has one piece of none."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    x = docs.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece") * capacity
    return x.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("n_tokens"))


def packed(docs: DataFrame, capacity: int, *, chunk_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, bin_id): every piece with its container. docs: doc_id, n_tokens, stored."""
    p = pieces(docs, capacity)
    counts = p.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    total = sum(r["n"] for r in counts)
    chunks = max(1, -(-total // chunk_rows))
    plan = Packing({r["n_tokens"]: r["n"] for r in counts}, capacity)
    # rank among the pieces of a size: the pieces in chunks before, then the place in the chunk
    p = p.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    if chunks > 1:
        per = p.where("n_tokens > 0").groupBy("n_tokens", "chunk").agg(F.count("*").alias("c"))
        before = per.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
        p = p.join(before.select("n_tokens", "chunk", F.coalesce("before", F.lit(0)).alias("before")), ["n_tokens", "chunk"], "left")
    else:
        p = p.withColumn("before", F.lit(0))
    p = p.withColumn("rank", F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("n_tokens", "chunk").orderBy("doc_id", "piece")) - 1)
    by_size: dict[int, list] = {}
    for size, a, b, at, per_bin in plan.ranges:
        by_size.setdefault(size, []).append((a, at, per_bin))
    table = {s: tuple(np.asarray(c, dtype=np.int64) for c in zip(*r)) for s, r in by_size.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full(len(b), -1, dtype=np.int64)
            sizes, rank = b["n_tokens"].to_numpy(), b["rank"].to_numpy()
            for s in np.unique(sizes):
                if s in table:
                    at = np.flatnonzero(sizes == s)
                    start, first, per_bin = table[s]
                    i = np.searchsorted(start, rank[at], side="right") - 1
                    out[at] = first[i] + (rank[at] - start[i]) // per_bin[i]
            ids = pd.array(out, dtype="Int64")
            ids[out < 0] = pd.NA
            yield b[["doc_id", "piece", "start_token", "n_tokens"]].assign(bin_id=ids)

    return p.select("doc_id", "piece", "start_token", "n_tokens", "rank").mapInPandas(place, "doc_id long, piece int, start_token int, n_tokens int, bin_id long")
