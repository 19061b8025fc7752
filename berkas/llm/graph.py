"""Connected components of a large edge table, and the pairs within buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.session import _STORED, clear_stored, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) with the smallest node of the component as label, by taking the neighbours' smallest label and
    jumping along labels until nothing changes. edges must be stored; every round writes its labels to the shared
    folder and deletes those of the round before, so lineage stays short and a lost executor costs one round. Rounds grow
    with the logarithm of the longest path, not with the number of nodes; nothing but a count reaches the driver."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionAll(edges.select(F.col(b).alias("node"), F.col(a).alias("other")))
    since = len(_STORED)
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("l")), "other").groupBy("node").agg(F.min("l").alias("l"))
        better = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("l"))
        jump = labels.select(F.col("node").alias("l"), F.col("label").alias("ll"))
        new = stored(better.join(jump, "l", "left").select("node", F.least("l", F.coalesce("ll", "l")).alias("label"), (F.least("l", F.coalesce("ll", "l")) != F.col("label")).alias("changed")))
        clear_stored(since, -1)  # the labels of the round before
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels


def meetings(left: DataFrame, right: DataFrame, key: str, part: str, *, block: int = 1000) -> DataFrame:
    """Every pair of a row of `left` and a row of `right` with equal `key`; their other columns must differ in name. The
    rows of `right` under one key are dealt by the column `part` into blocks of some `block` rows, each of which meets
    all rows of `left`, so a key that very many rows hold is spread over many tasks and no pair is left out."""
    big = stored(right.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"))
    if big.isEmpty():
        return left.join(right, key).drop(key)
    blocks = F.coalesce("blocks", F.lit(1))
    x = left.join(big, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    y = right.join(big, key, "left").withColumn("salt", F.pmod(F.xxhash64(part), blocks).cast("int")).drop("blocks")
    return x.join(y, [key, "salt"]).drop(key, "salt")


def dealt(rows: DataFrame, by: str, block: int) -> DataFrame:
    """`rows` with every bucket of more than `block` rows replaced by one bucket for each pair of its blocks, to which both
    blocks go, sorted by bucket within tasks. by: tells rows of a bucket apart; cross tells a bucket of two blocks, part the block of a
    row there. Every pair of rows meets in one bucket."""
    rows = rows.withColumns({"part": F.lit(0), "cross": F.lit(False)})
    big = stored(rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"))
    if big.isEmpty():
        return rows.repartition("bucket").sortWithinPartitions("bucket")
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    x = rows.drop("part", "cross").join(big, "bucket").withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("bucket", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))).withColumn("cross", F.col("part") != F.col("other"))
    rows = rows.join(big, "bucket", "left_anti").unionByName(x.select(*rows.columns))
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Batches of rows sorted by bucket, cut where buckets end, with the number of the bucket of each row, from 0; buckets of one row are left out."""

    def shared(parts: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
        t = pa.Table.from_batches(parts)
        group = numbered(t)
        t = t.filter(pa.array(np.bincount(group)[group] > 1)).combine_chunks()
        if t.num_rows:
            yield numbered(t), t

    def numbered(t: pa.Table) -> np.ndarray:
        bucket = t.column("bucket").to_numpy()
        return np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1

    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        bucket = b.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut or rest and rest[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield from shared([*rest, b.slice(0, cut)] if cut else rest)
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield from shared(rest)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of every i, size[i] of them, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def shortened(word: str, letters: int) -> set[str]:
    """The word, from four letters on also with up to so many letters left out."""
    out = last = {word}
    for _ in range(letters if len(word) >= 4 else 0):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def sharing(group: np.ndarray, row: np.ndarray, key: np.ndarray, *, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different rows (x < y) of one group that share a key, some `most` at a time. row, key: an entry per key of a row;
    group: of each row."""
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + group[row].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.lexsort((row, mixed))
    mixed, row = mixed[order], row[order]
    start = np.flatnonzero(np.r_[True, mixed[1:] != mixed[:-1]])
    length = np.diff(np.r_[start, len(mixed)])
    later = np.repeat(start + length, length) - np.arange(len(mixed)) - 1  # entries of the same key that follow
    at = np.flatnonzero(later)
    total = np.cumsum(later[at])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        n = later[at[i:j]]
        x = np.repeat(at[i:j], n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        x, y = row[x], row[y]
        both = np.unique((x * len(group) + y)[(x != y) & (group[x] == group[y])])
        yield both // len(group), both % len(group)
        i = j
