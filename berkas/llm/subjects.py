"""Subject areas of documents.

Words fall into a fixed number of hash buckets; a bucket's weight grows with its rarity over the corpus and with how often
its words recur inside one document, counted over all documents: words of a subject recur, turns of phrase and names do not.
The normalised vectors of all documents are clustered by bisecting k-means: leaves of large spread are split in two, level by
level; every pass over the stored vectors sums each leaf's documents where they lie, and only centres, counts and a few
documents to start from reach the driver.

A leaf takes its subjects from the labelled documents whose passages reach it and from the terms (buckets) that set subjects
apart. Each passage (a sentence; a card or receipt is one) of each document descends the tree to its leaf, which gives its
mixture of subjects; terms of subjects, counted over the passages of all documents by the leaves they lie in, sharpen it. A
document has the subjects that enough of its passages have: the mixture of its leaves.

Bounds: `BUCKETS` classes of words, `LEAVES` leaves, `LABELLED` passages of labelled documents to label the leaves by. All
else covers every document.

Edge cases: null, empty and one-mark texts have no passages and so no subject; a text of any length is read
whole; repeated labels and wrong ones are outvoted within a leaf; without labels no subject is given; repeated rows of a document
give the same rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berkas.session import stored

BUCKETS = 1 << 15
LABELLED = 60_000
LEAVES = 256
#: rounds of 2-means a level; leaves of at least this part of the largest spread are split together; documents per leaf to
#: take starting points from; a leaf of fewer documents is not split
ROUNDS, TOGETHER, STARTS, LEAST = 2, 0.3, 24, 8
NEAR = 0.25
ALONE = 0.4
RECURS = 0.35
#: what the terms of a passage must add up to: more than one term, as a single one may be a turn of phrase
SPOKEN = 4.0
#: least part of a term's passages that lie in documents of the subject it speaks for
MOSTLY = 0.35
SHARE = 0.22
# Abbreviations whose point ends no sentence.
ABBREVIATIONS = "jl|jln|gg|no|kel|kec|kab|ds|rt|rw|rm|gol|dr|drg|hj|tb|tk|wr|wrg|kd|pt|cv|bkl|apt|rest|cab|sdr|yth|mr|mrs|hal|tgl|ut|tim|utr|dlm|ry|idh|indh|tmr"


#: what stands between words; listed marks are found faster than letters are told from all else
BETWEEN = r"[\s0-9.,;:()/\"!?#%&*<=>\[\]\\^_`{}~@+|$'\u00A0\u00AD\u00AC\u00B0\u00AB\u00BB\u2010-\u2026-]+"


def passages(text: Column) -> Column:
    """Array of passages, each an array of word buckets. Sentences end at a mark before white space; a line break inside
    a sentence is a blank."""
    sentences = F.split(F.regexp_replace(F.lower(text), r"-\s*\n\s*", ""), rf"[.!?](?<!\b(?:{ABBREVIATIONS}|\p{{L}})[.!?])\s+|\n\s*\n")
    word = lambda s: F.filter(F.split(s, BETWEEN), lambda w: F.length(w) >= 3)
    return F.filter(F.transform(sentences, lambda s: F.transform(word(s), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))), lambda p: F.size(p) > 0)


def bucket_weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weight per bucket, and whether its words recur inside documents, from document and occurrence counts over all
    documents (docs: column p of passages). The counts are combined in each task first; BUCKETS rows reach the driver."""
    flat = F.flatten("p")
    counted = lambda words: {r["b"]: r["n"] for r in docs.select(F.explode(words).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    df, cf = counted(F.array_distinct(flat)), counted(flat)
    total = docs.count()
    w, recurs = np.zeros(BUCKETS, dtype=np.float32), np.zeros(BUCKETS, dtype=bool)
    for b, n in df.items():
        if n >= 3:
            common = n / (n + 0.005 * total)  # words of a few documents tell names, not subjects
            again = np.log(cf[b] / n)
            recurs[b] = again > RECURS
            w[b] = np.log((1 + total) / (1 + n)) * (again + 0.08) * common
    return w, recurs


class Rows:
    """Sparse rows of unit length, from lists of buckets."""

    def __init__(self, buckets: list, weights: np.ndarray) -> None:
        lens = np.fromiter((len(b) for b in buckets), dtype=np.int64, count=len(buckets))
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets]) if len(buckets) else np.zeros(0, np.int64)
        keys, n = np.unique(np.repeat(np.arange(len(buckets)), lens) * BUCKETS + flat, return_counts=True)
        row, idx = keys // BUCKETS, keys % BUCKETS
        val = weights[idx] * np.sqrt(n)
        on = val > 0
        row, self.idx, val = row[on], idx[on], val[on]
        norm = np.sqrt(np.bincount(row, weights=val * val, minlength=len(buckets)))
        self.val = (val / norm[row]).astype(np.float32)
        self.row = row
        self.ptr = np.r_[0, np.cumsum(np.bincount(row, minlength=len(buckets)))]

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def of(self, value: np.ndarray) -> np.ndarray:
        """The value of each entry's bucket."""
        return value[self.idx]


class Tree:
    """The tree of bisecting k-means. kids: first child of a node, -1 of a leaf; cut: first centre less the second one;
    centre: of each node; all over the `used` buckets."""

    def __init__(self, used: np.ndarray) -> None:
        self.place = np.full(BUCKETS, -1, dtype=np.int32)
        self.place[used] = np.arange(len(used), dtype=np.int32)
        self.used = used
        self.kids = np.array([-1])
        self.cut = np.zeros((1, len(used)), dtype=np.float32)
        self.centre = np.zeros((1, len(used)), dtype=np.float32)

    def leaf(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """The leaf that each of n rows descends to; (row, idx, val) are their entries."""
        node = np.zeros(n, dtype=np.int64)
        while (go := self.kids[node] >= 0).any():
            side = np.bincount(row, weights=val * self.cut[node[row], idx], minlength=n) < 0
            node = np.where(go, self.kids[node] + side, node)
        return node

    def near(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and how like its centre the row is."""
        on = self.place[rows.idx] >= 0
        row, idx, val = rows.row[on], self.place[rows.idx[on]], rows.val[on]
        node = self.leaf(row, idx, val, len(rows))
        return node, np.bincount(row, weights=val * self.centre[node[row], idx], minlength=len(rows))


_VECTOR = "h long, idx array<int>, val array<float>"


def vectors(docs: DataFrame, weights: np.ndarray, place: np.ndarray) -> DataFrame:
    """(h, idx, val): the normalised vector of every document (docs: doc_id, p) that has one, h a hash of its number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            r = Rows([np.concatenate(p) for p in b["p"]], weights)
            full = np.flatnonzero(np.diff(r.ptr) > 0)
            if len(full):
                yield pd.DataFrame({"h": b["h"].to_numpy()[full], "idx": [place[r.idx[r.ptr[i] : r.ptr[i + 1]]] for i in full], "val": [r.val[r.ptr[i] : r.ptr[i + 1]] for i in full]})

    return docs.select(F.xxhash64("doc_id").alias("h"), "p").mapInPandas(run, _VECTOR)


_PART = "node int, n long, total binary, h array<long>, idx array<array<int>>, val array<array<float>>"


def _passed(data: DataFrame, tree: Tree, watched: np.ndarray) -> list:
    """One pass: for each of the watched leaves the number of documents, the sum of their vectors and the `STARTS` documents
    of smallest hash. Summed in each task first, then leaf by leaf on the executors."""
    dims, kids, cut = len(tree.used), tree.kids, tree.cut
    which = np.full(len(kids), -1)
    which[watched] = np.arange(len(watched))

    def least(h: list, idx: list, val: list) -> tuple:
        o = sorted(range(len(h)), key=lambda i: (h[i], list(idx[i])))[:STARTS]
        return [h[i] for i in o], [idx[i] for i in o], [val[i] for i in o]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        t = Tree(np.zeros(0, dtype=int))
        t.kids, t.cut = kids, cut
        total, n = np.zeros((len(watched), dims)), np.zeros(len(watched), dtype=np.int64)
        start: dict[int, tuple] = {}
        for b in batches:
            lens = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            idx, val, h = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(0).to_numpy()
            row, ptr = np.repeat(np.arange(len(lens)), lens), np.r_[0, np.cumsum(lens)]
            slot = which[t.leaf(row, idx, val, len(lens))]
            on = slot[row] >= 0
            total += np.bincount(slot[row][on] * dims + idx[on], weights=val[on], minlength=total.size).reshape(total.shape)
            n += np.bincount(slot[slot >= 0], minlength=len(n))
            order = np.lexsort((h, slot))
            first = np.searchsorted(slot[order], np.arange(len(watched)))
            for k, a in enumerate(first):
                take = [i for i in order[a : a + STARTS] if slot[i] == k]
                if take:
                    old = start.get(k, ([], [], []))
                    start[k] = least(old[0] + [int(h[i]) for i in take], old[1] + [idx[ptr[i] : ptr[i + 1]].copy() for i in take], old[2] + [val[ptr[i] : ptr[i + 1]].copy() for i in take])
        keep = sorted(start)
        if not keep:
            return
        cols = [pa.array([int(watched[k]) for k in keep], pa.int32()), pa.array([int(n[k]) for k in keep], pa.int64()), pa.array([total[k].astype(np.float32).tobytes() for k in keep], pa.binary())]
        cols += [pa.array([start[k][0] for k in keep], pa.list_(pa.int64())), pa.array([[list(map(int, x)) for x in start[k][1]] for k in keep], pa.list_(pa.list_(pa.int32()))), pa.array([[list(map(float, x)) for x in start[k][2]] for k in keep], pa.list_(pa.list_(pa.float32())))]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "n", "total", "h", "idx", "val"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for node, n, total, h, idx, val in b.itertuples(index=False):
                new = [n, np.frombuffer(total, np.float32).astype(float), least(list(h), list(idx), list(val))]
                if node in held:
                    old = held[node]
                    new = [old[0] + n, old[1] + new[1], least(old[2][0] + new[2][0], old[2][1] + new[2][1], old[2][2] + new[2][2])]
                held[node] = new
        if held:
            yield pd.DataFrame([(k, n, t.astype(np.float32).tobytes(), *s) for k, (n, t, s) in sorted(held.items())], columns=["node", "n", "total", "h", "idx", "val"])

    return data.mapInArrow(run, _PART).repartition("node").mapInPandas(merge, _PART).collect()


def starts(start: list[tuple]) -> tuple[np.ndarray, np.ndarray] | None:
    """Two documents of a leaf to start 2-means from: the most central of some and the one least like it, as (idx, val)."""
    sims = np.zeros((len(start), len(start)))
    for i, (ai, av) in enumerate(start):
        for j in range(i):
            _, x, y = np.intersect1d(ai, start[j][0], return_indices=True)
            sims[i, j] = sims[j, i] = float((np.asarray(av)[x] * np.asarray(start[j][1])[y]).sum())
    a = int(sims.sum(1).argmax())
    sims[a, a] = 9
    return (start[a], start[int(sims[a].argmin())]) if len(start) > 1 else None


def bisected(data: DataFrame, used: np.ndarray, leaves: int = LEAVES) -> Tree:
    """The tree of bisecting k-means over all vectors (`vectors`, stored). The driver holds centres and starting points."""
    tree = Tree(used)
    size, spread, start = np.zeros(1, dtype=np.int64), np.zeros(1), {}

    def look(nodes: np.ndarray) -> None:
        for r in _passed(data, tree, nodes):
            total = np.frombuffer(r["total"], np.float32)
            length = float(np.linalg.norm(total))
            k = r["node"]
            size[k], spread[k], start[k] = r["n"], r["n"] - length, list(zip(r["idx"], r["val"]))
            tree.centre[k] = total / length if length > 0 else 0

    look(np.array([0]))
    while True:
        now = np.flatnonzero(tree.kids < 0)
        live = [i for i in now if size[i] >= LEAST and spread[i] > 1e-3 and len(start.get(i, ())) > 1]
        live = sorted(live, key=lambda i: (-spread[i], i))[: leaves - len(now)]
        live = [i for i in live if spread[i] >= TOGETHER * spread[live[0]]]
        if not live:
            return tree
        base, more = len(tree.kids), 2 * len(live)
        tree.kids = np.r_[tree.kids, np.full(more, -1)]
        tree.cut, tree.centre = (np.r_[x, np.zeros((more, len(used)), dtype=np.float32)] for x in (tree.cut, tree.centre))
        size, spread = np.r_[size, np.zeros(more, dtype=np.int64)], np.r_[spread, np.zeros(more)]
        for j, i in enumerate(live):
            tree.kids[i] = base + 2 * j
            (ai, av), (bi, bv) = starts(start[i])
            np.add.at(tree.cut[i], np.asarray(ai), np.asarray(av, dtype=np.float32))
            np.subtract.at(tree.cut[i], np.asarray(bi), np.asarray(bv, dtype=np.float32))
        for r in range(ROUNDS):
            if r:
                for i in live:
                    k = tree.kids[i]
                    if size[k] and size[k + 1]:
                        tree.cut[i] = tree.centre[k] - tree.centre[k + 1]
            size[base:], spread[base:] = 0, 0
            look(np.arange(base, base + more))


def leaf_subjects(tree: Tree, weights: np.ndarray, labelled: list[tuple[str, list]], names: list[str]) -> np.ndarray:
    """Node by subject mixture, rows sum to at most 1; a leaf that no subject sets apart has a zero row. labelled: (subject,
    passages) per labelled document and subject."""
    n, k = len(tree.kids), len(names)
    if not k:
        return np.zeros((n, 0), dtype=np.float32)
    # share of each subject's passages in each leaf; documents with several subjects count for all of them
    counts = np.full((n, k), 0.0)
    for s, ps in labelled:
        if s in names:
            r = Rows(ps, weights)
            if len(r.val):
                at, sim = tree.near(r)
                np.add.at(counts[:, names.index(s)], at[sim > NEAR], 1.0)
    total = counts.sum(0, keepdims=True)
    # subjects weigh the same however many labels they have; a little of all subjects keeps rare leaves undecided
    rate = counts / np.maximum(total, 1) * max(1.0, total.mean()) + 0.15
    mix = rate / rate.sum(1, keepdims=True)
    seen = counts.sum(1)
    out = np.zeros((n, k), dtype=np.float32)
    for i in np.flatnonzero(tree.kids < 0):
        lead = mix[i].max()
        if seen[i] >= 2 and lead >= 0.45:
            out[i] = np.where(mix[i] >= 0.2 * lead, mix[i], 0)
            out[i] /= out[i].sum()
    # the other leaves by the terms that set subjects apart from the whole
    profile = out.T @ tree.centre
    norm = np.sqrt((profile * profile).sum(1, keepdims=True))
    profile = profile / np.where(norm > 0, norm, 1)
    apart = np.maximum(profile - 1.5 * profile.mean(0), 0)
    norm = np.sqrt((apart * apart).sum(1, keepdims=True))
    terms = tree.centre @ (apart / np.where(norm > 0, norm, 1)).T
    for i in np.flatnonzero((tree.kids < 0) & (seen < 2)):
        if terms[i].max(initial=0) > 0.1:
            t = np.maximum(terms[i], 0) ** 2
            out[i] = t / t.sum() if t.max() / t.sum() > 0.5 else 0
    return out


def fitted(docs: DataFrame, labels: DataFrame, subjects: list[str]) -> dict:
    """The model: bucket weights, tree, leaf mixtures and terms. docs: doc_id, p; stored, as every pass reads it."""
    weights, recurs = bucket_weights(docs)
    used = np.flatnonzero(weights > 0)
    tree = Tree(used)
    data = stored(vectors(docs, weights, tree.place))
    tree = bisected(data, used)
    marked = labels.where("subject is not null").select("doc_id", "subject").distinct()
    got = docs.dropDuplicates(["doc_id"]).join(marked, "doc_id").select("doc_id", "subject", F.posexplode("p").alias("i", "b"))
    got = got.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "subject", "i").limit(LABELLED).groupBy("doc_id", "subject").agg(F.collect_list("b").alias("p")).collect()
    mix = leaf_subjects(tree, weights, [(r["subject"], r["p"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["subject"]))], subjects)
    model = {"weights": weights, "tree": tree, "mix": mix, "subjects": subjects, "terms": np.zeros((BUCKETS, len(subjects)), dtype=np.float32)}
    if subjects and mix.any():
        model["terms"] = discriminative(*term_counts(docs, model)) * recurs[:, None]
    return model


def term_counts(docs: DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket by subject: passages with the bucket in documents mostly of the subject, not decided otherwise themselves;
    passages of each subject; passages with each bucket. Counted over all documents, in each task first and then in
    sixteen sums; undecided passages of a document count with it, so that terms of rare leaves are learnt from the company
    they keep."""
    k = len(model["subjects"])

    def one(docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = [p for d in docs for p in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        rows = Rows(flat, model["weights"])
        got = decided(model, rows)
        per = np.zeros((len(docs), k))
        np.add.at(per, owner, got)
        total = per.sum(1)
        sure = (total > 0) & (per.max(1, initial=0) >= 0.6 * total)
        subject = np.where(sure, per.argmax(1), -1)[owner]
        own = np.where(got.max(1) > 0, got.argmax(1), subject)
        use = (subject >= 0) & (own == subject)
        at = use[rows.row]
        counts = np.bincount(rows.idx[at] * k + subject[rows.row[at]], minlength=BUCKETS * k).reshape(BUCKETS, k)
        return counts, np.bincount(subject[use], minlength=k), np.bincount(rows.idx, minlength=BUCKETS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, task = None, 0
        for b in batches:
            task = int(b["h"].iloc[0]) % 16 if len(b) else task
            for a in range(0, len(b), 2000):
                new = one(b["p"].iloc[a : a + 2000].to_list())
                total = new if total is None else tuple(x + y for x, y in zip(total, new))
        if total is not None:
            yield pd.DataFrame({"g": [task], "c": [np.concatenate([x.ravel() for x in total]).astype(np.int64).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for c in b["c"]:
                new = np.frombuffer(c, np.int64)
                total = new if total is None else total + new
        if total is not None:
            yield pd.DataFrame({"g": [0], "c": [total.tobytes()]})

    parts = docs.select(F.abs(F.xxhash64("doc_id")).alias("h"), "p").mapInPandas(run, "g int, c binary").repartition(16, "g").mapInPandas(merge, "g int, c binary").collect()
    flat = np.sum([np.frombuffer(r["c"], np.int64) for r in parts], axis=0) if parts else np.zeros(BUCKETS * (k + 1) + k, np.int64)
    return flat[: BUCKETS * k].reshape(BUCKETS, k), flat[BUCKETS * k : BUCKETS * k + k], flat[BUCKETS * k + k :]


def discriminative(counts: np.ndarray, size: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Bucket by subject: how far a term speaks for a subject (log of its lift), 0 for terms that speak for none."""
    seen = counts.sum(1)
    rate = (counts + 0.25) / (size + 1.0)
    lift = rate / rate.mean(1, keepdims=True)
    # a turn of phrase stands in many documents not yet decided too; a term of a subject hardly does
    out = np.where((seen[:, None] >= 6) & (lift > 4.0) & (counts >= MOSTLY * every[:, None]), np.log(lift), 0)
    return out.astype(np.float32)


def decided(model: dict, rows: Rows) -> np.ndarray:
    """Passage by subject, 1 for the one subject of a passage: from the mixture of its leaf and from the terms that speak for
    subjects; a row of zeros for a passage on no subject."""
    k = len(model["subjects"])
    node, sim = model["tree"].near(rows)
    leaf = np.where((sim > NEAR)[:, None], model["mix"][node], 0)
    one = np.zeros((len(rows), k), dtype=np.float32)
    if not k or not len(rows):
        return one
    if model["terms"].any():
        terms = np.stack([np.bincount(rows.row, weights=rows.of(model["terms"][:, j]), minlength=len(rows)) for j in range(k)], axis=1)
        score = terms + 2 * leaf
        ordered = np.sort(score, axis=1)
        margin = ordered[:, -1] - (ordered[:, -2] if k > 1 else 0)
        # a leaf alone decides where the passage lies close to it, as cards and receipts do; else its terms must agree
        ok = (margin > 0.8) & ((terms.max(1) > SPOKEN) | ((sim > ALONE) & (leaf.max(1) >= 0.5)))
    else:
        score = leaf
        ok = leaf.max(1) >= 0.5
    got = np.flatnonzero(ok)
    one[got, score[got].argmax(1)] = 1
    return one


def shares(model: dict, docs: list) -> np.ndarray:
    """Share of each subject in the subject passages of each document."""
    flat = [p for d in docs for p in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    out = np.zeros((len(docs), len(model["subjects"])), dtype=np.float32)
    if not flat:
        return out
    one = np.concatenate([decided(model, Rows(flat[a : a + 20_000], model["weights"])) for a in range(0, len(flat), 20_000)])
    np.add.at(out, owner, one)
    total = out.sum(1, keepdims=True)
    return out / np.where(total > 0, total, 1)


def subject_shares(docs: DataFrame, model: dict, least: float = 0.0) -> DataFrame:
    """(doc_id, subject, share) of docs (doc_id, p)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shares(model, b["p"].to_list())
            i, j = np.nonzero(s > max(least, 1e-9))
            if len(i):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i], "subject": [model["subjects"][k] for k in j], "share": s[i, j].astype(float)})

    return docs.select("doc_id", "p").mapInPandas(run, "doc_id long, subject string, share double")
