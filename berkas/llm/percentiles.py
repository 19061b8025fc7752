"""Exact percentiles per group over very many values, and summaries that combine.

Distributed multi-select: every chunk of rows proposes, for each group, the medians of its recursive halves (the ends of
equal slices of its sorted values; six halvings in one go do the work of six rounds). The weighted order of all proposals
gives two pivots around each wanted rank, with proven bounds on the ranks below and above them. Values below, at, between
and above the pivots are counted; the ranges outside are discarded, and the round is repeated on what lies strictly
between until the rank falls on a pivot or every slice holds one value; that is the percentile, exactly. A group whose chunks are small is done in one round.

The proposals are also the form that combines: summaries of separate days or files are put side by side (`unionAll`), and
`bounds` gives each percentile from them with its error in ranks: at most the sum of (slice width - 1) over the chunks,
which is at most n / slices. The proposals of many chunks are merged in a tree (`merged`), `FAN` at a time, so no task holds
those of all chunks of a group; each level adds its slice width to the error, and the rounds above make up for it.

The ranges still open go along with each task where they are few (`PAGE`); else the measurements are joined with them by
group, so the table is read once a round, however many groups are open.

A percentile p of n values is the value of rank ceil(p * n), the lower one of a tie; so it is always a measured value.

Edge cases: nulls, NaN and negative values are not measurements and are left out; a group without any gives no row; a null
group key is a group of its own; repeated records count once; ties are counted three ways, so equal values cost nothing;
an empty table gives no rows; one group may hold any share of the rows, as no group is ever gathered in one task before
it has been cut down to slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 64
FINE = 2048
CHUNK = 250_000
PAGE = 20_000
FAN = 64
SUMMARY = "kind int, m int, grp string, part string, chunk long, n long, vals array<float>, cum array<long>, err long"


def _segments(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values sorted within groups, group of each segment, its start and end."""
    order = np.lexsort((v, code))
    c, x = code[order], v[order]
    if not len(c):
        return x, c, np.zeros(0, int), np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    return x, c[start], start, np.r_[start[1:], len(c)]


def _slices(n: int, g: int) -> np.ndarray:
    """Ranks (from 1) at which n sorted values are cut into at most g slices of equal count."""
    return np.arange(1, n + 1) if n <= g else np.unique(np.ceil(np.arange(1, g + 1) * (n / g)).astype(np.int64))


def _chunks(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def summaries(data: DataFrame, kinds: list[str], measures: list[str], *, part: str | None = None, slices: int = SLICES) -> DataFrame:
    """Proposals of every chunk: (kind, m, grp, part, chunk, n, vals, cum, err), kind and m being places in `kinds` and
    `measures`, cum the rank of each value in its chunk, err the most that a rank between them can be off. part: a column (a day, a file) to keep summaries apart by."""
    nk, nm = len(kinds), len(measures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        for i, b in enumerate(_chunks(batches, CHUNK)):
            parts, pcodes = (pd.Index([""]), np.zeros(len(b), np.int64)) if part is None else pd.factorize(b[part], use_na_sentinel=False)[::-1]
            out = []
            for k in range(nk):
                codes, names = pd.factorize(b[kinds[k]], use_na_sentinel=False)
                both = codes.astype(np.int64) * len(parts) + pcodes
                for m in range(nm):
                    v = b[measures[m]].to_numpy(dtype=np.float32)
                    ok = v >= 0
                    x, segs, start, end = _segments(both[ok], v[ok])
                    for c, s, e in zip(segs, start, end):
                        cum = _slices(e - s, slices)
                        name, p = names[c // len(parts)], parts[c % len(parts)]
                        wide = int(np.diff(cum, prepend=0).max()) - 1
                        out.append((k, m, None if pd.isna(name) else name, None if pd.isna(p) else str(p), at + (i << 32), e - s, x[s + cum - 1], cum, wide))
            yield pd.DataFrame(out, columns=["kind", "m", "grp", "part", "chunk", "n", "vals", "cum", "err"])

    return data.select(*dict.fromkeys([*kinds, *([part] if part else []), *measures])).mapInPandas(run, SUMMARY)


def merged(summary: DataFrame, *, slices: int = FINE, fan: int | None = None) -> DataFrame:
    """The summaries of each (kind, m, grp, part) as one, of at most `slices` values; in a tree of `fan` at a time, level by
    level, so that a task never holds more than some `fan` of a group. Rows as of `summaries`."""
    fan = fan or FAN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, ["kind", "m", "grp", "part", "chunk"]):
            yield _joined(b, slices)

    keys = ["kind", "m", "grp", "part"]
    from berkas.session import stored

    summary = stored(summary)
    while True:
        most = summary.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
        at = F.pmod(F.xxhash64("chunk"), F.lit(-(-most // fan))) if most > fan else F.lit(0).cast("long")
        level = summary.withColumn("chunk", at).repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk").mapInPandas(run, SUMMARY)
        if most <= fan:
            return level
        summary = stored(level)


def _joined(b: pd.DataFrame, slices: int) -> pd.DataFrame:
    """Rows of summaries, sorted by group, as one summary per group."""
    keys = ["kind", "m", "grp", "part", "chunk"]
    lead, g, vals, w, base, total, error, _ = _merge(b, keys)
    out = []
    first = np.searchsorted(g, np.arange(len(base)), side="left")
    last = np.searchsorted(g, np.arange(len(base)), side="right")
    for i in range(len(base)):
        cum = w[first[i] : last[i]] - base[i]
        at = np.unique(np.searchsorted(cum, _slices(int(total[i]), slices), side="left"))
        new = cum[at]
        out.append((vals[first[i] : last[i]][at].astype(np.float32), new, int(error[i]) + int(np.diff(new, prepend=0).max()) - 1))
    return lead[keys].reset_index(drop=True).assign(n=total, vals=[x[0] for x in out], cum=[x[1] for x in out], err=[x[2] for x in out])


_BOUNDS = "kind int, m int, grp string, q int, n long, k long, lo float, hi float, error long"


def bounds(summary: DataFrame, probs: list[float]) -> DataFrame:
    """(kind, m, grp, q, n, k, lo, hi, error) per group and percentile: the value of rank k lies in [lo, hi], lo null for
    no lower bound; error is the most that the rank of hi can differ from k, 0 if hi is the percentile itself.
    Summaries of any chunks, days or files go in together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, ["kind", "m", "grp"]):
            yield _solve(b, probs)

    s = summary.select("kind", "m", "grp", "n", "vals", "cum", "err")
    return s.repartition("kind", "m", "grp").sortWithinPartitions("kind", "m", "grp").mapInPandas(run, _BOUNDS)


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut at group ends."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if b.empty:
            continue
        same = np.ones(len(b), bool)
        for k in keys:
            last = b[k].iloc[-1]
            same &= (b[k].isna() if pd.isna(last) else b[k] == last).to_numpy(dtype=bool)
        cut = len(b) - int(same[::-1].argmin()) if not same.all() else 0
        rest, done = b.iloc[cut:], b.iloc[:cut]
        if len(done):
            yield done
    if rest is not None and len(rest):
        yield rest


def _merge(b: pd.DataFrame, keys: list[str]):
    """Groups of proposals, sorted by value within groups: first row of each group, group of each value, values,
    cumulated weights over all groups, cumulated weight before each group, error of each group."""
    k = [b[c].astype(object).where(b[c].notna(), None) for c in keys]
    gid, first = pd.factorize(pd.MultiIndex.from_arrays([x.map(lambda v: "\0" if v is None else v) for x in k]))
    lens = b["vals"].map(len).to_numpy()
    vals = np.concatenate(b["vals"].to_list()) if len(b) else np.zeros(0)
    cum = np.concatenate(b["cum"].to_list()).astype(np.int64) if len(b) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(b)), lens)
    w = cum.copy()
    w[1:] -= np.where(row[1:] == row[:-1], cum[:-1], 0)
    g = gid[row]
    order = np.lexsort((vals, g))
    error = np.bincount(gid, weights=b["err"].to_numpy(dtype=float), minlength=len(first)).astype(np.int64)
    total = np.bincount(g, weights=w, minlength=len(first)).astype(np.int64)
    base = np.r_[0, np.cumsum(total)[:-1]]
    heads = np.r_[0, np.flatnonzero(np.diff(gid) != 0) + 1] if len(gid) else np.zeros(0, int)
    lead = b.iloc[pd.Series(np.arange(len(b))).groupby(gid).first().to_numpy()] if len(b) else b
    return lead, g[order], vals[order], np.cumsum(w[order]), base, total, error, heads


def _pick(g, vals, w, base, total, error, k):
    """(lo, hi) around rank k of each group: fewer than k values are below lo, and at least k are not above hi. Where both
    are the same value it is the percentile, however many ties it has."""
    at = np.searchsorted(w, base + k, side="left")
    hi = vals[np.minimum(at, len(vals) - 1)]
    # at a proposal x of cumulated weight w, at most w + error values are below x
    below = np.searchsorted(w, base + k - error, side="left") - 1
    first = np.searchsorted(g, np.arange(len(base)), side="left")
    lo = np.where(below >= first, vals[np.clip(below, 0, max(0, len(vals) - 1))], np.nan)
    lo = np.where(error == 0, np.nan, lo)
    return lo, hi


def ranks(total: np.ndarray, p: float) -> np.ndarray:
    """Rank of percentile p: ceil(p * n), at least 1; the product is rounded so that 0.9 * 10 is 9."""
    return np.maximum(1, np.ceil(np.round(total * p, 9))).astype(np.int64)


def _solve(b: pd.DataFrame, probs: list[float]) -> pd.DataFrame:
    lead, g, vals, w, base, total, error, _ = _merge(b, ["kind", "m", "grp"])
    out = []
    for q, p in enumerate(probs):
        k = ranks(total, p)
        lo, hi = _pick(g, vals, w, base, total, error, k)
        known = np.where(lo == hi, 0, error)
        out.append(pd.DataFrame({"kind": lead["kind"].to_numpy(), "m": lead["m"].to_numpy(), "grp": lead["grp"].to_numpy(), "q": q, "n": total, "k": k, "lo": lo.astype(np.float32), "hi": hi.astype(np.float32), "error": known}))
    return pd.concat(out, ignore_index=True)


def multi_select(data: DataFrame, kinds: list[str], measures: list[str], probs: list[float]) -> DataFrame:
    """(kind, m, grp, q, n, value): exact percentiles of every group. data should be stored: each round reads it."""
    from berkas.session import stored

    first = stored(bounds(merged(summaries(data, kinds, measures)), probs))
    done = first.where("error = 0")
    todo = first.where("error > 0").drop("error")
    while (open_ := todo.select("kind", "m", "grp").distinct().count()) > 0:
        got = stored(_narrow(data, kinds, measures, todo, few=open_ <= PAGE))
        done = done.unionByName(got.where("error = 0"))
        todo = got.where("error <> 0").drop("error")
    return done.select("kind", "m", "grp", "q", "n", F.col("hi").alias("value"))


_KEYS = ["kind", "m", "grp", "q"]
_RANGE = "kind int, m int, grp string, q int, total long, k long, lo float, hi float, upto long, inside long, n long, vals array<float>, cum array<long>, err long"
_RANGE_COLUMNS = [c.split()[0] for c in _RANGE.split(", ")]


def _narrow(data: DataFrame, kinds: list[str], measures: list[str], todo: DataFrame, *, few: bool) -> DataFrame:
    """One round on the ranges of `todo`. Values are counted three ways at both pivots: below and at lo, strictly between,
    and so at hi; fine proposals stand for those between. The percentile is lo or hi if its rank falls there, else it lies
    strictly between, so every round leaves a smaller range. Rows as of `bounds`. few: the ranges fit a closure; else they
    are joined with the measurements."""

    def entry(x: np.ndarray, r) -> tuple:
        """Counts and proposals of one range in sorted values."""
        lo = -np.inf if r.lo is None or np.isnan(r.lo) else np.float32(r.lo)
        upto = int(np.searchsorted(x, lo, side="right"))
        inside = max(int(np.searchsorted(x, np.float32(r.hi), side="left")) - upto, 0)
        cum = _slices(inside, FINE) if inside else np.zeros(0, np.int64)
        wide = int(np.diff(cum, prepend=0).max()) - 1 if inside else 0
        return (r.kind, r.m, None if pd.isna(r.grp) else r.grp, r.q, r.n, r.k, r.lo, r.hi, upto, inside, inside, x[upto + cum - 1] if inside else np.zeros(0, np.float32), cum, wide)

    def by_closure() -> DataFrame:
        ranges: dict[tuple, dict] = {}
        for r in todo.toPandas().itertuples(index=False):
            ranges.setdefault((int(r.kind), int(r.m)), {}).setdefault(None if pd.isna(r.grp) else r.grp, []).append(r)

        def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _chunks(batches, CHUNK):
                out = []
                for (k, m), groups in ranges.items():
                    codes, names = pd.factorize(b[kinds[k]], use_na_sentinel=False)
                    v = b[measures[m]].to_numpy(dtype=np.float32)
                    ok = v >= 0
                    x, segs, start, end = _segments(codes[ok], v[ok])
                    for c, s, e in zip(segs, start, end):
                        out += [entry(x[s:e], r) for r in groups.get(None if pd.isna(names[c]) else names[c], ())]
                yield pd.DataFrame(out, columns=_RANGE_COLUMNS)

        return data.select(*dict.fromkeys([*kinds, *measures])).mapInPandas(propose, _RANGE)

    def by_join() -> DataFrame:
        cells = [F.struct(F.lit(i).alias("kind"), F.lit(j).alias("m"), F.col(k).cast("string").alias("grp"), F.col(c).cast("float").alias("v")) for i, k in enumerate(kinds) for j, c in enumerate(measures)]
        long = data.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("v >= 0 and not isnan(v)")
        o = todo.select(F.col("kind").alias("_kind"), F.col("m").alias("_m"), F.col("grp").alias("_grp"), "q", "n", "k", "lo", "hi")
        same = (F.col("kind") == F.col("_kind")) & (F.col("m") == F.col("_m")) & F.col("grp").eqNullSafe(F.col("_grp"))
        x = long.join(o, same & (F.col("v") < F.col("hi"))).select("kind", "m", "grp", "q", "n", "k", "lo", "hi", "v")

        def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in _chunks(batches, CHUNK):
                groups = b.groupby(_KEYS, dropna=False, sort=False)
                yield pd.DataFrame([entry(np.sort(g["v"].to_numpy(dtype=np.float32)), next(g.head(1).itertuples(index=False))) for _, g in groups], columns=_RANGE_COLUMNS)

        # ranges in which no measurement lies below hi have their percentile at hi
        none = todo.select("kind", "m", "grp", "q", F.col("n").alias("total"), "k", "lo", "hi", *[F.lit(0).cast("long").alias(c) for c in ("upto", "inside", "n")], F.array().cast("array<float>").alias("vals"), F.array().cast("array<long>").alias("cum"), F.lit(0).cast("long").alias("err"))
        return x.mapInPandas(propose, _RANGE).unionByName(none)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_groups(batches, _KEYS):
            new = b[_KEYS].ne(b[_KEYS].shift()) & ~(b[_KEYS].isna() & b[_KEYS].shift().isna())
            new = new.any(axis=1).to_numpy()
            new[:1] = True
            at = np.cumsum(new) - 1
            head = b[new].reset_index(drop=True)
            upto, inside = (np.bincount(at, weights=b[c].to_numpy(dtype=float)).astype(np.int64) for c in ("upto", "inside"))
            k = head["k"].to_numpy() - upto
            low, high = head["lo"].to_numpy(dtype=np.float64), head["hi"].to_numpy(dtype=np.float64)
            found = (k <= 0) | (k > inside)  # the rank falls on a pivot
            rows = head[[*_KEYS, "k"]].assign(n=head["total"], lo=np.float32("nan"), hi=np.where(k <= 0, low, high).astype(np.float32), error=np.where(found, 0, -1))
            rest = b[~found[at] & (b["inside"] > 0).to_numpy()]
            if len(rest):
                where = np.unique(at[rest.index.to_numpy() - b.index[0]])
                _, g, vals, w, base, total, error, _ = _merge(rest, _KEYS)
                lo, hi = _pick(g, vals, w, base, total, error, k[where])
                rows.loc[where, "error"] = np.where(lo == hi, 0, error)
                rows.loc[where, "lo"] = np.where(np.isnan(lo), low[where], lo).astype(np.float32)
                rows.loc[where, "hi"] = hi.astype(np.float32)
            yield rows[["kind", "m", "grp", "q", "n", "k", "lo", "hi", "error"]]

    made = by_closure() if few else by_join()
    return made.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInPandas(solve, _BOUNDS)
