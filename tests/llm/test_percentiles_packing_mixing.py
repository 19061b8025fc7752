"""Percentiles, packing and mixing against brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from berkas.llm import mixing, packing, percentiles

PROBS = [0.5, 0.9, 0.99]


def values(spark, n=6000):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        g = rng.choice(["a"] * 6 + ["b", "c", None])
        v = rng.choice([0.0, 1.0, round(rng.expovariate(0.01), 2), float("nan"), None, -1.0])
        rows.append((i, g, "d%d" % (i % 3), v))
    return spark.createDataFrame(rows, "doc long, g string, day string, v float"), rows


def exact(rows, key):
    out = {}
    for r in rows:
        v = r[3]
        if v is not None and not math.isnan(v) and v >= 0:
            out.setdefault(r[key], []).append(np.float32(v))
    return {k: [sorted(v)[max(1, math.ceil(round(p * len(v), 9))) - 1] for p in PROBS] for k, v in out.items()}


@pytest.mark.parametrize("slices, fine", [(64, 2048), (4, 8), (2, 3)])
def test_exact_whatever_the_slices(spark, monkeypatch, slices, fine):
    monkeypatch.setattr(percentiles, "SLICES", slices)
    monkeypatch.setattr(percentiles, "FINE", fine)
    monkeypatch.setattr(percentiles.summaries, "__kwdefaults__", {"part": None, "slices": slices})
    df, rows = values(spark)
    want = {("g", k): v for k, v in exact(rows, 1).items()} | {("day", k): v for k, v in exact(rows, 2).items()}
    got = {}
    for r in percentiles.multi_select(df.repartition(5), ["g", "day"], ["v"], PROBS).collect():
        got.setdefault((["g", "day"][r["kind"]], r["grp"]), [0] * 3)[r["q"]] = np.float32(r["value"])
    assert got == want


def test_summaries_combine_with_their_bound(spark):
    df, rows = values(spark)
    s = percentiles.summaries(df, ["g"], ["v"], part="day", slices=32)
    every = {k: sorted(np.float32(r[3]) for r in rows if r[1] == k and r[3] is not None and r[3] >= 0) for k in ("a", "b", "c", None)}
    one, two = s.where("part = 'd0'"), s.where("part <> 'd0'")
    for r in percentiles.bounds(one.unionAll(two), PROBS).collect():
        v = every[r["grp"]]
        assert r["n"] == len(v) and r["error"] <= len(v) / 32 + 1
        low, high = np.searchsorted(v, np.float32(r["hi"]), "left") + 1, np.searchsorted(v, np.float32(r["hi"]), "right")
        assert low - r["error"] <= r["k"] <= high + r["error"]


@pytest.mark.parametrize("slices, fine, page", [(64, 2048, 0), (2, 3, 0)])
def test_open_ranges_joined_with_the_table(spark, monkeypatch, slices, fine, page):
    """Where too many ranges are open for a closure they are joined; the result is the same."""
    for name, value in (("SLICES", slices), ("FINE", fine), ("PAGE", page)):
        monkeypatch.setattr(percentiles, name, value)
    monkeypatch.setattr(percentiles.summaries, "__kwdefaults__", {"part": None, "slices": slices})
    monkeypatch.setattr(percentiles.merged, "__kwdefaults__", {"slices": fine, "fan": 2})
    df, rows = values(spark)
    got = {}
    for r in percentiles.multi_select(df.repartition(5), ["g", "day"], ["v"], PROBS).collect():
        got.setdefault((["g", "day"][r["kind"]], r["grp"]), [0] * 3)[r["q"]] = np.float32(r["value"])
    assert got == {("g", k): v for k, v in exact(rows, 1).items()} | {("day", k): v for k, v in exact(rows, 2).items()}


@pytest.mark.parametrize("slices", [16, 4096])
def test_merged_in_a_tree(spark, monkeypatch, slices):
    monkeypatch.setattr(percentiles, "CHUNK", 20)
    df, rows = values(spark)
    s = percentiles.merged(percentiles.summaries(df.repartition(7), ["g"], ["v"], part="day", slices=slices), slices=slices, fan=3)
    kept = s.collect()
    assert len({(r["grp"], r["part"]) for r in kept}) == len(kept) and all(len(r["vals"]) <= slices for r in kept)
    for r in percentiles.bounds(s, PROBS).collect():
        v = sorted(np.float32(x[3]) for x in rows if x[1] == r["grp"] and x[3] is not None and x[3] >= 0)
        low, high = np.searchsorted(v, np.float32(r["hi"]), "left") + 1, np.searchsorted(v, np.float32(r["hi"]), "right")
        assert r["n"] == len(v) and low - r["error"] <= r["k"] <= high + r["error"] and (slices == 16 or r["error"] == 0)


def test_empty_and_unusable(spark):
    df = spark.createDataFrame([(1, "a", "d", None), (2, "a", "d", float("nan")), (3, None, "d", -5.0)], "doc long, g string, day string, v float")
    assert percentiles.multi_select(df, ["g"], ["v"], PROBS).count() == 0
    assert percentiles.multi_select(df.limit(0), ["g"], ["v"], PROBS).count() == 0


def unfold(p):
    bins = {}
    for size, a, b, at, per in p.ranges:
        for r in range(a, b):
            bins.setdefault(at + (r - a) // per, []).append(size)
    return bins


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_packing_is_whole_and_within_capacity(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    p = packing.Packing(counts, 30)
    bins = unfold(p)
    assert sorted(s for b in bins.values() for s in b) == sorted(sizes) and set(bins) == set(range(p.bins))
    assert all(sum(b) <= 30 and sum(3 * s > 30 for s in b) <= 2 for b in bins.values())
    # no worse than first-fit decreasing by more than one bin in nine and one
    ffd = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, b in enumerate(ffd) if b + s <= 30), None)
        if k is None:
            ffd.append(s)
        else:
            ffd[k] += s
    assert p.bins <= len(ffd) * 11 / 9 + 1


def test_packing_of_very_many_sizes():
    sizes = {s: 1 + s % 3 for s in range(1, 60_000)}
    p = packing.Packing(sizes, 128_000)
    assert p.bins * 128_000 >= sum(s * n for s, n in sizes.items()) and sum(b - a for _, a, b, _, _ in p.ranges) == sum(sizes.values())


@pytest.mark.parametrize("chunk_rows", [1_000_000, 7])
def test_packed_documents(spark, chunk_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 5, 5, 5, 5, 40, 55, 60, 99, 100, 101, 250])) for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").fillna(0)
    got = packing.packed(df, 100, chunk_rows=chunk_rows).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start_token"], r["n_tokens"]))
        if r["bin_id"] is not None:
            by_bin[r["bin_id"]] = by_bin.get(r["bin_id"], 0) + r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
    assert max(by_bin.values()) <= 100 and set(by_bin) == set(range(len(by_bin)))
    for d, n in rows:
        ps = sorted(by_doc[d])
        assert sum(p[2] for p in ps) == (n or 0) and len(ps) == max(1, -(-(n or 0) // 100)) and [p[1] for p in ps] == [100 * k for k in range(len(ps))]
    assert packing.packed(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("a " * 5000,)], "t string")
    got = [r[0] for r in df.select(packing.token_count(F.col("t"), f"/opt/tokenizers/{name}")).collect()]
    assert got[0] == 2 and got[1] in (0, 1) and got[2] == got[1] and got[3] >= 5000


def test_flow_by_hand():
    flow, on = mixing.min_cost_flow(4, [(0, 1, 5, 0), (0, 1, 5, 3), (0, 2, 4, 1), (1, 3, 8, 0), (2, 3, 4, 0)], 0, 3)
    assert flow == 12 and on == [5, 3, 4, 8, 4]


def test_routes_share_overlaps():
    total, flow = mixing.routed({("a",): 100, ("a", "b"): 100, ("b",): 20}, {"a": (0.5, 1), "b": (0.5, 1), "c": (0.1, 2)})
    assert abs(total - 220) < 1 and abs(flow[("a", "b"), "b"] - 90) < 1
    assert mixing.routed({}, {"a": (1.0, 1)}) == (0.0, {})


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big"] * 8 + ["small"] + [None]), rng.randint(0, 30)) for i in range(4000)]
    df = spark.createDataFrame([(i, s, 10**6 + (i if i % 50 else i - i % 100), n) for i, s, n in rows], "doc_id long, source string, text_key long, n_tokens int")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_weight double, max_repeats int")
    drawn = mixing.mixed(df, t)
    s = {r["source"]: r["share"] for r in mixing.shares(drawn, t).where("source is not null").collect()}
    assert abs(s["big"] - 0.6) < 0.02 and abs(s["small"] - 0.4) < 0.02 and s["none"] == 0
    assert drawn.where("(source = 'big' and repeats > 1) or repeats > 3 or repeats < 1").count() == 0
    assert drawn.groupBy("source", "doc_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixing.mixed(df.repartition(7), t).collect()))
    assert mixing.mixed(df.limit(0), t).count() == 0
