"""Mixing sources to target weights.

Texts that several sources hold are one text with several memberships. Tokens are summed per membership pattern (which
set of sources), a min-cost flow routes them to the quotas of the sources, each further use of a text costing more than
the one before, and every text is then drawn as often as its place in a seeded order says. The total is the largest at
which all reachable targets can be met within the repeats allowed, so the shares are met up to the size of a text.

The flow runs over patterns and sources, whose number does not grow with the corpus (checked); prefix sums of the seeded
order are taken in hash ranges, so a source that holds a third of all texts is no bottleneck.

Edge cases: texts with a null source, or with a source without target, are not drawn; empty texts have no tokens and are
not drawn; a target source without texts is reported with share 0, the others keep their proportions; copies of a text
within a source count once; repeats are never above max_repeats.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 11
RANGES = 4096


def min_cost_flow(n: int, edges: list[tuple[int, int, float, float]], s: int, t: int) -> tuple[float, list[float]]:
    """(flow, flow on each edge) of largest flow and least cost; edges (from, to, capacity, cost >= 0). Successive
    shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in edges:
        graph[a].append(len(to))
        to.append(b), cap.append(float(c)), cost.append(float(w))
        graph[b].append(len(to))
        to.append(a), cap.append(0.0), cost.append(-float(w))
    h = [0.0] * n
    flow, eps = 0.0, 1e-6
    while True:
        dist = [float("inf")] * n
        dist[s], via = 0.0, [-1] * n
        heap = [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u] + 1e-12:
                continue
            for e in graph[u]:
                if cap[e] > eps:
                    nd = d + cost[e] + h[u] - h[to[e]]
                    if nd < dist[to[e]] - 1e-12:
                        dist[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if dist[t] == float("inf"):
            break
        for v in range(n):
            if dist[v] < float("inf"):
                h[v] += dist[v]
        f, v = float("inf"), t
        while v != s:
            f, v = min(f, cap[via[v]]), to[via[v] ^ 1]
        v = t
        while v != s:
            cap[via[v]] -= f
            cap[via[v] ^ 1] += f
            v = to[via[v] ^ 1]
        flow += f
    return flow, [cap[2 * i + 1] for i in range(len(edges))]


def routed(tokens: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[tuple[tuple[str, ...], str], float]]:
    """(total, tokens of each pattern to each source). targets: source -> (weight, max_repeats)."""
    patterns = sorted(p for p, n in tokens.items() if n > 0)
    held = {s for p in patterns for s in p}
    sources = sorted(s for s in targets if s in held and targets[s][0] > 0 and targets[s][1] > 0)
    weight = sum(targets[s][0] for s in sources)
    if not sources:
        return 0.0, {}
    most = max(targets[s][1] for s in sources)
    n = 2 + len(patterns) + len(sources)
    pid = {p: 1 + i for i, p in enumerate(patterns)}
    sid = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}

    def solve(total: float):
        edges = []
        for p in patterns:
            # every further use of a text costs more
            edges += [(0, pid[p], tokens[p], float(r * r)) for r in range(most)]
        legs = [(p, s) for p in patterns for s in p if s in sid]
        edges += [(pid[p], sid[s], tokens[p] * targets[s][1], 0.0) for p, s in legs]
        edges += [(sid[s], n - 1, total * targets[s][0] / weight, 0.0) for s in sources]
        flow, on = min_cost_flow(n, edges, 0, n - 1)
        k = len(patterns) * most
        return flow, {leg: on[k + i] for i, leg in enumerate(legs)}

    low, high = 0.0, float(sum(tokens.values()) * most)
    for _ in range(60):
        mid = (low + high) / 2
        if solve(mid)[0] >= mid * (1 - 1e-9) - 1e-3:
            low = mid
        else:
            high = mid
    return low, solve(low)[1]


def mixed(docs: DataFrame, targets: DataFrame, *, seed: int = SEED, max_patterns: int = 5_000) -> DataFrame:
    """(source, doc_id, repeats, n_tokens): the documents drawn, each with how often, from docs (doc_id, source,
    text_key, n_tokens) for targets (source, target_weight, max_repeats)."""
    from berkas.session import stored

    want = {r["source"]: (float(r["target_weight"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_weight is not null and max_repeats is not null").limit(10_001).collect()}
    if len(want) > 10_000:
        raise ValueError("more than 10,000 target sources")
    live = docs.where((F.col("n_tokens") > 0) & F.col("source").isin(list(want)))
    texts = live.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = texts.groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("held"))
    texts = texts.withColumn("pattern", F.transform("held", lambda x: x["source"])).withColumn("h", F.xxhash64("text_key", F.lit(seed)))
    texts = stored(texts.withColumn("range", F.pmod(F.shiftright("h", 32), F.lit(RANGES)).cast("int")))
    sums = texts.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("t"))
    rows = sums.groupBy("pattern").agg(F.sum("t").alias("t")).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    tokens = {tuple(r["pattern"]): int(r["t"]) for r in rows}
    total, flow = routed(tokens, want)
    # each source takes a stretch of the ring of its pattern's tokens, one after the other
    legs, at = [], dict.fromkeys(tokens, 0.0)
    for (p, s), f in sorted(flow.items()):
        if f > 0:
            legs.append((list(p), s, at[p], at[p] + f, float(tokens[p]), want[s][1]))
            at[p] += f
    spark = docs.sparkSession
    legs_df = spark.createDataFrame(legs, "pattern array<string>, source string, a double, b double, ring double, most int")
    before = sums.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("pattern", "range").orderBy("h", "text_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = texts.withColumn("inside", inside).join(before.select("pattern", "range", "before"), ["pattern", "range"])
    # the middle of a text, so that a stretch takes a text whole or not
    placed = placed.withColumn("c", F.col("before") + F.col("inside") + F.col("n_tokens") / 2.0)
    x = placed.join(F.broadcast(legs_df), "pattern")  # at most max_patterns x sources rows
    times = F.ceil((F.col("b") - F.col("c")) / F.col("ring")) - F.ceil((F.col("a") - F.col("c")) / F.col("ring"))
    x = x.withColumn("repeats", F.least(times, F.col("most")).cast("int")).where("repeats > 0")
    own = F.element_at(F.filter("held", lambda e: e["source"] == F.col("source")), 1)["doc_id"]
    return x.select("source", own.alias("doc_id"), "repeats", "n_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, n_docs, tokens, share) of every target source."""
    s = drawn.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens").cast("long") * F.col("repeats")).alias("tokens"))
    s = targets.select("source", "target_weight", "max_repeats").join(s, "source", "left").fillna(0, ["n_docs", "tokens"])
    return s.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
