"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern, and a flow routes token
capacity from patterns to source quotas: each pattern offers its tokens once for every allowed repetition,
at a cost that rises with each one, so that the cheapest flow repeats as little as it can. The flow has a
node for each pattern and each source, whatever the number of documents. Documents are then selected by a
seeded hash: all of a pattern's documents for its whole repetitions, and those below a threshold for the rest.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (5, 2, 1)


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, max_repeats: int) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeats`` times its source's size; what exceeds that is shared again."""
    out, open_, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0}, float(total)
    while open_:
        whole = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if left * weights[i] / whole > max_repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in sorted(full):
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def min_cost_flow(supplies: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_repeats: int) -> list[dict[int, int]]:
    """For each pattern, the tokens that it gives to each of its sources.

    Successive shortest paths over pattern -> source -> sink; the arcs from the start to a pattern are convex:
    its tokens once for 0, once more for 1, for 3, 6, ...
    """
    n_p, n_s = len(supplies), len(quotas)
    start, sink, graph = n_p + n_s, n_p + n_s + 1, [[] for _ in range(n_p + n_s + 2)]

    def arc(u: int, v: int, cap: int, cost: int) -> None:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for p, supply in enumerate(supplies):
        for repeat in range(max_repeats):
            arc(start, p, supply, repeat * (repeat + 1) // 2)
        for s in members[p]:
            arc(p, n_p + s, supply * max_repeats, 0)
    for s, quota in enumerate(quotas):
        arc(n_p + s, sink, quota, 0)
    potential = [0] * len(graph)
    while True:
        dist, back, heap = [None] * len(graph), [None] * len(graph), [(0, start)]
        dist[start] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                if cap > 0 and (dist[v] is None or d + cost + potential[u] - potential[v] < dist[v]):
                    dist[v], back[v] = d + cost + potential[u] - potential[v], (u, k)
                    heapq.heappush(heap, (dist[v], v))
        if dist[sink] is None:
            break
        potential = [h + d if d is not None else h for h, d in zip(potential, dist, strict=True)]
        path, v = [], sink
        while v != start:
            path.append(back[v])
            v = back[v][0]
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
    return [{v - n_p: graph[v][r][1] for v, _, _, r in graph[p] if n_p <= v < n_p + n_s and graph[v][r][1] > 0} for p in range(n_p)]


def route(supplies: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], max_repeats: int) -> list[dict[int, int]]:
    """The cheapest flow, found for each set of patterns that share sources by itself.

    Patterns that share nothing with others (one source each, as a rule) need no search: they give what is asked,
    as far as their repetitions reach.
    """
    parent = list(range(len(quotas)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for m in members:
        for s in m[1:]:
            parent[root(s)] = root(m[0])
    groups: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        if m:
            groups.setdefault(root(m[0]), []).append(p)
    out: list[dict[int, int]] = [{} for _ in supplies]
    for group in groups.values():
        if len(group) == 1 and len(members[group[0]]) == 1:
            (p,), (s,) = group, members[group[0]]
            given = min(quotas[s], supplies[p] * max_repeats)
            out[p] = {s: given} if given else {}
            continue
        sources = sorted({s for p in group for s in members[p]})
        at = {s: i for i, s in enumerate(sources)}
        flows = min_cost_flow([supplies[p] for p in group], [[at[s] for s in members[p]] for p in group], [quotas[s] for s in sources], max_repeats)
        for p, flow in zip(group, flows, strict=True):
            out[p] = {sources[i]: given for i, given in flow.items()}
    return out


def n_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _name_order(name: str | None) -> tuple:
    return name is None, name or ""


def mix(docs: DataFrame, *, memberships: Column | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: Callable[[int, str | None], float] = lambda i, _: WEIGHTS[i % len(WEIGHTS)], max_repeats: int = 3, seed: int = 11, keep_columns: bool = False) -> DataFrame:
    """Choose how many words of each document the mix takes, so that every source meets its target.

    ``memberships`` is an array of source names for each document (default: its one source). ``weights`` maps
    a source's place by code point (null last) and name to its weight. Returns ``doc_id, size, source_size,
    target, taken`` for each document, with all of its columns first if ``keep_columns``; for documents of several
    sources, ``source_size`` and ``target`` are sums over them.

    * A null or empty text has size 0 and is taken with 0 words. A null source is a source of its own; a
      document of no source isn't taken. An empty table gives an empty result.
    * Rows that repeat id and text share one place in the seeded order and are taken alike.
    * One row for each distinct membership pattern is collected, however many documents there are. Only patterns
      that overlap others meet in the flow, whose time grows with their number.
    """
    if memberships is None:
        memberships = F.array(F.col(source_col))
    pattern = F.to_json(F.transform(F.array_sort(F.array_distinct(memberships)), lambda x: F.struct(F.coalesce(x, F.lit("")).alias("s"), x.isNull().alias("z"))))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text_col)), 4)  # 60 bits: six digits of 10
    rest = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    sized = docs.select(F.struct(*(rest if keep_columns else [id_col])).alias("row"), n_words(F.col(text_col)).alias("size"), F.coalesce(pattern, F.lit("[]")).alias("pattern"), place.alias("place"))
    sized = materialise(sized, "sized")

    sums = sized.groupBy("pattern").agg(F.sum("size").alias("size")).collect()
    sums = sorted((r["pattern"], r["size"]) for r in sums)
    named = [[None if m["z"] else m["s"] for m in json.loads(p)] for p, _ in sums]
    sources = sorted({s for m in named for s in m}, key=_name_order)
    at = {s: i for i, s in enumerate(sources)}
    members = [[at[s] for s in m] for m in named]
    source_sizes = [sum(size for (_, size), m in zip(sums, members, strict=True) if i in m) for i in range(len(sources))]
    wanted = targets(source_sizes, [weights(i, s) for i, s in enumerate(sources)], sum(size for (_, size), m in zip(sums, members, strict=True) if m), max_repeats)
    flows = route([size for _, size in sums], members, [round(t) for t in wanted], max_repeats)

    plan = []
    for (name, size), m, flow in zip(sums, members, flows, strict=True):
        whole, part = divmod(sum(flow.values()), size) if size else (0, 0)
        plan.append((name, int(whole), int(part), int(sum(source_sizes[i] for i in m)), float(sum(wanted[i] for i in m))))
    below = _thresholds(sized, {name: part for name, _, part, _, _ in plan if part})
    rows = [(*row, below.get(row[0], -1)) for row in plan]
    planned = F.broadcast(sized.sparkSession.createDataFrame(rows, "pattern string, whole int, part bigint, source_size bigint, target double, below bigint"))
    out = sized.join(planned, "pattern")
    taken = F.col("size") * (F.col("whole") + (F.col("place") <= F.col("below")).cast("int"))
    head = F.col("row.*") if keep_columns else F.col(f"row.{id_col}").alias("doc_id")
    return out.select(head, "size", "source_size", "target", taken.alias("taken"))


def _thresholds(sized: DataFrame, parts: dict[str, int]) -> dict[str, int]:
    """For each pattern the place up to which its documents hold about so many words.

    The place's 60 bits are fixed 10 at a time: a histogram of one pattern's next digit has at most 1,024
    rows, however many documents there are, and only the digit where the sum is reached goes on.
    """
    spark, found = sized.sparkSession, dict.fromkeys(parts, 0)
    left = dict(parts)
    for level in range(6):
        if not left:
            break
        shift = 50 - 10 * level
        here = F.broadcast(spark.createDataFrame([(p, found[p] >> (shift + 10), left[p]) for p in left], "pattern string, prefix bigint, words bigint"))
        rows = sized.join(here, "pattern").where(F.shiftright("place", shift + 10) == F.col("prefix"))
        bins = rows.groupBy("pattern", F.shiftright("place", shift).alias("digit")).agg(F.sum("size").alias("size"), F.first("words").alias("words"))
        upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("digit"))
        bins = bins.select("pattern", "digit", "size", "words", upto.alias("upto"))
        ends = {r["pattern"]: r for r in bins.where("upto >= words AND upto - size < words").groupBy("pattern").agg(F.min(F.struct("digit", "size", "upto", "words")).alias("r")).select("pattern", "r.*").collect()}
        for p, r in ends.items():
            before = r["upto"] - r["size"]
            left[p] = r["words"] - before
            found[p] = r["digit"] << shift
            if level == 5:  # the last document is in if that comes nearer
                found[p] -= 2 * left[p] < r["size"]
    return found
