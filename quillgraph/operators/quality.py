"""Semantic quality: surfaces, predicates, relations, churn, adjudication, ranking and paired comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.functions import vocabulary as V
from quillgraph.operators import gates


def surface_layer(nodes: DataFrame) -> DataFrame:
    """One row: nodes, groups of one type with the same key, keys under several types, low-value and generic titles."""
    keyed = nodes.select("type", udfs.surface_key(F.col("title")).alias("key"), C.is_low_value_title(F.col("title")).alias("low"), C.is_generic_title(F.col("title")).alias("generic"))
    by_type = keyed.groupBy("key", "type").agg(F.count("*").alias("n"), F.sum(F.col("low").cast("long")).alias("low"), F.sum(F.col("generic").cast("long")).alias("generic"))
    by_key = by_type.groupBy("key").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 1).cast("long")).alias("same"), F.count("*").alias("types"), F.sum("low").alias("low"), F.sum("generic").alias("generic"))
    return by_key.agg(F.sum("n").alias("n_nodes"), F.sum("same").alias("duplicate_groups"), F.sum((F.col("types") > 1).cast("long")).alias("conflict_groups"), F.sum("low").alias("low_value"), F.sum("generic").alias("generic"))


def predicate_layer(claims: DataFrame, registered: tuple[str, ...] = V.CORE_PREDICATES) -> DataFrame:
    """One row: claims, predicates, those used once, placeholders, labels per 1000 claims, share of claims on registered ones."""
    key = C.predicate_key(F.col("p"))
    by = claims.groupBy(key.alias("p")).agg(F.count("*").alias("n"))
    known, hollow = F.col("p").isin(*registered), F.col("p").isin("", *V.PLACEHOLDER_LABELS)
    out = by.agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_predicates"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.sum(F.when(hollow, F.col("n")).otherwise(0)).alias("placeholders"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("registered"))
    return out.select("n_claims", "n_predicates", "singletons", "placeholders", F.round(1000 * F.col("n_predicates") / F.col("n_claims"), 6).alias("per_thousand"), F.round(F.col("registered") / F.col("n_claims"), 6).alias("registered_share"))


def relation_layer(claims: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: claims with an object, those without their edge, edges without a claim, claims with a dead end, nodes without any edge.

    Superseded claims aren't counted, but still account for the edges that they left.
    """
    said = claims.where("o_id IS NOT NULL").select(F.col("s").alias("src"), F.col("p").alias("type"), F.col("o_id").alias("dst"), gates.is_superseded(claims).alias("old"))
    tied = said.where("NOT old").drop("old")
    lines, ids = edges.select("src", "type", "dst"), nodes.select("id")
    lost = tied.join(lines, ["src", "type", "dst"], "left_anti").agg(F.count("*").alias("claims_without_edge"))
    bare = lines.join(said.select("type").distinct(), "type", "left_semi").join(said, ["src", "type", "dst"], "left_anti").agg(F.count("*").alias("edges_without_claim"))
    dead = tied.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").agg(F.count("*").alias("dead_ends"))
    alone = ids.join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti").agg(F.count("*").alias("isolated"))
    total = tied.agg(F.count("*").alias("relation_claims"))
    return total.join(F.broadcast(lost)).join(F.broadcast(bare)).join(F.broadcast(dead)).join(F.broadcast(alone))  # one row each


def churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """``dimension`` with counts before, after, added, removed and the share of the union that changed, of members ``dimension, member``."""
    b, a = before.distinct().withColumn("b", F.lit(1)), after.distinct().withColumn("a", F.lit(1))
    both = b.join(a, ["dimension", "member"], "full_outer").groupBy("dimension")
    out = both.agg(F.count("b").alias("before_count"), F.count("a").alias("after_count"), F.sum(F.col("b").isNull().cast("long")).alias("added"), F.sum(F.col("a").isNull().cast("long")).alias("removed"), F.count("*").alias("union_count"))
    return out.withColumn("churn_share", F.round((F.col("added") + F.col("removed")) / F.col("union_count"), 6))


def b_cubed(items: DataFrame) -> DataFrame:
    """Precision, recall and F1 of clusters ``gold, predicted`` over items, from counts of cells: no pairs."""
    cells = items.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    g, p = cells.groupBy("gold").agg(F.sum("n").alias("g")), cells.groupBy("predicted").agg(F.sum("n").alias("p"))
    sums = cells.join(g, "gold").join(p, "predicted").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("p")).alias("x"), F.sum(F.col("n") * F.col("n") / F.col("g")).alias("y"))
    precision, recall = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def pairwise_clusters(items: DataFrame) -> DataFrame:
    """Pairs merged wrongly and missed, from binomials of cell counts."""
    two = lambda n: F.sum(n * (n - 1) / 2).cast("long")
    cells = items.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    both = cells.agg(two(F.col("n")).alias("both"))
    gold = cells.groupBy("gold").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("gold"))
    predicted = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("predicted"))
    out = both.join(F.broadcast(gold)).join(F.broadcast(predicted))  # one row each
    return out.select((F.col("predicted") - F.col("both")).alias("false_merges"), (F.col("gold") - F.col("both")).alias("missed_merges"), F.col("both").alias("right_merges"))


def classification(rows: DataFrame) -> DataFrame:
    """``class`` with precision, recall, F1 and support from ``expected, actual``."""
    cells = rows.groupBy("expected", "actual").agg(F.count("*").alias("n"))
    right = cells.where("expected = actual").select(F.col("expected").alias("class"), F.col("n").alias("tp"))
    want = cells.groupBy(F.col("expected").alias("class")).agg(F.sum("n").alias("support"))
    have = cells.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("said"))
    all_ = want.join(have, "class", "full_outer").join(right, "class", "left").fillna(0, ["tp", "support", "said"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return all_.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def ranking(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per question: first right rank, reciprocal rank, precision and recall at ``k``; questions without a hit count with 0."""
    found = hits.where(F.col("rank") <= k).join(gold.withColumn("right", F.lit(1)), ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.min(F.when(F.col("right") == 1, F.col("rank"))).alias("first_rank"), F.sum(F.coalesce("right", F.lit(0))).alias("hits"))
    want = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    out = want.join(per, "query_id", "left")
    return out.select("query_id", F.col("first_rank").cast("long").alias("first_rank"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("hits", F.lit(0)) / k, 6).alias("precision"), F.round(F.coalesce("hits", F.lit(0)) / F.col("n_gold"), 6).alias("recall"))


def timing(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Calls, total, p50, p90 and maximum of each group, by place in the order: n // 2 and the smaller of n - 1 and 0.9 n. Places are found by rank, not by gathering."""
    w = Window.partitionBy(group)
    ranked = rows.select(group, F.col(value).alias("v"), (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = lambda place: F.round(F.max(F.when(F.col("i") == place, F.col("v"))), 3)
    p90 = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9).cast("long"))
    return ranked.groupBy(group).agg(F.count("*").alias("calls"), F.round(F.sum("v"), 3).alias("total"), at(F.floor(F.col("n") / 2).cast("long")).alias("p50"), at(p90).alias("p90"), F.round(F.max("v"), 3).alias("max"))


def distribution(rows: DataFrame, value: Column) -> DataFrame:
    """Total and nearest-rank p50 and p95."""
    v = rows.select(value.alias("v"))
    return v.agg(F.count("v").alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"))


def stratified(rows: DataFrame, bucket: str, key: str, n: int, seed: str) -> DataFrame:
    """The ``n`` rows of each bucket whose seeded hash comes first."""
    place = F.sha2(F.concat_ws("\x00", F.lit(seed), F.col(bucket).cast("string"), F.col(key).cast("string")), 256)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(bucket).orderBy(place))).where(F.col("__n") <= n).drop("__n")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 x 2 counts of ``query_id, correct`` in two arms."""
    both = a.select("query_id", F.col("correct").alias("x")).join(b.select("query_id", F.col("correct").alias("y")), "query_id")
    cell = lambda c, name: F.sum(c.cast("long")).alias(name)
    return both.agg(cell(F.col("x") & F.col("y"), "both"), cell(F.col("x") & ~F.col("y"), "only_a"), cell(~F.col("x") & F.col("y"), "only_b"), cell(~F.col("x") & ~F.col("y"), "neither"))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact two-sided p of discordant counts."""
    n, k = only_a + only_b, min(only_a, only_b)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def rebuild_gate(checks: DataFrame) -> DataFrame:
    """``passed, failed``: checks ``code, ok``; a null check fails."""
    return checks.agg(F.min(F.coalesce("ok", F.lit(False))).alias("passed"), F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("code")))).alias("failed"))
