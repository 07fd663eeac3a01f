"""Predicates: vocabulary, shared arguments, aliases, admission, relation gate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.operators.components import connected_components


def vocabulary(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``predicate, n`` over edge types and claim predicates."""
    return edges.select(F.col("type").alias("predicate")).unionByName(claims.select(F.col("p").alias("predicate"))).groupBy("predicate").agg(F.count("*").alias("n"))


def argument_pairs(claims: DataFrame) -> DataFrame:
    """``p, s, o, n``: how often each predicate holds for each pair of arguments."""
    return claims.where(F.col("s").isNotNull() & F.coalesce("o_id", "o_literal").isNotNull()).groupBy("p", "s", F.coalesce("o_id", "o_literal").alias("o")).agg(F.count("*").alias("n"))


def shared_arguments(pairs: DataFrame) -> DataFrame:
    """``a, b, same_order, swapped``: for predicates ``a < b`` the smaller counts of shared argument pairs, summed, in the same and in the swapped order.

    The join is on the argument pair, whose rows are as many as its distinct predicates.
    """
    left = pairs.select(F.col("p").alias("a"), "s", "o", F.col("n").alias("na"))
    right = pairs.select(F.col("p").alias("b"), "s", "o", F.col("n").alias("nb"))
    same = left.join(right, ["s", "o"]).where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("same_order"))
    turned = right.select("b", F.col("o").alias("s"), F.col("s").alias("o"), "nb")
    swapped = left.join(turned, ["s", "o"]).where("a < b").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("swapped"))
    both = same.join(swapped, ["a", "b"], "full_outer")
    return both.select("a", "b", F.coalesce("same_order", F.lit(0)).alias("same_order"), F.coalesce("swapped", F.lit(0)).alias("swapped"))


def signatures(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``p, subject_type, object_type, n``: node types at both ends, ``literal`` for values."""
    kinds = {c: nodes.select(F.col("id").alias(c), F.col("type").alias(f"t_{c}")) for c in ("s", "o_id")}
    known = claims.join(kinds["s"], "s", "left").join(kinds["o_id"], "o_id", "left")
    kind = F.when(F.col("o_id").isNull(), "literal").otherwise(F.coalesce("t_o_id", F.lit("unknown")))
    return known.groupBy("p", F.coalesce("t_s", F.lit("unknown")).alias("subject_type"), kind.alias("object_type")).agg(F.count("*").alias("n"))


def alias_map(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """``predicate, canonical``: the closure of exact matches (``a, b``); a class is named by its most frequent member, then the smallest."""
    parts = connected_components(matches).withColumnRenamed("id", "predicate")
    best = parts.join(counts, "predicate", "left").groupBy("component").agg(F.min_by("predicate", F.struct(-F.coalesce("n", F.lit(0)), F.col("predicate"))).alias("canonical"))
    return parts.join(best, "component").select("predicate", "canonical")


def inverse_map(pairs: DataFrame) -> DataFrame:
    """``predicate, inverse, conflict``: confirmed inverses in both directions; a predicate with several has a conflict."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return both.groupBy(F.col("a").alias("predicate")).agg(F.min("b").alias("inverse"), (F.count("*") > 1).alias("conflict"))


def proposals(counts: DataFrame, shared: DataFrame, affinity: Column, limit: int = 30, support: int = 2, judged: DataFrame | None = None) -> DataFrame:
    """The ``limit`` pairs of predicates to judge, by affinity, shared arguments and frequency: ``a, b`` with their counts, those of ``judged`` left out."""
    pairs = shared if judged is None else shared.join(judged.select("a", "b"), ["a", "b"], "left_anti")
    known = pairs.join(counts.select(F.col("predicate").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("predicate").alias("b"), F.col("n").alias("nb")), "b")
    known = known.where(F.least("na", "nb") >= support).withColumn("affinity", F.round(affinity, 6)).withColumn("shared", F.col("same_order") + F.col("swapped"))
    order = [F.col("affinity").desc(), F.col("shared").desc(), F.greatest("na", "nb").desc(), F.least("na", "nb").desc(), "a", "b"]
    return known.orderBy(*order).limit(limit)


def greedy_clusters(vocabulary: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``predicate, cluster``: single-link clusters of ``predicate, n, embedding`` in order of frequency; a predicate joins the first cluster with a member at least that near.

    The vocabulary is a closed, small table (one row for each predicate label), so that one task may hold it.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(["n", "predicate"], ascending=[False, True])
        x = np.array(pdf["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, place, names = x @ x.T >= threshold, np.full(len(x), -1), pdf["predicate"].tolist()
        heads: list[str] = []
        for i in range(len(x)):
            joined = [place[j] for j in range(i) if near[i, j]]
            place[i] = min(joined) if joined else len(heads)
            if not joined:
                heads.append(names[i])
        return pd.DataFrame({"predicate": names, "cluster": [heads[k] for k in place]})

    return vocabulary.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: cluster(pdf), "predicate string, cluster string")


def admission(raw: Column, literal: Column, registered: dict[str, str], exact: dict[str, str] | None = None, inverse: dict[str, str] | None = None) -> Column:
    """``struct<reason, predicate>`` for a proposed predicate, by rules in order.

    ``registered`` maps labels to their lifecycle (canonical or provisional); ``exact`` and ``inverse`` are learned
    mappings. Placeholders, malformed labels and noise are rejected first; then conflicts of mappings, denied,
    verbose and unregistered labels are queued; what is left is admitted with how it was found.
    """
    exact, inverse = exact or {}, inverse or {}
    label = C.predicate_label(raw)
    core = C.mapped(label, V.PREDICATE_ALIASES)
    in_ = lambda value, keys: value.isin(*sorted(keys)) if keys else F.lit(False)
    target = F.when(core != label, core).otherwise(C.mapped(label, exact))
    words = F.size(F.filter(F.split(F.translate(raw, "_-", "  "), r"\s+"), lambda w: w != ""))
    noise = ((words > 6) & raw.rlike(r"\s")) | label.isin(*V.GRAMMATICAL_GLUE)
    overridden = (core != label) & ((in_(label, exact) & (C.mapped(label, exact) != core)) | (in_(core, exact) & (C.mapped(core, exact) != core)))
    both = set(exact) & set(inverse)
    targets = [F.when(in_(key, inverse), C.mapped(key, inverse)) for key in (label, core, target)]
    several = F.size(F.array_distinct(F.array_compact(F.array(*targets)))) > 1
    conflict = overridden | in_(label, both) | in_(core, both) | several
    lifecycle = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(registered.items()) for x in pair]), target)
    verbose = F.size(F.split(target, "_")) > 6
    say = lambda reason, predicate: F.struct(F.lit(reason).alias("reason"), predicate.alias("predicate"))
    none = F.lit("")
    return (
        F.when(F.lower(raw).isin(*V.PLACEHOLDER_PREDICATES), say("reject_placeholder", none))
        .when(label == "", say("reject_malformed", none))
        .when(label.isin(*V.PLACEHOLDER_LABELS), say("reject_placeholder", none))
        .when(noise, say("reject_structural_noise", label))
        .when(conflict, say("queue_mapping_conflict", F.when(overridden | in_(label, both) | in_(core, both), core).otherwise(target)))
        .when(target.isin(*V.DENIED_PREDICATES), say("reject_structural_noise", target))
        .when(lifecycle.isNull() & verbose, say("queue_verbose_label", target))
        .when(lifecycle.isNull(), say("queue_unregistered", target))
        .when(literal, say("literal", target))
        .when(target != label, say("exact_mapping", target))
        .when(lifecycle == "provisional", say("provisional", target))
        .otherwise(say("canonical", target))
    )


def relation_gate(status: Column, noise: Column, unsupported: Column, live: Column, redundant: Column, typed: Column, accepted: Column, grounded: Column) -> Column:
    """The one reason for a relation: hard rejections before queues, queues in order, else commit."""
    return (
        F.when(status == "placeholder", "reject_placeholder")
        .when((status == "structural_noise") | noise, "reject_structural_noise")
        .when(unsupported, "reject_unsupported_inference")
        .when(~live, "reject_dead_endpoint")
        .when(redundant, "reject_redundant")
        .when(~typed, "queue_type_conflict")
        .when(~accepted, "queue_predicate")
        .when(~grounded, "queue_grounding")
        .otherwise("commit")
    )
