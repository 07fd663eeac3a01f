"""Queries on the property graph: census, degrees, neighbourhoods, ego graphs, folds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.operators import gates
from quillgraph.operators.retrieve import degrees, neighbours
from quillgraph.runtime import materialise


def census(nodes: DataFrame) -> DataFrame:
    """``type, structural, n`` with totals by type, by flag and of all, in one pass: grouping sets over the flagged nodes."""
    sets = nodes.groupingSets([["type", "structural"], ["type"], ["structural"], []], "type", "structural")
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def top_subgraph(nodes: DataFrame, edges: DataFrame, limit: int, min_degree: int = 0) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` nodes of the highest degree among edges with both ends visible, and the edges between them.

    Edges are counted and never written: all of them, and again without those of hidden ends if there are any.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    counted = materialise(degrees(edges), "end-degrees")
    hidden = materialise(counted.select("id").join(nodes.select("id"), "id", "left_anti"), "hidden-ends")
    if not hidden.isEmpty():
        counted = degrees(edges.join(hidden.withColumnRenamed("id", "src"), "src", "left_anti").join(hidden.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    ranked = nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")).where(F.col("degree") >= min_degree)
    order = [F.col("degree").desc(), F.col("id")]
    kept = materialise(ranked.orderBy(*order).limit(limit), "top-nodes")
    ids = F.broadcast(kept.select("id"))  # at most ``limit`` rows
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.orderBy(*order), inner


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``seed, id, hop``: every node within ``hops`` undirected steps of each seed, with its least distance."""
    near = materialise(neighbours(edges), "near")
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(near, "id").select("seed", F.col("other").alias("id")).distinct()
        frontier = step.join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if hop < hops:
            frontier = materialise(frontier, f"hop-{hop}")
        seen = seen.unionByName(frontier)
    return seen


def capped_neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int, limit: int) -> DataFrame:
    """``seed, id, hop``: the nearest ``limit`` nodes of each seed, those of a hop in order of id, the seed first."""
    place = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "id"))
    return k_hop(seeds, edges, hops).withColumn("__n", place).where(F.col("__n") <= limit).drop("__n")


def bridge_claims(claims: DataFrame, seeds: DataFrame, terms: DataFrame, cap: int, min_confidence: float = 0.0, allowed: Iterable[str] | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """``seed, id, coverage, confidence, rank``: for each seed entity the ``cap`` claims that mention it and answer best.

    ``claims(id, s, p, o_id, o_literal, confidence)``, ``terms(seed, term)``. Claims that the gates or the ``allowed``
    predicates hold back count for nothing. A claim is worth the inverse frequencies, within its seed's claims, of
    the terms that it covers; ties go by confidence, by the cosine to the question (``similarity(seed, id, cosine)``,
    where given), then id.
    """
    ends = claims.where(gates.passes(claims) & gates.predicate_allowed(F.col("p"), allowed)).where(F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)) >= min_confidence).select("*", F.explode(F.array_distinct(F.array_compact(F.array("s", "o_id")))).alias("seed"))
    pool = ends.join(seeds.select("seed").distinct(), "seed")
    size = pool.groupBy("seed").agg(F.count("*").alias("n"))
    text = F.concat_ws(" ", C.verbalized(F.col("p")), F.coalesce("o_literal", F.lit("")))
    covered = pool.select("seed", "id", F.explode(F.array_distinct(C.word_tokens(text))).alias("term")).join(terms, ["seed", "term"])
    # a hub's claims are counted in parts, and cut to the cap in each task before they meet
    covered = covered.join(covered.groupBy("seed", "term").agg(F.count("*").alias("df")).join(size, "seed"), ["seed", "term"])
    scores = covered.groupBy("seed", "id").agg(F.round(F.sum(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), 9).alias("coverage"))
    ranked = pool.join(scores, ["seed", "id"], "left").select("seed", "id", "s", "p", "o_id", "o_literal", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)).alias("confidence"))
    order = [F.col("coverage").desc(), F.col("confidence").desc()]
    if similarity is not None:
        ranked = ranked.join(similarity, ["seed", "id"], "left")
        order.append(F.coalesce("cosine", F.lit(0.0)).desc())
    place = F.row_number().over(Window.partitionBy("seed").orderBy(*order, "id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= cap).drop("cosine")


#: Claims of a seed's own block that are shown with it.
SIBLINGS = 3


def claim_seeds(claims: DataFrame, seeds: DataFrame, terms: DataFrame, cap: int = SIBLINGS, min_confidence: float = 0.0, allowed: Iterable[str] | None = None, similarity: DataFrame | None = None) -> DataFrame:
    """``seed, id, s, p, o_id, o_literal, coverage, confidence, rank``: each claim that is a seed, at rank 0, and its ``cap`` best siblings.

    ``claims(id, s, p, o_id, o_literal, confidence, block_id)``, ``seeds(seed)`` ids of claims, ``terms(seed, term)``. Siblings are the other
    claims of the seed's block that have its subject at either end. They are ranked by the question's terms that they cover, weighed
    by inverse frequency among seed and siblings, then by confidence, ``similarity(seed, id, cosine)``, and id.

    * A seed without a subject, and one that the gates or its confidence hold back, opens nothing; without a block it has no siblings.
    * An end and its block meet in one equality join, so a hub meets its own block's seeds alone; siblings are cut to the cap in each task.
    * Repeated claims count once; seeds of unknown ids give nothing.
    """
    fine = claims.where(gates.passes(claims) & gates.predicate_allowed(F.col("p"), allowed) & (F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)) >= min_confidence))
    shown = ["id", "s", "p", "o_id", "o_literal", F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)).alias("confidence"), "block_id"]
    fine = fine.select(*shown).dropDuplicates(["id"])
    own = fine.where(F.coalesce("s", F.lit("")) != "").join(seeds.select(F.col("seed").alias("id")).distinct(), "id", "left_semi")
    opened = materialise(own.select(F.col("id").alias("seed"), F.col("s").alias("end"), "block_id"), "claim-seeds")
    ends = fine.where(F.coalesce("block_id", F.lit("")) != "").select("*", F.explode(F.array_distinct(F.array_compact(F.array("s", "o_id")))).alias("end"))
    near = ends.join(opened, ["end", "block_id"]).where("id <> seed").drop("end", "block_id")
    pool = near.withColumn("sibling", F.lit(True)).unionByName(own.drop("block_id").withColumn("seed", F.col("id")).withColumn("sibling", F.lit(False)))
    pool = materialise(pool, "claim-seed-pool")
    text = F.concat_ws(" ", C.verbalized(F.col("p")), F.coalesce("o_literal", F.lit("")))
    covered = pool.select("seed", "id", F.explode(F.array_distinct(C.word_tokens(text))).alias("term")).join(terms.distinct(), ["seed", "term"])
    size = pool.groupBy("seed").agg(F.count("*").alias("n"))
    covered = covered.join(covered.groupBy("seed", "term").agg(F.count("*").alias("df")).join(size, "seed"), ["seed", "term"])
    scores = covered.groupBy("seed", "id").agg(F.round(F.sum(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), 9).alias("coverage"))
    scored = pool.join(scores, ["seed", "id"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    order = [F.col("coverage").desc(), F.col("confidence").desc()]
    if similarity is not None:
        scored = scored.join(similarity, ["seed", "id"], "left")
        order.append(F.coalesce("cosine", F.lit(0.0)).desc())
    place = F.row_number().over(Window.partitionBy("seed").orderBy("sibling", *order, "id"))
    columns = ["seed", "id", "s", "p", "o_id", "o_literal", "coverage", "confidence"]
    return scored.withColumn("rank", place).where(F.col("rank") <= cap + 1).select(*columns, (F.col("rank") - 1).alias("rank"))


def claim_ego_graph(claims: DataFrame, seeds: DataFrame, terms: DataFrame, cap: int, hops: int = 1, allowed: Iterable[str] | None = None) -> DataFrame:
    """Rows of the ego graph of each claim seed: ``seed, hop, id, s, p, o_id, o_literal, coverage, confidence``; a fact once, in its first hop.

    The first hop holds the seed, its siblings and the ``cap`` best claims of its subject, wherever they stand; later ones
    at most ``max(cap // 2, 4)`` claims of each entity, and ``cap`` entities, that the hop before named.
    """
    near = materialise(claim_seeds(claims, seeds, terms, allowed=allowed), "claim-ego")
    columns = ["seed", "hop", "id", "s", "p", "o_id", "o_literal", "coverage", "confidence"]
    out = near.withColumn("hop", F.lit(1)).select(*columns)
    # a seed's subject is opened under the seed's own question
    frontier = known = near.where("rank = 0").select("seed", F.col("s").alias("entity"))
    # seeds that ask for the same terms ask one question
    asked = materialise(terms.groupBy("seed").agg(F.array_sort(F.collect_set("term")).alias("question")), "claim-questions")
    for hop in range(1, hops + 1):
        found = _entity_claims(claims, frontier, asked, cap if hop == 1 else max(cap // 2, 4), allowed)
        rows = materialise(found.withColumn("hop", F.lit(hop)).select(*columns), f"claim-ego-{hop}")
        out = out.unionByName(rows)
        if hop < hops:
            named = (out if hop == 1 else rows).select("seed", "coverage", "confidence", F.explode(F.array_compact(F.array("s", "o_id"))).alias("entity"))
            best = named.groupBy("seed", "entity").agg(F.max(F.struct("coverage", "confidence")).alias("b")).join(known, ["seed", "entity"], "left_anti")
            place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("b").desc(), "entity"))
            frontier = materialise(best.withColumn("n", place).where(F.col("n") <= cap).select("seed", "entity"), f"claim-frontier-{hop}")
            known = known.unionByName(frontier)
    fact = Window.partitionBy("seed", "s", "p", F.coalesce("o_id", F.concat(F.lit("\x1f"), "o_literal"))).orderBy("hop", F.col("coverage").desc(), F.col("confidence").desc(), "id")
    return out.withColumn("__n", F.row_number().over(fact)).where("__n = 1").drop("__n")


def _entity_claims(claims: DataFrame, ends: DataFrame, asked: DataFrame, cap: int, allowed: Iterable[str] | None) -> DataFrame:
    """The ``cap`` best claims of each entity under each question, for every seed that opens it: ``ends(seed, entity)``, ``asked(seed, question)`` with sorted terms.

    An entity's claims are ranked once for each question and not for each seed. Those that hold the same words cover the
    same, so they are counted together, and only the ``cap`` best of them meet the questions.
    """
    ends = materialise(ends.join(asked, "seed", "left").select("seed", "entity", F.coalesce("question", F.array().cast("array<string>")).alias("question")), "claim-ends")
    opened = materialise(ends.select("entity", "question").distinct(), "claim-opened")
    fine = claims.where(gates.passes(claims) & gates.predicate_allowed(F.col("p"), allowed)).withColumn("confidence", F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)))
    words = F.array_sort(F.array_distinct(C.word_tokens(F.concat_ws(" ", C.verbalized(F.col("p")), F.coalesce("o_literal", F.lit(""))))))
    shown = ["id", "s", "p", "o_id", "o_literal", "confidence"]
    about = fine.select(*shown, words.alias("words"), F.explode(F.array_distinct(F.array_compact(F.array("s", "o_id")))).alias("entity"))
    about = materialise(about.join(opened.select("entity").distinct(), "entity", "left_semi").dropDuplicates(["entity", "id"]), "claims-about", compression="zstd")
    held = materialise(about.groupBy("entity", "words").agg(F.count("*").alias("m")), "claim-words")
    place = F.row_number().over(Window.partitionBy("entity", "words").orderBy(F.col("confidence").desc(), "id"))
    best = about.withColumn("n", place).where(F.col("n") <= cap).drop("n")
    # inverse frequency among an entity's claims
    of_term = held.select("entity", "words", "m", F.explode("words").alias("term")).join(opened.select("entity", F.explode("question").alias("term")).distinct(), ["entity", "term"])
    size, df = held.groupBy("entity").agg(F.sum("m").alias("n")), of_term.groupBy("entity", "term").agg(F.sum("m").alias("df"))
    covered = of_term.select("entity", "words", "term").join(opened.select("entity", "question", F.explode("question").alias("term")), ["entity", "term"]).join(df, ["entity", "term"]).join(size, "entity")
    scores = covered.groupBy("entity", "question", "words").agg(F.round(F.sum(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), 9).alias("coverage"))
    scored = opened.join(best, "entity").join(scores, ["entity", "question", "words"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("entity", "question").orderBy(F.col("coverage").desc(), F.col("confidence").desc(), "id"))
    top = scored.select("entity", "question", *shown, "coverage", place.alias("rank")).where(F.col("rank") <= cap)
    return ends.join(top, ["entity", "question"])


def ego_graph(claims: DataFrame, seeds: DataFrame, terms: DataFrame, cap: int, hops: int = 1, allowed: Iterable[str] | None = None) -> DataFrame:
    """Rows of each seed's ego graph: ``seed, hop, id, s, p, o_id, o_literal, coverage, confidence``; a fact once, in its first hop.

    Each level takes ``cap`` claims for every entity at its frontier, and the entities that these name are the next
    level's frontier, at most ``cap`` of them.
    """
    out, frontier, known = None, seeds.select("seed", F.col("seed").alias("entity")), seeds.select("seed", F.col("seed").alias("entity"))
    for hop in range(1, hops + 1):
        asked = frontier.select(F.col("entity").alias("seed")).distinct()
        words = frontier.join(terms, "seed").select(F.col("entity").alias("seed"), "term").distinct()
        found = bridge_claims(claims, asked, words, cap, allowed=allowed).withColumnRenamed("seed", "entity")
        rows = frontier.join(found, "entity").withColumn("hop", F.lit(hop))
        rows = materialise(rows.drop("entity", "rank"), f"ego-{hop}")
        out = rows if out is None else out.unionByName(rows)
        if hop < hops:
            ends = rows.select("seed", "coverage", "confidence", F.explode(F.array_compact(F.array("s", "o_id"))).alias("entity"))
            best = ends.groupBy("seed", "entity").agg(F.max(F.struct("coverage", "confidence")).alias("b")).join(known, ["seed", "entity"], "left_anti")
            place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("b").desc(), "entity"))
            frontier = materialise(best.withColumn("n", place).where(F.col("n") <= cap).select("seed", "entity"), f"frontier-{hop}")
            known = known.unionByName(frontier)
    fact = Window.partitionBy("seed", "s", "p", F.coalesce("o_id", F.concat(F.lit("\x1f"), "o_literal"))).orderBy("hop", F.col("coverage").desc(), F.col("confidence").desc(), "id")
    return out.withColumn("__n", F.row_number().over(fact)).where("__n = 1").drop("__n")


def within_budget(rows: DataFrame, group: str, order: list, cost, budget: int) -> DataFrame:
    """The first rows of each group, in order, whose costs together stay within the budget: all before the first that overflows."""
    upto = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("spent", upto).where(F.col("spent") <= budget)


def rendered(rows: DataFrame, group: str) -> DataFrame:
    """``group, text``: claims of a group as lines of text, ordered by coverage, confidence and id."""
    line = F.concat(F.lit("- "), F.col("s"), F.lit(" "), C.verbalized(F.col("p")), F.lit(" "), F.coalesce("o_id", "o_literal"), F.lit(". ["), F.substring("id", 1, 8), F.lit("]"))
    item = F.struct((-F.col("coverage")).alias("a"), (-F.col("confidence")).alias("b"), F.col("id"), line.alias("line"))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))


def fold_graph(edges: DataFrame, equivalence: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, type, dst``: edges with members replaced by canonicals that are nodes of the view, without loops and repeats."""
    present = equivalence.join(nodes.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").select("member_id", "canonical_id")
    left, right = (present.select(F.col("member_id").alias(c), F.col("canonical_id").alias(f"c_{c}")) for c in ("src", "dst"))
    moved = edges.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("c_src", "src").alias("src"), "type", F.coalesce("c_dst", "dst").alias("dst"))
    return moved.where("src <> dst").distinct()


def fold_nodes(nodes: DataFrame, equivalence: DataFrame) -> DataFrame:
    """``id, variant_count``: nodes without the variants whose canonical is among them."""
    present = equivalence.join(nodes.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi")
    named = nodes.join(present, nodes["id"] == present["member_id"], "left").select(F.coalesce("canonical_id", "id").alias("id"))
    return named.groupBy("id").agg((F.count("*") - 1).alias("variant_count"))


def _turned(rows: DataFrame, kind: str, ends: tuple[str, str], inverse: DataFrame | None) -> DataFrame:
    """Rows whose predicate has an inverse that is the canonical one (``predicate, canonical``): under that, with their ends swapped. Rows without both ends stay."""
    if inverse is None:
        return rows
    a, b = ends
    named = rows.join(inverse.select(F.col("predicate").alias(kind), F.col("canonical").alias("__turn")).dropDuplicates([kind]), kind, "left")
    swap = F.col("__turn").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    new = {kind: F.when(swap, F.col("__turn")).otherwise(F.col(kind)), a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))}
    return named.select(*(new.get(c, F.col(c)).alias(c) for c in rows.columns))


def canonical_edges(edges: DataFrame, equivalence: DataFrame, aliases: DataFrame, inverse: DataFrame | None = None) -> DataFrame:
    """``id, type, src, dst``: edges between canonical entities under canonical types, keyed anew, without loops and repeats.

    ``equivalence(member_id, canonical_id)``, ``aliases(predicate, canonical)`` and ``inverse`` of the same columns, by which an edge is turned round. A member or
    predicate has one canonical; null ends are no edges.
    """
    turned = _turned(edges.select("type", "src", "dst"), "type", ("src", "dst"), inverse)
    ends = {c: equivalence.select(F.col("member_id").alias(c), F.col("canonical_id").alias(f"c_{c}")) for c in ("src", "dst")}
    moved = turned.join(ends["src"], "src", "left").join(ends["dst"], "dst", "left").join(aliases.withColumnRenamed("predicate", "type"), "type", "left")
    moved = moved.select(F.coalesce("canonical", "type").alias("type"), F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")).where("src <> dst").distinct()
    return moved.select(C.edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", "src", "dst")


def canonical_nodes(nodes: DataFrame, equivalence: DataFrame) -> DataFrame:
    """Nodes without the members that another node stands for; one whose canonical isn't there stays."""
    held = equivalence.where("member_id <> canonical_id").join(nodes.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi")
    return nodes.join(held.select(F.col("member_id").alias("id")), "id", "left_anti")


def canonical_copy(claims: DataFrame, equivalence: DataFrame, aliases: DataFrame, inverse: DataFrame | None = None) -> DataFrame:
    """Claims on canonical entities and predicates, keyed anew; equal ones are one, with the number that say so and the best confidence.

    ``inverse(predicate, canonical)`` turns a claim on an entity round, so that both directions of a relation are one claim.
    """
    claims = _turned(claims, "p", ("s", "o_id"), inverse)
    ends = {c: equivalence.select(F.col("member_id").alias(c), F.col("canonical_id").alias(f"c_{c}")) for c in ("s", "o_id")}
    moved = claims.join(ends["s"], "s", "left").join(ends["o_id"], "o_id", "left").join(aliases.withColumnRenamed("predicate", "p"), "p", "left")
    moved = moved.select(F.coalesce("c_s", "s").alias("s"), F.coalesce("canonical", "p").alias("p"), F.coalesce("c_o_id", "o_id").alias("o_id"), "o_literal", "confidence")
    moved = moved.where(F.col("o_id").isNull() | (F.col("s") != F.col("o_id")))
    key = C.sha256_id(F.lit("claim"), F.col("s"), F.col("p"), F.coalesce("o_id", "o_literal"))
    return moved.groupBy(key.alias("id"), "s", "p", "o_id", "o_literal").agg(F.count("*").alias("corroboration"), F.max("confidence").alias("confidence"))
