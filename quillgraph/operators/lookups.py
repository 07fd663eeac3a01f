"""Reads around a node: provenance, hits, detail, relationships, routing, mentions, references, identities and tallies."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.functions import vocabulary as V
from quillgraph.operators import gates
from quillgraph.runtime import materialise

#: Relationships that keep look-alikes apart come first where only some are shown.
DISTINGUISHING = ("alias_of", "different_from", "distinguished_from", "not_same_as")
RELATIONSHIP_CAP = 5
COMMIT_CONFIDENCE, FOLD_CONFIDENCE = 0.75, 0.85


def sha256_uri(value: Column) -> Column:
    """``sha256:`` and 64 hex digits: those of the value if it has that shape, else its digest."""
    raw = C.text_or_empty(value)
    bare = F.regexp_replace(raw, "^sha256:", "")
    return F.concat(F.lit("sha256:"), F.when(bare.rlike("^[0-9a-fA-F]{64}$"), bare).otherwise(F.sha2(raw, 256)))


def provenance(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """``id, path, byte_start, byte_end, content_hash, block_id``: where each claim's bytes lie.

    ``claims(id, block_id, span STRUCT<source_path, byte_start, byte_end, content_hash>)``, ``blocks(id, path,
    byte_start, byte_end, content_hash)``. A span counts if its path stays within the root and it has a digest; then
    the block's anchor; a claim without either is its own digest, without a path.
    """
    span = F.col("span")
    fine = F.coalesce(C.safe_path(span["source_path"]) & (span["source_path"] != "") & (span["content_hash"] != ""), F.lit(False))
    held = blocks.select(F.col("id").alias("block_id"), F.struct(F.col("path").alias("source_path"), "byte_start", "byte_end", "content_hash").alias("held"))
    known = claims.join(held, "block_id", "left").withColumn("at", F.when(fine, span).otherwise(F.col("held")))
    inside = F.when(C.safe_path(F.col("at.source_path")), F.col("at.source_path"))
    number = lambda c: F.coalesce(F.col(f"at.{c}"), F.lit(0)).cast("long").alias(c)
    return known.select("id", C.text_or_empty(inside).alias("path"), number("byte_start"), number("byte_end"), sha256_uri(F.coalesce(F.col("at.content_hash"), F.col("id").cast("string"))).alias("content_hash"), C.text_or_empty(F.col("block_id")).alias("block_id"))


def query_hits(results: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The first ``k`` results of each question (``query_id, id, score, rank``) with their anchors, scores over the question's best, from 0 to 1."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    top = results.where(F.col("rank") <= k).withColumn("best", best)
    part = F.when(F.col("best") == 0, F.col("score")).otherwise(F.col("score") / F.col("best"))
    return top.withColumn("score", F.greatest(F.lit(0.0), F.least(part, F.lit(1.0)))).drop("best").join(anchors, "id", "left")


def node_detail(nodes: DataFrame, edges: DataFrame, equivalence: DataFrame, types: Sequence[str]) -> DataFrame:
    """``id, edge_type, direction, n, canonical_id``: each visible node's edges by type and direction, and the node that stands for it."""
    shown = nodes.where(F.col("type").isin(*types) & ~gates.is_infra(nodes)).select("id").join(equivalence.select(F.col("member_id").alias("id"), "canonical_id"), "id", "left")
    ends = edges.select("type", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction")))).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias("id"), F.col("type").alias("edge_type"), F.col("e.direction").alias("direction")).agg(F.count("*").alias("n"))
    return shown.join(counts, "id", "left").select("id", "edge_type", "direction", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("canonical_id", "id").alias("canonical_id"))


def node_edges(asked: DataFrame, nodes: DataFrame, edges: DataFrame, equivalence: DataFrame) -> DataFrame:
    """``id, type, title, canonical_id, direction, edge_type, other, other_title``: all that a node's page shows, a row for each edge; a node without edges has one row.

    ``asked(id)``, ``nodes(id, type, title)``, ``edges(type, src, dst)``, ``equivalence(member_id, canonical_id)``. A loop is an edge in and out. The title of an end that
    isn't a node is null; unknown and null ids have no row, repeated ones one. Ends are joined by their ids, so a hub's edges are split as any join's.
    """
    shown = nodes.join(asked.where("id IS NOT NULL").select("id").distinct(), "id", "left_semi").select("id", "type", "title").join(equivalence.select(F.col("member_id").alias("id"), "canonical_id"), "id", "left")
    both = [edges.select(F.col(a).alias("id"), F.lit(way).alias("direction"), F.col("type").alias("edge_type"), F.col(b).alias("other")) for a, b, way in (("src", "dst", "out"), ("dst", "src", "in"))]
    titles = nodes.select(F.col("id").alias("other"), F.col("title").alias("other_title"))
    rows = shown.join(both[0].unionByName(both[1]), "id", "left").join(titles, "other", "left")
    return rows.select("id", "type", "title", F.coalesce("canonical_id", "id").alias("canonical_id"), "direction", "edge_type", "other", "other_title")


def relationship_lines(subjects: DataFrame, edges: DataFrame, titles: DataFrame, cap: int = RELATIONSHIP_CAP) -> DataFrame:
    """``id, rank, line``: at most ``cap`` relationships of each subject as text, distinguishing ones first, then outgoing ones.

    The cut is made on ids, by partial ranks in each task, before titles are joined.
    """
    ends = [edges.select(F.col(a).alias("id"), "type", F.col(b).alias("other"), F.lit(d).alias("incoming")) for a, b, d in (("src", "dst", 0), ("dst", "src", 1))]
    near = ends[0].unionByName(ends[1]).join(subjects.select("id").distinct(), "id", "left_semi")
    apart = F.when(F.col("type").isin(*DISTINGUISHING), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("id").orderBy(apart, "incoming", "type", "other"))
    top = near.withColumn("rank", place).where(F.col("rank") <= cap)
    name = lambda c: titles.select(F.col("id").alias(c), F.col("title").alias(f"t_{c}"))
    named = top.join(name("id"), "id", "left").join(name("other"), "other", "left")
    own, far = F.coalesce("t_id", "id"), F.coalesce("t_other", "other")
    left, right = F.when(F.col("incoming") == 0, own).otherwise(far), F.when(F.col("incoming") == 0, far).otherwise(own)
    return named.select("id", "rank", F.concat(left, F.lit(" --"), "type", F.lit("--> "), right).alias("line"))


def object_nodes(claims: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, object_id``: the object of each topology claim, by its ``rdf:object`` edge, else by its facet; only nodes that exist."""
    bridge = edges.where("type = 'rdf:object'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("bridge"))
    named = claims.join(bridge, "id", "left").select("id", F.coalesce("bridge", "o_id").alias("object_id")).where("object_id <> ''")
    return named.join(nodes.select(F.col("id").alias("object_id")), "object_id", "left_semi")


def routed_claims(claims: DataFrame, nodes: DataFrame, min_confidence: float = 0.0, allowed: Sequence[str] | None = None) -> DataFrame:
    """``id, section``: claims with an object whose ends may both be shown are relationships, those with a literal are claims; a fact once, by its smallest id."""
    fine = nodes.where(gates.passes(nodes)).select("id", F.lit(True).alias("ok"))
    live = claims.where(gates.passes(claims) & gates.predicate_allowed(F.col("p"), allowed) & (F.coalesce("confidence", F.lit(V.CLAIM_CONFIDENCE)) >= min_confidence))
    ends = {c: fine.select(F.col("id").alias(c), F.col("ok").alias(f"ok_{c}")) for c in ("s", "o_id")}
    known = live.join(ends["s"], "s", "left").join(ends["o_id"], "o_id", "left")
    tied = C.text_or_empty(F.col("o_id")) != ""
    section = F.when(tied & F.col("ok_s") & F.col("ok_o_id"), "relationship").when(~tied & F.col("o_literal").isNotNull(), "claim")
    routed = known.withColumn("section", section).where("section IS NOT NULL")
    return routed.groupBy("section", "s", "p", F.coalesce(F.when(tied, F.col("o_id")), "o_literal").alias("o")).agg(F.min("id").alias("id")).select("id", "section")


def visible_nodes(nodes: DataFrame, types: Sequence[str], include_structural: bool = False) -> DataFrame:
    """Nodes that the browser shows: of the closed types, no infrastructure, and no claims about a document's structure unless asked."""
    shown = nodes.where(F.col("type").isin(*types) & ~gates.is_infra(nodes))
    return shown if include_structural else shown.where(~((F.col("type") == "Claim") & C.is_structural_claim(F.col("p"), F.col("title"))))


def source_mentions(entities: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, type, src, dst``: mentions that are still to be made from documents to the entities whose ``source_path`` names them."""
    named = entities.where(F.col("type").isin(*V.PRIMITIVE_TYPES) & (F.col("source_path") != "")).select(F.col("id").alias("dst"), C.sha256_id(F.lit("document"), F.col("source_path")).alias("src"))
    found = named.where("src <> dst").join(documents.select(F.col("id").alias("src")), "src", "left_semi").distinct()
    kind = F.lit("schema:mentions")
    return found.select(C.edge_id(F.col("src"), kind, F.col("dst")).alias("id"), kind.alias("type"), "src", "dst").join(edges.select("id"), "id", "left_anti")


def evidence_blocks(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """``id, evidence_id``: the blocks of each document's path, or the document itself."""
    return documents.join(blocks.select("path", F.col("id").alias("block")), "path", "left").select("id", F.coalesce("block", "id").alias("evidence_id"))


def model_claims(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """``block_id, id``: claims that a model made from each block, by ``prov:wasDerivedFrom``; deterministic ones and plumbing aren't."""
    live = claims.where((C.text_or_empty(F.col("model_id")) != "") & ~gates.is_infra(claims)).select("id")
    return edges.where("type = 'prov:wasDerivedFrom'").select(F.col("dst").alias("block_id"), F.col("src").alias("id")).distinct().join(live, "id", "left_semi")


def correction_candidates(edges: DataFrame, claims: DataFrame, orphans: DataFrame, current: DataFrame) -> DataFrame:
    """``id``: model claims of orphaned blocks (``block_id``) that no current block supports."""
    made = model_claims(edges, claims)
    return made.join(orphans, "block_id", "left_semi").select("id").distinct().join(made.join(current, "block_id", "left_semi").select("id"), "id", "left_anti")


def ledger_references(refs: DataFrame, candidates: DataFrame, planned: DataFrame) -> DataFrame:
    """``refs`` with ``kind``: to a node that a plan creates (internal), to a candidate without a plan (observed), or to anything else (external)."""
    known = refs.join(planned.select(F.col("id").alias("ref")).distinct().withColumn("p", F.lit(True)), "ref", "left").join(candidates.select(F.col("id").alias("ref")).distinct().withColumn("c", F.lit(True)), "ref", "left")
    return known.withColumn("kind", F.when(F.col("p"), "internal").when(F.col("c"), "observed_unplanned").otherwise("external")).drop("p", "c")


def collision_groups(members: DataFrame, key: str) -> DataFrame:
    """``kind, key, type, n``: keys that several members of one type have, and keys under several types (type null); empty keys are none."""
    counts = members.where(F.col(key) != "").groupBy(F.col(key).alias("key"), "type").agg(F.count("*").alias("n"))
    same = counts.where("n > 1").select(F.lit("same_type").alias("kind"), "key", "type", "n")
    across = counts.groupBy("key").agg(F.count("*").alias("types"), F.sum("n").alias("n")).where("types > 1")
    return same.unionByName(across.select(F.lit("cross_type").alias("kind"), "key", F.lit(None).cast("string").alias("type"), "n"))


def top_counts(counts: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent keys of each group, the smaller key first on a tie."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), key))
    return counts.withColumn("rank", place).where(F.col("rank") <= limit)


def type_layer(nodes: DataFrame, support: Sequence[str]) -> DataFrame:
    """``type, n, kind``: nodes by type, which are primitives, support or invalid."""
    kind = F.when(F.col("type").isin(*V.PRIMITIVE_TYPES), "primitive").when(F.col("type").isin(*support), "support").otherwise("invalid")
    return nodes.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", kind)


def combined_costs(costs: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Sums of the fields of each group, ``measured`` only if all of its rows are."""
    status = F.when(F.min((F.col("status") == "measured").cast("int")) == 1, "measured").otherwise("partial")
    return costs.groupBy(group).agg(status.alias("status"), *(F.sum(f).alias(f) for f in fields))


def accuracy(rows: DataFrame, group: str) -> DataFrame:
    """``count, correct, incorrect, accuracy`` of ``correct`` for each group."""
    out = rows.groupBy(group).agg(F.count("correct").alias("count"), F.sum(F.col("correct").cast("long")).alias("hits"))
    return out.select(group, "count", F.col("hits").alias("correct"), (F.col("count") - F.col("hits")).alias("incorrect"), F.round(F.col("hits") / F.col("count"), 6).alias("accuracy"))


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` runs by start, or else by end."""
    return runs.withColumn("began", F.coalesce("started_at", "completed_at")).orderBy(F.col("began").desc_nulls_last(), "run_id").limit(limit)


def commit_decision(confidence: Column, contradicted: Column, threshold: float = COMMIT_CONFIDENCE) -> Column:
    """Null where a candidate is committed, else why it is reviewed: a contradiction, whatever the confidence, or too little of that."""
    return F.when(contradicted, "contradiction").when(confidence >= threshold, F.lit(None).cast("string")).otherwise("low_confidence")


def folds_onto_incumbent(verdict: Column, target: Column, proposed: Column, confidence: Column, canonical: Column) -> Column:
    """Whether a proposed label gives way to its target."""
    return F.coalesce((verdict == "same") & (target != "") & (target != proposed) & (confidence >= FOLD_CONFIDENCE) & ((canonical == "") | (canonical == target)), F.lit(False))


def validity(superseded: Column, valid_until: Column, detached: Column, valid_as_of: Column) -> Column:
    """What a caller is told of a claim that no longer holds, or has lost its source."""
    return F.struct(superseded.alias("superseded"), F.when(superseded, valid_until).alias("valid_until"), detached.alias("detached"), F.when(detached, valid_as_of).alias("valid_as_of"))


def uses_chunking(size: Column, overlap: Column, chunk_bytes: int, overlap_bytes: int) -> Column:
    """Whether a block was cut under the policy; one without facets was cut under the old one."""
    return (F.coalesce(size, F.lit(V.LEGACY_CHUNK_BYTES)) == chunk_bytes) & (F.coalesce(overlap, F.lit(0)) == overlap_bytes)


def candidate_id(kind: Column, title: Column, content: Column) -> Column:
    """The id of a candidate, by its title's surface key and not by its spelling."""
    return C.sha256_id(kind, udfs.surface_key(title), content)


def json_id(**fields: Column) -> Column:
    """sha256 of the fields as compact JSON in order of their names, nulls included; for ASCII values."""
    return F.sha2(F.to_json(F.struct(*(value.alias(name) for name, value in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def outer_roots(roots: DataFrame) -> DataFrame:
    """``root``: those that lie in no other, each once. Each root meets its own ancestors, not all roots."""
    path = F.regexp_replace("root", "/+$", "")
    named = roots.select(path.alias("root")).distinct()
    steps = F.split("root", "/")
    above = named.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("ancestor")).where("ancestor <> ''")
    return named.join(above.join(named.toDF("ancestor"), "ancestor").select("root").distinct(), "root", "left_anti")


@F.pandas_udf(StringType())
def node_digest(ids: pd.Series, kinds: pd.Series, titles: pd.Series, contents: pd.Series, tags: pd.Series, predicates: pd.Series, embeddings: pd.Series) -> pd.Series:
    """sha256 over all of a node that can move a search score: its texts as compact JSON, then its vector as float64."""
    out = []
    for node, kind, title, content, tag, predicate, vector in zip(ids, kinds, titles, contents, tags, predicates, embeddings, strict=True):
        fields = [node, kind, title, content, [] if tag is None else list(tag), predicate]
        raw = json.dumps(fields, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")
        out.append(hashlib.sha256(raw + (b"\x00" if vector is None else b"\x01" + np.asarray(vector, "<f8").tobytes())).hexdigest())
    return pd.Series(out, dtype=object)


def node_digests(nodes: DataFrame) -> DataFrame:
    """``id, digest`` of ``nodes(id, type, title, content, tags, p, embedding)``."""
    return nodes.select("id", node_digest("id", "type", "title", "content", "tags", "p", "embedding").alias("digest"))


def generation(digests: DataFrame, buckets: int = 1024) -> DataFrame:
    """``bucket, n, digest``: stamps of ranges of nodes, whose digests are joined in order of id; any change of a node changes its bucket's.

    One stamp over all ids in order would need one task for the whole graph. Nodes are dealt to ``buckets`` by their
    id's hash, and the few stamps stand for the graph.
    """
    at = digests.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: x["digest"]), "")
    return at.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("digest"))


def alias_score(left: Column, right: Column) -> Column:
    """Why two titles go before the judge: 1 for shared bases without company suffixes, a surname or token containment; a high Jaro-Winkler for its own value; else null."""
    a, b = udfs.surface_key(left), udfs.surface_key(right)
    base_a, base_b = C.alias_base(left), C.alias_base(right)
    cut = (F.size(base_a) < F.size(C.word_tokens(left))) | (F.size(base_b) < F.size(C.word_tokens(right)))
    bases = (F.size(base_a) > 0) & (base_a == base_b) & cut
    surname = C.surname(left).isNotNull() & (C.surname(left) == C.surname(right))
    contained = C.token_subset(left, right) | C.token_subset_unordered(left, right)
    likeness, keys = udfs.jaro_winkler(left, right), [udfs.discovery_surface_key(x) for x in (left, right)]
    near = (likeness >= V.STRONG_JARO_WINKLER) & ((keys[0] == keys[1]) | (F.least(F.length(keys[0]), F.length(keys[1])) >= V.FUZZY_MIN_LENGTH))
    return F.when((a == "") | (b == "") | (a == b), F.lit(None).cast("double")).when(F.coalesce(bases | surname | contained, F.lit(False)), 1.0).when(near, likeness)


def within_batch(pairs: DataFrame, order: DataFrame, confidence: float = 0.85, edges: DataFrame | None = None, apart: DataFrame | None = None, k: int = 3) -> DataFrame:
    """``id, survivor``: candidates of a batch (``id, seq``), each folded into an earlier one that is still its own, or left as it is.

    ``pairs(a, b, same BOOLEAN, confidence[, score])`` are what the lanes propose, with the judge's answer. In order of
    ``seq`` a candidate meets, of its pairs with earlier candidates that were *not* folded, the ``k`` best by
    ``score`` (then the earlier one), and folds into the first that the judge calls the same at ``confidence`` or more. An edge
    (``src, dst``) between it and the other, or anything folded into the other before, keeps them apart; so does a pair of ``apart`` (``a, b``), for itself.

    A candidate waits only for what can change its own outcome, so all that don't depend on each other are
    decided in one round: who surely folds, wherever to, holds up nobody. The result is that of the loop in order.

    * Nulls: a pair with a null answer, confidence or end isn't the same; a null score is 0. Repeated pairs count by their best score, then the surest answer.
    * Equal ``seq`` go by id, a repeated id has its first; pairs and edges of unknown ids, and loops, count for nothing. No candidates give no rows.
    """
    order = materialise(order.groupBy("id").agg(F.min("seq").alias("seq")), "batch-order")
    place = lambda c: order.select(F.col("id").alias(c), F.struct("seq", "id").alias(f"at_{c}"))
    score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in pairs.columns else F.lit(0.0)
    accept = F.coalesce(F.col("same") & (F.col("confidence") >= confidence), F.lit(False))
    both = pairs.select("a", "b", score.cast("double").alias("score"), accept.alias("accept")).join(place("a"), "a").join(place("b"), "b").where("a <> b")
    early = F.col("at_a") < F.col("at_b")
    both = both.select(*(F.when(early, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"))), F.when(early, F.col("at_a")).otherwise(F.col("at_b")).alias("at"), "score", "accept")
    met = both.groupBy("a", "b").agg(F.max(F.struct("score", "accept")).alias("best"), F.first("at").alias("at")).select("a", "b", "at", "best.score", "best.accept")
    ends = None
    if edges is not None:
        ends = edges.select(F.col("src").alias("b"), F.col("dst").alias("c")).unionByName(edges.select(F.col("dst").alias("b"), F.col("src").alias("c"))).where("b <> c").distinct()
        ends = materialise(ends, "batch-edges")
        met = met.join(ends.withColumnRenamed("c", "a"), ["a", "b"], "left_anti")
    if apart is not None:
        met = met.join(apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ["a", "b"], "left_anti")
    met = materialise(met, "batch-pairs")
    # what may lie in the other's closure and is tied to the candidate: decided before it, or it waits
    tied = None
    if ends is not None:
        others = met.select("a", F.col("b").alias("c"))
        tied = met.select("a", "b").join(ends, "b").join(others, ["a", "c"]).join(place("b"), "b").join(place("c"), "c").where("at_c < at_b").select("a", "b", "c")
        tied = materialise(tied, "batch-ties")
    waiting = met.where("accept").select(F.col("b").alias("id")).distinct()
    state = materialise(order.select("id").join(waiting.withColumn("w", F.lit(True)), "id", "left").select("id", F.when(F.col("w").isNull(), F.col("id")).alias("survivor"), F.lit(False).alias("folds")), "batch-state")
    while not state.where("survivor IS NULL").isEmpty():
        known = state.select(F.col("id").alias("a"), F.col("survivor").alias("sa"), F.col("folds").alias("fa"))
        # of the pairs of those that wait: with whom is or may be a survivor
        rows = met.join(state.where("survivor IS NULL").select(F.col("id").alias("b")), "b", "left_semi").join(known, "a").where("(sa IS NULL AND NOT fa) OR sa = a")
        rows = rows.withColumn("open", F.col("sa").isNull())
        if tied is not None:
            barred = tied.join(state.select(F.col("id").alias("c"), F.col("survivor").alias("sc")), "c").groupBy("a", "b").agg(F.max(F.coalesce(F.col("sc") == F.col("a"), F.lit(False))).alias("barred"), F.max(F.col("sc").isNull()).alias("unsure"))
            rows = rows.join(barred, ["a", "b"], "left").where("NOT coalesce(barred, false)").withColumn("open", F.col("open") | F.coalesce("unsure", F.lit(False)))
        # a pair that is taken matters if fewer than k that aren't come before it: surely few, or perhaps
        before = Window.partitionBy("b").orderBy(F.col("score").desc(), "at").rowsBetween(Window.unboundedPreceding, -1)
        count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
        rows = rows.withColumn("least", count(~F.col("accept") & ~F.col("open"))).withColumn("most", count(~F.col("accept"))).where(F.col("accept") & (F.col("least") < k))
        told = rows.withColumn("sure", ~F.col("open") & (F.col("most") < k)).groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct("sure", "a"), F.struct(-F.col("score"), F.col("at"))).alias("first"), F.max("sure").alias("sure"))
        after = state.where("survivor IS NULL").join(told, "id", "left")
        after = after.select("id", F.when(F.col("first").isNull(), F.col("id")).when(F.col("first.sure"), F.col("first.a")).alias("survivor"), (F.col("folds") | F.coalesce("sure", F.lit(False))).alias("folds"))
        state = materialise(state.where("survivor IS NOT NULL").unionByName(after), "batch-state")
    return state.select("id", "survivor")
