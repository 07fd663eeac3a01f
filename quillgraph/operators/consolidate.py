"""Consolidation: folding a batch's duplicate candidates under a veto, corroboration, prefilters, batching."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.functions import vocabulary as V
from quillgraph.operators import resolve, retrieve
from quillgraph.runtime import materialise


def grounding_score(title: Column, content: Column, source: Column) -> Column:
    """How well a source supports a candidate: 50 for its title as a phrase, 5 for each shared title token, 1 for each shared content token."""
    src, words = udfs.surface_key(source), C.word_tokens(source)
    shared = lambda x: F.size(F.array_intersect(F.array_distinct(C.word_tokens(x)), words))
    phrase = (udfs.surface_key(title) != "") & src.contains(udfs.surface_key(title))
    return F.when(src == "", 0).otherwise(F.when(phrase, 50).otherwise(0) + 5 * shared(title) + shared(content))


def collapse_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, survivor`` for each candidate, and the remapped edges without loops and repeats.

    ``nodes(seq, id, type, title, score)``, ``edges(id, type, src, dst, block_id)``. A candidate without a title folds
    with nothing. Candidates of one type and key fold
    into the best grounded one, then the first. Two that an edge joins never become one, not even through others: keys
    without such an edge, nearly all of them, fold by a window; a key with one is folded in order, by itself.
    """
    title = udfs.surface_key(F.col("title"))
    keyed = nodes.withColumn("key", F.when(title != "", F.concat_ws("\x1f", "type", title)).otherwise(F.concat(F.lit("\x1f\x1f"), "id")))
    keyed = materialise(keyed.select("seq", "id", "key", "score"), "candidates")
    ends = edges.where("src <> dst").select("src", "dst")
    inner = ends.join(keyed.select(F.col("id").alias("src"), F.col("key").alias("k1")), "src").join(keyed.select(F.col("id").alias("dst"), F.col("key").alias("k2")), "dst").where("k1 = k2").select(F.col("k1").alias("key"), "src", "dst")
    inner = materialise(inner.distinct(), "inner-edges")
    tied = inner.select("key").distinct()
    free = keyed.join(tied, "key", "left_anti")
    first = free.groupBy("key").agg(F.min_by("id", F.struct(-F.col("score"), F.col("seq"))).alias("survivor"))
    folded = free.join(first, "key").select("id", "survivor")

    def in_order(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        joined = {frozenset(p) for p in zip(pairs["src"], pairs["dst"], strict=True)}
        heads: dict[str, set[str]] = {}
        out, first = [], None
        for x in rows.sort_values("seq")["id"]:
            if first is not None and x not in heads[first] and not any(frozenset((x, m)) in joined for m in heads[first]):
                heads[first].add(x)
                out.append((x, first))
            elif first is not None and x in heads[first]:
                out.append((x, first))
            else:
                first = first or x
                heads.setdefault(x, {x})
                out.append((x, x))
        return pd.DataFrame(out, columns=["id", "survivor"])

    guarded = keyed.join(tied, "key", "left_semi").groupBy("key").cogroup(inner.groupBy("key")).applyInPandas(in_order, "id string, survivor string")
    into = materialise(folded.unionByName(guarded).distinct(), "survivors")
    ends = {c: into.select(F.col("id").alias(c), F.col("survivor").alias(f"s_{c}")) for c in ("src", "dst")}
    moved = edges.join(ends["src"], "src", "left").join(ends["dst"], "dst", "left")
    moved = moved.select("id", "type", F.coalesce("s_src", "src").alias("src"), F.coalesce("s_dst", "dst").alias("dst"), "block_id").where("src <> dst")
    return into, moved.groupBy("type", "src", "dst", "block_id").agg(F.min("id").alias("id"))


def folded_tags(nodes: DataFrame, into: DataFrame) -> DataFrame:
    """``survivor, tags``: the survivor's tags, then those of what it took in, in order of ``seq``, each once. ``nodes(seq, id, tags)``."""
    at = nodes.join(into, "id").select("survivor", F.struct((F.col("id") != F.col("survivor")).alias("other"), "seq").alias("turn"), F.posexplode("tags").alias("pos", "tag"))
    first = at.groupBy("survivor", "tag").agg(F.min(F.struct("turn", "pos")).alias("at"))
    # a survivor's distinct tags: as many as there are tags, not candidates
    listed = first.groupBy("survivor").agg(F.sort_array(F.collect_list(F.struct("at", "tag"))).alias("found"))
    return listed.select("survivor", F.col("found.tag").alias("tags"))


def evidence(pairs: DataFrame, jaccard: DataFrame, vetoes: DataFrame, fuzzy: Column, floor: float = 0.25) -> DataFrame:
    """``a, b, evidence ARRAY, corroborated`` for canonical and variant titles ``a, b, ta, tb``.

    Identity (token containment with a distinctive token) or shared neighbours corroborate; a likeness of spelling
    alone doesn't, and a distinguishing edge in either direction takes all away.
    """
    negative = vetoes.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct().withColumn("veto", F.lit(True))
    known = pairs.join(jaccard, ["a", "b"], "left").join(negative, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left")
    identity = C.token_subset_unordered(F.col("ta"), F.col("tb"))
    shared = F.exists(F.array_intersect(C.word_tokens(F.col("ta")), C.word_tokens(F.col("tb"))), C.is_distinctive)
    found = F.array_compact(
        F.array(
            F.when(fuzzy & ~shared, "fuzzy"), F.when(identity, "identity"), F.when(F.coalesce("veto", F.lit(False)), "negative"), F.when(F.coalesce("jaccard", F.lit(0.0)) >= floor, "relational")
        )
    )
    ok = ~F.array_contains("evidence", "negative") & (F.array_contains("evidence", "identity") | F.array_contains("evidence", "relational"))
    return known.select("a", "b", found.alias("evidence")).withColumn("corroborated", ok)


def authority_records(members: DataFrame, canonicals: DataFrame) -> DataFrame:
    """``cluster_id, canonical_id, member_ids, pairs`` of clusters ``cluster_id, id``; a cluster's size is capped where clusters are made."""
    joined = members.join(canonicals, "cluster_id").groupBy("cluster_id", "canonical_id").agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    others = F.filter("member_ids", lambda m: m != F.col("canonical_id"))
    return joined.select(C.cluster_id(F.col("member_ids")).alias("cluster_id"), "canonical_id", "member_ids", F.transform(others, lambda m: F.array(F.col("canonical_id"), m)).alias("pairs"))


def merge_route(confidence: Column, corroborated: Column, verdict: Column) -> Column:
    """merge at 0.9 with two corroborated members; queue other positive verdicts; skip the rest."""
    return F.when((verdict == "same") & (confidence >= 0.9) & (corroborated >= 2), "merge").when(verdict == "same", "queue").otherwise("skip")


def is_trivial(content: Column, mentions: Column, min_mentions: int, max_chars: int) -> Column:
    """Seldom mentioned, short, and one sentence at most; off below two mentions."""
    if min_mentions < 2:
        return F.lit(False)
    text = F.trim(C.text_or_empty(content))
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != ""))
    return (mentions < min_mentions) & (F.length(text) <= max_chars) & (sentences <= 1)


def is_re_mention(content: Column, known: list[Column]) -> Column:
    """Whether a candidate says nothing that one of the node's texts doesn't."""
    key = C.near_dup_key(content)
    out = key == ""
    for text in known:
        out = out | (key == C.near_dup_key(text))
    return out


def demoted(raw: Column, canonical: Column, listed: tuple[str, ...]) -> Column:
    """``raw`` or ``canonical`` if that spelling is on the list, else null."""
    names = [x.strip().lower() for x in listed if x.strip()]
    if not names:
        return F.lit(None).cast("string")
    return F.when(F.lower(F.trim(C.text_or_empty(raw))).isin(*names), "raw").when(F.lower(F.trim(C.text_or_empty(canonical))).isin(*names), "canonical")


def mention_counts(candidates: DataFrame) -> DataFrame:
    """``key, n`` by near-duplicate key of the title, without empty keys."""
    return candidates.groupBy(C.near_dup_key(F.col("title")).alias("key")).agg(F.count("*").alias("n")).where("key <> ''")


def batches(items: DataFrame, size: int) -> DataFrame:
    """``seq, block_id, batch``: items of a block in order, ``size`` to a batch; an item without a block is a batch of its own."""
    block = F.when(F.coalesce("block_id", F.lit("")) != "", F.col("block_id")).otherwise(F.concat(F.lit("\x1f"), F.col("seq").cast("string")))
    keyed = items.withColumn("__k", block)
    part = F.floor((F.row_number().over(Window.partitionBy("__k").orderBy("seq")) - 1) / max(1, size)).cast("long")
    return keyed.select("seq", "block_id", F.concat_ws("#", "__k", part.cast("string")).alias("batch"))


def lexical_aliases(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """``c_id, n_id, score``: every stored node of the candidate's type that a lane of names proposes, with the best score.

    Shared surname, proper subset with the same first or a distinctive token, and equality without company suffixes
    score 1; a Jaro-Winkler of 0.9 or more its own value. Equal exact keys, empty ones and the same id are no aliases.
    """
    keyed = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("type").alias("type"), udfs.exact_surface_key("title").alias(f"{p}_exact"), udfs.discovery_surface_key("title").alias(f"{p}_key")).where(F.col(f"{p}_exact") != "")
    left, right = materialise(keyed(candidates, "c"), "alias-candidates"), materialise(keyed(stored, "n"), "alias-stored")
    one = F.lit(1.0)

    def meet(key: Callable[[Column], Column]) -> DataFrame:
        c, n = (df.withColumn("w", key(F.col(f"{p}_key"))).where("w IS NOT NULL AND w <> ''") for df, p in ((left, "c"), (right, "n")))
        return c.join(n, ["type", "w"])

    subset = C.proper_subset(C.word_tokens(F.col("c_key")), C.word_tokens(F.col("n_key")))
    stripped = lambda c: F.size(C.alias_base(F.col(c))) < F.size(C.word_tokens(F.col(c)))
    pairs = [
        meet(C.surname).withColumn("score", one),
        meet(lambda k: F.get(C.word_tokens(k), F.lit(0))).where(subset).withColumn("score", one),
        meet(lambda k: F.explode(F.filter(F.array_distinct(C.word_tokens(k)), C.is_distinctive))).where(subset).withColumn("score", one),
        meet(lambda k: F.array_join(C.alias_base(k), " ")).where(stripped("c_key") | stripped("n_key")).withColumn("score", one),
        meet(lambda k: k).withColumn("score", one),
    ]
    sides = left.select("type", F.col("c_key").alias("key")).unionByName(right.select("type", F.col("n_key").alias("key"))).distinct()
    fuzzy = resolve.fuzzy_key_pairs(sides.where(F.length("key") >= V.FUZZY_MIN_LENGTH).withColumn("id", F.concat_ws("\x1f", "type", "key")))
    fuzzy = fuzzy.select("a", "b", "score").unionByName(fuzzy.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    alike = left.withColumn("a", F.concat_ws("\x1f", "type", "c_key")).join(fuzzy, "a").join(right.withColumn("b", F.concat_ws("\x1f", "type", "n_key")).drop("type"), "b")
    names = ["c_id", "n_id", "c_exact", "n_exact", "score"]
    every = functools.reduce(DataFrame.unionByName, [p.select(*names) for p in (*pairs, alike)])
    return every.where("c_exact <> n_exact AND c_id <> n_id").groupBy("c_id", "n_id").agg(F.max("score").alias("score"))


def judged(candidates: DataFrame, stored: DataFrame, same: Column, band: float = V.SIMILAR_COSINE, k: int = 3, cap: int = 5) -> DataFrame:
    """``candidate_id, node_id``: the first stored node, in order of likeness, that the judge (a column over both rows) calls the same.

    ``candidates`` and ``stored`` have ``id, type, title, embedding``. At most ``k`` come from the vector
    band, and of all others that the lanes of names propose the ``cap`` best by score and id; the judge sees no others.
    """
    left, right = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "type", "title", "embedding")]) for df, p in ((candidates, "c"), (stored, "n")))
    rank = lambda order: F.row_number().over(Window.partitionBy("c_id").orderBy(*order))
    # scores have nine decimals, so that above the floor means at the band or above
    near = retrieve.vector(stored.select("id", "type", "embedding"), candidates.select(F.col("id").alias("query_id"), "type", "embedding"), k, same_type=True, floor=band - 5e-10)
    near = near.select(F.col("query_id").alias("c_id"), F.col("id").alias("n_id"), "score", F.col("rank").alias("r")).join(left, "c_id").join(right, "n_id")
    named = lexical_aliases(candidates, stored).join(near.select("c_id", "n_id"), ["c_id", "n_id"], "left_anti")
    named = named.withColumn("r", rank([F.col("score").desc(), "n_id"])).where(F.col("r") <= cap).join(left, "c_id").join(right, "n_id")
    both = near.withColumn("lane", F.lit(0)).unionByName(named.withColumn("lane", F.lit(1))).where(same)
    return both.groupBy(F.col("c_id").alias("candidate_id")).agg(F.min_by("n_id", F.struct("lane", "r")).alias("node_id"))


def corrected_types(chains: DataFrame, current: DataFrame) -> DataFrame:
    """``id, type, broken``: types after corrections ``seq, id, previous, corrected`` in order; a chain whose links don't meet is broken and keeps the type."""
    w = Window.partitionBy("id").orderBy("seq")
    linked = chains.join(current, "id").withColumn("before", F.coalesce(F.lag("corrected").over(w), "type"))
    ends = linked.groupBy("id").agg(F.max_by("corrected", "seq").alias("last"), F.max((F.col("before") != F.col("previous")).cast("int")).alias("bad"))
    out = current.join(ends, "id", "left")
    broken = F.coalesce("bad", F.lit(0)) == 1
    return out.select("id", F.when(broken | F.col("last").isNull(), F.col("type")).otherwise(F.col("last")).alias("type"), broken.alias("broken"))
