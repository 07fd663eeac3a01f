"""Hybrid retrieval over batches of questions: lexical, vector, title and answer legs, fused by rank.

All functions take ``queries(query_id, ...)`` and work on every question at once. Statistics are joined, never
collected; lists are ranked with explicit ties (smaller id first).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.operators import gates
from quillgraph.runtime import materialise, spread


def ranked(df: DataFrame, k: int | None = None, group: Sequence[str] = ("query_id",), score: str = "score", tie: str = "id") -> DataFrame:
    """Add ``rank`` from 1 by falling score; with ``k`` only the first k, pruned within each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie)))
    out = df.withColumn("rank", place)
    return out.where(F.col("rank") <= k) if k else out


def postings(corpus: DataFrame, text: Column) -> DataFrame:
    """``id, term, tf, dl``: one row for each distinct token of a text. Counted within the row, so nothing is shuffled."""
    # no filter on the array or its size: it would be pushed to the scan and cut each text once more
    tokens = corpus.select("id", C.search_tokens(text).alias("t")).select("id", F.size("t").alias("dl"), F.explode_outer("t").alias("term"))
    return tokens.where("term IS NOT NULL").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_stats(post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Document frequency of each term; number and mean length of the texts that have tokens."""
    frequency = post.groupBy("term").agg(F.count("*").alias("df"))
    size = post.select("id", "dl").distinct().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return frequency, size


def bm25(corpus: DataFrame, text: Column, queries: DataFrame, query_text: Column, k: int = 10) -> DataFrame:
    """``query_id, id, score, rank``: Okapi scores of the best ``k`` texts for each question.

    Texts are cut into tokens once: the postings of the terms that are asked for are written, with one more row for
    each text, from which the number of texts and their mean length come.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(C.search_tokens(query_text))).alias("term"))
    wanted = asked.select("term").distinct().unionByName(queries.sparkSession.createDataFrame([("",)], "term string"))
    tokens = corpus.select("id", C.search_tokens(text).alias("t")).select("id", F.size("t").alias("dl"), F.array_append("t", "").alias("t"))
    # the marker makes every array one that yields rows; said with explode_outer, so that no filter on its size cuts the text again
    post = tokens.select("id", "dl", F.explode_outer("t").alias("term")).join(wanted, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    # few rows may come back as one file: what each of them meets next is work for all cores
    post = spread(materialise(post, "postings"))
    size = post.where("term = '' AND dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    # counted with partial sums in each task: a term of a third of all texts is one row for each task, not one group
    frequency = post.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    # a posting's weight is its own: computed once, before it meets the questions
    length = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / F.col("avgdl"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = post.join(frequency, "term").join(F.broadcast(size)).select("id", "term", (idf * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + length)).alias("weight"))  # one row
    scored = weighted.join(asked, "term").groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
    return ranked(scored.withColumn("score", F.round("score", 9)), k)


#: Bytes of question vectors that go to every task at a time.
VECTOR_BYTES = 32_000_000


def _unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` numbers as unit rows, and their places; others, and those without a length, are left out."""
    lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1))
    at = np.flatnonzero(lengths == dim)
    flat = pa.compute.list_flatten(vectors.take(pa.array(at)))
    rows = np.array(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(len(at), dim)
    size = np.sqrt((rows * rows).sum(1))
    fine = np.isfinite(size) & (size > 0)
    return rows[fine] / size[fine][:, None], at[fine]


def vector(corpus: DataFrame, queries: DataFrame, k: int | None = 10, same_type: bool = False, floor: float = 0.0) -> DataFrame:
    """``query_id, id, score, rank`` by cosine of ``embedding``, times the column ``w`` if the corpus has one; only scores above ``floor``.

    With ``same_type`` only within one ``type``. A stated set of questions meets every row in blocks: its vectors go
    to the tasks, at most ``VECTOR_BYTES`` at a time and one pass over the corpus for each such part, a task
    multiplies matrices, and with ``k`` it keeps the best ``k`` of its rows for each question. Without ``k`` every
    pair above the floor is a row. Vectors of another length than the part's are left out.
    """
    spark, weighted = corpus.sparkSession, "w" in corpus.columns
    n, dim = queries.where(F.col("embedding").isNotNull()).agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = max(1, -(-n * (dim or 1) * 8 // VECTOR_BYTES))
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((corpus, "id"), (queries, "query_id")))
    rows = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding", *(["type"] if same_type else []), *(["w"] if weighted else []))
    found = None
    for part in range(parts):
        asks = queries.where(F.col("embedding").isNotNull()).where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "embedding", *(["type"] if same_type else [])).toArrow().combine_chunks()
        units, at = _unit_rows(asks.column("embedding").combine_chunks() if asks.num_rows else pa.array([], pa.list_(pa.float64())), dim or 1)
        asks = asks.take(pa.array(at))
        shared = spark.sparkContext.broadcast((units, asks.column("query_id").combine_chunks(), asks.column("type").to_pylist() if same_type else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            units, query_ids, types = shared.value
            for batch in batches:
                for piece in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                    vectors, at = _unit_rows(piece.column("embedding"), units.shape[1])
                    scores = vectors @ units.T
                    if weighted:
                        scores *= np.array(piece.column("w"))[at][:, None]
                    scores = np.round(scores, 9)
                    if types is not None:
                        scores[np.array(piece.column("type").to_pylist(), dtype=object)[at][:, None] != np.array(types, dtype=object)[None, :]] = -np.inf
                    if k and len(at) > k:
                        # ties with the k-th stay: ids decide between them
                        least = np.partition(scores, len(at) - k, axis=0)[len(at) - k]
                        keep = (scores > floor) & (scores >= least[None, :])
                    else:
                        keep = scores > floor
                    which, row = np.nonzero(keep.T)
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(which)), piece.column("id").take(pa.array(at[row])), pa.array(scores[row, which])], names=["query_id", "id", "score"])

        scored = rows.mapInArrow(run, f"query_id {query_type}, id {id_type}, score double") if len(at) else spark.createDataFrame([], f"query_id {query_type}, id {id_type}, score double")
        found = scored if found is None else found.unionByName(scored)
    return ranked(found, k)


def title_matches(corpus: DataFrame, queries: DataFrame, query_text: Column) -> DataFrame:
    """``query_id, id, score, phrase``: nodes whose title has two or more content terms, all in the question; ``phrase`` where the whole title is one of it.

    Blocked on the title's terms: a node meets a question only through the rarest of its title's terms.
    """
    asks = queries.select("query_id", C.content_terms(query_text).alias("qt"), F.array_join(C.word_tokens(query_text), " ").alias("qp"))
    tokens = C.word_tokens(F.col("title"))
    named = corpus.select("id", tokens.alias("tt"), C.content_terms(F.col("title")).alias("terms"), C.quality_weight(F.col("p"), F.col("title")).alias("w")).where(F.size("terms") >= 2)
    terms = named.select("id", F.explode("terms").alias("term"))
    rare = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    met = named.join(rare, "id").join(asks.select("query_id", "qt", "qp", F.explode("qt").alias("term")), "term")
    met = met.where(F.size(F.array_except("terms", "qt")) == 0)
    score = (F.size("terms") + F.least(F.size("tt"), F.lit(12)) / 100.0) * F.col("w")
    return met.select("query_id", "id", F.round(score, 9).alias("score"), F.col("qp").contains(F.array_join("tt", " ")).alias("phrase"))


def title_legs(corpus: DataFrame, queries: DataFrame, query_text: Column, exact: bool) -> DataFrame:
    """``query_id, id, score, rank`` of ``title_matches``; ``exact``: of phrases alone."""
    met = title_matches(corpus, queries, query_text)
    return ranked((met.where("phrase") if exact else met).select("query_id", "id", "score"))


def asked_terms(claims: DataFrame, queries: DataFrame, query_text: Column) -> tuple[DataFrame, DataFrame]:
    """The questions' terms (``query_id, term``), and ``id, term`` for those that each of ``claims(id, text)`` holds, and a null for each claim; texts are cut once."""
    asks = materialise(queries.select("query_id", F.explode(C.question_terms(query_text)).alias("term")), "asked-terms")
    words = F.array_append(F.array_distinct(C.word_tokens(F.col("text"))), F.lit(None).cast("string"))
    every = claims.select("id", words.alias("t")).select("id", F.explode_outer("t").alias("term"))
    wanted = asks.select("term").distinct().withColumn("asked", F.lit(True))
    held = every.join(wanted, "term", "left").where("asked OR term IS NULL").select("id", "term")
    return asks, spread(materialise(held, "claim-terms"))


def answer_ranks(pool: DataFrame, asks: DataFrame, held: DataFrame) -> DataFrame:
    """Claims of each question's pool (``query_id, id``) by the inverse frequencies, within the pool, of the question's terms that they cover; only ids move."""
    pool = pool.join(held.where("term IS NULL").select("id"), "id").select("query_id", "id")
    size = pool.groupBy("query_id").agg(F.count("*").alias("n"))
    terms = materialise(asks.join(held, "term").join(pool, ["query_id", "id"]).select("query_id", "id", "term"), "pool-terms")
    frequency = terms.groupBy("query_id", "term").agg(F.count("*").alias("df")).join(size, "query_id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return ranked(terms.join(frequency, ["query_id", "term"]).groupBy("query_id", "id").agg(F.round(F.sum(idf), 9).alias("score")).where("score > 0"))


def answer_leg(pool: DataFrame, queries: DataFrame, query_text: Column) -> DataFrame:
    """``answer_ranks`` of a pool with texts (``query_id, id, text``): each claim's text is cut once, however many questions it stands in."""
    claims = pool.select("id", "text").dropDuplicates(["id"])
    return answer_ranks(pool.select("query_id", "id").distinct(), *asked_terms(claims, queries, query_text))


def rrf(*legs: DataFrame) -> DataFrame:
    """``query_id, id, score``: the sum over the legs of 1 / (60 + rank)."""
    out = None
    for leg in legs:
        part = leg.select("query_id", "id", (1 / (V.RRF_K + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: edges in and out; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Each pair of different neighbours once in each direction: ``id, other``."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    return both.where("id <> other").distinct()


def one_hop(fused: DataFrame, edges: DataFrame, seeds: int = V.EXPANSION_SEEDS) -> DataFrame:
    """Add to ``fused`` what neighbours of the best seeds borrow: half the seed's score over the neighbour's degree."""
    top = ranked(fused, seeds).select("query_id", "id", "score")
    borrowed = top.join(neighbours(edges), "id").join(degrees(edges).withColumnRenamed("id", "other"), "other")
    borrowed = borrowed.select("query_id", F.col("other").alias("id"), (F.col("score") * V.HOP_DISCOUNT / F.greatest("degree", F.lit(1))).alias("score"))
    return fused.select("query_id", "id", "score").unionByName(borrowed).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def fold_equivalence(results: DataFrame, equivalence: DataFrame) -> DataFrame:
    """One row for each class (``member_id, canonical_id``) of a question: the best score, named by the canonical where it is a result, else by the best member."""
    known = results.join(equivalence, results["id"] == equivalence["member_id"], "left").withColumn("cls", F.coalesce("canonical_id", "id"))
    folded = known.groupBy("query_id", "cls").agg(F.max("score").alias("score"), F.max((F.col("id") == F.col("cls")).cast("int")).alias("present"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("top"))
    return folded.select("query_id", F.when(F.col("present") == 1, F.col("cls")).otherwise(F.col("top")).alias("id"), "score")


def fold_predicates(claims: DataFrame, aliases: DataFrame, column: str = "p") -> DataFrame:
    """Claims under their canonical predicate (``predicate, canonical``)."""
    return claims.join(aliases, claims[column] == aliases["predicate"], "left").withColumn(column, F.coalesce("canonical", column)).drop("predicate", "canonical")


def hybrid_recall(corpus: DataFrame, queries: DataFrame, edges: DataFrame, k: int = 10, equivalence: DataFrame | None = None, vector_k: int | None = None) -> DataFrame:
    """The whole retriever: ``corpus(id, type, title, content, p, embedding)``, ``queries(query_id, text, embedding)``.

    Five legs are fused, the best seeds lend to their neighbours, scores are weighted by quality, infrastructure,
    superseded claims and raw blocks go (columns ``infra`` and ``superseded`` where the corpus has them), classes are
    folded, and claims that answer a question come first. Returns ``query_id, id, score, rank``.

    The vector leg ranks every node of a positive weighted cosine, so that nothing is out of reach; that writes a row
    for each question and such node. ``vector_k`` bounds it for corpora where that is too much.
    """
    limit = max(k, V.LEAST_RESULTS)
    text = F.concat_ws(" ", "title", "content")
    # the contents are read for the lexical and the answer leg alone; what the others need is written once without them
    light = corpus.withColumn("w", C.quality_weight(F.col("p"), F.col("title"))).withColumn("recallable", gates.recallable(corpus))
    light = materialise(light.select("id", "title", "p", "w", "embedding", "recallable"), "corpus-without-contents")
    titled = materialise(title_matches(light, queries, F.col("text")), "titled")
    legs = [ranked(df.select("query_id", "id", "score")) for df in (titled.where("phrase"), titled)]
    legs += [vector(light, queries, k=vector_k), bm25(corpus, text, queries, F.col("text"), limit)]
    # each leg is computed once: the pool, the fusion and the answers read the written ranks
    found = reduce(DataFrame.unionByName, (leg.select("query_id", "id", "rank") for leg in legs))
    found = spread(materialise(found, "legs"))
    claims = corpus.where((F.col("type") == "Claim") & ~C.is_structural_claim(F.col("p"), F.col("title"))).select("id", text.alias("text"))
    asks, held = asked_terms(claims, queries, F.col("text"))
    answers = answer_ranks(found.select("query_id", "id").distinct(), asks, held)
    fused = one_hop(materialise(rrf(found, answers), "fused"), edges)
    known = light.where("recallable").select("id", "w")
    results = materialise(fused.join(known, "id").select("query_id", "id", (F.col("score") * F.col("w")).alias("score")), "results")
    if equivalence is not None:
        results = fold_equivalence(results, equivalence)
    final = answer_ranks(results.select("query_id", "id"), asks, held).select("query_id", "id", F.col("rank").alias("answer"))
    results = results.join(final, ["query_id", "id"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("answer").asc_nulls_last(), F.col("score").desc(), "id"))
    return results.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


def diversify(results: DataFrame, limit: int, subject_cap: int = V.SEED_SUBJECT_CAP, entity_min: int = V.SEED_ENTITY_MIN, relation_min: int = V.SEED_RELATION_MIN, scalar_max: int = V.SEED_SCALAR_MAX) -> DataFrame:
    """Seeds of each question under quotas: ``results(query_id, id, rank, type, s, p, o_id, o_literal)``.

    Facts said twice cost one place; then entities and relation claims up to their floors, the rest by rank under the
    caps on scalar claims and on claims of a subject, and what is over if places are left. The greedy choice runs in
    Python, for one question's results at a time.
    """
    fact = F.array_join(C.word_tokens(F.coalesce(F.when(F.col("o_id") != "", F.col("o_id")), "o_literal")), " ")
    repeats = (F.col("type") == "Claim") & (F.coalesce("s", F.lit("")) != "") & (fact != "")
    key = F.when(repeats, F.concat_ws("\x1f", "s", F.lower(F.trim(C.text_or_empty(F.col("p")))), fact)).otherwise(F.concat(F.lit("\x1e"), "id"))
    once = results.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))).where("__n = 1").drop("__n")
    kind = F.when(F.col("type") != "Claim", "entity").when(F.trim(C.text_or_empty(F.col("o_id"))) != "", "rel").otherwise("scalar")
    subject = F.when(F.col("type") == "Claim", F.trim(C.text_or_empty(F.col("s")))).otherwise("")
    rows = once.select("query_id", "id", "rank", kind.alias("kind"), subject.alias("subject"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        if len(pdf) <= limit:
            return pdf[["query_id", "id", "rank"]]
        taken: list[int] = []
        by_subject: dict[str, int] = {}
        by_kind = dict.fromkeys(("entity", "rel", "scalar"), 0)

        def fill(wanted, room) -> None:
            for i, kind, subject in zip(pdf.index, pdf["kind"], pdf["subject"], strict=True):
                if len(taken) >= limit or not room():
                    return
                if i not in taken and wanted(kind, subject):
                    taken.append(i)
                    by_kind[kind] += 1
                    if subject:
                        by_subject[subject] = by_subject.get(subject, 0) + 1

        fits = lambda kind, subject: not (kind == "scalar" and by_kind["scalar"] >= scalar_max) and not (subject and by_subject.get(subject, 0) >= subject_cap)
        fill(lambda kind, _: kind == "entity", lambda: by_kind["entity"] < entity_min)
        fill(lambda kind, subject: kind == "rel" and fits(kind, subject), lambda: by_kind["rel"] < relation_min)
        fill(fits, lambda: True)
        fill(lambda *_: True, lambda: True)
        return pdf.loc[sorted(taken), ["query_id", "id", "rank"]]

    return rows.groupBy("query_id").applyInPandas(choose, "query_id bigint, id string, rank int")
