"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words is trained from confirmed toxic documents and unlabelled ones. The risk is
corrected by the class prior: pi * E_pos[l(+)] + max(0, E_unl[l(-)] - pi * E_pos[l(-)]). Where the second
part turns negative, the step climbs back instead, so that a flexible model can't drive it below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Tokens, tokens_of
from quillgraph.llm.quality import held_out, sampled_labels
from quillgraph.runtime import materialise, remove_scratch

#: Hashed vocabulary of the model.
BUCKETS = 1 << 20
#: The score at which a document counts as toxic.
CUT = 0.3
#: Lengths of the word starts that are features beside the whole words.
STARTS = (4, 5, 6)


def _features(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their first bytes, with their documents; not yet distinct."""
    keys, docs = [t.hashes], [t.docs]
    for size in STARTS:
        long = t.lengths >= size
        keys.append(t.starts(size)[long])
        docs.append(t.docs[long])
    return (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(docs)


def _distinct(buckets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct buckets, in order of documents."""
    both = np.unique(docs.astype(np.int64) * BUCKETS + buckets)
    return both % BUCKETS, both // BUCKETS


def word_buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of one text."""
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
    return _distinct(*_features(next(tokens_of(batch, "text"))[1]))[0].astype(np.int32)


class _Rows:
    """Sparse rows of ones: flat column indices with row starts."""

    def __init__(self, lists: list[np.ndarray], column_of: np.ndarray):
        kept = [c[c >= 0] for c in (column_of[x] for x in lists)]
        self.n = len(lists)
        self.cols = np.concatenate(kept) if kept else np.empty(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), [len(k) for k in kept])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], width)


@dataclass
class ToxicModel:
    """A weight for each bucket that was selected, and a bias. The decision lies at a score of CUT."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.buckets] = self.weights
        return out


def _calibrated(pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept that put the cut where the prior-corrected zero-one risk of held-back rows is least.

    Of cuts that differ by less than one positive row the one in the widest gap between scores wins.
    """
    values = np.unique(np.concatenate([pos, unl]))
    cuts, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    hit = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    flagged = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    risk = prior * (1 - hit) + np.maximum(0, flagged - prior * hit)
    good = risk <= risk.min() + prior / len(pos) if len(cuts) else np.empty(0, bool)
    cut = cuts[good][np.argmax(gaps[good])] if good.any() else float(values.mean())
    slope = 3 / max(float(np.median(pos)) - cut, 1e-3)
    return slope, float(np.log(CUT / (1 - CUT)) - slope * cut)


_MUL = np.random.default_rng(17).integers(0, 2**62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def without_copies(rows: pa.Table) -> list[int]:
    """Keys of the rows without those that share seven of eight marks with an earlier one: copies aren't new evidence."""
    seen: set[tuple[int, int]] = set()
    out: dict[int, None] = {}
    for key, marks in zip(rows.column("key").to_pylist(), rows.column("marks").to_pylist(), strict=True):
        places = list(enumerate(marks))
        if sum(place in seen for place in places) < 7:
            out[key] = None
        seen.update(places)
    return list(out)


def selected_buckets(pos: np.ndarray, unl: np.ndarray, n_p: int, n_u: int, prior: float, *, width: int = 2048, support: float = 0.02, lift: float = 8.0) -> np.ndarray:
    """Places of the at most ``width`` buckets that separate best, from the documents of both kinds that hold each.

    What few positive documents hold, or what is about as common elsewhere, says little. The rate among clean
    documents comes from the unlabelled ones by the same correction as the risk.
    """
    rate_p, rate_u = pos / n_p, unl / n_u
    clean = np.maximum((rate_u - prior * rate_p) / (1 - prior), 0.0)
    z = (rate_p - rate_u) / np.sqrt((rate_u + 1 / n_u) / n_p + (rate_u + 1 / n_u) / n_u)
    chosen = np.flatnonzero((pos >= max(3, support * n_p)) & (rate_p > lift * clean) & (z > 4))
    return np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:width]])


def nn_risk(gp: np.ndarray, gu: np.ndarray, prior: float, gamma: float = 1.0) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """The non-negative risk under the logistic loss, the step's directions for both kinds of rows, and whether the second part was clipped.

    Unclipped, the directions are the risk's gradients. Where the part for clean rows is negative, they climb back:
    ``gamma`` times the descent of that part, turned round.
    """
    sigma = lambda t: 1 / (1 + np.exp(-np.clip(t, -50, 50)))
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up, uu = prior * sigma(gp) / len(gp), sigma(gu) / len(gu)  # gradients of the loss as a negative
    if negative < 0:
        return positive, gamma * up, -gamma * uu, True
    return positive + negative, np.full(len(gp), -prior / len(gp)), uu, False  # l(+) - l(-) is -g


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-3, gamma: float = 1.0) -> ToxicModel:
    """Full-batch Adam on the non-negative risk over the ``chosen`` buckets; every fifth row is held back for the cut."""
    column_of = np.full(BUCKETS, -1, np.int64)
    column_of[chosen] = np.arange(len(chosen))
    pos, unl = (_Rows([x for i, x in enumerate(rows) if i % 5], column_of) for rows in (positive, unlabelled))
    cut_pos, cut_unl = (_Rows(rows[::5], column_of) for rows in (positive, unlabelled))
    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0, 0.0
    for step in range(1, steps + 1):
        _, dp, du, _ = nn_risk(pos.dot(w) + b, unl.dot(w) + b, prior, gamma)
        grad, gb = pos.back(dp, len(w)) + unl.back(du, len(w)) + decay * w, dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    slope, shift = _calibrated(cut_pos.dot(w), cut_unl.dot(w), prior)
    return ToxicModel(chosen, w * slope, shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", modulus: int = 4, remainder: int = 2, max_positive: int = 10_000, max_unlabelled: int = 20_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """Train from about ``max_positive`` confirmed toxic rows and ``max_unlabelled`` documents, both by seeded hash and never held-out ones.

    The class prior is the toxic share of the labels that may be learned. The sample is written; to the driver come
    eight marks of each row (copies aren't new evidence), the supports of buckets that enough positive rows hold,
    and of each row the buckets that were selected.
    """
    held = held_out("doc_id", modulus, remainder)
    sample, counts = sampled_labels(labels, label_col, held, max_positive, seed)
    n = sum(counts.values())
    prior = min(max(counts.get(1, 0) / n if n else 0.01, 1e-4), 1 - 1e-4)
    texts = docs.where(~held_out(id_col, modulus, remainder)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, max_unlabelled / max(1, docs.count()) * modulus / (modulus - 1))
    picked = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1_000_000)) / 1e6 < share
    both = texts.join(F.broadcast(sample.where("y = 1")), "id", "left").select("id", "text", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce(picked, F.lit(False)).alias("u")).where("y = 1 OR u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tokens in tokens_of(batch, "text"):
                buckets, owners = _distinct(*_features(tokens))
                starts = np.searchsorted(owners, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(buckets.astype(np.int32)))
                marks = np.full((8, part.num_rows), -1, np.int64)
                filled = np.flatnonzero(np.diff(starts))
                if len(filled):
                    for k, mul in enumerate(_MUL):
                        marks[k, filled] = np.minimum.reduceat(buckets.astype(np.uint64) * mul, starts[filled]).view(np.int64)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * part.num_rows + 1, 8, dtype=np.int32)), pa.array(marks.T.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "y", "u")), lists, marks], names=["key", "y", "u", "x", "marks"])

    keyed = both.select(F.xxhash64("id", "text").alias("key"), "text", "y", "u")
    rows = materialise(keyed.mapInArrow(run, "key bigint, y int, u boolean, x array<int>, marks array<bigint>"), "toxic-sample")
    spark = docs.sparkSession
    seen = rows.select("key", "y", "u", "marks").toArrow().sort_by("key")
    positive = set(without_copies(seen.filter(pa.compute.equal(seen.column("y"), 1))))
    unlabelled = set(without_copies(seen.filter(seen.column("u"))))
    n_p, n_u = len(positive), len(unlabelled)
    if min(n_p, n_u) < 5:
        remove_scratch(spark, rows)
        return ToxicModel(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    kept = spark.createDataFrame([(k, int(k in positive), int(k in unlabelled)) for k in sorted(positive | unlabelled)], "key bigint, p int, q int")
    known = rows.dropDuplicates(["key"]).select("key", "x").join(F.broadcast(kept), "key")
    support = known.select(F.explode("x").alias("bucket"), "p", "q").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    support = support.where("p >= 3").toArrow().sort_by("bucket")
    buckets, p, q = (support.column(c).to_numpy() for c in ("bucket", "p", "q"))
    chosen = buckets[selected_buckets(p, q, n_p, n_u, prior)].astype(np.int64)
    found = known.select("key", "p", "q", F.array_intersect("x", F.lit(chosen.astype(np.int32).tolist()).cast("array<int>")).alias("x")).toArrow().sort_by("key")
    remove_scratch(spark, rows)
    lists, p, q = ([np.asarray(x.values) for x in found.column("x")], *(found.column(c).to_pylist() for c in "pq"))
    return train_nnpu([x for x, k in zip(lists, p, strict=True) if k], [x for x, k in zip(lists, q, strict=True) if k], chosen, prior)


def toxicity_scores(docs: DataFrame, model: ToxicModel, *, threshold: float = 0.3, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row, in one pass without a shuffle.

    Every row is scored by its whole text and by nothing else. A null text counts as empty; an empty text gets
    the score of a text without any selected word. A missing id isn't held out; an empty table gives an empty
    result. Without toxic labels every score is the class prior.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value.table(), shared.value.bias
        for batch in batches:
            for part, tokens in tokens_of(batch, "text"):
                buckets, owners = _features(tokens)
                weighty = table[buckets] != 0
                buckets, owners = _distinct(buckets[weighty], owners[weighty])
                logit = bias + np.bincount(owners, table[buckets], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))), pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
