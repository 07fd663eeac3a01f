"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the
identity. A score is the difference of the two Gaussian log-densities plus the log prior ratio; the
Mahalanobis terms come from the inverse Cholesky factors, which are computed once and travel with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "stop": [ord(c) for c in ".,;:"],
    "bang": [ord(c) for c in "!?"],
    "symbol": [ord(c) for c in "#$%&*+=@^~<>\\/_"],
    "bar": [ord(c) for c in "|[]{}"],
    "beyond": [*range(128, 256)],
    "space": [32, 9, 10, 11, 12, 13],
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_bytes, _i] = 1


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of the whole text: logarithms of sizes, square roots of shares. Empty texts give finite ones too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines, size = raw.split(), raw.split(b"\n"), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, share = len(words), lambda part, whole, slack=8.0: np.sqrt(part / (whole + slack))
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(map(bytes.isupper, words))
    odd = len(words) - sum(map(bytes.isalnum, words))
    full = [x for x in lines if len(x) > 1]
    probable = counts[counts > 0] / max(size, 1)
    entropy = -(probable * np.log2(probable)).sum() if size else 0.0
    return np.array([
        np.log1p(size), np.log1p(n), np.log1p(len(lines)), np.log1p((size - n) / max(n, 1)), np.log1p(size / len(lines)), entropy,
        *share(counts @ _TABLE, size), share(n - distinct, n), share(again, n), share(capital, n), share(odd, n), share(len(full) - len(set(full)), len(full), 2.0),
        np.log1p(n / max(distinct, 1)),
    ])


@dataclass
class Discriminant:
    """Priors, means, inverse Cholesky factors and log-determinants of the classes 0 and 1."""

    bias: float
    means: np.ndarray | None = None
    whiten: np.ndarray | None = None
    logdet: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, prior: float, pool: float = 0.1, ridge: float = 0.02) -> Discriminant:
        """``pool``: weight of the pooled covariance; ``ridge``: of the identity. With under two rows of a class only the prior is left."""
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        bias = float(np.log(prior / (1 - prior)))
        if min((y == 0).sum(), (y == 1).sum()) < 2:
            return cls(bias)
        groups = [x[y == c] for c in (0, 1)]
        covs = [np.cov(g, rowvar=False) for g in groups]
        pooled = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(x)
        means, whiten, logdet = [], [], []
        for g, c in zip(groups, covs, strict=True):
            # few rows lean more on the pooled covariance
            w = max(pool, min(1.0, 2.0 * x.shape[1] / len(g)))
            c = (1 - w) * c + w * pooled
            c = (1 - ridge) * c + ridge * np.trace(c) / len(c) * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            means.append(g.mean(0))
            whiten.append(np.linalg.inv(factor))
            logdet.append(2 * np.log(np.diag(factor)).sum())
        return cls(bias, np.array(means), np.array(whiten), np.array(logdet))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        logit = np.full(len(x), self.bias)
        if self.means is not None:
            far = [((x - m) @ w.T) ** 2 @ np.ones(x.shape[1]) for m, w in zip(self.means, self.whiten, strict=True)]
            logit = logit + 0.5 * (far[0] + self.logdet[0] - far[1] - self.logdet[1])
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the row is never learned from: crc32 of the id as text; a missing id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def sampled_labels(labels: DataFrame, label_col: str, held: Column, max_rows: int, seed: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """About ``max_rows`` labelled ids of each class for training, by a seeded hash, and the number of all of each class.

    Labels that are null or that contradict each other for an id aren't learned.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
    known = known.where("y = y2").select("id", F.col("y").cast("int"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1e6
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, max_rows / n))).otherwise(share)
    return known.where(place < share), counts


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", modulus: int = 5, remainder: int = 0, max_rows: int = 20_000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Learn from the labelled rows that aren't held out; at most about ``max_rows`` of each class, a bounded sample that is broadcast and collected."""
    sample, counts = sampled_labels(labels, label_col, held_out("doc_id", modulus, remainder), max_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), x], names=["y", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("y", "text")
    rows = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    n = sum(counts.values())
    prior = counts.get(1, 0) / n if n else 0.5
    x = np.array(rows.column("x").to_pylist()) if rows.num_rows else np.empty((0, 1))
    return Discriminant.fit(x, rows.column("y").to_numpy(), prior)


def quality_scores(docs: DataFrame, model: Discriminant, *, threshold: float = 0.3, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out, score, predicted`` (columns of these names are replaced), in one pass without a shuffle.

    Every row is scored by its whole text and by nothing else. A null text counts as empty, empty texts have a
    score like any other; a missing id isn't held out; an empty table gives an empty one. Without labels of both
    classes every score is the share of class 1 (0.5 without labels).
    """
    cols = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out_schema = docs.select(*cols).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(cols.index(text_col))
            x = np.array([statistics(t.as_py()) for t in texts]) if len(texts) else np.empty((0, 1))
            scores = shared.value.scores(x) if len(texts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*cols, "score"])

    out = docs.select(*cols).mapInArrow(run, out_schema)
    return out.select(*(F.col(c) for c in cols), held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
