"""Exact top-k inner products over an impact-ordered index, processed a score at a time.

A vector's components become whole numbers; each that isn't zero is a posting (component, vector) with a
quantised impact: its three leading bits. The index holds vectors in shards of a bounded number of rows; a shard's
postings lie in segments by falling impact, one for each power of two. A search adds up a segment's
quantised impacts for many questions at a time, largest impacts first. After each segment the true score of a vector is known up to
the length of what the segments have not said of it (Cauchy-Schwarz), which the index holds for every
vector and segment. A question is done with a shard only when this proves that all but a few of its
vectors, or none at all, can be among the best; those few are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

#: Vectors of a shard, and questions that a task works on at a time: together they bound a task's memory.
SHARD_ROWS, QUESTION_ROWS = 4096, 512
#: Bytes of questions that go to every task at a time; more of them take more passes over the index.
QUESTION_BYTES = 16_000_000
#: Possible members of a question in a shard that are scored one by one instead of reading on.
FEW = 48

_INDEX = "dim int, n int, width int, ids binary, vectors binary, errors binary, segments array<struct<octave:int,rows:binary,dims:binary,impacts:binary>>"


def whole_vectors(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: their places in the column and ``floor(scale * x)`` as int64; vectors that are null or hold null or non-finite numbers are left out."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), -1))
    for dim in np.unique(lengths[lengths >= 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
        rows = np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
        fine = np.isfinite(rows).all(1)
        rows = np.floor(rows[fine] * scale)
        if rows.size and np.abs(rows).max() >= 2.0**62:
            raise OverflowError("a component times the scale does not fit 63 bits")
        yield at[fine], rows.astype(np.int64)


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The quantised impact of each number (its three leading bits, and the middle of what follows them, with its sign) and its octave (bits of its magnitude; 0 has no posting)."""
    size = np.abs(rows)
    octave = np.frexp(size.astype(np.float64))[1]
    unit = np.left_shift(np.int64(1), np.maximum(octave - 3, 0))
    return np.sign(rows) * (size // unit * unit + unit // 2), octave


def _narrow(rows: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes that hold them."""
    most = int(np.abs(rows).max(initial=0))
    return rows.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _packed(ids: np.ndarray, rows: np.ndarray) -> dict:
    """One shard as a row of the index."""
    impact, octave = quantised(rows)
    rest, segments, errors = rows.astype(np.float64), [], []
    for level in sorted(set(np.unique(octave).tolist()) - {0}, reverse=True):
        row, dim = np.nonzero(octave == level)
        order = np.lexsort((row, dim, -np.abs(impact[row, dim])))
        row, dim = row[order], dim[order]
        found = impact[row, dim]
        rest[row, dim] -= found
        errors.append(np.sqrt((rest * rest).sum(1)))
        segments.append({"octave": int(level), "rows": row.astype("<u2").tobytes(), "dims": dim.astype("<u4" if rows.shape[1] > 65535 else "<u2").tobytes(), "impacts": found.astype("<i8").tobytes() if level > 31 else _narrow(found).astype("<i4" if level > 15 else "<i2").tobytes()})
    exact = _narrow(rows)
    # rounded up: an error is a bound
    up = np.nextafter(np.array(errors, np.float32).reshape(len(errors), len(rows)), np.float32(np.inf))
    return {"dim": rows.shape[1], "n": len(rows), "width": exact.itemsize, "ids": ids.astype("<i8").tobytes(), "vectors": exact.tobytes(), "errors": up.tobytes(), "segments": segments}


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of all vectors, one row for each shard; built where the vectors lie, without a shuffle, and written to the shared folder.

    Vectors that are null or hold null or non-finite numbers, and those without an id, are left out; vectors of
    different lengths come to different shards. Rows that repeat an id are rows of their own.
    """
    if not 0 < shard_rows <= 65536:
        raise ValueError("a shard holds from 1 to 65,536 vectors")
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("errors", pa.binary()), ("segments", pa.list_(pa.struct([("octave", pa.int32()), ("rows", pa.binary()), ("dims", pa.binary()), ("impacts", pa.binary())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        shard = lambda ids, rows: pa.RecordBatch.from_pylist([_packed(ids, rows)], schema)
        for batch in batches:
            ids = np.array(batch.column(0))
            for at, rows in whole_vectors(batch.column(1), scale):
                parts = held.setdefault(rows.shape[1], [])
                parts.append((ids[at], rows))
                if sum(len(x) for x, _ in parts) >= shard_rows:
                    ids_, rows_ = (np.concatenate(x) for x in zip(*parts, strict=True))
                    cut = len(ids_) // shard_rows * shard_rows
                    for i in range(0, cut, shard_rows):
                        yield shard(ids_[i : i + shard_rows], rows_[i : i + shard_rows])
                    held[rows.shape[1]] = [(ids_[cut:], rows_[cut:])]
        for parts in held.values():
            ids_, rows_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(ids_):
                yield shard(ids_, rows_)

    known = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return materialise(known.mapInArrow(run, _INDEX), "impact-index")


@dataclass
class Best:
    """The ``k`` best scores of each question so far with their ids: rows by falling score, then rising id; ``filled`` tells real ones."""

    scores: np.ndarray
    ids: np.ndarray
    filled: np.ndarray

    @classmethod
    def none(cls, questions: int, k: int) -> Best:
        return cls(np.zeros((questions, k), np.int64), np.zeros((questions, k), np.int64), np.zeros((questions, k), bool))

    def floor(self) -> np.ndarray:
        """The score that a new member must reach; a tie may still win by its id."""
        return np.where(self.filled[:, -1], self.scores[:, -1].astype(np.float64), -np.inf)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in scored vectors of the questions ``who``."""
        if not len(who):
            return
        k = self.scores.shape[1]
        touched = np.unique(who)
        old_row, old_place = np.nonzero(self.filled[touched])
        every = np.concatenate([np.searchsorted(touched, who), old_row])
        scores = np.concatenate([scores, self.scores[touched[old_row], old_place]])
        ids = np.concatenate([ids, self.ids[touched[old_row], old_place]])
        order = np.lexsort((ids, -scores, every))
        every, scores, ids = every[order], scores[order], ids[order]
        place = np.arange(len(every)) - np.searchsorted(every, every)
        keep = place < k
        row = touched[every[keep]]
        self.filled[touched] = False
        self.scores[row, place[keep]], self.ids[row, place[keep]], self.filled[row, place[keep]] = scores[keep], ids[keep], True


@dataclass
class Shard:
    """A row of the index."""

    ids: np.ndarray
    vectors: np.ndarray
    errors: np.ndarray
    segments: list[dict]

    @classmethod
    def of(cls, row: dict) -> Shard:
        n, dim = row["n"], row["dim"]
        vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(n, dim)
        return cls(np.frombuffer(row["ids"], "<i8"), vectors, np.frombuffer(row["errors"], "<f4").reshape(len(row["segments"]), n), row["segments"])

    def plane(self, place: int, out: np.ndarray) -> None:
        """A segment's postings: quantised impacts by component and vector."""
        s = self.segments[place]
        rows = np.frombuffer(s["rows"], "<u2")
        dims = np.frombuffer(s["dims"], "<u4" if self.vectors.shape[1] > 65535 else "<u2")
        out[:] = 0
        out[dims, rows] = np.frombuffer(s["impacts"], f"<i{8 if s['octave'] > 31 else 4 if s['octave'] > 15 else 2}")

    def exact(self, questions: np.ndarray) -> np.ndarray:
        """Exact scores of all vectors."""
        return _exact(questions, self.vectors, lambda q, v: q @ v.T)

    def exact_pairs(self, questions: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores, one question to one vector."""
        return _exact(questions, self.vectors[rows], lambda q, v: np.einsum("ij,ij->i", q, v))


def _exact(questions: np.ndarray, vectors: np.ndarray, product) -> np.ndarray:
    """The product in whole numbers: floats as long as every sum is exact in them, then 64-bit integers; beyond these an error."""
    most = int(np.abs(questions).max(initial=0)) * int(np.abs(vectors.astype(np.int64)).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return product(questions.astype(np.float64), vectors.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("a score may not fit 64 bits")
    return product(questions, vectors.astype(np.int64))


def search_shard(shard: Shard, question_ids: np.ndarray, questions: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with a shard; returns how many segments were read for all questions together."""
    n, dim = shard.vectors.shape
    k = best.scores.shape[1]
    sizes = np.sqrt((questions.astype(np.float64) ** 2).sum(1))
    lengths = np.sqrt((shard.vectors.astype(np.float64) ** 2).sum(1))
    # rounding of 32-bit sums, as a share of the product of both lengths
    slack = (dim + len(shard.segments) + 8) * 2.0**-22
    live = np.flatnonzero(sizes * lengths.max(initial=0) * (1 + slack) >= best.floor())
    asked = questions.astype(np.float32)
    own = [np.flatnonzero(shard.ids == q) for q in question_ids[live]] if len(np.intersect1d(question_ids, shard.ids)) else []
    sums, plane, read = np.zeros((len(live), n), np.float32), np.empty((dim, n), np.float32), 0
    for i, rows in enumerate(own):
        sums[i, rows] = -np.inf  # a question is no candidate of its own
    for place in range(len(shard.segments) or 1):
        if not len(live):
            break
        error = lengths
        if shard.segments:
            shard.plane(place, plane)
            sums += asked[live] @ plane
            error = shard.errors[place]
            read += len(live)
        bound = (error + lengths * slack).astype(np.float32)
        wide = sizes[live].astype(np.float32)[:, None] * np.float32(1 + 2**-20)
        floor = best.floor()[live].astype(np.float32)
        floor -= np.abs(floor, where=np.isfinite(floor), out=np.zeros_like(floor)) * np.float32(2**-22)
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and n > k:
            # until a question has k members, the k-th best of what is certain is its floor
            floor[new] = np.partition(sums[new] - wide[new] * bound, n - k, axis=1)[:, n - k]
        possible = sums + wide * bound >= floor[:, None]
        if own:
            possible &= sums > -np.inf
        count = possible.sum(1)
        done = (count <= FEW) | (place >= len(shard.segments) - 1)
        if not done.any():
            continue
        at = np.flatnonzero(done)
        few = at[count[at] <= n // 8]
        who, row = np.nonzero(possible[few])
        for i in range(0, len(who), 65536):
            w, r = live[few[who[i : i + 65536]]], row[i : i + 65536]
            best.add(w, shard.exact_pairs(questions[w], r), shard.ids[r])
        many = at[count[at] > n // 8]
        for i in range(0, len(many), 64):
            these = many[i : i + 64]
            scores = shard.exact(questions[live[these]])
            scores = np.where(possible[these], scores, np.iinfo(np.int64).min)
            least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(these), np.iinfo(np.int64).min)
            who, row = np.nonzero(possible[these] & (scores >= least[:, None]))
            best.add(live[these[who]], scores[who, row], shard.ids[row])
        rest = ~done
        live, sums = live[rest], sums[rest]
        own = own and [x for x, r in zip(own, rest, strict=True) if r]
    return read


def search(index: DataFrame, questions: DataFrame, k: int = 5, *, scale: float = 256.0, question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of the index for each of ``questions(query_id, embedding)``, ties by the smaller id.

    * A question's own row, any row of its id, is no candidate; fewer than ``k`` others give all of them.
    * Questions whose vector is null or holds null or non-finite numbers, or without an id, get no row. Of rows that repeat an id the least vector asks.
    * A question meets vectors of its own length only. Empty tables give an empty result.
    * Questions go to the tasks in parts of at most ``question_bytes``, each with a pass over the index; a task keeps
      the best ``k`` of all its shards, so that a question costs ``k`` rows for each partition.
    * A score that may not fit 64 bits is an error.
    """
    spark = index.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asks = questions.where(F.col("query_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    asks = materialise(asks.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min("embedding").alias("embedding")), "questions")
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in asks.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()):
        parts = max(1, -(-n * (dim + 1) * 8 // question_bytes))
        for part in range(parts):
            rows = asks.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow().combine_chunks()
            if not rows.num_rows:
                continue
            (at, whole), *_ = whole_vectors(rows.column("embedding").combine_chunks(), scale)
            shared = spark.sparkContext.broadcast((np.array(rows.column("query_id"))[at], whole))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, vectors = shared.value
                cuts = range(0, len(ids), QUESTION_ROWS)
                best = [Best.none(min(QUESTION_ROWS, len(ids) - i), k) for i in cuts]
                for batch in batches:
                    for row in range(batch.num_rows):
                        shard = Shard.of(batch.slice(row, 1).to_pylist()[0])
                        for i, b in zip(cuts, best, strict=True):
                            search_shard(shard, ids[i : i + QUESTION_ROWS], vectors[i : i + QUESTION_ROWS], b)
                for i, b in zip(cuts, best, strict=True):
                    who, place = np.nonzero(b.filled)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + who]), pa.array(b.ids[who, place]), pa.array(b.scores[who, place])], names=["query_id", "vec_id", "score"])

            scored = index.where(F.col("dim") == dim).mapInArrow(run, "query_id long, vec_id long, score long")
            found = scored if found is None else found.unionByName(scored)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
