"""Benchmark decontamination by winnowing.

Every window of ``window`` words is represented by the least hash among its ``k``-grams. Equal windows have
equal minima, so each shared span of at least ``window`` words shares a fingerprint. Where a minimum of a
document is a fingerprint of an item, the hit is extended word by word to both sides, and counts if it holds a
window. Items shorter than a window are one window of their own length.

The benchmark's index is broadcast if items and index hold at most ``max_index_bytes`` each (measured), and each
document is then read once without a shuffle. Beyond that, fingerprints of documents and items are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import gram_hashes, hash_words, mix64, words_alnum
from quillgraph.runtime import materialise


def window_minima(word_hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The least hash among the k-grams of each window of ``window`` words; fewer words than that give none."""
    grams = gram_hashes(word_hashes, min(k, window))
    if window <= k:
        return grams
    count = len(word_hashes) - window + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = grams[:count].copy()
    for i in range(1, window - k + 1):
        np.minimum(out, grams[i : i + count], out)
    return out


def minimum_places(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` k-grams the place of its least hash, the first one on a tie."""
    count = len(grams) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    least, place = grams[:count].copy(), np.arange(count)
    for i in range(1, span):
        lower = grams[i : i + count] < least
        np.copyto(least, grams[i : i + count], where=lower)
        place[lower] = np.flatnonzero(lower) + i
    return place


class BenchmarkIndex:
    """Selected fingerprints of the items, and the items' words as 64-bit hashes to extend hits by.

    Words are compared by these hashes. Items are grouped by the length of their window; in each group the sorted
    fingerprints point to a word of one long array, where items are parted by gaps that no word equals.
    """

    def __init__(self, items: Iterable[tuple[int | None, str | None]], window: int, k: int):
        self.window, self.k = window, k
        self.names: list[int | None] = []
        words: list[np.ndarray] = []
        prints: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        starts, at = [], 0
        for item, text in items:
            hashes = hash_words(words_alnum(text or ""))
            size = min(window, len(hashes))
            if size:
                grams = gram_hashes(hashes, min(k, size))
                places = np.unique(minimum_places(grams, size - min(k, size) + 1))
                prints.setdefault(size, []).append((grams[places], places + at))
                self.names.append(item)
                words.append(hashes)
                starts.append(at)
                at += len(hashes)
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.starts = np.array([*starts, at], np.int64)
        self.prints: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, found in prints.items():
            keys, places = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            order = np.argsort(keys, kind="stable")
            self.prints[size] = keys[order], places[order]

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.starts.nbytes + 16 * len(self.names) + sum(x.nbytes + y.nbytes for x, y in self.prints.values())

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int | None]]:
        """``start, end, item`` of each longest run of words that the document shares with an item and that holds a window.

        Every window that equals one of an item has its least k-gram where that one has it, so the window lies in
        the run around this k-gram.
        """
        found: list[tuple[int, int, int | None]] = []
        hashes = hash_words(words) if words and self.prints else np.empty(0, np.uint64)
        for size, (keys, places) in self.prints.items():
            k = min(self.k, size)
            grams = gram_hashes(hashes, k)
            picked = np.unique(minimum_places(grams, size - k + 1))
            low, high = np.searchsorted(keys, grams[picked]), np.searchsorted(keys, grams[picked], "right")
            done: dict[tuple[int, int], int] = {}  # item and its shift against the document: how far it has been compared
            for here, a, b in zip(picked.tolist(), low.tolist(), high.tolist(), strict=True):
                for place in places[a:b].tolist():
                    item = int(np.searchsorted(self.starts, place, "right")) - 1
                    shift = place - here
                    if done.get((item, shift), -1) > here:
                        continue
                    start, end = self._run(hashes, here, place, item)
                    done[item, shift] = max(end, here + 1)
                    if end - start >= size:
                        found.append((start, end, self.names[item]))
        return found

    def _run(self, hashes: np.ndarray, here: int, place: int, item: int) -> tuple[int, int]:
        """The run of equal words around the document's word ``here`` and the item's at ``place``."""
        back = min(here, place - int(self.starts[item]))
        ahead = min(len(hashes) - here, int(self.starts[item + 1]) - place)
        other = np.flatnonzero(hashes[here : here + ahead] != self.words[place : place + ahead])
        end = here + (int(other[0]) if len(other) else ahead)
        other = np.flatnonzero(hashes[here - back : here] != self.words[place - back : place])
        return here - back + (int(other[-1]) + 1 if len(other) else 0), end


def covered(n_words: int, spans: Iterable[tuple[int, int]]) -> int:
    """How many words lie in any of the spans."""
    steps = np.zeros(n_words + 1, np.int32)
    for start, end in spans:
        steps[start] += 1
        steps[end] -= 1
    return int((np.cumsum(steps)[:n_words] > 0).sum())


_SCHEMA = "n_words bigint, n_hit bigint, items array<bigint>, items_sha256 string"


def _summary(n_words: int, spans: list[tuple[int, int]], items: set) -> tuple:
    names = sorted("" if x is None else str(x) for x in items)
    return n_words, covered(n_words, spans) if spans else 0, sorted(items, key=lambda x: (x is not None, x)), hashlib.sha256(",".join(names).encode()).hexdigest()


def _result(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items")


def _by_broadcast(texts: DataFrame, index: BenchmarkIndex) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column("text"):
                words = words_alnum(value.as_py() or "")
                spans = index.spans(words)
                out.append(_summary(len(words), [x[:2] for x in spans], {x[2] for x in spans}))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            columns = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_words", "n_hit", "items", "items_sha256"])

    return texts.select("id", "text").mapInArrow(run, f"id bigint, {_SCHEMA}")


def _by_join(texts: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    def prints_of(text: str | None, sizes: list[int]) -> np.ndarray:
        hashes = hash_words(words_alnum(text or ""))
        found = [mix64(window_minima(hashes, size, k) + np.uint64(size)) for size in sizes]
        return np.unique(np.concatenate(found)).view(np.int64) if found else np.empty(0, np.int64)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [min(window, len(words_alnum(t.as_py() or ""))) for t in batch.column("text")]
            lists = [prints_of(t.as_py(), [size] if size else []) for t, size in zip(batch.column("text"), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("text"), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["item", "text", "size", "prints"])

    items = materialise(items.mapInArrow(of_items, "item bigint, text string, size int, prints array<bigint>").where("size > 0"), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` values

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([prints_of(t.as_py(), sizes) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), lists], names=["id", "th", "prints"])

    doc_prints = texts.mapInArrow(of_docs, "id bigint, th bigint, prints array<bigint>").select("id", "th", F.explode("prints").alias("print"))
    item_prints = items.select(F.xxhash64("item", "text").alias("ik"), F.explode("prints").alias("print")).distinct()
    pairs = materialise(doc_prints.join(materialise(item_prints, "item-prints"), "print").select("id", "th", "ik").distinct(), "decon-pairs")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("id", "th", "text", "item", "item_text")}
            spans = [[y for x in BenchmarkIndex([(item, other)], window, k).spans(words_alnum(text or "")) for y in x[:2]] for text, item, other in zip(rows["text"], rows["item"], rows["item_text"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), batch.column("item"), pa.array(spans, pa.list_(pa.int32()))], names=["id", "th", "item", "spans"])

    left, other = texts.alias("d"), items.select(F.xxhash64("item", "text").alias("ik"), "item", F.col("text").alias("item_text")).dropDuplicates(["ik"])
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.th") == F.col("p.th"))
    hits = left.dropDuplicates(["id", "th"]).alias("d").join(pairs.alias("p"), same).select("d.id", "d.th", "d.text", "ik").join(other, "ik").select("id", "th", "text", "item", "item_text")
    hits = hits.mapInArrow(confirm, "id bigint, th bigint, item bigint, spans array<int>").where(F.size("spans") > 0)
    hits = hits.groupBy("id", "th").agg(F.collect_list(F.struct("item", "spans")).alias("hits"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                spans = [(h["spans"][i], h["spans"][i + 1]) for h in hits or () for i in range(0, len(h["spans"]), 2)]
                out.append(_summary(len(words_alnum(text or "")), spans, {h["item"] for h in hits or ()}))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds))], names=["id", "n_words", "n_hit", "items", "items_sha256"])

    whole = left.join(hits.alias("p"), same, "left").select("d.id", "d.text", "hits")
    return whole.mapInArrow(gather, f"id bigint, {_SCHEMA}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_index_bytes: int = 32_000_000) -> DataFrame:
    """How much of each document lies in windows of benchmark items.

    Returns one row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``.

    * Texts that are null or without words have no words and no hits; such items have no windows.
    * Rows that repeat an item id are one item with the windows of all of them; an item without an id counts
      as one item, named by the empty string in the digest.
    * Each row of ``docs`` gives a row, with whatever id. An empty benchmark leaves every document clean; an
      empty ``docs`` gives an empty result. Other columns aren't read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    index = BenchmarkIndex(((r["item"], r["text"]) for r in items.collect()), window, k) if size <= max_index_bytes else None
    found = _by_broadcast(texts, index) if index and index.nbytes <= max_index_bytes else _by_join(texts, items, window, k)
    return _result(docs, found, id_col)
