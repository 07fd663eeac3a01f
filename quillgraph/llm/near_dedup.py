"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles (64-bit hashes), ``bands * rows`` minima, one key for each
   band of full minima, and the low ``b`` bits of all minima packed in ``b`` bit planes.
2. Documents of one set are folded into the class of their smallest id; only class representatives go on.
3. Representatives that share a band key are candidates. No bucket emits all its pairs: first each member
   meets the bucket's smallest id alone. Links are confirmed and folded into components; then only members
   of *different* components of a bucket meet, in pairs where the bucket is small and in blocks compared
   bit by bit where it is large, so that no link between different texts is lost.
4. A candidate's similarity is estimated from bit counts, corrected for chance collisions; what lies five
   standard deviations under the threshold goes. The rest is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import gram_hashes, hash_words, mix64, words_by_space
from quillgraph.operators.components import connected_components
from quillgraph.runtime import materialise

#: A bucket up to this size may emit pairs of members of different components; above, they are compared in blocks of BLOCK.
SMALL_BUCKET, BLOCK = 32, 1024


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's ``n``-word shingles; with fewer words, of the whole sequence; none without words."""
    words = words_by_space(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hash_words(words), min(n, len(words))))


class Sketcher:
    """Minima, band keys and packed low bits of a shingle set."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.words = math.ceil(bands * rows / 64)
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 2**63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, (bands * rows, 1), np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            out = np.minimum(out, (shingles[None, i : i + 1024] * self.mul + self.add).min(1))
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        keys = np.arange(self.bands, dtype=np.uint64)
        for column in minima.reshape(self.bands, self.rows).T:
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """``bits`` planes of ``words`` 64-bit words; bit i of a plane is one of the low bits of minimum i."""
        low = mix64(minima)
        planes = [np.packbits(((low >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), bitorder="little") for p in range(self.bits)]
        return np.concatenate([np.pad(x, (0, self.words * 8 - len(x))).view(np.uint64) for x in planes])


def _sketches(docs: DataFrame, n: int, sketcher: Sketcher) -> DataFrame:
    kind = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                out: dict[str, list] = {k: [] for k in ("n", "d1", "d2", "sig", "bands")}
                for value in part.column("text"):
                    shingles = shingle_set(value.as_py(), n)
                    if len(shingles):
                        minima = sketcher.minima(shingles)
                        # sums and xors of mixed members: equal sets agree, other sets do with a chance of 2^-128
                        d1, d2 = mix64(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(shingles * np.uint64(3)))
                        row = (len(shingles), int(d1.view(np.int64)), int(d2.view(np.int64)), sketcher.packed(minima).view(np.int64), sketcher.band_keys(minima).view(np.int64))
                    else:
                        row = (0, None, None, None, None)
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), *(pa.array(out[k], kind.field(k).type) for k in out)], schema=kind)

    return docs.mapInArrow(run, "id bigint, th bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>, bands array<bigint>")


def estimated(x: Column, y: Column, bits: int, words: int, hashes: int) -> Column:
    """Similarity from two packed signatures: share of equal b-bit values, corrected for those equal by chance."""
    differ = F.lit(0)
    for w in range(words):
        lanes = None
        for p in range(bits):
            one = F.get(x, p * words + w).bitwiseXOR(F.get(y, p * words + w))
            lanes = one if lanes is None else lanes.bitwiseOR(one)
        differ = differ + F.bit_count(lanes)
    chance = 2.0**-bits
    return ((1 - differ / F.lit(float(hashes))) - chance) / (1 - chance)


def _floor(threshold: float, sketcher: Sketcher) -> float:
    """The least estimate that a link may have: five standard deviations, widened by chance collisions, under the threshold."""
    return threshold - 5.4 * math.sqrt(threshold * (1 - threshold) / (sketcher.bands * sketcher.rows))


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, num: int, den: int, sketcher: Sketcher) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    hashes, least = sketcher.bands * sketcher.rows, _floor(num / den, sketcher)
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (estimated(F.col("sa"), F.col("sb"), sketcher.bits, sketcher.words, hashes) >= least)).select("a", "b")
    near = materialise(near, "near-pairs")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            found: list[tuple] = []
            for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb")), strict=True):
                sets = []
                for key, text in ((a.as_py(), ta), (b.as_py(), tb)):
                    if key not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held)))
                        held[key] = shingle_set(text.as_py(), n)
                    sets.append(held[key])
                shared = len(np.intersect1d(*sets, assume_unique=True))
                if den * shared >= num * (len(sets[0]) + len(sets[1]) - shared):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], batch.schema.field(c).type) for i, c in enumerate("ab")], names=["a", "b"])

    text = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    return near.join(text("a"), "a").join(text("b"), "b").mapInArrow(run, "a bigint, b bigint")


def _in_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, num: int, den: int, sketcher: Sketcher) -> DataFrame:
    """Candidates among different components of large buckets, none lost: a bucket's members are dealt to blocks of
    about BLOCK; those outside its largest component visit every block as queries, in bounded groups.

    A pair is compared in the first band that it shares. What the estimate can't rule out is counted on the sets
    with shingles cut to 32 bits, which can only raise a similarity, so that pairs just under the threshold, of
    which a group of copies may hold a square number, are never written out.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("size"))
    main = main.select("key", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort((shingle_set(t.as_py(), n) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int32()))], names=["id", "cut"])

    met = materialise(members.select("id").distinct(), "block-ids")
    sets = texts.join(met, "id").mapInArrow(cut, "id bigint, cut array<int>").join(nodes.select("id", "n", "sig", "bands"), "id")
    rows = members.join(materialise(main, "block-buckets"), "key").join(materialise(sets, "block-sets"), "id")
    to = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    at = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    whole = ("id", "component", "n", "sig", "bands", "cut")
    home = rows.select("key", at("blocks").alias("block"), to("parts").alias("part"), *whole, F.lit(False).alias("query"))
    query = rows.where("component <> main").select("key", to("blocks").alias("block"), at("parts").alias("part"), *whole, F.lit(True).alias("query"))
    bits, words, hashes = sketcher.bits, sketcher.words, sketcher.bands * sketcher.rows
    least = _floor(num / den, sketcher)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, h = pdf[pdf["query"]], pdf[~pdf["query"]]
        out: list[pd.DataFrame] = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        if len(q) and len(h):
            sig, bands = np.stack(h["sig"].to_numpy()).view(np.uint64), np.stack(h["bands"].to_numpy())
            ids, component, sizes, cuts = (h[c].to_numpy() for c in ("id", "component", "n", "cut"))
            for row in q.itertuples(index=False):
                fits = (component != row.component) & (den * np.minimum(sizes, row.n) >= num * np.maximum(sizes, row.n))
                fits &= (bands == row.bands).argmax(1) == int(np.flatnonzero(row.bands == row.key)[0])
                near = np.flatnonzero(fits)
                lanes = np.bitwise_or.reduce((sig[near] ^ np.asarray(row.sig).view(np.uint64)).reshape(len(near), bits, words), axis=1)
                share = 1 - np.bitwise_count(lanes).sum(1) / hashes
                near = near[(share - 2.0**-bits) / (1 - 2.0**-bits) >= least]
                if len(near):
                    own, flat = row.cut.view(np.uint32), np.concatenate(cuts[near]).view(np.uint32)
                    place = np.searchsorted(own, flat)
                    place[place == len(own)] = 0
                    starts = np.concatenate([[0], np.cumsum([len(c) for c in cuts[near]])[:-1]])
                    shared = np.add.reduceat((own[place] == flat).astype(np.int64), starts)
                    other = ids[near[(den + num) * shared >= num * (sizes[near] + row.n)]]
                    out.append(pd.DataFrame({"a": np.minimum(other, row.id), "b": np.maximum(other, row.id)}))
        return pd.concat(out)

    return home.unionByName(query).groupBy("key", "block", "part").applyInPandas(compare, "a bigint, b bigint").distinct()


def _bound(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes under ids of their own, and the links ``a, b`` between classes of one document: those that ``rows(id, d1, d2)`` repeats with other texts; None without any.

    A class is named by its smallest id. Where two have the same one, all but the first get a number beyond all ids instead
    (2^62 and a hash of their digest), so that each is compared by its own text; a component's smallest id is a document's still.
    """
    again = rows.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("low"), F.max(F.struct("d1", "d2")).alias("high")).where("low <> high").select("id")
    again = materialise(again, "repeated-ids")
    if again.isEmpty():
        return nodes, None
    first = nodes.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("first"))
    other = F.col("first").isNotNull() & (F.col("first") != F.struct("d1", "d2"))
    beyond = F.lit(2**62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("d1", "d2"), 2))
    named = nodes.join(first, "id", "left").withColumn("id", F.when(other, beyond).otherwise(F.col("id"))).select(*nodes.columns)
    named = materialise(named, "classes-apart")
    held = materialise(rows.join(again, "id", "left_semi").distinct().join(named.select("d1", "d2", F.col("id").alias("node")), ["d1", "d2"]).select("id", "node"), "repeated-classes")
    least = held.groupBy("id").agg(F.min("node").alias("a"))
    return named, materialise(held.join(least, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "repeated-links")


def near_duplicates(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4, bits: int = 4, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have ``den * intersection >= num * union``.

    Returns one row for each document: ``doc_id, n_shingles, component_id, kept`` (the smallest id of a
    component is kept). With 32 bands of 4 rows a link at the threshold of 0.8 is missed with a chance of
    5e-8, at 0.85 of 6e-11.

    * A text that is null or without words has no shingles, is linked with nothing and is kept; with fewer
      words than ``n`` the whole sequence is its one shingle.
    * Ids are integers below 2^62. A row without an id gets its ``n_shingles``, no component, and is kept. Rows that repeat
      an id are one document: links of one of them are links of that id, and all have one component.
    * An empty table gives an empty result; other columns aren't read.
    """
    sketcher = Sketcher(bands, rows, bits, seed)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    sketches = materialise(_sketches(texts, n, sketcher), "sketches")
    classes = sketches.where("id IS NOT NULL AND n > 0").groupBy("d1", "d2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialise(classes.select("rep.id", "rep.th", "d1", "d2", "n", "sig", "bands", F.col("rep.id").alias("own")), "classes")
    nodes, bound = _bound(nodes, sketches.where("id IS NOT NULL AND n > 0").select("id", "d1", "d2"))

    rows_ = nodes.select("id", F.explode("bands").alias("key"))
    buckets = materialise(rows_.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot < other").select("key", "pivot"), "buckets")
    members = materialise(rows_.join(buckets, "key"), "members")
    several = materialise(members.select("id").distinct(), "several")
    wanted = texts.join(nodes.join(several, "id").select(F.col("own").alias("id"), "th", F.col("id").alias("node")), ["id", "th"]).select(F.col("node").alias("id"), "text").dropDuplicates(["id"])
    texts = materialise(wanted, "near-texts")
    stars = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = materialise(_confirm(stars, nodes, texts, n, num, den, sketcher), "links")
    links = links if bound is None else links.unionByName(bound)
    found = connected_components(links)

    # Members of different components of one bucket that haven't met.
    now = members.join(found, "id", "left").select("key", "id", "pivot", F.coalesce("component", "id").alias("component"))
    now = materialise(now, "members-now")
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi AND size > 2")
    mixed = materialise(mixed.select("key", "size"), "mixed")
    small = now.join(mixed.where(F.col("size") <= SMALL_BUCKET), "key")
    left, right = (small.select("key", F.col("id").alias(c), "pivot", F.col("component").alias(f"c{c}")) for c in "ab")
    pairs = left.join(right.drop("pivot"), "key").where("a < b AND ca <> cb AND a <> pivot").select("a", "b").distinct()
    large = now.join(mixed.where(F.col("size") > SMALL_BUCKET), "key").drop("pivot", "size")
    pairs = pairs.unionByName(_in_blocks(large, nodes, texts, n, num, den, sketcher)).distinct()
    more = _confirm(pairs, nodes, texts, n, num, den, sketcher)
    more = materialise(more, "links-between")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    named = nodes.select("d1", "d2", "id").join(found, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    named = materialise(named, "named")
    out = sketches.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
