"""How far the sources of a language differ in their words: sums over a whole vocabulary, by inclusion and exclusion of supports.

For two groups with smoothed shares p and q of every kept term, the sum of ``f(p, q)`` over the vocabulary falls into
parts that need only what the groups hold:

* terms of one group, as if the other had none of them: ``f`` depends on the term's count alone, so a histogram of
  counts prices them, once for each other group;
* terms of both, which were then priced twice and wrongly: postings that share a term meet and correct this;
* terms of neither: all alike, a constant times their number.

No row is made for a group and a term that it doesn't hold. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.runtime import materialise

_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds before it passes them on; a bound on its memory.
HELD_TERMS = 400_000
#: A language's groups meet its histograms in so many places.
SALTS = 32


def term_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, df``: occurrences of each term in each group, and documents that hold it; counted within tasks first.

    Terms are runs of ASCII letters and of all beyond ASCII, A-Z lower-cased; a null text, lang or source is empty.
    """
    names = ["lang", "source", "term", "n", "df"]

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                fixed = [pa.DictionaryArray.from_arrays(pa.array([0] * len(part), pa.int32()), pa.array([x])).dictionary_decode() for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part]), pa.array([df[t] for t in part])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for place, key in enumerate(zip(langs, sources, strict=True)):
                words = (batch.column(2)[place].as_py() or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()
                n, df = held.setdefault(key, (Counter(), Counter()))
                n.update(words)
                df.update(set(words))
                if len(n) > HELD_TERMS:
                    yield from rows({key: held.pop(key)})
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    base = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.col(text_col).alias("text"))
    counted = base.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str) -> Column:
    """``1 + floor(1000000000 * (count + 2) / total)`` of two columns, exact for any 64-bit count; null where ``total`` is 0."""
    return F.expr(f"1 + (CAST({count} AS DECIMAL(20, 0)) + 2) * CAST(1000000000 AS DECIMAL(10, 0)) div CAST(nullif({total}, 0) AS DECIMAL(20, 0))")


def distance(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))`` of two columns, in 64-bit integers: shares are at most 1,000,000,001."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def kept_postings(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """``lang, source, term, n, total`` for the terms that a language keeps, with their count in it; and the groups ``lang, source, terms, vocabulary, size, lang_size, p0``.

    A group's ``size`` is the divisor of its shares, ``p0`` the share of a term that it lacks; all but ``vocabulary`` and
    ``terms`` (0) are null in a language that keeps no term.
    """
    counts = materialise(term_counts(docs), "term-counts")
    vocabulary = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df"), "vocabulary")
    postings = materialise(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept-postings")
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("total").alias("lang_n"))
    held = postings.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("group_n"))
    groups = named.join(held, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["terms", "group_n", "vocabulary", "lang_n"])
    groups = groups.select("lang", "source", "terms", "vocabulary", (F.col("group_n") + 2 * F.col("vocabulary")).alias("size"), (F.col("lang_n") + 2 * F.col("vocabulary")).alias("lang_size"))
    return postings, materialise(groups.withColumn("zero", F.lit(0)).withColumn("p0", share("zero", "size")).drop("zero"), "groups")


def divergence_terms(priced: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank``: of the terms that a group has more of than its language, those that add most. ``priced`` are postings with ``p`` and ``q``."""
    more = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))
    # the first ranks are found within each task before rows of a group meet
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return more.withColumn("rank", place).where(F.col("rank") <= top)


def divergence_pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value, rank``: each group's distance to each other source of its language over all kept terms."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("q0"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    both = lambda df, a, b: df.select("lang", F.col(a).alias("source"), F.col(b).alias("item"), "part").unionByName(df.select("lang", F.col(b).alias("source"), F.col(a).alias("item"), "part"))

    # terms of neither: as many as the vocabulary has beyond both supports, counted without their overlap
    pairs = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(other, ["lang", "salt"]).where("source <> item")
    neither = pairs.select("lang", "source", "item", F.coalesce((F.col("vocabulary") - F.col("terms") - F.col("item_terms")) * distance("p0", "q0"), F.lit(0)).alias("part"))

    # terms of one: their histogram, priced against the share of what the other lacks
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    one = histogram.withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int")).join(other.drop("item_terms"), ["lang", "salt"]).where("source <> item")
    one = one.select("lang", "source", "item", (F.col("m") * distance("p", "q0")).alias("part")).groupBy("lang", "source", "item").agg(F.sum("part").alias("part"))

    # terms of both: the right price for what was priced twice
    mine = priced.select("lang", "term", F.col("source").alias("s1"), F.col("p").alias("p"), F.col("p0").alias("p0"))
    theirs = priced.select("lang", "term", F.col("source").alias("s2"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    overlap = mine.join(theirs, ["lang", "term"]).where("s1 < s2")
    overlap = overlap.select("lang", "s1", "s2", (distance("p", "q") - distance("p", "q0") - distance("p0", "q") + distance("p0", "q0")).alias("part")).groupBy("lang", "s1", "s2").agg(F.sum("part").alias("part"))

    value = neither.unionByName(both(one, "source", "item")).unionByName(both(overlap, "s1", "s2")).groupBy("lang", "source", "item").agg(F.sum("part").cast("long").alias("value"))
    return value.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each group of ``docs(lang, source, text)``.

    Part ``pair``: each other source of the language with the distance to it, all ranks. Part ``term``: the ``top`` terms that
    the group has more of than its language. A language keeps the terms that at least ``min_docs`` of its documents hold.

    * A null text, lang or source is the empty string; a group without terms has its pairs, in a language without kept terms at distance 0.
    * Ties go to the smaller item in UTF-8. Rows that repeat are documents of their own. An empty table gives no rows.
    """
    postings, groups = kept_postings(docs, min_docs)
    priced = postings.join(groups.select("lang", "source", "size", "lang_size", "p0"), ["lang", "source"])
    priced = materialise(priced.select("lang", "source", "term", share("n", "size").alias("p"), share("total", "lang_size").alias("q"), "p0"), "priced")
    parts = (("pair", divergence_pairs(priced, groups)), ("term", divergence_terms(priced, top)))
    pair, term = (df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, df in parts)
    return pair.unionByName(term)
