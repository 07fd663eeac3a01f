"""Line deduplication with DataFrame functions alone.

Lines are exploded with their position, normalised and hashed; the distinct documents of each hash are
counted, lines of hashes over the threshold are dropped except in the largest document that holds them,
and what remains is put together again by position. Only hashes and positions are shuffled for the
counting; each text moves once, when it meets its list of dropped positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACES, hash128, lower_az
from quillgraph.runtime import materialise


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines whose key is found in at least ``min_docs`` documents, but not from the largest id that holds it.

    A line's key is the line without spaces at both ends, A-Z lower-cased; keys of fewer than ``min_chars``
    code points are never dropped. Returns every column of ``docs`` with the new text, and ``n_lines``
    (before), ``n_dropped`` (columns of these names in ``docs`` are replaced).

    * A null or empty text is one empty line; the result's text is then empty.
    * Documents are told apart by id: rows that repeat an id count once, and keep their lines together. A null
      id is one document, below every other id.
    * An empty table gives an empty table; other columns pass unchanged.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)
    keys = F.transform(F.split(lower_az(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))
    body = hash128(F.col("key"))
    exploded = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(keys).alias("pos", "key"))
    exploded = exploded.where(F.char_length("key") >= min_chars).select("id", "th", "pos", body[0].alias("h1"), body[1].alias("h2"))
    exploded = materialise(exploded, "lines")

    by_doc = exploded.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    common = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    common = materialise(common, "common-lines")
    dropped = exploded.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    dropped = dropped.groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    dropped = dropped.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))

    out = docs.withColumn("__key", F.xxhash64(text)).join(dropped, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.transform(F.array_sort(F.array_except(every, F.col("__gone"))), lambda i: F.get(lines, i))
    new_text = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    cols = [new_text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
