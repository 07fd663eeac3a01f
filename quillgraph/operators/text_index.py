"""A maintained lexical and vector index: postings in buckets by term that take batches of changed nodes as deltas.

A batch reads, of what is indexed, only the rows of its own ids; it takes back their postings (tombstones are the same rows with
the opposite sign) and adds the new ones, so that only buckets of terms that a changed node has or had are
written. Numbers of texts and tokens are sums in the commit; document frequencies follow from the signs. Searching reads the buckets
of the terms that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.operators.retrieve import ranked
from quillgraph.runtime import materialise, spread
from quillgraph.streaming.signed import SignedTables

_SCHEMAS = {
    "postings": "term string, id string, type string, tf int, dl int, sign int, bucket int",
    "records": "id string, type string, dl int, terms array<struct<term:string,tf:int>>, embedding array<double>, sign int, bucket int",
}


class TextIndex:
    """The index below one path. ``buckets`` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.buckets = spark, buckets
        self.tables = SignedTables(spark, path, _SCHEMAS, partition="bucket")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _live(self, ids: DataFrame | None = None) -> DataFrame:
        """The indexed record of each node, of ``ids`` alone if given; reads their buckets only, if they are few."""
        rows = self.tables.read("records")
        if ids is not None:
            rows = _within(rows, ids.select(self._bucket("id").alias("bucket")), self.buckets).join(ids.select("id").distinct(), "id", "left_semi")
        # a record taken back and the one that it was cancel; arrays are compared whole
        return rows.groupBy("id", "type", "dl", "terms", "embedding", "bucket").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")

    def apply(self, batch: int, nodes: DataFrame | None = None, deleted: DataFrame | None = None) -> bool:
        """Upsert ``nodes(id, type, text[, embedding])`` and then drop ``deleted(id)``; false if this batch was applied before.

        * A node without a vector keeps the one that is indexed for its id; of rows that repeat an id in a batch one counts, the greatest by type and text.
        * Null ids count for nothing, a null text is empty; an id that isn't indexed can be deleted without effect.
        """
        spark = self.spark
        if batch <= self.tables.state()["batch"]:
            return False
        kind = "id string, type string, text string, embedding array<double>"
        if nodes is None:
            nodes = spark.createDataFrame([], kind)
        vector = F.col("embedding").cast("array<double>") if "embedding" in nodes.columns else F.lit(None).cast("array<double>")
        new = nodes.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.struct("type", C.text_or_empty(F.col("text")).alias("text"), vector.alias("embedding")).alias("node"))
        new = new.groupBy("id").agg(F.max("node").alias("node")).select("id", "node.*")
        if deleted is not None:
            gone = materialise(deleted.where("id IS NOT NULL").select(F.col("id").cast("string").alias("id")).distinct(), "index-deleted")
            new = new.join(gone, "id", "left_anti")
        tokens = C.search_tokens(F.col("text"))
        pairs = new.select("id", "type", "embedding", tokens.alias("t"))
        pairs = materialise(pairs.select("id", "type", "embedding", F.size("t").alias("dl"), "t"), "index-batch")
        counted = pairs.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
        terms = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))  # a text's own terms
        touched = pairs.select("id") if deleted is None else pairs.select("id").unionByName(gone)
        old = materialise(self._live(touched), "index-old")
        kept = old.select("id", F.col("embedding").alias("held"))
        empty = F.array().cast("array<struct<term:string,tf:int>>")
        new = pairs.join(terms, "id", "left").join(kept, "id", "left").select("id", "type", "dl", F.coalesce("terms", empty).alias("terms"), F.coalesce("embedding", "held").alias("embedding"), self._bucket("id").alias("bucket"))
        signed = materialise(new.withColumn("sign", F.lit(1)).unionByName(old.select(*new.columns).withColumn("sign", F.lit(-1))), "index-signed")
        postings = signed.select("id", "type", "dl", "sign", F.explode("terms").alias("t")).select("t.term", "id", "type", "t.tf", "dl", "sign")
        # what a batch leaves as it was is neither taken back nor added
        postings = postings.groupBy("term", "id", "type", "tf", "dl").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").withColumn("bucket", self._bucket("term"))
        records = signed.groupBy("id", "type", "dl", "terms", "embedding", "bucket").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        n = lambda c: F.coalesce(F.sum(F.when(c, F.col("sign"))), F.lit(0))
        change = signed.agg(n(F.col("dl") > 0).alias("texts"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("tokens"), n(F.col("embedding").isNotNull()).alias("vectors"), n(F.lit(True)).alias("nodes")).first()
        # a bucket's rows are written by few tasks
        return self.tables.apply(batch, {"postings": postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))), "records": records.repartition("bucket")}, change.asDict())

    def reindex(self, nodes: DataFrame) -> None:
        """Forget everything and index all of ``nodes``."""
        self.tables.clear()
        self.apply(0, nodes)

    def merge(self) -> None:
        """Fold all batches into one."""
        self.tables.merge("postings", ["term", "id", "type", "tf", "dl", "bucket"])
        self.tables.merge("records", ["id", "type", "dl", "terms", "embedding", "bucket"])

    def records(self) -> DataFrame:
        """``id, type, dl, embedding`` of every indexed node."""
        return self._live().select("id", "type", "dl", "embedding")

    def stats(self) -> dict[str, float]:
        """Nodes, nodes with a vector, texts with tokens and their mean length."""
        held = self.tables.state()["summary"]
        texts = held.get("texts", 0)
        return {"nodes": held.get("nodes", 0), "vectors": held.get("vectors", 0), "texts": texts, "avgdl": held.get("tokens", 0) / texts if texts else 0.0}

    def bm25(self, queries: DataFrame, query_text: Column, k: int = 10, kind: str | None = None) -> DataFrame:
        """``query_id, id, score, rank``: the best ``k`` texts for each question, of one type if ``kind`` is given (frequencies are those of all types)."""
        state = self.tables.state()
        texts, tokens = state["summary"].get("texts", 0), state["summary"].get("tokens", 0)
        asked = materialise(queries.select("query_id", F.explode(F.array_distinct(C.search_tokens(query_text))).alias("term")), "asked")
        rows = _within(self.tables.read("postings", state), asked.select(self._bucket("term").alias("bucket")), self.buckets)
        rows = rows.join(asked.select("term").distinct(), "term", "left_semi")
        live = spread(materialise(rows.groupBy("term", "id", "type", "tf", "dl").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign"), "live-postings"))
        frequency = live.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.lit(texts) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * F.col("dl") / F.lit(tokens / texts if texts else 1.0))
        weighted = live.join(frequency, "term").select("id", "type", "term", (idf * F.col("tf") * (V.BM25_K1 + 1) / (F.col("tf") + length)).alias("weight"))
        hits = (weighted if kind is None else weighted.where(F.col("type") == kind)).join(asked, "term")
        scored = hits.groupBy("query_id", "id").agg(F.sum("weight").alias("score"))
        return ranked(scored.withColumn("score", F.round("score", 9)), k)


def _within(rows: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """Rows of the wanted buckets; at most ``buckets`` numbers come to the driver, so that the scan leaves the others out."""
    listed = [r["bucket"] for r in wanted.where("bucket IS NOT NULL").distinct().collect()]
    return rows if len(listed) >= buckets else rows.where(F.col("bucket").isin(listed))
