"""Tallies of a graph kept up to date by a stream of changes: census, degrees, vocabulary and argument pairs as signed counts.

A change is a row that is added (``sign`` 1) or taken away (-1); an update is both. A batch is summed by key before it is
written, so what a batch costs depends on what it touches and not on the graph; argument pairs, which hardly repeat, are
written as they come and summed when they are read or merged. Batches are idempotent by their id, as
``foreachBatch`` may run one again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V
from quillgraph.streaming.signed import SignedTables

#: Changes of nodes (claims have ``s, p, o``) and edges (``src, dst``) in one schema.
CHANGES = "op string, sign int, id string, type string, src string, dst string, s string, p string, o string, infra boolean"

_KEYS = {"census": ("type", "structural"), "edge_types": ("type",), "degrees": ("id",), "vocabulary": ("predicate",), "arguments": ("predicate", "s", "o")}
_SCHEMAS = {name: ", ".join(f"{k} {'boolean' if k == 'structural' else 'string'}" for k in keys) + ", sign long" for name, keys in _KEYS.items()}


class Projection:
    """The tallies below one path; after ``merge_every`` batches their folders are merged."""

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 16) -> None:
        self.tables, self.merge_every = SignedTables(spark, path, _SCHEMAS), merge_every

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch of changes; false if it was added before.

        Nodes of unknown types and infrastructure are in no census; a claim without a subject or an object has no
        arguments; an edge's ends and a claim's subject and object are pairs of its predicate; a loop counts twice for a degree.
        """
        if batch <= self.generation():
            return False
        edges = changes.where("op = 'edge'")
        nodes = changes.where(F.col("op") == "node").where(F.col("type").isin(*V.PRIMITIVE_TYPES, *V.SUPPORT_TYPES) & ~F.coalesce("infra", F.lit(False)))
        claims = changes.where("op = 'node' AND type = 'Claim'").where(C.text_or_empty(F.col("p")) != "")
        structural = (F.col("type") == "Claim") & F.coalesce(F.col("p").isin(*V.STRUCTURAL_PREDICATES), F.lit(False))
        named = edges.select(F.col("type").alias("predicate"), F.col("src").alias("s"), F.col("dst").alias("o"), "sign").unionByName(claims.select(F.col("p").alias("predicate"), "s", "o", "sign"))
        rows = {
            "census": nodes.select("type", structural.alias("structural"), "sign"),
            "edge_types": edges.select("type", "sign"),
            "degrees": edges.select(F.explode(F.array("src", "dst")).alias("id"), "sign"),
            "vocabulary": named.select("predicate", "sign"),
            "arguments": named.where("s <> '' AND o <> ''"),
        }
        done = self.tables.apply(batch, {name: df if name == "arguments" else df.groupBy(*_KEYS[name]).agg(F.sum("sign").alias("sign")).where("sign <> 0") for name, df in rows.items()})
        if len(self.tables.state()["live"]["census"]) >= self.merge_every:
            self.merge()
        return done

    def start(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keep up with a stream of changes until it has no more."""
        return changes.writeStream.foreachBatch(lambda df, batch: self.apply(batch, df) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merge(self) -> None:
        """Fold the folders of each table into one."""
        for name, keys in _KEYS.items():
            self.tables.merge(name, keys)

    def generation(self) -> int:
        """The last batch that the tallies hold; -1 before the first."""
        return self.tables.state()["batch"]

    def is_stale(self, generation: int) -> bool:
        """Whether the graph has moved on to a generation that the tallies don't hold."""
        return self.generation() < generation

    def _view(self, name: str) -> DataFrame:
        return self.tables.net(name, _KEYS[name]).withColumnRenamed("sign", "n")

    def census(self) -> DataFrame:
        """``type, structural, n`` of nodes."""
        return self._view("census")

    def edge_types(self) -> DataFrame:
        """``type, n`` of edges."""
        return self._view("edge_types")

    def degrees(self) -> DataFrame:
        """``id, n``: edges in and out of each node that has any."""
        return self._view("degrees")

    def vocabulary(self) -> DataFrame:
        """``predicate, n``: types of edges and predicates of claims."""
        return self._view("vocabulary")

    def arguments(self) -> DataFrame:
        """``predicate, s, o, n``: how often each pair of ends has each predicate."""
        return self._view("arguments")
