"""One graph in one folder: take files in, ask, explain, export.

A vault binds what the other modules do. Its nodes and edges are tables of signed rows, so that taking in a folder again costs what
changed in it: files whose bytes are known are left alone, the nodes of changed and removed ones are taken back, and the text index and
the tallies follow by the same changes. Every answer is a DataFrame over many questions or ids at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import embedding
from quillgraph.functions import vocabulary as V
from quillgraph.operators import evaluation, gates, lookups, retrieve
from quillgraph.operators.text_index import TextIndex
from quillgraph.runtime import materialise
from quillgraph.sources import markdown, snapshots
from quillgraph.streaming.projection import CHANGES, Projection
from quillgraph.streaming.signed import SignedTables

_NODE = "id string, type string, title string, content string, s string, p string, o_id string, o_literal string, confidence double, block_id string, document_id string, path string, byte_start long, byte_end long, content_hash string, infra boolean, embedding array<double>"
_EDGE = "id string, type string, src string, dst string, document_id string"
_KEYS = {"nodes": [c.strip().split()[0] for c in _NODE.split(", ")], "edges": [c.strip().split()[0] for c in _EDGE.split(", ")]}


class Vault:
    """The vault below ``path``, a folder that driver and executors share. ``embed`` gives texts their vectors."""

    def __init__(self, spark: SparkSession, path: str, embed: embedding.Embed = embedding.stub, *, block_bytes: int = V.CHUNK_BYTES) -> None:
        self.spark, self.path, self.embed, self.block_bytes = spark, path.rstrip("/"), embed, block_bytes
        self.tables = SignedTables(spark, f"{self.path}/graph", {"nodes": f"{_NODE}, sign int", "edges": f"{_EDGE}, sign int"})
        self.index = TextIndex(spark, f"{self.path}/index", buckets=16)
        self.tallies = Projection(spark, f"{self.path}/tallies")

    def nodes(self) -> DataFrame:
        """All nodes: documents, blocks, claims, and the agent and activity that made them."""
        return self.tables.net("nodes", _KEYS["nodes"]).drop("sign")

    def edges(self) -> DataFrame:
        """``id, type, src, dst`` of all edges."""
        return self.tables.net("edges", _KEYS["edges"]).drop("sign", "document_id")

    def take_in(self, root: str, *, ignore: tuple[str, ...] = (), prune: bool = True) -> dict[str, int]:
        """Take in the Markdown and text files below ``root``; returns how many were added, changed, removed and left alone.

        A file is known by its path below the root and its bytes. With ``prune`` the nodes of files that are gone go too.
        Hidden, ignored and empty files count as gone. What was taken in half, when a run failed, is finished by the next one.
        """
        files = markdown.selected(markdown.read_files(self.spark, root), ignore).where("verdict IS NULL").select("path", "content", "size")
        known = self.nodes().where("type = 'Document'").select("path", F.col("content_hash").alias("was"), F.col("document_id").alias("old_id"))
        now = files.select("path", F.sha2("content", 256).alias("hash"))
        verdict = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("was") == F.col("hash"), "same").otherwise("changed")
        diff = materialise(now.join(known, "path", "full_outer").select("path", "old_id", verdict.alias("verdict")), "vault-diff")
        counts = {v: 0 for v in ("added", "changed", "removed", "same")} | {r["verdict"]: r["count"] for r in diff.groupBy("verdict").count().collect()}
        batch = self.tables.state()["batch"] + 1
        if counts["added"] or counts["changed"] or (prune and counts["removed"]):
            self._change(files, diff, batch, prune)
        elif batch:
            self._follow(batch - 1)
        return counts

    def _change(self, files: DataFrame, diff: DataFrame, batch: int, prune: bool) -> None:
        """Commit the new rows of added and changed files, and take back the old ones of changed and removed files."""
        fresh = files.join(diff.where("verdict IN ('added', 'changed')").select("path"), "path", "left_semi")
        documents, blocks, claims = markdown.markdown_graph(fresh, self.block_bytes)
        none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
        number = lambda c: F.lit(None).cast("long").alias(c)
        agent, activity = (F.lit(x) for x in gates.SYSTEM_IDS)
        docs = documents.select("id", F.lit("Document").alias("type"), "title", F.lit("").alias("content"), *none("s", "p", "o_id", "o_literal"), F.lit(None).cast("double").alias("confidence"), *none("block_id"), F.col("id").alias("document_id"), "path", F.lit(0).cast("long").alias("byte_start"), F.col("size").alias("byte_end"), "content_hash")
        parts = blocks.select("id", F.lit("Block").alias("type"), F.concat_ws("#", "path", F.col("block_index").cast("string")).alias("title"), F.col("text").alias("content"), *none("s", "p", "o_id", "o_literal"), F.lit(None).cast("double").alias("confidence"), *none("block_id"), "document_id", "path", "byte_start", "byte_end", "content_hash")
        said = claims.select("id", F.lit("Claim").alias("type"), F.concat_ws(": ", C.verbalized(F.col("p")), "o_literal").alias("title"), C.text_or_empty(F.col("o_literal")).alias("content"), "s", "p", "o_id", "o_literal", F.col("confidence").cast("double").alias("confidence"), "block_id", F.col("s").alias("document_id"), *none("path"), number("byte_start"), number("byte_end"), *none("content_hash"))
        makers = self.spark.createDataFrame([(gates.SYSTEM_IDS[0], "Agent"), (gates.SYSTEM_IDS[1], "Activity")], "id string, type string") if batch == 0 else None
        every = docs.unionByName(parts).unionByName(said).withColumn("infra", F.lit(False)).dropDuplicates(["id"])
        if makers is not None:
            every = every.unionByName(makers.withColumn("infra", F.lit(True)), allowMissingColumns=True)
        text = F.concat_ws(" ", "title", "content")
        every = materialise(embedding.embed_in_batches(every.withColumn("__text", text), self.embed, text_col="__text").drop("__text"), "vault-nodes")
        ties = markdown.provenance_edges(claims, every, gates.SYSTEM_IDS[1], gates.SYSTEM_IDS[0]).join(said.select(F.col("id").alias("src"), "document_id").distinct(), "src")
        held = blocks.select(C.edge_id(F.col("document_id"), F.lit("has_block"), F.col("id")).alias("id"), F.lit("has_block").alias("type"), F.col("document_id").alias("src"), F.col("id").alias("dst"), "document_id")
        lines = materialise(ties.select("id", "type", "src", "dst", "document_id").unionByName(held), "vault-edges")

        touched = diff.where(F.col("verdict").isin("changed", *(["removed"] if prune else []))).select(F.col("old_id").alias("document_id"))
        changes = {}
        for name, new in (("nodes", every), ("edges", lines)):
            old = self.tables.net(name, _KEYS[name]).join(touched, "document_id", "left_semi").drop("sign")
            both = new.select(*_KEYS[name]).withColumn("sign", F.lit(1)).unionByName(old.select(*_KEYS[name]).withColumn("sign", F.lit(-1)))
            changes[name] = materialise(both.groupBy(*_KEYS[name]).agg(F.sum("sign").alias("sign")).where("sign <> 0"), f"vault-{name}-signed")
        self.tables.apply(batch, changes)
        self._follow(batch)

    def _follow(self, batch: int) -> None:
        """Bring index and tallies up to a committed batch; each skips what it holds already."""
        state = self.tables.state()
        folder = state["live"]["nodes"][-1] if state["live"]["nodes"] else None
        if folder is None or (self.index.tables.state()["batch"] >= batch and not self.tallies.is_stale(batch)):
            return
        nodes, edges = (self.spark.read.schema(self.tables._schema(n)).parquet(f"{self.tables.path}/{n}/{state['live'][n][-1]}") for n in ("nodes", "edges"))
        new = nodes.where("sign > 0 AND NOT infra").select("id", "type", F.concat_ws(" ", "title", "content").alias("text"), "embedding")
        gone = nodes.where("sign < 0").select("id").join(nodes.where("sign > 0").select("id"), "id", "left_anti")
        self.index.apply(batch, new, gone)
        none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
        order = [c.strip().split()[0] for c in CHANGES.split(",")]
        of_nodes = nodes.select(F.lit("node").alias("op"), "sign", "id", "type", *none("src", "dst"), "s", "p", F.coalesce("o_id", "o_literal").alias("o"), "infra")
        of_edges = edges.select(F.lit("edge").alias("op"), "sign", "id", "type", "src", "dst", *none("s", "p", "o"), F.lit(False).alias("infra"))
        self.tallies.apply(batch, of_nodes.select(*order).unionByName(of_edges.select(*order)))

    def ask(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """``query_id, id, score, rank, path, byte_start, byte_end, content_hash, block_id``: the best ``k`` nodes for each of ``questions(query_id, text)``, scores from 0 to 1, with their place in the files."""
        asked = materialise(embedding.embed_in_batches(questions.select("query_id", C.text_or_empty(F.col("text")).alias("text")), self.embed), "questions")
        corpus = materialise(self.nodes(), "vault-corpus")
        found = retrieve.hybrid_recall(corpus, asked, self.edges(), k)
        return lookups.query_hits(materialise(found, "vault-hits"), self.anchors(corpus), k)

    def search(self, questions: DataFrame, k: int = 10, kind: str | None = None) -> DataFrame:
        """``query_id, id, score, rank`` by words alone, from the index."""
        return self.index.bm25(questions, F.col("text"), k, kind)

    def anchors(self, nodes: DataFrame | None = None) -> DataFrame:
        """``id, path, byte_start, byte_end, content_hash, block_id`` of every node: a claim's are its block's."""
        nodes = self.nodes() if nodes is None else nodes
        span = F.struct(F.col("path").alias("source_path"), "byte_start", "byte_end", "content_hash")
        blocks = nodes.where("type = 'Block'").select("id", "path", "byte_start", "byte_end", "content_hash")
        own = F.when(F.col("type") == "Block", F.col("id")).otherwise(F.col("block_id"))
        return lookups.provenance(nodes.select("id", own.alias("block_id"), F.when(F.col("path").isNotNull(), span).alias("span")), blocks)

    def explain(self, ids: DataFrame) -> DataFrame:
        """For each of ``ids(id)`` that is a node its type, title, place and relationships: ``id, type, title, path, byte_start, byte_end, content_hash, lines``."""
        nodes = self.nodes()
        asked = nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "type", "title")
        lines = lookups.relationship_lines(asked, self.edges(), nodes.select("id", "title"))
        listed = lines.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))  # at most five a node
        return asked.join(self.anchors(nodes).drop("block_id"), "id").join(listed, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))

    def export(self, types: Sequence[str] | None = None, documents: DataFrame | None = None) -> DataFrame:
        """``value``: a JSON-LD object for each node in scope, without plumbing."""
        return snapshots.json_ld(evaluation.scoped(self.nodes().where("NOT infra"), types, documents))

    def merge(self) -> None:
        """Fold what many batches left into one folder a table."""
        for name, keys in _KEYS.items():
            self.tables.merge(name, keys)
        self.index.merge()
        self.tallies.merge()
