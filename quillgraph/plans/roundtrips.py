"""Queries that write tables in a format of the sources to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans.registry import query
from quillgraph.runtime import materialise, scratch_path
from quillgraph.sources import markdown, snapshots
from quillgraph.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table


@query(f"WITH {NODES_SQL} SELECT id, type, title, '/there/' || type || '/' || id AS source_path FROM nodes")
def snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes dumped as a snapshot with their edges, verified by checksums and loaded under another prefix of their paths."""
    path = scratch_path(spark, "snapshot")
    known = nodes(spark, sf_dir).select("id", "type", "title", F.concat(F.lit("/here/"), "type", F.lit("/"), "id").alias("source_path"))
    snapshots.dump({"nodes": known, "edges": edges(spark, sf_dir)}, path)
    return snapshots.load(spark, path, prefix=("/here/", "/there/"))["nodes"]


@query(f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 'nodes' AS "table", (SELECT count(*) FROM nodes) AS n, true AS whole, false AS whole_after UNION ALL SELECT 'edges', (SELECT count(*) FROM edges), true, true""")
def snapshot_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each table of a snapshot matches its manifest, before and after a node is written again in place of the nodes."""
    path = scratch_path(spark, "snapshot")
    known = nodes(spark, sf_dir)
    manifest = snapshots.dump({"nodes": known, "edges": edges(spark, sf_dir)}, path)
    before = snapshots.verify(spark, path)
    materialise(known, "nodes").limit(1).write.mode("append").parquet(f"{path}/nodes")
    after = snapshots.verify(spark, path)
    return spark.createDataFrame([(t, m["rows"], before[t], after[t]) for t, m in manifest["tables"].items()], "table string, n long, whole boolean, whole_after boolean")


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'English' ELSE lang END AS type, text AS content FROM documents")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved as an index corpus of JSON lines and read back, an upsert of those in English between."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("text").alias("content"))
    first, second = scratch_path(spark, "corpus"), scratch_path(spark, "corpus")
    kind = "id long, type string, content string"
    snapshots.save_corpus(docs, first)
    stored = snapshots.load_corpus(spark, first, kind)
    snapshots.save_corpus(snapshots.upsert(stored, docs.where("type = 'en'").withColumn("type", F.lit("English"))), second)
    return snapshots.load_corpus(spark, second, kind)


@query("""SELECT vec_id AS id, label + CASE WHEN label >= 5 THEN 100 ELSE 0 END AS label, round(CAST(embedding[1] AS DOUBLE), 6) AS first, label >= 5 AND vec_id IN (SELECT vec_id FROM embeddings WHERE label = 9) AS cleared_label
FROM embeddings""")
def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose rows are written again with another label and without a vector: they keep the one that is stored."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    new = rows.where("label >= 5").select("id", (F.col("label") + 100).alias("label"), F.lit(None).cast("array<double>").alias("embedding"))
    return snapshots.upsert(rows, new).select("id", "label", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), (F.col("label") == 109).alias("cleared_label"))


@query(f"""WITH {NODES_SQL} SELECT '{{"@id":"' || id || '","@type":"' || type || '","name":"' || title || '","description":"' || content || '"}}' AS value FROM nodes WHERE type IN ('Agent', 'Place')""")
def exported_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents and places as JSON-LD objects."""
    return snapshots.json_ld(nodes(spark, sf_dir), ("Agent", "Place"))


@query("SELECT event_type AS kind, user_id AS run_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a ledger in two batches and scanned back, by kind and run."""
    path = scratch_path(spark, "ledger")
    rows = table(spark, sf_dir, "events").select(F.lit(1).alias("ledger_version"), F.col("event_type").alias("kind"), F.col("user_id").alias("run_id"), "value")
    for part in (rows.where("value < 20"), rows.where("value >= 20 OR value IS NULL")):
        snapshots.append_events(part, path)
    events, _ = snapshots.scan_ledger(spark, path, "ledger_version int, kind string, run_id long, value double")
    return events.groupBy("kind", "run_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size, count(*) AS lines FROM (SELECT lang, source, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM documents) GROUP BY ALL")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files in a folder for each language and source, a line each, found again below the root: size and lines of each folder."""
    root = scratch_path(spark, "folder")
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]", " ").alias("value"))
    docs.write.partitionBy("lang", "source").text(root)
    files = markdown.selected(markdown.read_files(spark, root), ignore_dirs=("_temporary",)).where("verdict IS NULL")
    at = lambda name: F.regexp_extract("path", f"{name}=([^/]*)", 1)
    lines = F.octet_length("content") - F.octet_length(F.expr("CAST(translate(CAST(content AS STRING), '\\n', '') AS BINARY)"))
    return files.groupBy(at("lang").alias("lang"), at("source").alias("source")).agg(F.sum("size").alias("size"), F.sum(lines).cast("long").alias("lines"))
