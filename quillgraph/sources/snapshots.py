"""Tables in and out: versioned snapshots with checksums, index corpus, JSON-LD, ledger files, upserts by key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.runtime import remove_path


def checksum(df: DataFrame) -> dict[str, int | str]:
    """Number of rows and an order-free digest: sums of two hashes of each row, folded in each task."""
    cols = [F.to_json(F.col(c)) if df.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c).cast("string") for c in sorted(df.columns)]
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in cols]), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{at}")
    found = df.agg(F.count("*").alias("n"), part(1), part(13)).first()
    return {"rows": found["n"], "digest": f"{found['h1'] or 0}-{found['h13'] or 0}"}


def dump(tables: dict[str, DataFrame], path: str, version: int = 1) -> dict:
    """Write tables as Parquet below ``path`` with a manifest of rows and checksums; the manifest comes last."""
    manifest = {"version": version, "tables": {}}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest["tables"][name] = checksum(spark.read.parquet(f"{path}/{name}"))
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def verify(spark: SparkSession, path: str) -> dict[str, bool]:
    """Whether each table of the manifest still has its rows."""
    return {name: checksum(spark.read.parquet(f"{path}/{name}")) == want for name, want in read_manifest(spark, path)["tables"].items()}


def load(spark: SparkSession, path: str, prefix: tuple[str, str] | None = None, skip_embeddings: bool = False) -> dict[str, DataFrame]:
    """The snapshot's tables, if all verify; ``prefix`` rewrites the start of source paths."""
    if not all(verify(spark, path).values()):
        raise ValueError(f"{path} doesn't match its manifest")
    out = {}
    for name in read_manifest(spark, path)["tables"]:
        df = spark.read.parquet(f"{path}/{name}")
        if prefix and "source_path" in df.columns:
            old, new = prefix
            df = df.withColumn("source_path", F.when(F.col("source_path").startswith(old), F.concat(F.lit(new), F.expr(f"substr(source_path, {len(old) + 1})"))).otherwise(F.col("source_path")))
        out[name] = df.drop("embedding") if skip_embeddings else df
    return out


def upsert(stored: DataFrame, new: DataFrame, clear_embedding: bool = False) -> DataFrame:
    """Rows by ``id``, the new ones in place of the stored; a missing vector keeps the stored one unless it is to be cleared."""
    if "embedding" in new.columns and not clear_embedding:
        kept = stored.select("id", F.col("embedding").alias("__old"))
        new = new.join(kept, "id", "left").withColumn("embedding", F.coalesce("embedding", "__old")).drop("__old")
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new)


def save_corpus(records: DataFrame, path: str) -> None:
    """The index corpus as JSON lines in order of id."""
    records.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def load_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The index corpus; of rows with one id the one in the last place wins."""
    rows = spark.read.schema(schema).json(path)
    order = F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())
    cols = [c for c in rows.columns if c != "id"]
    return rows.select("*", order.alias("__at")).groupBy("id").agg(F.max_by(F.struct(*cols), "__at").alias("r")).select("id", "r.*")


def json_ld(nodes: DataFrame, types: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """One JSON-LD object a line for the nodes in scope: by type and creation time."""
    if types:
        nodes = nodes.where(F.col("type").isin(*types))
    if since is not None:
        nodes = nodes.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    named = F.struct(F.col("id").alias("@id"), F.col("type").alias("@type"), F.col("title").alias("name"), F.col("content").alias("description"))
    return nodes.select(F.to_json(named).alias("value"))


def append_events(events: DataFrame, path: str) -> None:
    """Append a batch of ledger events as JSON lines."""
    events.write.mode("append").json(path)


def scan_ledger(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """The readable events of ledger files, and one row that counts lines, blank, malformed and unknown-version ones, and torn tails."""
    lines = spark.read.text(path, lineSep="\n").where("value IS NOT NULL")
    parsed = lines.select(F.trim("value").alias("line"), F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("e"))
    bad = (F.col("line") != "") & (F.col("e.__bad").isNotNull() | ~F.col("line").startswith("{"))
    known = F.coalesce(F.col("e.ledger_version").isin(*versions), F.lit(True)) if "ledger_version" in schema else F.lit(True)
    marked = parsed.select("e", bad.alias("bad"), (F.col("line") == "").alias("blank"), (~known).alias("odd"), (bad & F.col("line").startswith("{") & ~F.col("line").endswith("}")).alias("torn"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    report = marked.agg(F.count("*").alias("lines"), count("blank"), count("bad"), count("odd"), count("torn"))
    return marked.where("NOT bad AND NOT blank").select("e.*").drop("__bad"), report


def publish(df: DataFrame, root: str, version: int, keep: int = 2) -> str:
    """Write a new version of a table beside the old ones and drop all but the last ``keep``; readers pin a version's path."""
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    for old in range(max(0, version - keep - 8), version - keep + 1):
        remove_path(df.sparkSession, f"{root}/v={old}")
    return path
