"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keeps one state row for each digest in RocksDB, without expiry:
digest, number of rows, the stable identifier of the row that stays and the locator of its content
(file and row number). Rows are pre-aggregated before the shuffle, so a text that a third of all rows
share costs one state update for each task. Every hit is then checked against the full bytes that the
locator names; digests under which different texts meet are grouped anew by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import lower_az
from quillgraph.runtime import is_file, materialise, remove_path, scratch_path

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves 4 MB of disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text_col: str) -> Column:
    """The text that is compared: null as empty, A-Z lower-cased."""
    return lower_az(F.coalesce(F.col(text_col), F.lit("")))


def _rows(docs: DataFrame, id_col: str, text_col: str, key_chars: int, with_text: bool) -> DataFrame:
    text = normalised(text_col)
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = docs.select(F.col(id_col).alias("id"), where.alias("at"), F.sha2(text, 256).alias("sha"), *([text.alias("body")] if with_text else []))
    return rows.withColumn("key", F.substring("sha", 1, key_chars))


def fold_stream(spark: SparkSession, path: str, checkpoint: str, updates: str, *, id_col: str = "doc_id", text_col: str = "text", key_chars: int = 64, source_options: dict[str, str] | None = None) -> None:
    """Run the stream over all files of ``path`` that ``checkpoint`` hasn't seen, and append its state updates.

    A later call with the same ``checkpoint`` takes the new files alone: the state has no expiry. Each
    micro-batch overwrites its own folder, so a batch that is retried leaves its rows once.
    """
    schema, options, folder = spark.read.parquet(path).schema, dict(source_options or {}), path
    if is_file(spark, path):  # a streaming source is a folder
        folder, options["pathGlobFilter"] = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    rows = _rows(stream, id_col, text_col, key_chars, False)
    state = rows.groupBy("key").agg(F.max(F.struct("id", "at")).alias("best"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}"))
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def latest_state(spark: SparkSession, updates: str) -> DataFrame:
    """The state after the last batch: counts and identifiers only ever rise, so the largest of each is the last."""
    found = spark.read.option("basePath", updates).parquet(updates)
    return found.groupBy("key").agg(F.max("best").alias("best"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", key_chars: int = 64, source_options: dict[str, str] | None = None) -> DataFrame:
    """Group the rows of the Parquet table at ``path`` by equal text; the largest id of each group stays.

    Returns one row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * A null text counts as the empty text; empty texts form one group.
    * A null id is below every other one. Of rows that repeat the same id and text exactly one is kept.
    * An empty table gives an empty result. Other columns of the table aren't read.
    * ``key_chars``: hex digits of the digest that key the state. Fewer digits give more collisions, not
      another result: full texts decide.
    """
    if spark.read.parquet(path).isEmpty():
        return spark.createDataFrame([], "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string")
    checkpoint, updates = scratch_path(spark, "dedup-state"), scratch_path(spark, "dedup-updates")
    fold_stream(spark, path, checkpoint, updates, id_col=id_col, text_col=text_col, key_chars=key_chars, source_options=source_options)
    state = materialise(latest_state(spark, updates), "dedup-latest")
    remove_path(spark, checkpoint)
    remove_path(spark, updates)
    docs = spark.read.parquet(path)

    # Full bytes of the hits alone; rows are split by the adaptive join where one digest is hot.
    several = state.where("n > 1").select("key", F.col("best.at").alias("best_at"))
    hits = _rows(docs, id_col, text_col, key_chars, True).join(several, "key").select("key", "id", "at", "sha", "body", (F.col("at") == F.col("best_at")).alias("best"))
    hits = materialise(hits, "dedup-hits")
    stays = hits.where("best").select("key", F.col("body").alias("stays_body"))
    clashes = materialise(hits.where("not best").join(stays, "key").where("body <> stays_body").select("key"), "dedup-clashes")

    rows = _rows(docs, id_col, text_col, key_chars, False)
    out = rows.join(state, "key", "left").select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("best.at")).alias("kept"), F.col("sha").alias("text_sha256"), "key"
    )
    if clashes.isEmpty():
        return out.drop("key")
    apart = hits.join(clashes, "key", "left_semi")
    groups = materialise(apart.groupBy("key", "body").agg(F.max(F.struct("id", "at")).alias("best"), F.count("*").alias("n")), "dedup-apart").withColumnRenamed("best", "first")
    exact = apart.join(groups, ["key", "body"]).select(F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("first.at")).alias("kept"), F.col("sha").alias("text_sha256"))
    return out.join(clashes, "key", "left_anti").drop("key").unionByName(exact)
