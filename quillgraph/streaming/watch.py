"""Streams: a folder of event files folded to the last state of each key, and debounced change batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.functions import vocabulary as V


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON event files as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)


def latest_state(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last event of each key as a streaming aggregate: partial in each task, state without expiry."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(seq, *[c for c in rest if c != seq])).alias("last"), F.count("*").alias("n")).select(key, "last.*", "n")


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Events by window and key; late ones count until the watermark passes."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str = "3 seconds", lateness: str = "1 hour") -> DataFrame:
    """Event-time sessions: changes of a key with gaps under ``gap`` become one batch."""
    grouped = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("until"), "n")


def debounce(changes: DataFrame, key: str, ts: str, quiet: int = V.QUIET_SECONDS, floor: int = V.FLOOR_SECONDS) -> DataFrame:
    """``key, first, last, n, ready_at``: changes of a key, held until ``quiet`` seconds without one, at least ``floor`` seconds after the last batch.

    Clocks are event times, so that a replay gives the same batches; what is still open when a stream ends is kept in
    state for the next run. State for a key is three numbers.
    """
    out = f"{key} string, first double, last double, n bigint, ready_at double"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, sent = state.get if state.exists else (0.0, 0.0, 0, 0.0)
        times = sorted(t for pdf in parts for t in pdf["__t"])
        rows = []
        for t in times:
            ready = max(last + quiet, sent + floor) if n else 0.0
            if n and t >= ready:
                rows.append((k[0], first, last, n, ready))
                sent, n = ready, 0
            first, last, n = (first if n else t), max(last, t) if n else t, n + 1
        state.update((first, last, n, sent))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "first", "last", "n", "ready_at"])

    timed = changes.select(F.col(key).cast("string").alias(key), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us")).select(key, (F.col("__us") / 1e6).alias("__t"))
    return timed.groupBy(key).applyInPandasWithState(step, out, "first double, last double, n bigint, sent double", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there, then stop. Batches of an updating query go to folders of their own."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()
    return query
