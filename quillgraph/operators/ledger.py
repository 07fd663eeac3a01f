"""Folds over an append-only ledger of events ``seq, kind, ts, run_id, ...``; the order is always ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import columns as C


def run_summary(events: DataFrame) -> DataFrame:
    """One row for each run: last state, first start, last end, distinct candidates, events by kind. All partial aggregates."""
    is_run = F.col("kind") == "ingest_run"
    return events.where(F.coalesce("run_id", F.lit("")) != "").groupBy("run_id").agg(
        F.max_by("state", F.when(is_run & F.col("state").isNotNull(), F.col("seq"))).alias("state"),
        F.min(F.when(is_run & (F.col("state") == "started"), F.col("ts"))).alias("started_at"),
        F.max(F.when(is_run & (F.col("state") != "started"), F.col("ts"))).alias("completed_at"),
        F.count_distinct(F.when(F.col("kind") == "candidate", F.col("candidate_id"))).alias("candidates"),
        *[F.sum((F.col("kind") == kind).cast("long")).alias(name) for kind, name in (("comparison", "comparisons"), ("commit_plan", "commit_plans"), ("commit_record", "commit_records"))],
    )


def open_runs(events: DataFrame) -> DataFrame:
    """Runs whose last state is ``started``."""
    return run_summary(events).where("state = 'started'").select("run_id", "started_at")


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key; a hot key is folded in each task first."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def resumable_run(events: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The last open run that started under the wanted policy."""
    starts = events.where((F.col("kind") == "ingest_run") & (F.col("state") == "started"))
    for name, value in wanted.items():
        starts = starts.where(F.col(name).eqNullSafe(F.lit(value)))
    return starts.join(open_runs(events).select("run_id"), "run_id", "left_semi").agg(F.max_by("run_id", "seq").alias("run_id"))


def plans_without_outcome(events: DataFrame) -> DataFrame:
    """Commit plans that were neither committed nor abandoned."""
    ended = events.where(F.col("kind").isin("commit_record", "plan_abandoned")).select("plan_id")
    return events.where(F.col("kind") == "commit_plan").join(ended, "plan_id", "left_anti")


def order_issues(events: DataFrame) -> DataFrame:
    """Receipts that come before their plan or without one: ``plan_id, seq``."""
    plan = events.where(F.col("kind") == "commit_plan").groupBy("plan_id").agg(F.min("seq").alias("planned"))
    receipts = events.where(F.col("kind") == "operation_receipt").join(plan, "plan_id", "left")
    return receipts.where(F.col("planned").isNull() | (F.col("seq") < F.col("planned"))).select("plan_id", "seq")


def bursts(events: DataFrame, key: str, ts: Column, gap_seconds: int) -> DataFrame:
    """``key, first, last, n``: runs of events with gaps under ``gap_seconds``: what a quiet-period debounce would have enqueued."""
    rows = events.select(key, ts.cast("timestamp").alias("t"))
    w = Window.partitionBy(key).orderBy("t")
    fresh = F.coalesce((F.unix_micros("t") - F.unix_micros(F.lag("t").over(w))) >= gap_seconds * 1_000_000, F.lit(True))
    marked = rows.withColumn("fresh", fresh.cast("long")).withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "burst").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).drop("burst")


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: files (``path, mtime, digest``) that are new, changed, touched or deleted."""
    a, b = (df.select("path", F.col("mtime").alias(f"m{i}"), F.col("digest").alias(f"d{i}")) for i, df in ((0, old), (1, new)))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("d0").isNull(), "new").when(F.col("d1").isNull(), "deleted").when(F.col("d0") != F.col("d1"), "changed").when(F.col("m0") != F.col("m1"), "touched")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def page_after(rows: DataFrame, order: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows after the cursor in the order: a keyset filter, no offset scan."""
    if cursor is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(order, cursor, strict=True)]))
    return rows.orderBy(*order).limit(limit)


def collapse_literals(candidates: DataFrame) -> DataFrame:
    """Candidates ``seq, block_id, src, p, literal`` with ``kept_seq``: the first of a block's near-equal literals; its own for the rest."""
    key = F.when(F.col("literal").isNotNull() & (F.coalesce("block_id", F.lit("")) != ""), F.concat_ws("\x1f", "block_id", "src", F.lower("p"), C.near_dup_key(F.col("literal"))))
    first = candidates.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.min("seq").alias("kept_seq"))
    return candidates.withColumn("k", key).join(first, "k", "left").withColumn("kept_seq", F.coalesce("kept_seq", "seq")).drop("k")
