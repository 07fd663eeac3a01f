"""Drift detectors over document metadata ``id, type, ...``: one finding for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V


def _finding(df: DataFrame, kind: str, message: Column) -> DataFrame:
    name = F.concat(F.lit("f_"), F.substring(C.sha256_id(F.lit(kind), F.col("id")), 1, 16))
    return df.select(name.alias("finding_id"), F.lit(kind).alias("kind"), F.lit("warn").alias("severity"), F.lit("open").alias("status"), F.col("id").alias("document_id"), message.alias("message"))


def overdue_commitments(docs: DataFrame, closures: DataFrame, reference_date: str = V.REFERENCE_DATE) -> DataFrame:
    """Commitments due before the date that no other document's closure names.

    ``docs(id, type, due, tokens)``: tokens are the names that may refer to the document; ``closures(id, value)``: exploded
    values under the closure keys.
    """
    late = docs.where((F.col("type") == "commitment") & (C.parsed_date(F.col("due").cast("string")) < F.lit(reference_date).cast("date")))
    names = late.select("id", F.explode(F.array_distinct(F.array_append("tokens", F.col("id")))).alias("value"))
    closed = names.join(closures.select(F.col("id").alias("by"), "value"), "value").where("id <> by").select("id")
    return _finding(late.join(closed, "id", "left_anti"), "commitment_temporal_shacl", F.concat(F.lit("Commitment is overdue with no closure evidence: "), F.col("id")))


def stale_heads(docs: DataFrame) -> DataFrame:
    """Decisions ``id, decision_id, supersedes ARRAY, head``, explicitly no head, that supersede something and are superseded."""
    gone = docs.select(F.explode("supersedes").alias("decision_id")).distinct()
    stale = docs.where((F.size("supersedes") > 0) & (F.col("head") == F.lit(False)) & (F.col("decision_id") != "")).join(gone, "decision_id", "left_semi")
    return _finding(stale, "supersedence_stale_head", F.concat(F.lit("Decision "), F.col("decision_id"), F.lit(" is stale and superseded by a later head")))


def alias_collisions(docs: DataFrame) -> DataFrame:
    """Authorities ``id, type, agent, alias_of`` that are aliases of an agent which is also a primary one."""
    rows = docs.where((F.col("type") == "authority") & (F.coalesce("agent", F.lit("")) != ""))
    alias = F.coalesce("alias_of", F.lit("")) != ""
    hit = rows.where(alias).join(rows.where(~alias).select("agent"), "agent", "left_semi")
    return _finding(hit, "authority_alias_collision", F.concat(F.lit("Authority alias collides with primary authority: "), F.col("agent")))
