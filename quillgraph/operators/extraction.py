"""Reading what an extractor returns: JSON objects within text, candidates with gates, strict batch verdicts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import vocabulary as V

_DECODER = json.JSONDecoder()


def json_objects(text: str | None) -> list[dict]:
    """Every JSON object in the text, in order, none within another."""
    out, at, text = [], 0, text or ""
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = _DECODER.raw_decode(text, at)
            out += [found] if isinstance(found, dict) else []
        except ValueError:
            at += 1
    return out


def embedded_objects(replies: DataFrame) -> DataFrame:
    """``reply_id, pos, object`` (JSON) of ``reply_id, text``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, n, json.dumps(o, sort_keys=True, ensure_ascii=False)) for i, t in zip(pdf["reply_id"], pdf["text"], strict=True) for n, o in enumerate(json_objects(t))]
            yield pd.DataFrame(rows, columns=["reply_id", "pos", "object"])

    return replies.select("reply_id", "text").mapInPandas(run, "reply_id long, pos int, object string")


def candidates(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``reply_id, type, title, content`` and claims ``reply_id, subject, predicate, object`` that pass the gates.

    Nodes need a known type and a title that isn't worthless, generic, a file name or a type's name; claims need all
    three parts and a predicate that is neither noise nor metadata. Repeats within a reply are one.
    """
    shape = "nodes array<struct<type:string,title:string,content:string>>, claims array<struct<subject:string,predicate:string,object:string>>"
    parsed = objects.select("reply_id", F.from_json("object", shape).alias("o"))
    n = parsed.select("reply_id", F.explode("o.nodes").alias("n")).select("reply_id", "n.type", F.trim("n.title").alias("title"), F.coalesce("n.content", F.lit("")).alias("content"))
    title = F.col("title")
    names = [t.lower() for t in V.PRIMITIVE_TYPES] + ["claim", "entity", "node"]
    nodes = n.where(F.col("type").isin(*V.PRIMITIVE_TYPES) & ~C.is_low_value_title(title) & ~C.is_generic_title(title) & ~C.is_filename(title) & ~F.lower(title).isin(*names))
    c = parsed.select("reply_id", F.explode("o.claims").alias("c")).select("reply_id", F.trim("c.subject").alias("subject"), F.trim("c.predicate").alias("predicate"), F.trim("c.object").alias("object"))
    claims = c.where((F.col("subject") != "") & (F.col("object") != "") & (C.predicate_key(F.col("predicate")) != "") & ~C.is_noisy_predicate(F.col("predicate")) & ~C.is_metadata_predicate(F.col("predicate")))
    return nodes.dropDuplicates(["reply_id", "type", "title"]), claims.dropDuplicates(["reply_id", "subject", "predicate", "object"])


def batch_verdicts(replies: DataFrame, expected: DataFrame, allowed: tuple[str, ...] = ("commit", "queue", "reject")) -> DataFrame:
    """``batch, item_id, verdict, valid``: a reply (``batch, text`` as a JSON array) counts only if it names each expected item once, no other, with allowed verdicts."""
    said = replies.select("batch", F.explode_outer(F.from_json("text", "array<struct<id:string,verdict:string>>")).alias("v")).select("batch", F.col("v.id").alias("item_id"), "v.verdict")
    counted = said.groupBy("batch", "item_id").agg(F.count("*").alias("n"), F.min("verdict").alias("verdict"))
    both = expected.select("batch", "item_id").join(counted, ["batch", "item_id"], "full_outer").join(expected.select("batch", "item_id").withColumn("e", F.lit(True)), ["batch", "item_id"], "left")
    fine = F.coalesce(F.col("e") & (F.col("n") == 1) & F.col("verdict").isin(*allowed), F.lit(False))
    whole = both.groupBy("batch").agg(F.min(fine).alias("valid"))
    return both.where("e").join(whole, "batch").select("batch", "item_id", F.when(F.col("valid"), F.col("verdict")).alias("verdict"), "valid")
