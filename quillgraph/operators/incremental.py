"""Incremental maintenance: what an edit removed, changed fragments, supersedence and validity."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.runtime import materialise


def sentence_units(text: Column) -> Column:
    """The distinct sentences of a text, whatever its line breaks: paragraphs are joined to a line, then cut after ``. ! ? ; :``."""
    joined = F.transform(F.split(C.text_or_empty(text), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    units = F.flatten(F.transform(joined, lambda p: F.split(p, r"(?<=[.!?;:])\s+")))
    return F.array_distinct(F.filter(F.transform(units, F.trim), lambda u: u != ""))


def orphan_diffs(orphans: DataFrame, current: DataFrame) -> DataFrame:
    """``block_id, unit, survived``: each sentence of an orphaned block (``block_id, path, text``), and whether the path's current text (``path, text``) still has it."""
    units = orphans.select("block_id", "path", F.explode(sentence_units(F.col("text"))).alias("unit"))
    alive = current.select("path", F.explode(sentence_units(F.col("text"))).alias("unit")).distinct().withColumn("alive", F.lit(True))
    return units.join(alive, ["path", "unit"], "left").select("block_id", "unit", F.coalesce("alive", F.lit(False)).alias("survived"))


def carrying_units(units: Column, literal: Column) -> Column:
    """Those units that carry a claim's value: with it verbatim, else with a telling token, else with all of its tokens, else all but headings."""
    needle = F.lower(F.trim(C.text_or_empty(literal)))
    tokens = F.filter(F.regexp_extract_all(needle, F.lit("([a-z0-9][a-z0-9._:/-]*)"), 1), lambda t: (F.length(t) >= 4) | t.rlike("[0-9]"))
    telling = F.filter(tokens, lambda t: (F.length(t) >= 8) | t.rlike("[0-9]"))
    verbatim = F.filter(units, lambda u: F.lower(u).contains(needle))
    some = F.filter(units, lambda u: F.exists(telling, lambda t: F.lower(u).contains(t)))
    every = F.filter(units, lambda u: F.forall(tokens, lambda t: F.lower(u).contains(t)))
    plain = F.filter(units, lambda u: ~F.ltrim(u).startswith("#"))
    return (
        F.when((needle != "") & (F.size(verbatim) > 0), verbatim)
        .when((F.size(telling) > 0) & (F.size(some) > 0), some)
        .when((F.size(tokens) > 0) & (F.size(every) > 0), every)
        .when(F.size(plain) > 0, plain)
        .otherwise(units)
    )


def detached_claims(claims: DataFrame, diffs: DataFrame) -> DataFrame:
    """``id``: claims (``id, block_id, o_literal``) of orphaned blocks none of whose carrying sentences survived, where some were removed."""
    units = diffs.groupBy("block_id").agg(F.collect_list("unit").alias("units"), F.collect_list(F.when(F.col("survived"), F.col("unit"))).alias("alive"))
    known = claims.join(units, "block_id").withColumn("mine", carrying_units(F.col("units"), F.col("o_literal")))
    return known.where((F.size("mine") > 0) & (F.size(F.array_intersect("mine", "alive")) == 0)).select("id")


def superseded(claims: DataFrame, new: DataFrame, valid_as_of: str) -> DataFrame:
    """Claims ``id, s, p, o, valid_until``: those that a new claim (``id, s, p, o``) contradicts end at the date and name the smallest that does.

    Of the new claims under a subject and predicate only two can be that: the smallest of all, and the smallest that
    says something else than it. So each old claim meets one row, however many contradict it.
    """
    ids = new.groupBy("s", "p", "o").agg(F.min("id").alias("n"))
    first = ids.groupBy("s", "p").agg(F.min(F.struct("n", "o")).alias("first"))
    second = ids.join(first, ["s", "p"]).where(F.col("o") != F.col("first.o")).groupBy("s", "p").agg(F.min("n").alias("second"))
    known = claims.join(first.join(second, ["s", "p"], "left"), ["s", "p"], "left")
    by = F.when(F.col("o") != F.col("first.o"), F.col("first.n")).when(F.col("o") == F.col("first.o"), F.col("second"))
    out = known.withColumn("superseded_by", by).select(*claims.columns, "superseded_by")
    return out.withColumn("valid_until", F.when(F.col("superseded_by").isNotNull() & F.col("valid_until").isNull(), F.lit(valid_as_of).cast("date")).otherwise(F.col("valid_until")))


def retired(stored: DataFrame, fresh: DataFrame, valid_as_of: str) -> DataFrame:
    """Deterministic claims of a document that its new version doesn't mint any more end; others are untouched. Both have ``id, document_id``."""
    touched = stored.join(fresh.select("document_id").distinct(), "document_id", "left_semi").join(fresh.select("id"), "id", "left_anti").select("id").withColumn("gone", F.lit(True))
    out = stored.join(touched, "id", "left")
    return out.withColumn("valid_until", F.when(F.col("gone") & F.col("valid_until").isNull(), F.lit(valid_as_of).cast("date")).otherwise(F.col("valid_until"))).drop("gone")


def resurrected(claims: DataFrame, current_units: DataFrame) -> DataFrame:
    """Ended claims whose value a current sentence (``path, unit``) has again lose their end: ``id, path, o_literal, valid_until``."""
    ended = claims.where("valid_until IS NOT NULL AND o_literal <> ''").select("id", "path", "o_literal")
    back = ended.join(current_units, "path").where(F.lower("unit").contains(F.lower(F.trim("o_literal")))).select("id").distinct().withColumn("back", F.lit(True))
    return claims.join(back, "id", "left").withColumn("valid_until", F.when(F.col("back"), F.lit(None).cast("date")).otherwise(F.col("valid_until"))).drop("back")


def valid_at(claims: DataFrame, day: Column) -> DataFrame:
    """Claims that hold on a day: from ``valid_as_of`` (or always) until before ``valid_until`` (or for good)."""
    return claims.where((F.coalesce("valid_as_of", day) <= day) & (F.col("valid_until").isNull() | (F.col("valid_until") > day)))


def changed_fragments(old: str, new: bytes, base: int) -> list[tuple[int, int, str]]:
    """``start, end, text`` of runs of lines that the new bytes replace or add, by a line diff without trailing space."""
    lines = new.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    diff = difflib.SequenceMatcher(None, [x.rstrip() for x in old.splitlines()], [x.decode("utf-8", "replace").rstrip() for x in lines], autojunk=False)
    out = []
    for tag, _, _, a, b in diff.get_opcodes():
        text = new[starts[a] : starts[b]].decode("utf-8", "replace").strip() if tag in ("replace", "insert") else ""
        if text:
            out.append((base + starts[a], base + starts[b], text))
    return out


def hunks(pairs: DataFrame) -> DataFrame:
    """``block_id, byte_start, byte_end, text, content_hash`` of what changed in ``block_id, old STRING, new BINARY, byte_start``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for block, old, new, base in zip(pdf["block_id"], pdf["old"], pdf["new"], pdf["byte_start"], strict=True):
                raw = bytes(new or b"")
                for a, b, text in changed_fragments(old or "", raw, int(base)):
                    rows.append((block, a, b, text, hashlib.sha256(raw[a - int(base) : b - int(base)]).hexdigest()))
            yield pd.DataFrame(rows, columns=["block_id", "byte_start", "byte_end", "text", "content_hash"])

    return pairs.select("block_id", "old", "new", "byte_start").mapInPandas(run, "block_id string, byte_start long, byte_end long, text string, content_hash string")


def prior_snapshot(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an earlier version left: ``path, content_hash`` of blocks that carry claims, and for each ``path, block_index`` one block ``old, had_claims``.

    ``old(path, block_index, content_hash, text, has_claims)``. Of several blocks at one place one with claims stands for it, then the one of the smallest digest.
    """
    claimed = F.coalesce("has_claims", F.lit(False))
    settled = old.where(claimed & (F.coalesce("content_hash", F.lit("")) != "")).select("path", "content_hash").distinct()
    best = F.min_by(F.struct(C.text_or_empty(F.col("text")).alias("old"), claimed.alias("had_claims")), F.struct(~claimed, "content_hash"))
    return settled, old.where("block_index IS NOT NULL").groupBy("path", "block_index").agg(best.alias("b")).select("path", "block_index", "b.old", "b.had_claims")


def extraction_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, block_id, byte_start, byte_end, content_hash, text, whole``: what an edit leaves to be extracted.

    ``new(path, id, block_index, byte_start, byte_end, content_hash, raw BINARY)``. A block whose bytes carried claims
    before, wherever in its file, is left out by its digest, before any text is compared. Of others the lines that differ from the old block of
    the same place are units, with their bytes in the new file; a block without an old one, or without a new line whose
    old one never had claims, is a unit as a whole.

    * A null text or null bytes are empty; a block of white space alone has no unit of lines. Repeated rows of a block count once.
    * Texts of the two versions meet by path and place, one to one, so that no group grows with a file. Empty tables give no rows.
    """
    settled, placed = prior_snapshot(old)
    fresh = new.dropDuplicates(["path", "id"]).join(settled, ["path", "content_hash"], "left_anti")
    pairs = materialise(fresh.select("path", F.col("id").alias("block_id"), "block_index", "byte_start", "byte_end", "content_hash", F.coalesce("raw", F.lit(b"")).alias("new")).join(placed, ["path", "block_index"], "left"), "changed-blocks")
    known = pairs.where("old <> ''")
    lines = materialise(hunks(known), "changed-lines").join(known.select("block_id", "path").distinct(), "block_id")
    lines = lines.select("path", "block_id", "byte_start", "byte_end", "content_hash", "text", F.lit(False).alias("whole"))
    untouched = pairs.join(lines.select("block_id").distinct(), "block_id", "left_anti").where("old IS NULL OR old = '' OR NOT had_claims")
    whole = untouched.select("path", "block_id", "byte_start", "byte_end", F.sha2("new", 256).alias("content_hash"), F.btrim(F.decode("new", "utf-8")).alias("text"), F.lit(True).alias("whole"))
    return lines.unionByName(whole)
