"""Files as a source: Markdown and text with front matter, folder manifests, selection rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import ingest


def read_files(spark: SparkSession, root: str, pattern: str = "*.{md,markdown,txt}") -> DataFrame:
    """``path`` (below the root), ``content``, ``mtime``, ``size`` of every file below the root that fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    inside = F.regexp_replace(F.expr(f"substr(path, instr(path, '{base}') + {len(base)})"), "^/+", "")
    return files.select(inside.alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def selected(files: DataFrame, ignore: tuple[str, ...] = (), ignore_dirs: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """Files with ``verdict``: null for those taken, else why not (hidden, ignored folder, ignored file, empty)."""
    like = lambda glob: "^" + glob.replace(".", r"\.").replace("*", "[^/]*").replace("?", "[^/]") + "$"
    parts = F.split("path", "/")
    folder, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    verdict = F.when(F.exists(folder, lambda p: p.isin(*ignore_dirs) if ignore_dirs else F.lit(False)), "ignored_dir").when(F.exists(parts, lambda p: p.startswith(".")), "hidden")
    for glob in ignore:
        verdict = verdict.when(name.rlike(like(glob)), "ignored_glob")
    return files.withColumn("verdict", verdict.when(F.col("size") == 0, "empty"))


def manifest(files: DataFrame) -> DataFrame:
    """``path, mtime, size, digest`` of each file."""
    return files.select("path", "mtime", "size", F.sha2("content", 256).alias("digest"))


def corpus_hash(manifest: DataFrame) -> DataFrame:
    """One row: the digest over the paths' lines in order, and the number of files. A manifest is one short line for each file."""
    line = F.concat_ws("\x1f", "path", "digest")
    return manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("corpus_hash"), F.count("*").alias("n_files"))


def metadata(files: DataFrame) -> DataFrame:
    """``path, meta`` (front matter as JSON, null without one), ``body_start``, ``title``, ``tags``."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                meta, start = ingest.front_matter(bytes(raw or b""))
                tags = meta.get("tags") or []
                rows.append((path, json.dumps(meta, default=str, sort_keys=True) if meta else None, start, str(meta.get("title") or path), [str(t) for t in (tags if isinstance(tags, list) else [tags])]))
            yield pd.DataFrame(rows, columns=["path", "meta", "body_start", "title", "tags"])

    return files.select("path", "content").mapInPandas(parse, "path string, meta string, body_start long, title string, tags array<string>")


def markdown_graph(files: DataFrame, size: int, overlap: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, blocks and deterministic claims (headings, tags, links) of the files, all with content-addressed ids."""
    meta = metadata(files)
    documents = meta.select(C.sha256_id(F.lit("document"), F.col("path")).alias("id"), "path", "title", "meta").join(files.select("path", "size", F.sha2("content", 256).alias("content_hash")), "path")
    blocks = ingest.blocks(files, size, overlap).withColumn("document_id", C.sha256_id(F.lit("document"), F.col("path")))
    texts = blocks.select("id", "content_hash", "document_id", "text")
    said = None
    for predicate, found, value in (("has_heading", ingest.headings(texts, "id"), "heading"), ("has_tag", ingest.tags(texts, "id"), "tag"), ("links_to", ingest.wikilinks(texts, "id"), "target")):
        part = found.select("id", F.lit(predicate).alias("p"), F.col(value).alias("o_literal")).distinct()
        said = part if said is None else said.unionByName(part)
    from_meta = meta.select("path", F.explode("tags").alias("o_literal")).join(blocks.where("block_index = 0").select("path", "id"), "path").select("id", F.lit("has_tag").alias("p"), "o_literal")
    rows = said.unionByName(from_meta).distinct().join(texts.drop("text"), "id")
    claim = C.sha256_id(F.col("content_hash"), F.col("document_id"), F.col("p"), F.col("o_literal"))
    claims = rows.select(claim.alias("id"), F.col("document_id").alias("s"), "p", F.lit(None).cast("string").alias("o_id"), "o_literal", F.lit(1.0).alias("confidence"), F.col("id").alias("block_id"))
    return documents, blocks, claims


def provenance_edges(claims: DataFrame, nodes: DataFrame, activity: str, agent: str) -> DataFrame:
    """``id, type, src, dst`` from each claim to its block, activity and agent, and to the ends that are nodes."""
    ends = F.array(
        *[F.struct(F.lit(t).alias("type"), c.alias("dst")) for t, c in (("prov:wasDerivedFrom", F.col("block_id")), ("prov:wasGeneratedBy", F.lit(activity)), ("prov:wasAttributedTo", F.lit(agent)))]
    )
    always = claims.select(F.col("id").alias("src"), F.explode(ends).alias("e")).select("src", "e.*")
    refs = F.array(F.struct(F.lit("rdf:subject").alias("type"), F.col("s").alias("dst")), F.struct(F.lit("rdf:object").alias("type"), F.col("o_id").alias("dst")))
    known = claims.select(F.col("id").alias("src"), F.explode(refs).alias("e")).select("src", "e.*").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = always.unionByName(known).where("dst IS NOT NULL").distinct()
    return both.select(C.edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", "src", "dst")
