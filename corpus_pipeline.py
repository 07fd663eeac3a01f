"""The corpus pipeline: documents in, a deduplicated, decontaminated and mixed corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet to the shared
folder and read again as the next stage's ``docs``, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.line_dedup import line_dedup
from quillgraph.llm.mixing import mix
from quillgraph.llm.near_dedup import near_duplicates
from quillgraph.llm.quality import fit_quality, quality_scores
from quillgraph.runtime import expose_package, materialise

#: Of the table documents; all stages but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    expose_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(docs.select(*COLUMNS), fit_quality(docs, labels))
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more share; the count of characters follows the new text."""
    expose_package(spark)
    kept = line_dedup(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more."""
    expose_package(spark)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(materialise(kept, "kept-ids"), F.col("doc_id").eqNullSafe(F.col("__id"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    expose_package(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = materialise(found.select(F.col("doc_id").alias("__id")).distinct(), "contaminated-ids")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their text, their source's target and the words taken of them."""
    expose_package(spark)
    return mix(docs.select(*COLUMNS), keep_columns=True).where("taken > 0")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{place}")
    return docs


#: The stages hold a trained classifier, MinHash and a seeded choice, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None
