"""Framing of large JSON-lines files, read in ranges: where each line lies, and whether the file is whole.

Ranges of a file are read in parallel; each starts at the first line end after its own start and reads the line that runs over its
end, so no byte is read twice. A line's place follows from the bytes of the lines before it: within its range by
a running sum, across ranges by their totals. That the ranges leave no gap is checked: each must begin between its own start
and end where the lines of the ranges before it end, and together they must be as long as the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Versions of records that are understood. Fixed values.
LEDGER_VERSIONS = (1, 2)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, start, length, raw, file_size, gap``: every line of the files at ``path``, numbered from 1, with its first byte, its bytes and their number without the line end.

    ``gap`` tells lines of a range that doesn't begin where the one before it ended. Lines end at LF alone; a CR before
    it is the line's own. Ranges are as long as ``spark.sql.files.maxPartitionBytes`` says, and the result is the same for any.
    """
    found = spark.read.option("lineSep", "\n").text(path)
    lines = found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("span"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))
    # the line end is the line's, also where the last line has none: the file's size tells that
    lines = lines.withColumn("length", F.octet_length("raw").cast("long"))
    ranges = lines.groupBy("file", "block").agg(F.sum(F.col("length") + 1).alias("bytes"), F.count("*").alias("lines"), F.first("span").alias("span"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ranges = ranges.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start0"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("line0"), "span")
    ranges = ranges.withColumn("gap", F.when(F.col("block") == 0, F.col("start0") != 0).otherwise((F.col("start0") <= F.col("block")) | (F.col("start0") > F.col("block") + F.col("span"))))
    within = Window.partitionBy("file", "block").orderBy("at")
    placed = lines.withColumn("n", F.row_number().over(within)).withColumn("sofar", F.sum(F.col("length") + 1).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.drop("span").join(ranges, ["file", "block"])
    return placed.select("file", (F.col("line0") + F.col("n")).alias("line"), (F.col("start0") + F.col("sofar") - F.col("length") - 1).alias("start"), "length", "raw", "file_size", "gap")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` without ``raw``, with ``fault`` (null, ``invalid_utf8``, ``invalid_json`` or ``record_not_object``), ``blank``, ``kind``, ``version`` (an integer, else null) and ``json``."""
    kept = ["file", "line", "start", "length", "file_size", "gap"]

    def look(raw: bytes) -> tuple:
        if not raw.strip():
            return None, True, None, None, None
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            return "invalid_utf8", False, None, None, None
        try:
            record = json.loads(text)
        except ValueError:
            return "invalid_json", False, None, None, None
        if not isinstance(record, dict):
            return "record_not_object", False, None, None, None
        version, kind = record.get("ledger_version"), record.get("kind")
        whole = isinstance(version, int) and not isinstance(version, bool) and abs(version) < 2**63
        return None, False, kind if isinstance(kind, str) else None, version if whole else None, text

    types = (("fault", pa.string()), ("blank", pa.bool_()), ("kind", pa.string()), ("version", pa.int64()), ("json", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [look(x.as_py()) for x in batch.column("raw")]
            more = [pa.array([s[i] for s in seen], kind) for i, (_, kind) in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], names=[*kept, *(n for n, _ in types)])

    return lines.select(*kept, "raw").mapInArrow(run, "file string, line long, start long, length long, file_size long, gap boolean, fault string, blank boolean, kind string, version long, json string")


def framing(parsed: DataFrame, versions: Sequence[int] = LEDGER_VERSIONS) -> DataFrame:
    """One row for each file: its lines and faults, and whether it is complete.

    ``torn`` is a last line without a line end that isn't a record: an append that was cut off. ``contiguous`` tells
    that the lines cover the file byte for byte. Records of other versions, or without one, leave a file
    incomplete, as malformed lines do. Blank lines count as lines only. An empty file has no row.
    """
    known = F.coalesce(F.col("version").isin(*versions), F.lit(False))
    record = ~F.col("blank") & F.col("fault").isNull()
    n = lambda c: F.count_if(c)
    out = parsed.groupBy("file").agg(
        F.first("file_size").alias("file_size"), F.count("*").alias("lines"), n(~F.col("blank")).alias("nonempty_lines"), n(record).alias("records"), n(F.col("fault").isNotNull()).alias("malformed"),
        *(n(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("invalid_utf8", "invalid_json", "record_not_object")),
        n(record & ~known).alias("unknown_versions"), F.max(F.col("start") + F.col("length")).alias("end"), F.max_by(F.col("fault").isNotNull(), "line").alias("last_bad"), F.max("gap").alias("gap"), F.min(F.when(F.col("fault").isNotNull(), F.col("start"))).alias("first_malformed_at"),
    )
    open_end = F.col("end") == F.col("file_size")
    out = out.withColumn("unterminated", open_end).withColumn("torn", open_end & F.col("last_bad")).withColumn("contiguous", ~F.col("gap") & (F.col("end") - F.col("file_size")).isin(-1, 0))
    reasons = F.array_compact(F.array(F.when(~F.col("contiguous"), "ranges_with_gaps"), F.when(F.col("malformed") > 0, "malformed_ledger_lines"), F.when(F.col("torn"), "trailing_partial_record"), F.when(F.col("unknown_versions") > 0, "unrecognized_ledger_versions")))
    reason = F.when(F.size(reasons) > 0, F.array_join(reasons, "+")).when(F.col("nonempty_lines") > 0, "all_nonempty_lines_parsed").otherwise("empty_ledger")
    return out.withColumn("complete", F.size(reasons) == 0).withColumn("reason", reason).drop("end", "last_bad", "gap")


def malformed_samples(parsed: DataFrame, limit: int = 20) -> DataFrame:
    """``file, line, start, fault`` of the first malformed lines of each file."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    return parsed.where("fault IS NOT NULL").withColumn("n", place).where(F.col("n") <= limit).select("file", "line", "start", "fault")
