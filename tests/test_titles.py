"""Titles, reference tokens and plan hashes on odd texts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C


def values(spark, rows, kind, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kind}").orderBy("i").select(column.alias("x")).collect()]


def test_canonical_title(spark):
    rows = [("Concept", " The  Green \t Tea "), ("Agent", "The  Casey"), ("Concept", "a / b/ "), ("Concept", "/"), ("Concept", "//"), ("Concept", "the"), ("Concept", "THE end"), ("Concept", "Theory"), (None, "The x"), ("Concept", None), ("Concept", ""), ("Concept", "EPICS"), ("Concept", "tea  　pot"), ("Place", "x" * 100_000 + "  /")]
    got = values(spark, rows, "k string, t string", C.canonical_title(F.col("k"), F.col("t")))
    assert got == ["Green Tea", "The Casey", "a/b", "/", "//", "the", "end", "Theory", "The x", "", "", "EPICS", "tea pot", "x" * 100_000]
    assert values(spark, [("Concept", "Epics"), ("Concept", "the Stories"), ("Agent", "tasks")], "k string, t string", C.canonical_title(F.col("k"), F.col("t"), C.PACK_TITLES)) == ["Epic", "Story", "tasks"]


def test_document_title(spark):
    rows = [
        ("Given", "/v/a.md", "/v"), (None, "/v/a/b.c.md", "/v"), ("", "/v/a/README", "/v/"), (None, "/other/b.md", "/v"), (None, "/vault/x.md", "/v"), (None, "/v/.hidden", "/v"), (None, "/v/copies/0123456789abcdef/n/s.md", "/v"),
        (None, "/v/copies/n/s.md", "/v"), (None, "/v/copies/0123456789abcdef", "/v"), (None, None, "/v"), (None, "/v/", "/v"),
    ]
    got = values(spark, rows, "e string, p string, r string", C.document_title(F.col("e"), F.col("p"), F.col("r"), "copies"))
    assert got == ["Given", "a/b.c", "a/README", "b", "x", ".hidden", "n/s", "n/s", "0123456789abcdef", None, "v"]


def test_reference_tokens(spark):
    rows = [("i", "c-1", None, "/v/a/b.md", "/v"), ("i", "i", "", None, "/v"), (None, None, None, "b.md", "/v")]
    got = values(spark, rows, "i2 string, a string, b string, p string, r string", C.reference_tokens(F.col("i2"), [F.col("a"), F.col("b")], F.col("p"), F.col("r")))
    assert got == [["i", "c-1", "b.md", "/v/a/b.md", "a/b.md"], ["i"], ["b.md"]]


@pytest.mark.parametrize("operations", [[], [{"a": 1, "op": 'say "x"'}, {"op": "y"}]])
def test_plan_hash(spark, operations):
    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    want = "sha256:" + hashlib.sha256(canon({"run_id": 'r"1', "plan_id": "[p]", "operations": operations, "context": {"k": None}}).encode()).hexdigest()
    got = values(spark, [('r"1', "[p]", [canon(o) for o in operations], canon({"k": None}))], "r string, p string, o array<string>, c string", C.plan_hash(F.col("r"), F.col("p"), F.col("o"), F.col("c")))
    assert got == [want]
