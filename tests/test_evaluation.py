"""Nulls, ties, repeated rows, empty tables and extra columns in evaluation and adjudication."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import adjudicate, evaluation, quality


def test_entities_of_all_kinds(spark):
    truth = spark.createDataFrame([("a", "g", "Agent", "a", "A"), ("b", "g", "Agent", "a", "A"), ("c", "h", "Place", "c", "C"), ("d", "i", "Place", "d", "D")], "candidate_id string, cluster string, kind string, canonical string, title string")
    proposals = spark.createDataFrame([("a", "Agent", "A"), ("b", " ", "B"), ("c", "Place", None), ("d", "Place", "D")], "candidate_id string, kind string, title string")
    said = spark.createDataFrame([("a", None, " ", None), ("b", "Agent", "B!", "a"), ("c", "Concept", "C", "unheard of")], "candidate_id string, kind string, title string, target string")
    got = {r.candidate_id: tuple(r)[2:] for r in evaluation.entity_outcomes(truth, proposals, said).collect()}
    assert got == {"a": ("a", False, True, True, None, True), "b": ("a", False, True, True, True, True), "c": ("unheard of", False, False, False, None, False), "d": ("__missing__:d", True, False, False, None, False)}
    empty = evaluation.entity_outcomes(truth.limit(0), proposals, said)
    assert tuple(evaluation.entity_metrics(empty).first()) == (0, 0, None, None, None, None)
    assert quality.pairwise_clusters(evaluation.entity_outcomes(truth, proposals, said)).first().asDict() == {"false_merges": 0, "missed_merges": 0, "right_merges": 1}


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    diffs = spark.createDataFrame([(d,) for d in [1] * 30 + [0] * 50 + [-1] * 10 + [None] * 5], "d int")
    one, many = (evaluation.bootstrap_ci(diffs.repartition(n), "d", iters=300).first() for n in (1, 7))
    assert one == many and one.low < 20 / 90 < one.high
    assert tuple(evaluation.bootstrap_ci(diffs.limit(0), "d", iters=5).first()) == (0.0, 0.0)
    assert tuple(evaluation.bootstrap_ci(diffs.where("d = 1"), "d", iters=5).first()) == (1.0, 1.0)


def test_recall_layer_needs_every_sample(spark):
    good = {"schema_version": "recall_cost.v1", "measurement_status": None, "completion_free": True, **dict.fromkeys(evaluation.RECALL_COUNTS, 0), **dict.fromkeys(evaluation.RECALL_TIMES, 2.0), **dict.fromkeys(evaluation.RECALL_NAMES, "local")}
    schema = ", ".join(f"{k} {'boolean' if k == 'completion_free' else 'int' if k in evaluation.RECALL_COUNTS else 'double' if k in evaluation.RECALL_TIMES else 'string'}" for k in good)
    frame = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    whole = evaluation.recall_layer(frame(good, good)).first()
    assert (whole.status, whole.provided, whole.total_latency_ms_p95, whole.violations) == ("measured", 2, 2.0, 0)
    broken = evaluation.recall_layer(frame(good, good | {"retrieved_bytes": None})).first()
    assert (broken.status, broken.provided, broken.measured, broken.total_latency_ms_p50) == ("unmeasured", 2, 1, None)
    assert evaluation.recall_layer(frame(good).limit(0)).first().status == "unmeasured"


def test_gate_fails_closed(spark):
    checks = spark.createDataFrame([(c, "passed", None) for c in evaluation.REBUILD_CODES], "code string, status string, reason string")
    assert quality.rebuild_gate(evaluation.gate_checks(checks)).first().passed
    twice = checks.unionByName(checks.where("code = 'registered_predicates'"))
    assert quality.rebuild_gate(evaluation.gate_checks(twice)).first().failed == ["registered_predicates"]
    assert len(quality.rebuild_gate(evaluation.gate_checks(checks.limit(0))).first().failed) == len(evaluation.REBUILD_CODES)


def test_completed_runs(spark):
    columns = "seq int, run_id string, kind string, state string, quality string, receipts_complete boolean, receipts int, post_policy string, policy string, model string"
    run = lambda name, at, **over: [
        (at, name, "ingest_run", "started", None, None, None, None, "p", over.get("model", "m")),
        (at + 1, name, "commit_plan", None, None, None, None, None, None, None),
        (at + 2, name, "commit_record", None, None, True, over.get("receipts", 2), None, None, None),
        (at + 3, name, "ingest_run", over.get("state", "completed"), "complete", True, None, over.get("post", "p"), None, None),
    ]
    rows = run("late", 50) + run("good", 0) + run("other", 10, model="n") + run("failed", 20, state="failed") + run("changed", 30, post="q") + run("open", 40, receipts=None) + run("gone", 60) + [(70, "gone", "plan_abandoned", *[None] * 7), (80, None, "ingest_run", *[None] * 7)]
    records = spark.createDataFrame(rows, columns)
    assert [r.run_id for r in evaluation.completed_runs(records, {"policy": "p", "model": "m"}).orderBy("place").collect()] == ["good", "late"]
    assert evaluation.completed_runs(records, {"policy": "", "model": "m"}).collect() == []


def test_scope_ids_and_paths(spark):
    nodes = spark.createDataFrame([("a", "T", "d", "2020-01-02"), ("b", "U", "d", "2020-01-01"), ("c", "T", None, None)], "id string, type string, document_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(evaluation.scoped(nodes)) == ["a", "b", "c"]
    assert ids(evaluation.scoped(nodes, types=[])) == []
    assert ids(evaluation.scoped(nodes, ["T"], since="2020-01-02")) == ["a"]
    assert ids(evaluation.scoped(nodes, documents=nodes.select("document_id"))) == ["a", "b"]
    asked = spark.createDataFrame([("a",), ("a",), ("z",)], "id string")
    assert {(r.id, r.found) for r in evaluation.by_ids(nodes, asked).collect()} == {("a", True), ("z", False)}
    paths = spark.createDataFrame([("/x/src/a/src/b",), ("none",), (None,)], "p string")
    assert [r.p for r in paths.select(evaluation.relocated_path(F.col("p"), "/src", "/new").alias("p")).collect()] == ["/new/a/src/b", "none", None]


def test_competing_names_under_one_common_token(spark):
    pool = spark.createDataFrame([("T", f"Ann {i % 50:02d}") for i in range(500)] + [("T", "Ann"), ("T", None), ("U", "Ann Zoe")], "type string, title string")
    pairs = spark.createDataFrame([("T", "Ann", "ann x"), ("V", "Ann", "Ann Q"), ("T", "Bob", "Ann"), ("T", None, None)], "type string, a_title string, b_title string")
    got = {r.type: r.names for r in evaluation.competing_names(pairs, pool).collect()}
    assert got == {"T": ["Ann 00", "Ann 01", "Ann 02"], "V": []}


def test_verdicts_keep_no_pair_that_was_held_apart(spark):
    members = spark.createDataFrame([(1, x) for x in "abcde"] + [(2, "f"), (2, "g"), (3, "h")], "cluster_id int, id string")
    heads = spark.createDataFrame([(1, "a"), (2, "f"), (3, "h")], "cluster_id int, canonical string")
    judged = spark.createDataFrame([(1, "b", True, 0.9), (1, "c", True, 0.95), (1, "d", True, 0.8), (1, "e", True, 0.99), (2, "g", True, 0.79)], "cluster_id int, id string, same boolean, confidence double")
    apart = spark.createDataFrame([("c", "b"), ("c", "d"), ("e", "a"), ("b", "g")], "a string, b string")
    got = {r.cluster_id: tuple(r)[1:] for r in adjudicate.cluster_verdicts(members, heads, judged, apart).collect()}
    assert got == {1: (True, 0.8, "a", ["a", "b", "d"]), 2: (False, 0.0, None, ["f", "g"]), 3: (False, 0.0, None, ["h"])}


@pytest.mark.parametrize(("answer", "want"), [(None, False), ("", False), ("NO RECORD of it", True), ("It doesn't  really\nsay.", True), ("They do not in any way say", False), ("doing nothing, it states", False)])
def test_abstains(spark, answer, want):
    assert spark.createDataFrame([(answer,)], "a string").select(adjudicate.abstains(F.col("a")).alias("x")).first().x is want


def test_registry_keeps_every_canonical_line(spark):
    rows = spark.createDataFrame([(f"c{i}", "canonical", "out", 0, "d") for i in range(3)] + [(f"p{i}", None, "out", i, "d") for i in range(4)], "label string, lifecycle string, direction string, support int, definition string")
    lines = lambda cap: [(r.line.split(" ")[0], r.dropped) for r in adjudicate.registry_lines(rows, cap).orderBy("place").collect()]
    assert lines(2) == [("c0", 4), ("c1", 4), ("c2", 4)]
    assert lines(4) == [("c0", 3), ("c1", 3), ("c2", 3), ("p3", 3)]
    assert len(lines(100)) == 7 and lines(100)[0][1] == 0
    assert adjudicate.registry_lines(rows.limit(0)).collect() == []


def test_manifests_detachments_and_superseders(spark):
    old, new = (spark.createDataFrame(r, "path string, digest string") for r in ([("a", "1"), ("b", "1")], [("a", "2"), ("b", "2"), ("c", "2")]))
    wait = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "path string")
    assert sorted(map(tuple, adjudicate.persistable_manifest(old, new, wait).collect())) == [("a", "2"), ("b", "1")]
    claims = spark.createDataFrame([("k", "s", "p", None, "l")], "id string, s string, p string, o_id string, o_literal string")
    gone = spark.createDataFrame([("k", "f"), ("k", "f"), ("unknown", "f")], "id string, source_path string")
    (line,) = adjudicate.detachment_lines(claims, gone, "2026").collect()
    assert json.loads(line.line)["O_id"] is None and list(json.loads(line.line)) == sorted(json.loads(line.line))
    edges = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("z", "c")], "src string, dst string")
    states = spark.createDataFrame([("x", True, None), ("y", None, None)], "id string, superseded boolean, detached boolean")
    assert {(r.id, r.stale) for r in adjudicate.superseders_stale(edges, states).collect()} == {("a", False), ("b", True), ("c", True)}


def test_labels(spark):
    rows = spark.createDataFrame([("i", "pref", "EN", "x"), ("i", "alt", "en", "x"), ("i", "alt", "de", "y"), ("i", "alt", "DE", "y"), ("i", "pref", None, "z"), ("i", "pref", "fr", None)], "id string, field string, lang string, label string")
    assert sorted(r.code for r in evaluation.label_issues(rows).collect()) == ["label_duplicate_in_lang", "label_empty", "label_pref_alt_overlap", "lang_invalid_bcp47"]
    assert evaluation.label_issues(rows.limit(0)).collect() == []
