"""Gates, lookups and vector retrieval on small frames, and those without SQL against plain Python."""

import hashlib
import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.operators import consolidate, gates, graph, incremental, lookups, quality, retrieve


def test_vector_leg_weighs_before_it_ranks(spark):
    corpus = spark.createDataFrame([("tag", [1.0, 0.0], "tag", "x"), ("real", [0.994, 0.109], "says", "y"), ("zero", [0.0, 0.0], "says", "z"), ("none", None, "says", "z"), ("long", [1.0, 0.0, 1.0], "says", "z")], "id string, embedding array<double>, p string, title string")
    asks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, embedding array<double>")
    weighted = corpus.withColumn("w", C.quality_weight(F.col("p"), F.col("title")))
    got = [(r["id"], r["rank"]) for r in retrieve.vector(weighted, asks, None).orderBy("rank").collect()]
    assert got == [("real", 1), ("tag", 2)]
    assert retrieve.vector(corpus.limit(0), asks).collect() == [] and retrieve.vector(corpus, asks.limit(0)).collect() == []


@pytest.mark.parametrize(("k", "part"), [(3, 32_000_000), (3, 100), (None, 100)])
def test_vector_against_all_pairs(spark, monkeypatch, k, part):
    monkeypatch.setattr(retrieve, "VECTOR_BYTES", part)
    rng = random.Random(1)
    # few different vectors: ties at the cut are the rule
    rows = [(f"n{i}", [float(rng.randrange(3)) for _ in range(3)], rng.choice("ab")) for i in range(60)]
    asks = [(i, [float(rng.randrange(1, 3)) for _ in range(3)], "a") for i in range(9)]
    for same in (False, True):
        got = retrieve.vector(spark.createDataFrame(rows, "id string, embedding array<double>, type string").repartition(4), spark.createDataFrame(asks, "query_id bigint, embedding array<double>, type string"), k, same_type=same)
        want = set()
        for q, v, kind in asks:
            scored = sorted((-round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 9), node) for node, e, t in rows if any(e) and (not same or t == kind))
            want |= {(q, node, rank) for rank, (_, node) in enumerate([x for x in scored if x[0] < 0][:k], 1)}
        assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == want


def test_recall_leaves_out_what_the_gates_hold(spark):
    rows = [("a", "Claim", "alpha beta", "alpha beta gamma", None, [1.0, 0.0], False, False), ("b", "Claim", "alpha beta", "alpha beta gamma", None, [1.0, 0.0], True, False), ("c", "Claim", "alpha beta", "alpha beta gamma", None, [1.0, 0.0], False, True), ("d", "Block", "alpha beta", "alpha", None, [1.0, 0.0], None, None), (gates.SYSTEM_IDS[0], "Agent", "alpha beta", "alpha", None, [1.0, 0.0], None, None)]
    corpus = spark.createDataFrame(rows, "id string, type string, title string, content string, p string, embedding array<double>, infra boolean, superseded boolean")
    asks = spark.createDataFrame([(1, "what is alpha beta?", [1.0, 0.0])], "query_id bigint, text string, embedding array<double>")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r["id"] for r in retrieve.hybrid_recall(corpus, asks, edges).collect()] == ["a"]
    assert [r["id"] for r in retrieve.hybrid_recall(corpus.drop("infra", "superseded"), asks, edges).orderBy("id").collect()] == ["a", "b", "c"]


def test_allowed_predicates(spark):
    row = spark.createDataFrame([("Lives_In",), ("lives in",), ("has",), (None,)], "p string")
    verdicts = lambda allowed: [r[0] for r in row.select(gates.predicate_allowed(F.col("p"), allowed)).collect()]
    assert verdicts(None) == verdicts([]) == verdicts([" "]) == [True] * 4
    assert verdicts(["Lives in"]) == [True, True, False, False]


def test_ties_by_likeness(spark):
    claims = spark.createDataFrame([(f"c{i}", "s", "says", None, "x", 0.5) for i in range(4)], "id string, s string, p string, o_id string, o_literal string, confidence double")
    seeds = spark.createDataFrame([("s",)], "seed string")
    terms, near = spark.createDataFrame([], "seed string, term string"), spark.createDataFrame([("s", "c3", 0.9), ("s", "c1", 0.2)], "seed string, id string, cosine double")
    assert [r["id"] for r in graph.bridge_claims(claims, seeds, terms, 3, similarity=near).orderBy("rank").collect()] == ["c3", "c1", "c0"]


def test_superseded_claims_are_not_counted(spark):
    claims = spark.createDataFrame([("1", "a", "knows", "b", True), ("2", "a", "knows", "c", False)], "id string, s string, p string, o_id string, superseded boolean")
    edges = spark.createDataFrame([("a", "knows", "b")], "src string, type string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = quality.relation_layer(claims, edges, nodes).first()
    assert (got["relation_claims"], got["claims_without_edge"], got["edges_without_claim"], got["isolated"]) == (1, 1, 0, 1)


def test_untitled_candidates_never_fold(spark):
    nodes = spark.createDataFrame([(1, "a", "Agent", "", 0), (2, "b", "Agent", "", 0), (3, "c", "Agent", "   ", 0), (4, "d", "Agent", "Straße", 0), (5, "e", "Agent", "STRASSE", 0), (6, "f", "Agent", None, 0)], "seq int, id string, type string, title string, score int")
    edges = spark.createDataFrame([], "id string, type string, src string, dst string, block_id string")
    into, _ = consolidate.collapse_duplicates(nodes, edges)
    assert {r["id"]: r["survivor"] for r in into.collect()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "d", "f": "f"}
    tags = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["z", "x"]), (3, "c", ["w"])], "seq int, id string, tags array<string>")
    over = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "c")], "id string, survivor string")
    assert {r["survivor"]: r["tags"] for r in consolidate.folded_tags(tags, over).collect()} == {"b": ["z", "x", "y"], "c": ["w"]}


def test_surface_keys(spark):
    texts = ["Straße", "STRASSE", "e\u0301", "\u00c9", "  A  b ", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(udfs.surface_key(F.col("t"))).collect()]
    assert got == [udfs.exact_key(t) for t in texts] and got[0] == got[1] and got[2] == got[3]


def test_supersedence_against_all_pairs(spark):
    rng = random.Random(3)
    claim = lambda i: (f"{i:03}", rng.choice("ab"), rng.choice("pq"), rng.choice("xyz"))
    old, new = [claim(i) for i in range(40)], [claim(100 + i) for i in range(9)]
    kind = "id string, s string, p string, o string"
    got = incremental.superseded(spark.createDataFrame([(*c, None) for c in old], f"{kind}, valid_until date"), spark.createDataFrame(new, kind), "2026-01-01")
    want = {c[0]: min((n[0] for n in new if n[1:3] == c[1:3] and n[3] != c[3]), default=None) for c in old}
    assert {r["id"]: r["superseded_by"] for r in got.collect()} == want
    assert all((r["valid_until"] is None) == (r["superseded_by"] is None) for r in got.collect())


def test_digests(spark):
    nodes = [("b", "Claim", "T é", "c", ["x"], "says", [1.0, 2.5]), ("a", "Agent", None, "", None, None, None)]
    got = {r["id"]: r["digest"] for r in lookups.node_digests(spark.createDataFrame(nodes, "id string, type string, title string, content string, tags array<string>, p string, embedding array<double>")).collect()}
    for n in nodes:
        raw = json.dumps([*n[:4], n[4] or [], n[5]], separators=(",", ":"), ensure_ascii=False).encode()
        raw += b"\x00" if n[6] is None else b"\x01" + struct.pack("<2d", *n[6])
        assert got[n[0]] == hashlib.sha256(raw).hexdigest()
    stamp = lookups.generation(spark.createDataFrame(list(got.items()), "id string, digest string"), buckets=1).first()
    assert stamp["digest"] == hashlib.sha256((got["a"] + got["b"]).encode()).hexdigest() and stamp["n"] == 2


@pytest.mark.parametrize(("a", "b", "want"), [("Saulo", "Saulo Lima", 1.0), ("Acme Inc", "Acme", 1.0), ("Acme", "acme", None), ("", "x", None), ("Jonathan Smithe", "Jonathan Smyth", "near"), ("Ann Lee", "Bob Lee", 1.0), ("Karl", "Otto", None)])
def test_alias_scores(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(lookups.alias_score(F.col("a"), F.col("b"))).first()[0]
    assert got == want if want != "near" else 0.9 <= got < 1
