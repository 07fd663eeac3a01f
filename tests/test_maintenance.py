import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import consolidate, extraction, incremental
from quillgraph.sources import packs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_collapse_keeps_joined_apart(spark):
    nodes = [(1, "a", "Agent", "Casey Lee", 0), (2, "b", "Agent", "casey  lee", 9), (3, "c", "Agent", "Riley", 0), (4, "d", "Agent", "riley", 0), (5, "e", "Agent", "RILEY", 0)]
    edges = [("e1", "knows", "c", "d", "k"), ("e2", "in", "a", "z", "k"), ("e3", "in", "b", "z", "k"), ("e4", "same", "a", "b", "k")]
    into, moved = consolidate.collapse_duplicates(spark.createDataFrame(nodes, "seq int, id string, type string, title string, score int"), spark.createDataFrame(edges[:3], "id string, type string, src string, dst string, block_id string"))
    assert {r["id"]: r["survivor"] for r in into.collect()} == {"a": "b", "b": "b", "c": "c", "d": "d", "e": "c"}
    assert {(r["type"], r["src"], r["dst"]) for r in moved.collect()} == {("knows", "c", "d"), ("in", "b", "z")}
    into, _ = consolidate.collapse_duplicates(spark.createDataFrame(nodes, "seq int, id string, type string, title string, score int"), spark.createDataFrame(edges, "id string, type string, src string, dst string, block_id string"))
    assert {r["id"]: r["survivor"] for r in into.collect()}["a"] == "a"


def test_grounding(spark):
    got = one(spark, consolidate.grounding_score(F.lit("Casey Lee"), F.lit("met Casey"), F.lit("Then Casey Lee met us")))
    assert got == 50 + 10 + 2


def test_evidence(spark):
    pairs = spark.createDataFrame([("a", "b", "Casey Lee", "Dr Casey Lee"), ("a", "c", "Casey Lee", "Other"), ("a", "d", "Casey Lee", "Casey")], "a string, b string, ta string, tb string")
    jaccard = spark.createDataFrame([("a", "c", 0.3)], "a string, b string, jaccard double")
    vetoes = spark.createDataFrame([("d", "a")], "src string, dst string")
    got = {r["b"]: (r["evidence"], r["corroborated"]) for r in consolidate.evidence(pairs, jaccard, vetoes, F.lit(False)).collect()}
    assert got == {"b": (["identity"], True), "c": (["relational"], True), "d": (["identity", "negative"], False)}


def test_prefilters(spark):
    assert one(spark, consolidate.is_trivial(F.lit("One line."), F.lit(1), 2, 40)) and not one(spark, consolidate.is_trivial(F.lit("One. Two."), F.lit(1), 2, 40))
    assert one(spark, consolidate.is_re_mention(F.lit("Casey  LEE!"), [F.lit("casey lee")])) and not one(spark, consolidate.is_re_mention(F.lit("x"), [F.lit("y")]))
    assert one(spark, consolidate.demoted(F.lit("Says"), F.lit("tells"), ("says",))) == "raw" and one(spark, consolidate.demoted(F.lit("a"), F.lit("b"), ())) is None
    items = spark.createDataFrame([(i, "b1" if i < 5 else None) for i in range(7)], "seq int, block_id string")
    sizes = sorted(r["count"] for r in consolidate.batches(items, 2).groupBy("batch").count().collect())
    assert sizes == [1, 1, 1, 2, 2]


def test_judged_takes_the_first_accepted(spark):
    kind = "id string, type string, title string, embedding array<double>"
    cand = spark.createDataFrame([("c1", "Agent", "Casey Lee", [1.0, 0.0]), ("c2", "Agent", "Nobody", [0.0, 1.0])], kind)
    stored = spark.createDataFrame([("n1", "Agent", "Casey L", [0.99, 0.1]), ("n2", "Agent", "Dr Lee", [0.0, -1.0]), ("n3", "Place", "Lee", [1.0, 0.0])], kind)
    got = consolidate.judged(cand, stored, F.col("n_title") != "Casey L").collect()
    assert [(r["candidate_id"], r["node_id"]) for r in got] == [("c1", "n2")]


def test_judged_sees_all_lanes_of_names(spark):
    kind = "id string, type string, title string, embedding array<double>"
    titles = {"c1": "Saulo", "c2": "Acme Works Ltd", "c3": "Northern Ligths", "c4": "Casey Lee", "c5": "Ana Reed", "c6": "Jos\u00e9"}
    cand = spark.createDataFrame([(i, "Agent", t, [1.0, 0.0]) for i, t in titles.items()], kind)
    names = {"n1": "Saulo Lima", "n2": "Acme Works", "n3": "Northern Lights", "n4": "Dr Casey Lee Jr", "n9": "Jose"}
    rows = [(i, "Agent", t, [0.0, 1.0]) for i, t in names.items()]
    # three in the vector band and four by surname alone come before the right one
    rows += [(f"m{i}", "Agent", "Rita Reed", [1.0, 0.0]) for i in range(3)] + [(f"o{i}", "Agent", f"X{i} Reed", [0.0, 1.0]) for i in range(5)]
    got = consolidate.judged(cand, spark.createDataFrame(rows, kind), F.col("n_id").isin("n1", "n2", "n3", "n4", "n9", "o4")).collect()
    assert {r["candidate_id"]: r["node_id"] for r in got} == {"c1": "n1", "c2": "n2", "c3": "n3", "c4": "n4", "c5": "o4", "c6": "n9"}
    scores = {(r["c_id"], r["n_id"]): round(r["score"], 4) for r in consolidate.lexical_aliases(cand, spark.createDataFrame(rows, kind)).collect()}
    assert scores["c1", "n1"] == scores["c2", "n2"] == scores["c6", "n9"] == 1.0 and 0.9 <= scores["c3", "n3"] < 1 and ("c1", "n2") not in scores


def test_type_corrections(spark):
    chains = spark.createDataFrame([(1, "a", "Agent", "Place"), (2, "a", "Place", "Concept"), (1, "b", "Concept", "Place")], "seq int, id string, previous string, corrected string")
    current = spark.createDataFrame([("a", "Agent"), ("b", "Agent"), ("c", "Agent")], "id string, type string")
    got = {r["id"]: (r["type"], r["broken"]) for r in consolidate.corrected_types(chains, current).collect()}
    assert got == {"a": ("Concept", False), "b": ("Agent", True), "c": ("Agent", False)}


def test_authority_records(spark):
    members = spark.createDataFrame([("k", "b"), ("k", "a")], "cluster_id string, id string")
    got = consolidate.authority_records(members, spark.createDataFrame([("k", "b")], "cluster_id string, canonical_id string")).first()
    assert got["member_ids"] == ["a", "b"] and got["pairs"] == [["b", "a"]] and len(got["cluster_id"]) == 16


def test_rewrapping_removes_nothing(spark):
    orphans = spark.createDataFrame([("k", "p", "The port is 8080.\nIt listens on all\ninterfaces.\n\n# Head")], "block_id string, path string, text string")
    current = spark.createDataFrame([("p", "# Head\n\nIt listens on all interfaces.")], "path string, text string")
    diffs = incremental.orphan_diffs(orphans, current)
    assert {(r["unit"], r["survived"]) for r in diffs.collect()} == {("The port is 8080.", False), ("It listens on all interfaces.", True), ("# Head", True)}
    claims = spark.createDataFrame([("c1", "k", "8080"), ("c2", "k", "all interfaces"), ("c3", "k", None)], "id string, block_id string, o_literal string")
    assert [r["id"] for r in incremental.detached_claims(claims, diffs).collect()] == ["c1"]


def test_validity(spark):
    kind = "id string, s string, p string, o string, valid_as_of date, valid_until date"
    claims = spark.createDataFrame([("c1", "s", "p", "1", None, None), ("c2", "s", "q", "1", None, None)], kind)
    new = spark.createDataFrame([("n1", "s", "p", "2")], "id string, s string, p string, o string")
    out = incremental.superseded(claims, new, "2026-01-02")
    assert {r["id"]: (r["superseded_by"], r["valid_until"]) for r in out.collect()} == {"c1": ("n1", datetime.date(2026, 1, 2)), "c2": (None, None)}
    day = lambda d: {r["id"] for r in incremental.valid_at(out, F.lit(d).cast("date")).collect()}
    assert day("2026-01-01") == {"c1", "c2"} and day("2026-01-02") == {"c2"}
    ended = out.select("id", F.lit("p").alias("path"), F.lit("port 1").alias("o_literal"), "valid_until")
    back = incremental.resurrected(ended, spark.createDataFrame([("p", "The Port 1 is open.")], "path string, unit string"))
    assert all(r["valid_until"] is None for r in back.collect())


def test_retired(spark):
    stored = spark.createDataFrame([("a", "d1", None), ("b", "d1", None), ("c", "d2", None)], "id string, document_id string, valid_until date")
    got = incremental.retired(stored, spark.createDataFrame([("a", "d1")], "id string, document_id string"), "2026-01-01")
    assert {r["id"]: r["valid_until"] is not None for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_hunks(spark):
    new = "one\nTWO é\nthree\nfour\n".encode()
    got = incremental.hunks(spark.createDataFrame([("k", "one\ntwo\nthree", bytearray(new), 10)], "block_id string, old string, new binary, byte_start long")).collect()
    assert [(r["text"], new[r["byte_start"] - 10 : r["byte_end"] - 10].decode()) for r in got] == [("TWO é", "TWO é\n"), ("four", "four\n")]


def test_extraction(spark):
    reply = 'Sure: {"nodes": [{"type": "Agent", "title": "Casey"}, {"type": "Agent", "title": "v1"}, {"type": "Odd", "title": "X"}], "claims": [{"subject": "Casey", "predicate": "knows", "object": "Lee"}, {"subject": "Casey", "predicate": "tag", "object": "9"}]} and {"a": "}"} {broken'
    objects = extraction.embedded_objects(spark.createDataFrame([(1, reply), (2, None)], "reply_id long, text string"))
    assert objects.count() == 2
    nodes, claims = extraction.candidates(objects)
    assert [r["title"] for r in nodes.collect()] == ["Casey"] and [r["predicate"] for r in claims.collect()] == ["knows"]


def test_batch_verdicts(spark):
    replies = spark.createDataFrame([("x", '[{"id": "1", "verdict": "commit"}, {"id": "2", "verdict": "queue"}]'), ("y", '[{"id": "3", "verdict": "commit"}, {"id": "9", "verdict": "commit"}]'), ("z", "no")], "batch string, text string")
    expected = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3"), ("z", "4")], "batch string, item_id string")
    got = {r["item_id"]: (r["verdict"], r["valid"]) for r in extraction.batch_verdicts(replies, expected).collect()}
    assert got == {"1": ("commit", True), "2": ("queue", True), "3": (None, False), "4": (None, False)}


def test_packs(spark):
    files = {"base": "id: base\nversion: 1.0.0\ntypes: [A, B]", "more": "id: more\nversion: 1.0.0\nimports: [base]\ntypes: [B, C]", "loop": "id: loop\nversion: 1.0.0\nimports: [loop]"}
    found = packs.load("more", files.__getitem__)
    assert packs.type_table(spark, found).count() == 4 and packs.resolve_type(found, "C") == "more:C" and packs.resolve_type(found, "B", "base") == "base:B"
    for bad in (lambda: packs.resolve_type(found, "B"), lambda: packs.load("loop", files.__getitem__), lambda: packs.parse_manifest("id: x\nid: y\nversion: 1.0.0"), lambda: packs.parse_manifest("[]"), lambda: packs.parse_manifest("id: x\nversion: one")):
        with pytest.raises(packs.PackError):
            bad()


def test_more_columns(spark):
    lit = F.lit
    assert [one(spark, C.safe_path(lit(p))) for p in ("a/b.md", "/a", "C:/a", "a/../b", "a\\b", None)] == [True, False, False, False, False, False]
    assert [one(spark, C.bcp47(lit(t))) for t in ("PT-latn-br", "en", "x", "es-419")] == ["pt-Latn-BR", "en", None, "es-419"]
    ids = {one(spark, C.semantic_claim_id(lit("s"), lit("p"), lit(None), lit(k), lit(v))) for k, v in (("str", "1"), ("int", "1"), ("float", "1.0"), ("bool", "true"))}
    assert len(ids) == 4
    assert one(spark, C.literal_identity(lit("str"), lit('a"b'))) == 'literal:str:"a\\"b"'
    assert one(spark, C.surface_flags(lit("a_b’s – c  d"))) == ["whitespace_normalized", "underscore_separator", "apostrophe_variant", "dash_variant"]
    assert one(spark, C.contains_all(lit("The Answer is 42"), F.array(lit("answer"), lit("42"))))
    assert one(spark, C.within_span(lit(1), lit(2), lit(0), lit(2))) and not one(spark, C.within_span(lit(1), lit(3), lit(0), lit(2)))


def test_sentence_diffs_take_every_document(spark):
    from quillgraph.plans import maintenance
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.trim("text") != "")
    got = maintenance.sentence_diffs(spark, SF)
    assert got.select("block_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert {r["survived"] for r in got.select("survived").distinct().collect()} == {True, False}
