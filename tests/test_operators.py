import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.functions import udfs
from quillgraph.operators import detect, graph, ingest, integrity, ledger, predicates, quality, resolve, retrieve
from quillgraph.operators.components import connected_components
from quillgraph.runtime import materialise
from quillgraph.sources.tables import edges as edges_of
from tests.conftest import SF


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é\n#", max_size=12), max_size=12).map("\n".join), st.integers(1, 30))
def test_windows_rebuild_the_body(text, size):
    body = text.encode()
    spans = ingest.windows(body, size)
    at = 0
    for a, b in spans:
        assert body[at:a].strip() == b"" and a < b
        assert body[b - 1 : b] == b"\n" or b == len(body)
        assert b - a <= size or body[a:b].count(b"\n") <= 1 or body[a : b - 1].find(b"\n") < 0
        at = b
    assert body[at:].strip() == b""


def test_windows_overlap():
    body = b"aaaa\nbbbb\ncccc\ndddd\n"
    assert ingest.windows(body, 10, 5) == [(0, 10), (5, 15), (10, 20)]


def test_front_matter():
    assert ingest.front_matter(b"---\ntitle: X\n---\nbody") == ({"title": "X"}, 17)
    assert ingest.front_matter(b"no") == ({}, 0)
    assert ingest.front_matter(b"---\n: [\n---\nx") == ({}, 0)


def test_headings_leave_code_out(spark):
    text = "# A #\n```\n# no\n```\n### B\ntext"
    found = ingest.headings(spark.createDataFrame([(1, text)], "k int, text string"), "k").collect()
    assert [(r["pos"], r["heading"]) for r in found] == [(1, "A"), (5, "B")]


def test_headings_query_is_its_sql_on_odd_lines(spark, tmp_path):
    import duckdb

    from quillgraph.plans import catalogue

    texts = ["a. b.###", "a. b ## ", "```\n# in a fence\n```", "~~~. x", "# a\rb", "# a\r", "#\x0bno", "##\u00a0no", "# \u00a0b\u3000", "# \u2028x\u0085", "####### no", "   # three", "    # four", "# \t#", "#. #", "", None, "end. "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, pos, heading FROM ({catalogue.oracle_sql()['headings']})").fetchall()
    got = [(r["doc_id"], r["pos"], r["heading"]) for r in catalogue.queries()["headings"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (0, 2, "b.###") in got


def test_adjacency_issues_are_those_of_a_join(spark):
    rng = random.Random(5)
    one = [(f"e{i}", f"a{i % 7}", f"b{i % 5}") for i in range(300)] + [("e1", "x", "b1"), ("twin", "a", "b"), ("twin", "a", "c"), (None, "a", "b"), ("half", None, "b"), ("same", "a", "b"), ("same", "a", "b")]
    other = [r if rng.random() < 0.9 else (r[0], "moved", r[2]) for r in one if rng.random() < 0.95] + [("new", "a", "b"), ("twin", "a", "c")]
    for a, b in ((one, other), (other, one), (one, one), ([], one)):
        left, right = (spark.createDataFrame(rows, "id string, src string, dst string") for rows in (a, b))
        joined = left.toDF("id", "s1", "d1").join(right.toDF("id", "s2", "d2"), "id", "full_outer").collect()
        want = [("missing_adjacency_observation", r["id"], None) for r in joined if r["s2"] is None] + [("unlisted_physical_edge", r["id"], None) for r in joined if r["s1"] is None]
        for side, x, y in (("src", "s1", "s2"), ("dst", "d1", "d2")):
            want += [("adjacency_property_mismatch", r["id"], side) for r in joined if None not in (r[x], r[y]) and r[x] != r[y]]
        got = [(r["code"], r["artifact_id"], r["reference"]) for r in integrity.adjacency_issues(left, right).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))


def _shuffled(spark, run):
    """What ``run`` gives, and the bytes of its shuffles."""
    store = spark.sparkContext._jsc.sc()

    def total():
        store.listenerBus().waitUntilEmpty(30_000)
        return store.statusStore().executorList(True).head().totalShuffleWrite()

    before = total()
    return run(), total() - before


def test_sound_edges_do_not_meet_by_their_ids(spark, monkeypatch):
    """Ids of 64 digits are shuffled only where something is wrong, and no audit or view writes the edges."""
    monkeypatch.setattr(integrity, "ID_RANGES", 64, raising=False)
    edges = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("src"), F.lit("t").alias("type"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    edges = edges.select(C.edge_id(F.col("src"), F.col("type"), F.col("dst")).alias("id"), "type", "src", "dst")
    nodes = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("id"))
    wrong = edges.withColumn("id", F.when(F.col("src") == "n7", F.sha2("id", 256)).otherwise(F.col("id"))).unionByName(edges.where("src = 'n7'"))
    lost, n = _shuffled(spark, lambda: integrity.missing_endpoints(edges, nodes).collect())
    assert [(r["reference"], r["expected"]) for r in lost] == [("dst", "n30000")] and n < 2_000_000
    codes, n = _shuffled(spark, lambda: {r["code"]: r["n"] for r in integrity.audit(integrity.wrong_edge_ids(wrong)).collect()})
    assert codes == {"content_addressed_id_mismatch": 1, "conflicting_deterministic_identity": 2} and n < 100_000
    codes, n = _shuffled(spark, lambda: {r["code"]: r["n"] for r in integrity.audit(integrity.adjacency_issues(edges, wrong.where("src <> 'n9'"))).collect()})
    assert codes == {"missing_adjacency_observation": 1, "unlisted_physical_edge": 1} and n < 2_000_000
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, label: written.append(df.columns) or materialise(df, label))
    kept, inner = graph.top_subgraph(nodes, edges.unionByName(edges.where("src IN ('n5', 'n29999')")), 3)
    assert [tuple(r) for r in kept.collect()] == [("n5", 3), ("n6", 3), ("n1", 2)] and inner.count() == 2
    assert written and not any("src" in columns for columns in written)


def test_edges_are_made_distinct_as_numbers(spark):
    found, n = _shuffled(spark, lambda: edges_of(spark, SF).count())
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert found > rows and n < 12 * found


def test_diversify_against_loop(spark):
    rows = []
    for i in range(60):
        kind = "Claim" if i % 4 else "Concept"
        rows.append((1, f"n{i:02}", i + 1, kind, f"s{i % 3}", "says", f"o{i}" if i % 6 == 1 else None, f"v{i % 11}"))
    df = spark.createDataFrame(rows, "query_id bigint, id string, rank int, type string, s string, p string, o_id string, o_literal string")
    got = [r["id"] for r in retrieve.diversify(df, 20).orderBy("rank").collect()]
    seen, once = set(), []
    for r in rows:
        obj = r[6] or r[7]
        if r[3] == "Claim":
            if (r[4], obj) in seen:
                continue
            seen.add((r[4], obj))
        once.append(r)
    kind = lambda r: "entity" if r[3] != "Claim" else "rel" if r[6] else "scalar"
    taken = []

    def ok(r):
        same = [t for t in taken if t[3] == "Claim" and t[4] == r[4]]
        return not (kind(r) == "scalar" and sum(kind(t) == "scalar" for t in taken) >= 10) and not (r[3] == "Claim" and len(same) >= 3)

    for want, limit in (("entity", 6), ("rel", 4)):
        for r in once:
            if len(taken) < 20 and sum(kind(t) == want for t in taken) < limit and r not in taken and kind(r) == want and (want == "entity" or ok(r)):
                taken.append(r)
    for r in once:
        if len(taken) < 20 and r not in taken and ok(r):
            taken.append(r)
    for r in once:
        if len(taken) < 20 and r not in taken:
            taken.append(r)
    assert got == [r[1] for r in sorted(taken, key=lambda r: r[2])]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20))
def test_components(spark, pairs):
    group = {x: x for p in pairs for x in p}
    for _ in group:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = connected_components(spark.createDataFrame(pairs, "a int, b int"))
    assert {r["id"]: r["component"] for r in got.collect()} == group


def test_clusters_keep_the_cap(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}", round(1 - i / 100, 2)) for i in range(20)]
    got = resolve.clusters(spark.createDataFrame(pairs, "a string, b string, score double"), cap=8).collect()
    sizes = {}
    for r in got:
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert sizes["n00"] == 8 and max(sizes.values()) == 8 and len({r["id"] for r in got}) == len(got)


def test_fuzzy_recall(spark):
    base = ["alpha station", "beta river delta", "northern lights", "garden of eden", "silver spoon co", "western railway", "morning session"]
    titles = base + [t[:3] + t[4:] for t in base] + [t + "s" for t in base] + [t.replace("e", "a", 1) for t in base]
    rows = [(f"i{n:02}", "Concept", t) for n, t in enumerate(titles)]
    got = {(r["a"], r["b"]) for r in resolve.fuzzy_pairs(spark.createDataFrame(rows, "id string, type string, title string")).collect()}
    first = {}
    for i, _, t in rows:
        first.setdefault(udfs.discovery_key(t), i)
    want = {(a, b) for (x, a), (y, b) in itertools.combinations(sorted(first.items(), key=lambda p: p[1]), 2) if udfs.jaro_winkler_of(x, y) >= 0.9}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_fuzzy_pairs_are_all_pairs(spark):
    lost = [("that en", "thea thnd"), ("the hetihe", "ther theahe"), ("the the", "theand thble"), ("the the erntre", "thea hetire, nt re")]
    draw = random.Random(5)
    words = ["the", "thea", "and", "hetire", "alpha", "station", "n\u00e9e", "sta", "ation", "eth"]
    made = [" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(150)]
    titles = [*itertools.chain(*lost), *made, *("".join(draw.sample(t, len(t))) for t in made[:40]), *(t[1:] + t[0] for t in made[:40]), None, ""]
    rows = [(f"i{n:03}", "Concept" if n % 9 else "Place", t) for n, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id string, type string, title string")
    first = {}
    for i, kind, t in rows:
        first.setdefault((kind, udfs.discovery_key(t)), i)
    for floor, least in ((0.9, 7), (0.75, 2)):
        keys = [(i, kind, key) for (kind, key), i in first.items() if len(key) >= least]
        want = {(a, b): round(udfs.jaro_winkler_of(x, y), 6) for (a, k, x), (b, m, y) in itertools.combinations(sorted(keys), 2) if k == m}
        want = {p: score for p, score in want.items() if score >= floor}
        got = [((r["a"], r["b"]), r["score"]) for r in resolve.fuzzy_pairs(df, floor, least).collect()]
        assert len(got) == len(want) > 50 and dict(got) == want


def test_members_of_pairs(spark):
    titles = {"a1": "Saulo Lima", "a2": "Saulo Lima", "a3": "Rita Lima", "a4": "saulo  lima", "a5": "Other Name", "a6": None, "a7": None}
    df = spark.createDataFrame([(i, "Agent", t) for i, t in titles.items()], "id string, type string, title string")
    lanes = {r["id"]: tuple(r)[1:] for r in resolve.lane_members(df).collect()}
    assert lanes == {"a1": ("a1", 2, 2), "a2": ("a1", 2, 2), "a3": ("a3", 1, 2), "a4": ("a4", 1, 2), "a5": ("a5", 1, 0), "a6": ("a6", 2, 0), "a7": ("a6", 2, 0)}
    fuzzy = {r["id"]: tuple(r)[1:3] for r in resolve.fuzzy_members(df).collect()}
    assert fuzzy == {"a1": ("a1", 3), "a2": ("a1", 3), "a3": ("a3", 1), "a4": ("a1", 3), "a5": ("a5", 1), "a6": ("a6", 2), "a7": ("a6", 2)}


def test_admission_conflicts(spark):
    cases = {"uses tool": "queue_mapping_conflict", "writes": "exact_mapping", "both": "queue_mapping_conflict", "": "reject_placeholder", "Null": "reject_placeholder"}
    verdict = predicates.admission(F.col("raw"), F.lit(False), {"uses": "canonical", "author_of": "canonical"}, {"uses_tool": "handles", "writes": "author_of", "both": "uses"}, {"both": "uses"})
    rows = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", verdict["reason"].alias("r")).collect()
    assert {r["raw"]: r["r"] for r in rows} == cases


def test_alias_and_inverse_maps(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 1)], "predicate string, n long")
    got = predicates.alias_map(spark.createDataFrame([("a", "b"), ("c", "b")], "a string, b string"), counts)
    assert {r["predicate"]: r["canonical"] for r in got.collect()} == {"a": "b", "b": "b", "c": "b"}
    inverse = {r["predicate"]: (r["inverse"], r["conflict"]) for r in predicates.inverse_map(spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string")).collect()}
    assert inverse == {"x": ("y", False), "y": ("x", True), "z": ("y", False)}


def test_greedy_clusters(spark):
    rows = [("uses", 9, [1.0, 0.0]), ("using", 3, [0.99, 0.1]), ("eats", 5, [0.0, 1.0]), ("ate", 1, [0.1, 0.99])]
    got = predicates.greedy_clusters(spark.createDataFrame(rows, "predicate string, n int, embedding array<double>"))
    assert {r["predicate"]: r["cluster"] for r in got.collect()} == {"uses": "uses", "using": "uses", "eats": "eats", "ate": "eats"}


def test_proposals_leave_judged_out(spark):
    counts = spark.createDataFrame([("a", 4), ("b", 3), ("c", 2)], "predicate string, n long")
    shared = spark.createDataFrame([("a", "b", 2, 0), ("a", "c", 1, 1), ("b", "c", 3, 0)], "a string, b string, same_order int, swapped int")
    judged = spark.createDataFrame([("b", "c")], "a string, b string")
    got = predicates.proposals(counts, shared, F.lit(0.5), judged=judged).collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "b"), ("a", "c")]


def test_ego_graph_levels(spark):
    claims = [("k1", "a", "knows", "b", None, 0.9), ("k2", "b", "knows", "c", None, 0.8), ("k3", "c", "knows", "d", None, 0.8), ("k4", "a", "age", None, "7", 0.5)]
    df = spark.createDataFrame(claims, "id string, s string, p string, o_id string, o_literal string, confidence double")
    seeds = spark.createDataFrame([("a",)], "seed string")
    terms = spark.createDataFrame([("a", "age")], "seed string, term string")
    got = {(r["hop"], r["id"]) for r in graph.ego_graph(df, seeds, terms, 4, 2).collect()}
    assert got == {(1, "k1"), (1, "k4"), (2, "k2")}


def test_integrity(spark):
    nodes = spark.createDataFrame([("a", "Agent"), ("b", "Odd"), ("a", "Agent")], "id string, type string")
    edges = spark.createDataFrame([("0" * 64, "t", "a", "b"), ("1" * 64, "t", "a", "b"), ("e", "t", "a", "gone")], "id string, type string, src string, dst string")
    issues = integrity.audit(integrity.missing_endpoints(edges, nodes), integrity.wrong_edge_ids(edges), integrity.duplicate_ids(nodes, "duplicate_node_id"), integrity.unwritable_types(nodes, ("Agent",)))
    assert {r["code"]: r["n"] for r in issues.collect()} == {"missing_edge_endpoint": 1, "content_addressed_id_mismatch": 2, "conflicting_deterministic_identity": 2, "duplicate_node_id": 1, "closed_type_set": 1}
    m = integrity.manifest_issues(spark.createDataFrame([("x", "1"), ("y", "1")], "id string, digest string"), spark.createDataFrame([("x", "2"), ("z", "1")], "id string, digest string"))
    assert sorted(r["code"] for r in m.collect()) == ["artifact_mismatch", "missing_artifact", "unexpected_artifact"]


def test_detectors(spark):
    docs = spark.createDataFrame([("d1", "commitment", "2026-01-01", ["c-1"]), ("d2", "commitment", "2027-01-01", ["c-2"]), ("d3", "commitment", "2026-01-01", ["c-3"]), ("d4", "commitment", None, ["c-4"])], "id string, type string, due string, tokens array<string>")
    closures = spark.createDataFrame([("d9", "c-3"), ("d1", "c-1")], "id string, value string")
    assert [r["document_id"] for r in detect.overdue_commitments(docs, closures).collect()] == ["d1"]


def test_ledger_order_and_plans(spark):
    rows = [(1, "commit_plan", "p1"), (2, "operation_receipt", "p1"), (3, "operation_receipt", "p2"), (4, "commit_record", "p1"), (5, "commit_plan", "p3")]
    df = spark.createDataFrame(rows, "seq long, kind string, plan_id string")
    assert [(r["plan_id"], r["seq"]) for r in ledger.order_issues(df).collect()] == [("p2", 3)]
    assert [r["plan_id"] for r in ledger.plans_without_outcome(df).collect()] == ["p3"]


def test_mcnemar():
    assert quality.mcnemar_p(0, 0) == 1.0
    assert quality.mcnemar_p(1, 9) == pytest.approx(0.021484375)


def test_rebuild_gate(spark):
    got = quality.rebuild_gate(spark.createDataFrame([("a", True), ("b", None)], "code string, ok boolean")).first()
    assert (got["passed"], got["failed"]) == (False, ["b"])
