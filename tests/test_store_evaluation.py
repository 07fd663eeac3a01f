"""The store's checks, each broken once; framing of JSON-lines files for any length of a range."""

import hashlib
import json
import math

import pytest

from quillgraph.operators import evaluation, store_evaluation
from quillgraph.sources import framing

NODE = ", ".join(f"{c} {t}" for c, t in store_evaluation.NODE_COLUMNS.items())
HASH = hashlib.sha256(b"x").hexdigest()


def graph():
    """A small graph without a fault: two entities, one relation and one literal claim, each with bridges and provenance."""
    node = lambda id_, type_, **more: {"id": id_, "type": type_} | more
    claim = lambda id_, **more: node(id_, "Claim", s="a", block_id="b", activity_id="act", agent_id="ag", **more)
    nodes = [
        node("a", "Agent"), node("c", "Concept"), node("ag", "Agent", infra=True), node("act", "Activity", infra=True), node("b", "Block", source_path="f.md", byte_start=0, byte_end=4, content_hash=HASH),
        claim("k1", p="uses", o_id="c"), claim("k2", p="says", o_literal="hello"), claim("k3", p="was", o_id="c", superseded=True), node("meta", "SchemaMetadata"),
    ]
    ties = [(kind, k, dst) for k in ("k1", "k2", "k3") for kind, dst in (("rdf:subject", "a"), ("prov:wasDerivedFrom", "b"), ("prov:wasGeneratedBy", "act"), ("prov:wasAttributedTo", "ag"))]
    return nodes, [("uses", "a", "c"), ("was", "a", "c"), ("rdf:object", "k1", "c"), ("rdf:object", "k3", "c"), *ties]


def checks(spark, nodes, edges, registered=("uses", "says", "was"), **options):
    made = spark.createDataFrame([tuple(n.get(c) for c in store_evaluation.NODE_COLUMNS) for n in nodes], NODE)
    rows = store_evaluation.evaluate_store(made, spark.createDataFrame(edges, "type string, src string, dst string"), registered=registered, **options)
    return {r["code"]: r for r in rows.collect()}


def failed(found):
    return {c: (r["count"], r["samples"]) for c, r in found.items() if r["status"] != "passed"}


def change(nodes, id_, **more):
    return [n | more if n["id"] == id_ else n for n in nodes]


def test_a_whole_graph_passes(spark):
    nodes, edges = graph()
    assert failed(checks(spark, nodes, edges)) == {}
    assert failed(checks(spark, [], [])) == {}
    # repeated rows and edges, rows without an id or an end
    assert failed(checks(spark, [*nodes, *nodes, {"type": "Odd"}, {"id": "", "type": "Odd"}], [*edges, *edges, ("x", None, "a"), ("x", "a", "")])) == {}


BROKEN = {
    "closed_primitive_set": lambda n, e: ([*n, {"id": "z", "type": "Thing"}], e, (1, ["z"])),
    "claim_object_shape": lambda n, e: (change(n, "k2", o_literal=None), e, (1, ["k2"])),
    "placeholder_predicates": lambda n, e: (change(n, "k2", p=" N/A "), e, (1, ["k2"])),
    "claim_source_anchors": lambda n, e: (change(n, "b", content_hash="short"), e, (3, ["k1", "k2", "k3"])),
    "claim_bridge_materialization": lambda n, e: (n, [x for x in e if x not in (("rdf:subject", "k1", "a"), ("rdf:object", "k1", "c"))], (2, ["k1", "k1"])),
    "claim_provenance_materialization": lambda n, e: (change(n, "k1", agent_id="c"), e, (1, ["k1"])),
    "live_relation_endpoints": lambda n, e: (change(change(n, "k1", o_id="b"), "k3", s="gone"), [*e, ("rdf:object", "k1", "b"), ("rdf:subject", "k3", "gone"), ("uses", "a", "b")], (1, ["k1"])),
    "relation_materialization": lambda n, e: (n, [x for x in e if x[0] != "uses"], (1, ["k1"])),
    "topology_claim_coverage": lambda n, e: (n, [*e, ("knows", "c", "a"), ("knows", "c", "a"), ("knows", "ag", "a")], (1, ["knows"])),
}


@pytest.mark.parametrize("code", BROKEN)
def test_each_check_fails_once(spark, code):
    nodes, edges, want = BROKEN[code](*graph())
    found = failed(checks(spark, nodes, edges, registered=("uses", "says", "was", "N/A")))
    if code == "topology_claim_coverage":
        assert found[code][0] == want[0]
    elif code == "live_relation_endpoints":
        assert found[code] == want and set(found) == {code, "topology_claim_coverage"} or found == {code: want}
    else:
        assert found[code][0] == want[0] and set(found[code][1]) == set(want[1])
        assert set(found) <= {code, "topology_claim_coverage"}


def test_registry_and_integrity(spark):
    nodes, edges = graph()
    found = failed(checks(spark, nodes, edges, registered=("uses",)))
    assert found == {"registered_predicates": (1, ["says"])}  # a superseded claim's isn't asked for
    found = checks(spark, nodes, edges, registered=None)
    assert found["registered_predicates"]["status"] == "not_measured" and found["registered_predicates"]["count"] is None
    found = checks(spark, change(nodes, "k2", p="none"), edges, verified=False)
    assert {c for c, r in found.items() if r["status"] == "not_measured"} == set(store_evaluation.TOPOLOGY_CODES)
    assert found["placeholder_predicates"]["status"] == "failed"
    gate = {r["code"]: r["ok"] for r in evaluation.gate_checks(spark.createDataFrame([(c, r["status"], r["reason"]) for c, r in found.items()], "code string, status string, reason string")).collect()}
    assert gate["closed_primitive_set"] and not gate["complete_store_scan"] and not gate["placeholder_predicates"]


def test_one_scan_of_each_table(spark, tmp_path):
    nodes, edges = graph()
    spark.createDataFrame([tuple(n.get(c) for c in store_evaluation.NODE_COLUMNS) for n in nodes], NODE).write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame(edges, "type string, src string, dst string").write.parquet(f"{tmp_path}/edges")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    plan = store_evaluation.node_facts(read("nodes"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    found, _ = store_evaluation.failures(read("nodes"), read("edges"), ("uses",))
    # what follows reads the facts that the passes wrote, and neither table again
    assert f"{tmp_path}/nodes" not in found._jdf.queryExecution().executedPlan().toString() and f"{tmp_path}/edges" not in found._jdf.queryExecution().executedPlan().toString()


# --- framing ----------------------------------------------------------------------------------------------------------


def ledger_bytes():
    record = lambda i, **more: json.dumps({"kind": f"k{i % 3}", "ledger_version": 1 + i % 2, "n": i, "t": "ü" * (i % 40)} | more).encode()
    lines = [record(i) for i in range(400)]
    lines[7] = b'{"kind": "cut", "ledger_ver'
    lines[50] = b"[1, 2]"
    lines[51] = b'"text"'
    lines[99] = b"\xff\xfe{}"
    lines[120] = b""
    lines[121] = b"   \t"
    lines[122] = record(1, ledger_version=True)
    lines[123] = record(1, ledger_version=9)
    lines[124] = b'{"kind": 5}\r'
    lines[200] = record(2, big="x" * 20_000)
    return lines


def brute(raw):
    """The rule, line by line."""
    lines = raw.split(b"\n")
    ended = lines[-1] == b""
    lines = lines[:-1] if ended else lines
    out, at = [], 0
    for i, line in enumerate(lines, 1):
        fault = version = None
        if line.strip():
            try:
                value = json.loads(line.decode())
                fault = None if isinstance(value, dict) else "record_not_object"
                version = value.get("ledger_version") if fault is None and type(value.get("ledger_version")) is int else None
            except UnicodeDecodeError:
                fault = "invalid_utf8"
            except ValueError:
                fault = "invalid_json"
        out.append((i, at, len(line), fault, not line.strip(), version))
        at += len(line) + 1
    return out, not ended


@pytest.mark.parametrize("size", [300, 4_000, 10_000_000])
@pytest.mark.parametrize("end", [b"\n", b"", b'\n{"torn'])
def test_framing_for_any_range(spark, tmp_path, size, end):
    raw = b"\n".join(ledger_bytes()) + end
    (tmp_path / "ledger.jsonl").write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        lines = framing.scan_lines(spark, f"file://{tmp_path}/ledger.jsonl")
        if size < 5_000:
            assert lines.select("file").rdd.getNumPartitions() > 1
        parsed = framing.parsed_lines(lines)
        got = sorted((r["line"], r["start"], r["length"], r["fault"], r["blank"], r["version"]) for r in parsed.collect())
        report = framing.framing(parsed).first()
        samples = framing.malformed_samples(parsed, 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want, unterminated = brute(raw)
    assert got == want
    faults = [w for w in want if w[3]]
    assert (report["lines"], report["malformed"], report["records"]) == (len(want), len(faults), sum(1 for w in want if not w[3] and not w[4]))
    assert report["contiguous"] and report["unterminated"] == unterminated and report["torn"] == (end == b'\n{"torn')
    assert report["unknown_versions"] == 3 and report["first_malformed_at"] == faults[0][1] and not report["complete"]
    assert [(s["line"], s["start"]) for s in samples] == [w[:2] for w in faults[:2]]
    assert report["reason"] == "malformed_ledger_lines+" + ("trailing_partial_record+" if report["torn"] else "") + "unrecognized_ledger_versions"


def test_framing_of_whole_and_empty_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"ledger_version": 1}\n\n{"ledger_version": 2}\n')
    (tmp_path / "b.jsonl").write_bytes(b"\n")
    (tmp_path / "c.jsonl").write_bytes(b"")
    rows = {r["file"][-7]: r for r in framing.framing(framing.parsed_lines(framing.scan_lines(spark, f"file://{tmp_path}"))).collect()}
    assert rows["a"]["complete"] and rows["a"]["reason"] == "all_nonempty_lines_parsed" and rows["a"]["lines"] == 3
    assert rows["b"]["complete"] and rows["b"]["reason"] == "empty_ledger"
    assert "c" not in rows


def test_gaps_are_told(spark):
    """Ranges that don't meet, as from a file that changed while it was read."""
    kind = "file string, line long, start long, length long, file_size long, gap boolean, fault string, blank boolean, kind string, version long, json string"
    rows = [("f", 1, 0, 4, 30, False, None, False, "k", 1, "{}"), ("f", 2, 9, 4, 30, True, None, False, "k", 1, "{}")]
    report = framing.framing(spark.createDataFrame(rows, kind)).first()
    assert not report["contiguous"] and report["reason"] == "ranges_with_gaps"


def test_arms(spark):
    made = lambda rows: spark.createDataFrame(rows, "query_id int, correct boolean")
    right = lambda n, good: [(i, i in good) for i in range(n)]
    found = evaluation.compare_arms(made(right(300, set(range(100)))), made(right(310, set(range(50, 180)))), iters=100)
    assert (found["n"], found["both"], found["only_a"], found["only_b"], found["neither"]) == (300, 50, 50, 80, 120)
    assert found["delta"] == pytest.approx(0.1) and found["chi2"] == pytest.approx(29**2 / 130)
    assert found["exact_p"] == pytest.approx(min(1, 2 * sum(math.comb(130, i) for i in range(51)) / 2**130))
    assert found["low"] < 0.1 < found["high"] and found["conditions"]["significant"] and found["conditions"]["material"]
    # what can be told solves its equation
    share = evaluation.detectable_share(130)
    assert math.sqrt(130) * (share - 0.5) == pytest.approx(evaluation.Z_ALPHA / 2 + evaluation.Z_BETA * math.sqrt(share * (1 - share)))
    assert evaluation.needed_pairs(found["mde"], 130 / 300) == pytest.approx(300)
    assert found["verdict"] == ("REAL" if found["delta"] >= found["mde"] else "directional, not proven") and found["escalate"] == (found["delta"] < found["mde"])
    worse = evaluation.compare_arms(made(right(50, set(range(20)))), made(right(50, set(range(10)))), iters=50)
    assert worse["verdict"] == "no improvement" and not worse["escalate"] and "directional" in worse["failed"]
    # nulls are wrong, a repeated question counts once, and equal arms have nothing to tell
    same = evaluation.compare_arms(made([(1, True), (2, None), (1, False), (None, True)]), made([(1, True), (2, False), (3, True)]), iters=10)
    assert (same["n"], same["both"], same["neither"], same["exact_p"], same["mde"], same["chi2"]) == (2, 1, 1, 1.0, None, None)
    with pytest.raises(ValueError):
        evaluation.compare_arms(made([]), made([(1, True)]))
    assert evaluation.detectable_share(3) is None and evaluation.exact_mcnemar(400_000, 401_000) == pytest.approx(math.erfc(999 / math.sqrt(2 * 801_000)), rel=0.01)
