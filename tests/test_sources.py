import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ingest
from quillgraph.sources import markdown, snapshots
from quillgraph.streaming import watch


def test_markdown_graph(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_text("---\ntitle: One\ntags: [x, y]\n---\n# Head\nSee [[two]] #t\n")
    (tmp_path / "two.txt").write_text("plain é text\n" * 5)
    (tmp_path / "skip.bin").write_bytes(b"\0")
    files = markdown.read_files(spark, str(tmp_path))
    documents, blocks, claims = markdown.markdown_graph(files, 30)
    assert {r["path"] for r in documents.collect()} == {"a/one.md", "two.txt"}
    assert {(r["p"], r["o_literal"]) for r in claims.collect()} == {("has_heading", "Head"), ("has_tag", "t"), ("has_tag", "x"), ("has_tag", "y"), ("links_to", "two")}
    assert all(r["current"] for r in ingest.current_blocks(blocks, files).collect())
    edges = markdown.provenance_edges(claims, documents, "act", "me")
    assert edges.where("type = 'rdf:subject'").count() == claims.count()
    assert markdown.corpus_hash(markdown.manifest(files)).first()["n_files"] == 2


def test_selection(spark):
    rows = [("x/.git/a.md", 1), (".h.md", 1), ("n/b.tmp", 1), ("c.md", 0), ("d.md", 2)]
    got = markdown.selected(spark.createDataFrame(rows, "path string, size long"), ("*.tmp",)).collect()
    assert [r["verdict"] for r in got] == ["ignored_dir", "hidden", "ignored_glob", "empty", None]


def test_snapshot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "/old/x", [1.0]), ("b", None, None)], "id string, source_path string, embedding array<double>")
    snapshots.dump({"nodes": nodes}, str(tmp_path / "s"))
    assert snapshots.verify(spark, str(tmp_path / "s")) == {"nodes": True}
    loaded = snapshots.load(spark, str(tmp_path / "s"), ("/old/", "/new/"), skip_embeddings=True)["nodes"]
    assert {tuple(r) for r in loaded.collect()} == {("a", "/new/x"), ("b", None)}
    nodes.limit(1).write.mode("overwrite").parquet(str(tmp_path / "s/nodes"))
    with pytest.raises(ValueError):
        snapshots.load(spark, str(tmp_path / "s"))


def test_upsert_keeps_vectors(spark):
    kind = "id string, title string, embedding array<double>"
    old, new = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], kind), spark.createDataFrame([("a", "z", None), ("c", "w", None)], kind)
    assert {tuple(map(str, r)) for r in snapshots.upsert(old, new).collect()} == {("a", "z", "[1.0]"), ("b", "y", "[2.0]"), ("c", "w", "None")}
    assert snapshots.upsert(old, new, True).where("id = 'a'").first()["embedding"] is None


def test_json_lines_and_json_ld(spark, tmp_path):
    rows = spark.createDataFrame([("b", "Agent", "B", "x"), ("a", "Place", "A", "y")], "id string, type string, title string, content string")
    snapshots.save_corpus(rows, str(tmp_path / "c"))
    assert snapshots.load_corpus(spark, str(tmp_path / "c"), rows.schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    assert [json.loads(r[0])["@id"] for r in snapshots.json_ld(rows, ("Agent",)).collect()] == ["b"]


def test_ledger_scan(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"kind": "candidate", "ledger_version": 1}\n\nnonsense\n{"kind": "x", "ledger_version": 9}\n{"kind": "y", "le')
    events, report = snapshots.scan_ledger(spark, str(tmp_path / "l.jsonl"), "kind string, ledger_version int")
    assert report.first().asDict() == {"lines": 5, "blank": 1, "bad": 2, "odd": 1, "torn": 1}
    assert sorted(r["kind"] for r in events.collect()) == ["candidate", "x"]


def test_publish_keeps_versions(spark, tmp_path):
    for v in range(4):
        snapshots.publish(spark.range(v + 1), str(tmp_path / "t"), v)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v=2", "v=3"]


def test_stream_latest_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "seq bigint, run string, state string"
    (source / "1.json").write_text('{"seq": 1, "run": "a", "state": "started"}\n{"seq": 2, "run": "b", "state": "started"}\n')
    run = lambda: watch.run_available(watch.latest_state(watch.read_events(spark, str(source), schema), "run"), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    run()
    (source / "2.json").write_text('{"seq": 3, "run": "a", "state": "completed"}\n')
    run()
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    last = rows.groupBy("run").agg(F.max_by("state", "seq").alias("state"), F.max("n").alias("n"))
    assert {tuple(r) for r in last.collect()} == {("a", "completed", 2), ("b", "started", 1)}


def test_stream_debounce(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda key, t: json.dumps({"path": key, "ts": f"2026-01-01T00:00:{t:02}"}) + "\n"
    (source / "1.json").write_text("".join(line("a", t) for t in (0, 1, 2, 8, 30)))
    changes = watch.read_events(spark, str(source), "path string, ts timestamp")
    watch.run_available(watch.debounce(changes, "path", "ts"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r["n"], round(r["last"] - r["first"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0), (3, 2)]
