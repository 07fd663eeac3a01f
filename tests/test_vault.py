"""A vault over a folder: taking in, asking, explaining, exporting, and taking in again after edits."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import retrieve
from quillgraph.vault import Vault

FILES = {
    "notes/tea.md": "---\ntitle: Tea notes\ntags: [drinks]\n---\n# Green tea\n\nGreen tea is brewed at eighty degrees. See [[Kettle]].\n",
    "kettle.md": "# Kettle\n\nA kettle boils water quickly. #kitchen\n",
    "plain.txt": "Oolong lies between green and black tea.\n",
    ".hidden.md": "# Hidden\n",
    "empty.md": "",
}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    folder, home = tmp_path_factory.mktemp("files"), tmp_path_factory.mktemp("vault")
    write(folder, FILES)
    vault = Vault(spark, f"file://{home}/v")
    first = vault.take_in(f"file://{folder}")
    return vault, folder, first


def test_takes_in_and_answers(spark, taken):
    vault, folder, first = taken
    assert first == {"added": 3, "changed": 0, "removed": 0, "same": 0}
    assert vault.take_in(f"file://{folder}") == {"added": 0, "changed": 0, "removed": 0, "same": 3}
    asks = spark.createDataFrame([(1, "green tea degrees"), (2, "which kettle boils water?"), (3, None)], "query_id int, text string")
    hits = vault.ask(asks, 5).collect()
    assert {r["query_id"] for r in hits} >= {1, 2} and all(0 <= r["score"] <= 1 for r in hits)
    assert "kettle.md" in {r["path"] for r in hits if r["query_id"] == 2}
    # an anchor is the bytes that its digest is of
    for r in hits:
        if r["block_id"]:
            raw = (folder / r["path"]).read_bytes()[r["byte_start"] : r["byte_end"]]
            assert raw and hashlib.sha256(raw).hexdigest() == r["content_hash"].removeprefix("sha256:")
    found = vault.search(asks, 1, kind="Block").collect()
    assert {r["query_id"] for r in found} == {1, 2}


def test_explains_and_exports(spark, taken):
    vault, _, _ = taken
    nodes = {r["id"]: r for r in vault.nodes().collect()}
    claims = [i for i, r in nodes.items() if r["type"] == "Claim"]
    assert {(nodes[i]["p"], nodes[i]["o_literal"]) for i in claims} >= {("has_heading", "Green tea"), ("has_tag", "drinks"), ("has_tag", "kitchen"), ("links_to", "Kettle")}
    got = {r["id"]: r for r in vault.explain(spark.createDataFrame([(i,) for i in [*claims, "unknown", None]], "id string")).collect()}
    assert set(got) == set(claims)
    for r in got.values():
        assert r["path"] in FILES and any("prov:wasDerivedFrom" in line for line in r["lines"]) and len(r["lines"]) <= 5
    out = [json.loads(r["value"]) for r in vault.export(["Document"]).collect()]
    assert sorted(d["name"] for d in out) == ["Tea notes", "kettle.md", "plain.txt"] and all(d["@type"] == "Document" for d in out)
    one = vault.nodes().where("path = 'kettle.md' AND type = 'Document'").select("document_id")
    assert {json.loads(r["value"])["@type"] for r in vault.export(documents=one).collect()} == {"Document", "Block", "Claim"}
    assert vault.export([]).count() == 0


def consistent(spark, vault):
    """Index and tallies hold what the tables hold."""
    nodes, edges = vault.nodes(), vault.edges()
    shown = {r["id"] for r in nodes.where("NOT infra").select("id").collect()}
    assert {r["id"] for r in vault.index.records().select("id").collect()} == shown
    assert {r["id"]: r["n"] for r in vault.tallies.degrees().collect()} == {r["id"]: r["degree"] for r in retrieve.degrees(edges).collect()}
    census = {(r["type"]): r["n"] for r in vault.tallies.census().groupBy("type").agg(F.sum("n").alias("n")).collect()}
    assert census == {r["type"]: r["count"] for r in nodes.where("NOT infra").groupBy("type").count().collect()}
    ids = {r["id"] for r in nodes.select("id").collect()}
    assert all(r["src"] in ids and r["dst"] in ids for r in edges.collect())


def test_edits_cost_what_changed(spark, tmp_path):
    folder = tmp_path / "files"
    write(folder, FILES)
    vault = Vault(spark, f"file://{tmp_path}/v")
    vault.take_in(f"file://{folder}")
    before = {r["id"] for r in vault.nodes().where("path = 'plain.txt'").collect()}
    (folder / "kettle.md").write_text("# Samovar\n\nA samovar keeps water hot.\n")
    (folder / "notes/tea.md").unlink()
    write(folder, {"new.md": "Matcha is ground.\n"})
    assert vault.take_in(f"file://{folder}") == {"added": 1, "changed": 1, "removed": 1, "same": 1}
    consistent(spark, vault)
    assert {r["id"] for r in vault.nodes().where("path = 'plain.txt'").collect()} == before
    words = spark.createDataFrame([(1, "samovar"), (2, "matcha"), (3, "kettle"), (4, "eighty")], "query_id int, text string")
    assert {r["query_id"] for r in vault.search(words, 3).collect()} == {1, 2}
    # one batch's folder holds nothing of files that stayed
    state = vault.tables.state()
    last = spark.read.parquet(f"{vault.tables.path}/nodes/{state['live']['nodes'][-1]}")
    assert last.where("path = 'plain.txt'").count() == 0
    # without pruning what is gone stays
    (folder / "new.md").unlink()
    assert vault.take_in(f"file://{folder}", prune=False)["removed"] == 1
    assert vault.search(words, 3).where("query_id = 2").count() > 0
    vault.merge()
    consistent(spark, vault)


def test_a_run_that_failed_half_way_is_finished(spark, tmp_path, monkeypatch):
    folder = tmp_path / "files"
    write(folder, {"a.md": "# One\n\ntext\n"})
    vault = Vault(spark, f"file://{tmp_path}/v")
    monkeypatch.setattr(Vault, "_follow", lambda self, batch: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        vault.take_in(f"file://{folder}")
    monkeypatch.undo()
    assert vault.index.stats()["nodes"] == 0
    assert vault.take_in(f"file://{folder}")["same"] == 1
    consistent(spark, vault)


def test_empty_vault(spark, tmp_path):
    (tmp_path / "files").mkdir()
    write(tmp_path / "files", {"empty.md": ""})
    vault = Vault(spark, f"file://{tmp_path}/v")
    assert vault.take_in(f"file://{tmp_path}/files") == {"added": 0, "changed": 0, "removed": 0, "same": 0}
    assert vault.nodes().count() == 0 and vault.export().count() == 0
    assert vault.search(spark.createDataFrame([(1, "x")], "query_id int, text string"), 3).count() == 0
