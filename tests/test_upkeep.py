"""Maintained index, signed tallies and self-joins of vectors: equal to a rebuild and to brute force, also after replays and odd batches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import predicates, retrieve, vectors
from quillgraph.operators.text_index import TextIndex
from quillgraph.plans import upkeep
from quillgraph.streaming.projection import CHANGES, Projection
from quillgraph.streaming.signed import SignedTables
from tests.conftest import SF
from tests.test_within_batch import loop

NODE = "id string, type string, text string, embedding array<double>"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], NODE)


def same_ranks(spark, index, live, k=5):
    """BM25 on the index is BM25 of the live rows from scratch."""
    asks = spark.createDataFrame([(1, "red blue"), (2, "green, green!"), (3, "nothing"), (4, "")], "query_id int, text string")
    want = retrieve.bm25(docs(spark, live), F.col("text"), asks, F.col("text"), k)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())
    assert key(index.bm25(asks, F.col("text"), k)) == key(want)


def folders(index, table):
    return {f: index.tables._names(f"{index.tables.path}/{table}/{f}") for f in index.tables.state()["live"][table]}


def test_index_takes_deltas(spark, tmp_path):
    rng = random.Random(2)
    words = ["red", "blue", "green", "Green.", "black", "white", "grey"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8)))
    live = {f"n{i}": (f"n{i}", "a" if i % 2 else "b", text()) for i in range(30)}
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8)
    assert index.apply(0, docs(spark, live.values()))
    same_ranks(spark, index, live.values())
    for batch in (1, 2, 3):
        changed = [(f"n{i}", rng.choice("ab"), text()) for i in rng.sample(range(40), 6)]
        gone = [f"n{i}" for i in rng.sample(range(40), 4)]
        assert index.apply(batch, docs(spark, changed), spark.createDataFrame([(x,) for x in gone], "id string"))
        live |= {r[0]: r for r in changed}
        live = {k: v for k, v in live.items() if k not in gone}
        same_ranks(spark, index, live.values())
        # a replayed batch, even with other rows, changes nothing
        assert not index.apply(batch, docs(spark, [("n1", "a", "red red red")]))
    same_ranks(spark, index, live.values())
    assert {r["id"] for r in index.records().collect()} == set(live)
    index.merge()
    same_ranks(spark, index, live.values())
    assert all(len(f) == 1 for f in index.tables.state()["live"].values())
    assert index.stats()["nodes"] == len(live)
    index.reindex(docs(spark, [("x", "a", "red")]))
    same_ranks(spark, index, [("x", "a", "red")])


def test_only_touched_buckets_are_written(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=16)
    index.apply(0, docs(spark, [(f"n{i}", "a", f"w{i} common") for i in range(60)]))
    index.apply(1, docs(spark, [("n3", "a", "w3 common other")]))
    first, second = (sum(n.startswith("bucket=") for n in names) for names in folders(index, "postings").values())
    # the new term, and the two kept ones whose text's length changed
    assert first == 16 and second <= 3
    assert sum(n.startswith("bucket=") for n in list(folders(index, "records").values())[1]) == 1
    # what is written again as it was writes no posting
    index.apply(2, docs(spark, [("n3", "a", "w3 common other")]))
    assert not any(n.startswith("bucket=") for n in list(folders(index, "postings").values())[2])


def test_index_odd_batches(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    assert index.apply(0) and index.stats() == {"nodes": 0, "vectors": 0, "texts": 0, "avgdl": 0.0}
    same_ranks(spark, index, [])
    index.apply(1, docs(spark, [("a", "t", None, [1.0, 2.0]), ("b", "t", "red", [0.5, 0.5]), (None, "t", "red"), ("c", "t", "red red"), ("c", "t", "red red"), ("d", None, "blue " * 30_000)]))
    same_ranks(spark, index, [("a", "t", None), ("b", "t", "red"), ("c", "t", "red red"), ("d", None, "blue " * 30_000)])
    # no vector keeps the one that is held; deleting comes last, and of what isn't there has no effect
    index.apply(2, docs(spark, [("b", "t", "green")]), spark.createDataFrame([("a",), ("unknown",), (None,)], "id string"))
    assert {r["id"]: r["embedding"] for r in index.records().collect()} == {"b": [0.5, 0.5], "c": None, "d": None}
    assert index.stats()["vectors"] == 1
    index.apply(3, docs(spark, [("b", "t", "red")]), spark.createDataFrame([("b",)], "id string"))
    same_ranks(spark, index, [("c", "t", "red red"), ("d", None, "blue " * 30_000)])
    asks = spark.createDataFrame([(1, "red blue")], "query_id int, text string")
    assert [r["id"] for r in index.bm25(asks, F.col("text"), 5, kind="t").collect()] == ["c"]


def test_uncommitted_rows_are_not_seen(spark, tmp_path):
    """A batch that failed before its commit leaves a folder; it is overwritten."""
    tables = SignedTables(spark, f"file://{tmp_path}/t", {"x": "k string, sign long"})
    tables._write("x", spark.createDataFrame([("lost", 1)], "k string, sign long"), "1")
    assert tables.read("x").count() == 0
    tables.apply(0, {"x": spark.createDataFrame([("a", 1), ("b", 1)], "k string, sign long")})
    tables.apply(1, {"x": spark.createDataFrame([("a", -1)], "k string, sign long")})
    assert [tuple(r) for r in tables.net("x", ["k"]).collect()] == [("b", 1)]
    tables.merge("x", ["k"])
    assert [tuple(r) for r in tables.read("x").collect()] == [("b", 1)]
    tables.clear()
    assert tables.read("x").count() == 0 and tables.apply(0, {})


def test_projection_follows_a_stream(spark, tmp_path):
    rng = random.Random(4)
    kept = Projection(spark, f"file://{tmp_path}/p", merge_every=3)
    live: list[tuple] = []
    for batch in range(5):
        gone = rng.sample(live, min(len(live), 6))
        new = []
        for i in range(15):
            name = f"{batch}-{i}"
            if rng.random() < 0.5:
                new.append(("edge", f"e{name}", rng.choice(["knows", "likes"]), rng.choice("uvw"), rng.choice("uvwx"), None, None, None, False))
            else:
                new.append(("node", f"n{name}", rng.choice(["Claim", "Agent", "Place", "Odd"]), None, None, rng.choice(["u", None]), rng.choice(["says", "has_tag", "knows", None]), rng.choice(["v", ""]), rng.random() < 0.2))
        changes = [(r[0], -1, *r[1:]) for r in gone] + [(r[0], 1, *r[1:]) for r in new]
        live = [r for r in live if r not in gone] + new
        df = spark.createDataFrame(changes, CHANGES)
        assert kept.is_stale(batch) and kept.apply(batch, df) and not kept.is_stale(batch)
        assert not kept.apply(batch, df)  # replayed
        now = spark.createDataFrame([(r[0], 1, *r[1:]) for r in live], CHANGES)
        ends = now.where("op = 'edge'")
        assert {r["id"]: r["n"] for r in kept.degrees().collect()} == {r["id"]: r["degree"] for r in retrieve.degrees(ends).collect()}
        assert {r["type"]: r["n"] for r in kept.edge_types().collect()} == {r["type"]: r["count"] for r in ends.groupBy("type").count().collect()}
        claims = now.where("type = 'Claim' AND op = 'node' AND p IS NOT NULL").select("s", "p", F.col("o").alias("o_id"), F.lit(None).cast("string").alias("o_literal"))
        assert {r[0]: r[1] for r in kept.vocabulary().collect()} == {r[0]: r[1] for r in predicates.vocabulary(ends, claims).collect()}
        census = {}
        for r in live:
            if r[0] == "node" and r[2] != "Odd" and not r[8]:
                key = (r[2], r[2] == "Claim" and r[6] == "has_tag")
                census[key] = census.get(key, 0) + 1
        assert {(r["type"], r["structural"]): r["n"] for r in kept.census().collect()} == census
    assert len(kept.tables.state()["live"]["census"]) < 4
    assert kept.apply(9, spark.createDataFrame([], CHANGES))


def brute_pairs(rows, floor):
    """Representatives of equal vectors, and all pairs of them in the band."""
    heads = {}
    for i, kind, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            key = (kind, tuple(v))
            heads[key] = min(heads.get(key, i), i)
    out = []
    for ((k1, v1), a), ((k2, v2), b) in itertools.combinations(heads.items(), 2):
        if k1 == k2 and len(v1) == len(v2):
            score = round(float(np.dot(np.array(v1) / np.linalg.norm(v1), np.array(v2) / np.linalg.norm(v2))), 6)
            if score >= floor:
                out.append((min(a, b), max(a, b), score))
    return sorted(out), heads


def vector_case(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(220, 6))
    x[60:120] = x[0] + rng.normal(size=(60, 6)) / 20  # near copies
    x[120:150] = x[1]  # copies
    rows = [(i, ["a", "b", None][i % 3] if i < 60 else "a", v.tolist()) for i, v in enumerate(np.round(x, 3))]
    return rows + [(900, "a", None), (901, "a", []), (902, "a", [0.0] * 6), (903, "a", [float("nan")] + [1.0] * 5), (904, "a", [1.0, 2.0]), (905, "a", [2.0, 4.1]), (None, "a", rows[3][2]), (7, "b", rows[7][2])]


@pytest.mark.parametrize("block", [16, 1024])
def test_cosine_pairs_brute(spark, block):
    rows = vector_case(3)
    df = spark.createDataFrame(rows, "id long, type string, embedding array<double>")
    want, heads = brute_pairs(rows, 0.65)
    got = sorted((r["a"], r["b"], round(r["score"], 6)) for r in vectors.cosine_pairs(df, 0.65, block_rows=block).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want, strict=True))
    # members: counts and components without the pairs
    near = {}
    for a, b, _ in want:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    copies = {}
    for i, kind, v in rows:
        if i is not None and v and (kind, tuple(v)) in heads:
            copies[heads[kind, tuple(v)]] = copies.get(heads[kind, tuple(v)], 0) + 1
    component = {h: h for h in copies}
    changed = True
    while changed:
        changed = False
        for a, b, _ in want:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    for r in vectors.cosine_members(df, 0.65, block_rows=block).collect():
        h = r["representative"]
        assert r["component"] == component[h] and r["n_links"] == sum(copies[x] for x in near.get(h, ())) + copies[h] - 1


def test_blocks_are_pruned_without_loss(spark):
    """Clusters far apart: most pairs of blocks never meet, and no pair is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, "a", (centres[i % 12] + rng.normal(size=16) / 15).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, type string, embedding array<double>")
    blocks = vectors.vector_blocks(vectors.folded_vectors(df), block_rows=32)
    report = vectors.pruned(blocks, 0.9).first()
    assert report["met"] < report["block_pairs"] / 2
    assert sorted((r["a"], r["b"]) for r in vectors.cosine_pairs(df, 0.9, block_rows=32).collect()) == [w[:2] for w in brute_pairs(rows, 0.9)[0]]
    assert all(b["n"] <= 32 for b in blocks.select("n").collect())


def test_no_vectors(spark):
    df = spark.createDataFrame([], "id long, type string, embedding array<double>")
    assert vectors.cosine_pairs(df, 0.5).count() == 0 and vectors.cosine_members(df, 0.5).count() == 0


def test_batch_leaders_is_the_loop(spark):
    rows = [(r["vec_id"], r["label"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "id long, type int, embedding array<double>")
    pairs = [(r["a"], r["b"], r["score"] >= 0.31, r["score"] * 2.7, r["score"]) for r in vectors.cosine_pairs(df, upkeep.BAND).collect()]
    ends = {(r[0], r[1]) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    got = {r["id"]: r["survivor"] for r in upkeep.batch_leaders(spark, SF).collect()}
    assert got == loop(pairs, [(r[0], r[0]) for r in rows], ends)
    assert any(k != v for k, v in got.items())


def test_projected_stream_keeps_no_copy_of_its_changes(spark):
    """The batches' files are gone when the stream has ended, and its argument pairs are those of what is left."""
    from collections import Counter
    from pathlib import Path

    from quillgraph.runtime import shared_dir
    from quillgraph.sources.tables import claims, edges, table

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.rglob("*.parquet"))
    kept = upkeep._projected(spark, SF)
    new = {str(p.relative_to(shared)) for p in set(shared.rglob("*.parquet")) - before}
    assert new and all("/tallies/" in name for name in new)
    done = {f"orders:{r[0]}" for r in table(spark, SF, "orders").where("o_orderstatus = 'F'").select("o_orderkey").collect()}
    want = Counter((r["type"], r["src"], r["dst"]) for r in edges(spark, SF).collect() if r["src"] not in done)
    want += Counter((r["p"], r["s"], r["o_id"] or r["o_literal"]) for r in claims(spark, SF).collect())
    assert {(r["predicate"], r["s"], r["o"]): r["n"] for r in kept.arguments().collect()} == want
