"""Claims as seeds, packs by recursion, edited texts and batched embedding against brute force and on odd rows."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import embedding
from quillgraph.functions.udfs import embedding_of
from quillgraph.operators import graph, incremental, lookups
from quillgraph.plans import walks
from quillgraph.sources import packs
from tests.conftest import SF

CLAIM = "id string, s string, p string, o_id string, o_literal string, confidence double, block_id string, superseded boolean"
CAP = 3


def claim(id_, s, p, o_id=None, o_literal=None, confidence=0.5, block_id="b", superseded=False):
    return (id_, s, p, o_id, o_literal, confidence, block_id, superseded)


def coverage(pool, terms):
    """Inverse frequencies of the terms that each claim of a pool covers."""
    words = {c[0]: set(re.findall("[a-z0-9]+", f"{c[2].replace('_', ' ')} {c[4] or ''}".lower())) for c in pool}
    df = {t: sum(t in w for w in words.values()) for t in terms}
    return {i: round(sum(math.log(1 + (len(pool) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms if t in w), 9) for i, w in words.items()}


def brute_seeds(claims, seeds, terms):
    out = []
    fine = {c[0]: c for c in claims if not c[7]}
    for seed in sorted(set(seeds)):
        own = fine.get(seed)
        if own is None or not own[1]:
            continue
        near = [c for c in fine.values() if c[0] != seed and own[6] and c[6] == own[6] and own[1] in (c[1], c[3])]
        score = coverage([own, *near], terms.get(seed, set()))
        near.sort(key=lambda c: (-score[c[0]], -c[5], c[0]))
        out += [(seed, c[0], r, round(score[c[0]], 6)) for r, c in enumerate([own, *near[:CAP]])]
    return sorted(out)


def seeds_of(spark, claims, seeds, terms, **options):
    made = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    words = made([(s, t) for s, ts in terms.items() for t in ts], "seed string, term string")
    return graph.claim_seeds(made(claims, CLAIM), made([(s,) for s in seeds], "seed string"), words, **options)


def random_claims(seed, n=80):
    rng = random.Random(seed)
    ends = "uvwxyz"
    out = []
    for i in range(n):
        literal = rng.random() < 0.3
        out.append(claim(f"c{i:02}", rng.choice([*ends, None, ""]), rng.choice(["likes_red", "has_blue", "is"]), None if literal else rng.choice(ends), rng.choice(["red", "green tea"]) if literal else None, rng.choice([0.5, 0.9]), rng.choice(["b1", "b2", None]), rng.random() < 0.1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_claim_seeds_brute(spark, seed):
    claims = random_claims(seed)
    asked = [c[0] for c in claims[::3]] + ["unknown", "c00"]
    terms = {s: {"red", "blue", "tea"} if i % 2 else set() for i, s in enumerate(asked)}
    got = sorted((r["seed"], r["id"], r["rank"], round(r["coverage"], 6)) for r in seeds_of(spark, [*claims, claims[3]], asked, terms).collect())
    assert got == brute_seeds(claims, asked, terms)


def test_claim_seeds_gates_and_vectors(spark):
    claims = [claim("a", "x", "says", o_literal="one"), claim("b", "x", "likes", "y"), claim("c", "y", "knows", "x"), claim("d", "x", "says", o_literal="two", confidence=0.1)]
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert ids(seeds_of(spark, claims, ["a"], {})) == ["a", "b", "c", "d"]
    assert ids(seeds_of(spark, claims, ["a"], {}, min_confidence=0.2)) == ["a", "b", "c"]
    assert ids(seeds_of(spark, claims, ["a"], {}, allowed=["says", "knows"])) == ["a", "c", "d"]
    near = spark.createDataFrame([("a", "c", 0.9)], "seed string, id string, cosine double")
    assert ids(seeds_of(spark, claims, ["a"], {}, cap=1, similarity=near)) == ["a", "c"]
    assert seeds_of(spark, [], [], {}).count() == 0


def brute_ego(claims, seeds, terms, cap, hops):
    out = []
    fine = [c for c in claims if not c[7]]
    for seed in seeds:
        ts = terms.get(seed, set())
        near = [x for x in brute_seeds(claims, [seed], terms)]
        if not near:
            continue
        by_id = {c[0]: c for c in fine}
        found = [(1, by_id[i], score) for _, i, _, score in near]
        frontier, known = [by_id[seed][1]], {by_id[seed][1]}
        for hop in range(1, hops + 1):
            rows = []
            for entity in frontier:
                pool = [c for c in fine if entity in (c[1], c[3])]
                score = coverage(pool, ts)
                pool.sort(key=lambda c: (-score[c[0]], -c[5], c[0]))
                rows += [(hop, c, round(score[c[0]], 6)) for c in pool[: cap if hop == 1 else max(cap // 2, 4)]]
            found += rows
            named = {}
            for _, c, s in found if hop == 1 else rows:
                for e in (c[1], c[3]):
                    if e is not None and e not in known:
                        named[e] = max(named.get(e, (-1.0, -1.0)), (s, c[5]))
            frontier = [e for e, _ in sorted(sorted(named.items()), key=lambda x: x[1], reverse=True)][:cap]
            # ties by name
            frontier = sorted(named, key=lambda e: (tuple(-v for v in named[e]), e))[:cap]
            known |= set(frontier)
        facts = {}
        for hop, c, s in found:
            key = (c[1], c[2], c[3] if c[3] is not None else "\x1f" + str(c[4]))
            rank = (hop, -s, -c[5], c[0])
            if key not in facts or rank < facts[key][0]:
                facts[key] = (rank, (seed, hop, c[0], s))
        out += [v for _, v in facts.values()]
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 2])
def test_claim_ego_brute(spark, hops):
    claims = [c for c in random_claims(7, 60) if c[1]]
    asked = [c[0] for c in claims[::5]]
    terms = {s: {"red", "blue"} for s in asked}
    made = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    words = made([(s, t) for s, ts in terms.items() for t in ts], "seed string, term string")
    got = graph.claim_ego_graph(made(claims, CLAIM), made([(s,) for s in asked], "seed string"), words, cap=4, hops=hops).collect()
    assert sorted((r["seed"], r["hop"], r["id"], round(r["coverage"], 6)) for r in got) == brute_ego(claims, asked, terms, 4, hops)


def closure(spark, names, edges, **options):
    found = packs.import_closure(spark.createDataFrame([(n,) for n in names], "pack string"), spark.createDataFrame(edges, "pack string, import string"), **options)
    return found, {r["root"]: (r["n_packs"], r["depth"], r["fault"]) for r in packs.loadable(found).collect()}


def test_imports(spark):
    found, got = closure(spark, ["a", "b", "c", "d", None], [("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("d", "d"), (None, "a"), ("c", None)])
    assert got == {"a": (3, 2, None), "b": (2, 1, None), "c": (1, 0, None), "d": (1, 0, "self_import")}
    assert sorted(r["path"] for r in found.where("root = 'a' AND pack = 'c'").collect()) == [["a", "b", "c"], ["a", "c"]]
    found, got = closure(spark, ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "gone")])
    assert got["a"] == (3, 2, "circular_import") and got["c"] == (3, 2, "unknown_pack")
    assert found.where("fault = 'circular_import' AND root = 'a'").first()["path"] == ["a", "b", "c", "a"]
    chain = [f"p{i:02}" for i in range(40)]
    _, got = closure(spark, chain, list(zip(chain, chain[1:], strict=False)))
    assert got["p08"] == (32, 31, None) and got["p07"] == (32, 31, "too_deep") and got["p00"][2] == "too_deep"
    assert closure(spark, [], [])[1] == {}


def test_imports_agree_with_loading(spark):
    """The same as the loader that reads manifests one after the other."""
    rng = random.Random(1)
    names = [f"pack-{i}" for i in range(9)]
    edges = [(a, b) for a in names for b in names if a < b and rng.random() < 0.4]
    _, got = closure(spark, names, edges)
    fetch = lambda name: f"id: {name}\nversion: 1.0.0\nimports: [{', '.join(b for a, b in edges if a == name)}]"
    assert {n: got[n][0] for n in names} == {n: len(packs.load(n, fetch)) for n in names}


BLOCK = "path string, id string, block_index int, byte_start long, byte_end long, content_hash string, raw binary"
OLD = "path string, block_index int, content_hash string, text string, has_claims boolean"


def test_extraction_units(spark):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    block = lambda i, raw, start=0: ("f", f"n{i}", i, start, start + len(raw or b""), sha(raw or b""), raw)
    old = [("f", 0, sha(b"kept"), "kept", True), ("f", 1, "x", "one\ntwo\nthree", True), ("f", 2, "y", "same", False), ("f", 3, "z", "gone\nstays", True), ("f", 5, "a", None, True), ("f", 6, "q2", "lost", False), ("f", 6, "q1", "held", True)]
    new = [block(9, b"kept"), block(1, "one\nTWÖ\nthree\nfour\n".encode(), 100), block(2, b"same"), block(3, b"stays"), block(4, b"new"), block(5, None), block(6, b"held"), block(7, b"kept")]
    got = incremental.extraction_units(spark.createDataFrame(old, OLD), spark.createDataFrame([*new, new[4]], BLOCK))
    rows = {(r["block_id"], r["byte_start"]): (r["byte_end"], r["text"], r["whole"], r["content_hash"]) for r in got.collect()}
    assert rows == {
        ("n1", 104): (109, "TWÖ", False, sha("TWÖ\n".encode())), ("n1", 115): (120, "four", False, sha(b"four\n")),
        ("n2", 0): (4, "same", True, sha(b"same")),  # never extracted before
        ("n4", 0): (3, "new", True, sha(b"new")), ("n5", 0): (0, "", True, sha(b"")),
    }
    none = incremental.extraction_units(spark.createDataFrame([], OLD), spark.createDataFrame([], BLOCK))
    assert none.count() == 0


def test_units_and_old_texts_make_the_new_ones(spark):
    """Of every edited block, the lines outside its units are lines of the old block in order, and units have the file's bytes."""
    old, new = walks.edited(spark, SF)
    units = collections.defaultdict(list)
    for u in incremental.extraction_units(old, new).collect():
        units[u["block_id"]].append(u)
    before = {(r["path"], r["block_index"]): r for r in old.collect()}
    settled = {(r["path"], r["content_hash"]) for r in before.values() if r["has_claims"]}
    checked = 0
    for b in new.collect():
        raw, mine = bytes(b["raw"]), sorted(units.pop(b["id"], []), key=lambda u: u["byte_start"])
        assert hashlib.sha256(raw).hexdigest() == b["content_hash"]
        prior = before.get((b["path"], b["block_index"]))
        if (b["path"], b["content_hash"]) in settled:
            assert not mine
            continue
        if any(u["whole"] for u in mine) or prior is None:
            assert len(mine) == 1 and mine[0]["whole"]
            continue
        at, rest = b["byte_start"], b""
        for u in mine:
            piece = raw[u["byte_start"] - b["byte_start"] : u["byte_end"] - b["byte_start"]]
            assert hashlib.sha256(piece).hexdigest() == u["content_hash"] and piece.decode("utf-8", "replace").strip() == u["text"]
            rest += raw[at - b["byte_start"] : u["byte_start"] - b["byte_start"]]
            at = u["byte_end"]
        rest += raw[at - b["byte_start"] :]
        lines = iter(x.rstrip() for x in prior["text"].splitlines())
        assert all(any(y == x for y in lines) for x in (z.decode("utf-8", "replace").rstrip() for z in rest.splitlines()) if x)
        checked += bool(mine)
    assert not units and checked > 20


def test_embedding_is_the_same_for_any_batches(spark):
    rows = [(i, None if i % 11 == 5 else f"text {i} " * (i % 7) if i % 13 else "", f"x{i}") for i in range(200)] + [(7, "long " * 20_000, "y"), (7, "long " * 20_000, "y")]
    df = spark.createDataFrame(rows, "id int, text string, embedding string")
    want = sorted((i, None if t is None else [round(v, 12) for v in embedding_of(t)]) for i, t, _ in rows if t is not None)
    for parts, most, tokens in ((1, 32, 8192), (5, 3, 100), (3, 256, 10)):
        got = embedding.embed_in_batches(df.repartition(parts), most_texts=most, most_tokens=tokens).collect()
        assert sorted((r["id"], [round(v, 12) for v in r["embedding"]]) for r in got if r["text"] is not None) == want
        assert all(r["embedding"] is None for r in got if r["text"] is None) and len(got) == len(rows)
    assert embedding.embed_in_batches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        embedding.embed_in_batches(df, most_texts=0)


def test_calls_are_bounded_and_repeated_alone():
    calls, failing = [], {"bad once": 1}

    def embed(texts):
        calls.append(list(texts))
        for t in texts:
            if failing.get(t, 0) > 0:
                failing[t] -= 1
                raise OSError("away")
            if t == "never":
                raise ValueError("never")
        return [[float(len(t))] for t in texts]

    assert embedding._vectors(embed, ["a", "bad once", "ccc"], 2, 0) == [[1.0], [8.0], [3.0]]
    assert calls == [["a", "bad once", "ccc"]] * 2
    calls.clear()
    with pytest.raises(ValueError, match="never"):
        embedding._vectors(embed, ["a", "b", "never"], 1, 0)
    assert calls == [["a", "b", "never"], ["a"], ["b", "never"], ["b"], ["never"]]
    with pytest.raises(ValueError, match="0 vectors"):
        embedding._vectors(lambda texts: [], ["a"], 1, 0)


def test_reembedding_keeps_the_rest(spark):
    nodes = spark.createDataFrame([("a", "Red", "tea", [1.0], "src"), ("b", None, "blue", None, None)], "id string, title string, content string, embedding array<double>, provenance string")
    got = {r["id"]: r for r in embedding.reembedded(nodes, lambda texts: embedding.stub(texts, 24)).collect()}
    assert got["a"]["embedding"] == pytest.approx(embedding_of("Red tea", 24)) and got["b"]["embedding"] == pytest.approx(embedding_of("blue", 24))
    assert got["a"]["provenance"] == "src" and set(got["a"].asDict()) == {"id", "title", "content", "embedding", "provenance"}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in walks.embedded_documents(spark, SF).where(F.col("doc_id") < 20).collect():
        assert r["embedding"] == pytest.approx(embedding_of(docs[r["doc_id"]]))


def test_canonical_copies_turn_relations_round(spark):
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    kin = made([("a2", "a"), ("a", "a")], "member_id string, canonical_id string")
    alias, inverse = (made(r, "predicate string, canonical string") for r in ([("has", "holds")], [("held_by", "holds"), ("held_by", "holds")]))
    lines = made([("holds", "a", "x"), ("held_by", "x", "a2"), ("has", "a2", "x"), ("has", "a", "a2"), ("held_by", None, "a"), ("near", "x", "a2")], "type string, src string, dst string")
    got = sorted((r["type"], r["src"], r["dst"]) for r in graph.canonical_edges(lines, kin, alias, inverse).collect())
    assert got == [("holds", "a", "x"), ("near", "x", "a")]
    said = made([("k1", "a", "holds", "x", None, 0.5), ("k2", "x", "held_by", "a2", None, 0.9), ("k3", "x", "held_by", None, "someone", 0.7), ("k4", "a2", "has", "a", None, 0.9)], "id string, s string, p string, o_id string, o_literal string, confidence double")
    got = sorted(((r["s"], r["p"], r["o_id"], r["o_literal"], r["corroboration"], r["confidence"]) for r in graph.canonical_copy(said, kin, alias, inverse).collect()), key=repr)
    assert got == [("a", "holds", "x", None, 2, 0.9), ("x", "held_by", None, "someone", 1, 0.7)]
    assert sorted(r["id"] for r in graph.canonical_nodes(made([("a",), ("a2",), ("x",)], "id string"), kin).collect()) == ["a", "x"]
    assert graph.canonical_edges(lines.limit(0), kin, alias).count() == 0


def test_node_pages(spark):
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    nodes = made([("a", "Agent", "A"), ("b", "Place", None), ("c", "Place", "C")], "id string, type string, title string")
    lines = made([("t", "a", "a"), ("t", "b", "a"), ("u", "a", "gone")], "type string, src string, dst string")
    kin = made([("a", "z")], "member_id string, canonical_id string")
    asked = made([("a",), ("a",), ("c",), ("unknown",), (None,)], "id string")
    got = sorted((tuple(r) for r in lookups.node_edges(asked, nodes, lines, kin).collect()), key=repr)
    page = ("a", "Agent", "A", "z")
    assert got == sorted([(*page, "out", "t", "a", "A"), (*page, "in", "t", "a", "A"), (*page, "in", "t", "b", None), (*page, "out", "u", "gone", None), ("c", "Place", "C", "c", None, None, None, None)], key=repr)


def test_claims_of_a_hub_are_ranked_once_for_a_question(spark):
    """Many seeds of one subject that ask the same shuffle its claims once, not once each."""
    claims = spark.range(600).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("hub").alias("s"), F.lit("is").alias("p"), F.concat(F.lit("o"), "id").alias("o_id"), F.lit(None).cast("string").alias("o_literal"), (F.col("id") / 1000).alias("confidence"), F.concat(F.lit("b"), "id").alias("block_id"))
    seeds = claims.select(F.col("id").alias("seed"))
    store = spark.sparkContext._jsc.sc()

    def shuffled():
        store.listenerBus().waitUntilEmpty(30_000)
        return store.statusStore().executorList(True).head().totalShuffleWrite()

    before = shuffled()
    got = graph.claim_ego_graph(claims, seeds, seeds.withColumn("term", F.lit("is")), cap=2).where("seed = 'c5'").collect()
    assert sorted(r["id"] for r in got) == ["c5", "c598", "c599"]
    assert shuffled() - before < 2_000_000
