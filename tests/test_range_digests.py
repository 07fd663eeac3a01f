"""Members of a graph, their folds, and differences read from the ranges that differ alone."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import range_digests as R

NODE, CLAIM = "id string, type string, title string, infra boolean", "id string, s string, p string, o_id string, o_literal string, superseded boolean"


def opaque(kind, value):
    return "sha256:" + hashlib.sha256(kind.encode() + b"\0" + value.encode()).hexdigest()


def brute(nodes, claims):
    """The members, one after the other."""
    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    key = lambda t: " ".join((t or "").casefold().split())
    groups, value = collections.defaultdict(list), {}
    for i, kind, title, infra in nodes:
        if not infra:
            value[i] = {"surface": key(title), "type": kind}
            if kind in ("Agent", "Concept"):
                groups[kind, key(title)].append(i)
    for (kind, surface), ids in groups.items():
        for n, i in enumerate(sorted(ids), 1):
            value[i] = {"identity": {"surface": surface, "type": kind}, "ordinal": n}
    out = [("identities", opaque("identity", canon(value[i]))) for ids in groups.values() for i in ids]
    live = [c for c in claims if not c[5] and (c[2] or "").strip() not in ("has_tag",)]
    out += [("predicates", opaque("predicate", p)) for p in {(c[2] or "").strip() for c in live}]
    for _, s, p, o, literal, _ in live:
        end = lambda x: value.get(x, {"missing": True})
        thing = {"kind": "entity", "value": end(o)} if o is not None else {"kind": "literal", "type": "NoneType" if literal is None else "str", "value": literal}
        out.append(("relations", opaque("relation", canon({"subject": end(s), "predicate": (p or "").strip(), "object": thing}))))
    return sorted(out)


def case(seed=1, n=120):
    rng = random.Random(seed)
    nodes = [(f"n{i}", rng.choice(["Agent", "Concept", "Claim"]), rng.choice(["Tea", "tea ", "Kettle", None, 'Say "hi"', "Öl"]), rng.random() < 0.1) for i in range(n)]
    claims = [(f"k{i}", f"n{rng.randrange(n + 5)}", rng.choice(["likes", " has_tag", "says", None]), rng.choice([f"n{rng.randrange(n)}", None]), rng.choice(["x", 'quote " and \\ ', None, "ü"]), rng.random() < 0.1) for i in range(200)]
    return nodes, claims + [claims[0]]


def members(spark, nodes, claims):
    return R.semantic_members(spark.createDataFrame(nodes, NODE), spark.createDataFrame(claims, CLAIM))


def test_members(spark):
    nodes, claims = case()
    got = sorted((r["dimension"], r["member"]) for r in members(spark, nodes, claims).collect())
    assert got == brute(nodes, claims)
    assert members(spark, [], []).count() == 0


def test_ids_dont_matter(spark):
    """Another vault with the same knowledge under other ids has the same stamps."""
    nodes = [("a1", "Agent", "Casey", False), ("a2", "Concept", "Tea", False)]
    claims = [("k", "a1", "likes", "a2", None, False)]
    other = [("z9", "Agent", "Casey", False), ("z1", "Concept", " TEA", False)], [("q", "z9", "likes", "z1", None, False)]
    assert members(spark, nodes, claims).exceptAll(members(spark, *other)).count() == 0


def tree(spark, path, rows, depth=2):
    return R.DigestTree(spark, f"file://{path}", depth).write(spark.createDataFrame(rows, "dimension string, member string"))


def test_one_change_reads_one_range(spark, tmp_path):
    rows = [("d", opaque("x", str(i))) for i in range(3000)]
    a = tree(spark, tmp_path / "a", rows)
    b = tree(spark, tmp_path / "b", [*rows[:77], ("d", opaque("x", "new")), *rows[78:]])
    ranges = a.differing(b)
    assert set(ranges) == {rows[77][1][7:9], opaque("x", "new")[7:9]}
    assert {tuple(r) for r in a.difference(b).select("dimension", "member", "change").collect()} == {("d", rows[77][1], "removed"), ("d", opaque("x", "new"), "added")}
    plan = a.members(ranges)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan
    assert a.members(ranges).count() < 60
    assert a.stamp().first()["stamp"] != b.stamp().first()["stamp"]


def test_differences_are_those_of_the_multisets(spark, tmp_path):
    rng = random.Random(5)
    left = [(rng.choice("pq"), opaque("x", str(rng.randrange(60)))) for _ in range(300)]
    right = left[20:] + [("p", opaque("x", "1"))] * 3 + [("r", opaque("x", "2"))]
    a, b = tree(spark, tmp_path / "a", left, 1), tree(spark, tmp_path / "b", right, 1)
    want, other = collections.Counter(left), collections.Counter(right)
    got = collections.Counter((r["dimension"], r["member"], r["change"]) for r in a.difference(b).collect())
    assert got == collections.Counter({(*k, "removed"): n for k, n in (want - other).items()} | {(*k, "added"): n for k, n in (other - want).items()})
    # the same rows in another order and other partitions
    same = R.DigestTree(spark, f"file://{tmp_path}/c", 1).write(spark.createDataFrame(left[::-1], "dimension string, member string").repartition(7))
    assert a.differing(same) == [] and a.difference(same).count() == 0
    assert sorted(map(tuple, a.stamp().collect())) == sorted(map(tuple, same.stamp().collect()))


def test_empty_trees(spark, tmp_path):
    a, b = tree(spark, tmp_path / "a", []), tree(spark, tmp_path / "b", [("d", opaque("x", "1"))])
    assert a.differing(a) == [] and a.stamp().count() == 0
    assert [r["change"] for r in a.difference(b).collect()] == ["added"] and [r["change"] for r in b.difference(a).collect()] == ["removed"]
    with pytest.raises(ValueError):
        a.differing(R.DigestTree(spark, f"file://{tmp_path}/b", 1))
    with pytest.raises(ValueError):
        R.DigestTree(spark, "x", 9)


def test_canonical(spark):
    row = spark.range(1).select(R.canonical_json(b=F.lit("ü"), a=F.lit(None).cast("string"), c=F.lit(2)).alias("j")).select("j", R.canonical_hash(F.col("j")).alias("h")).first()
    assert row["j"] == '{"a":null,"b":"ü","c":2}' and row["h"] == "sha256:" + hashlib.sha256(row["j"].encode()).hexdigest()
