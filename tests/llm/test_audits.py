"""The filter audit, the divergence of sources and the exact top-k search against brute force, and on odd rows."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest

from quillgraph.llm import queries
from quillgraph.llm import topk_search as topk
from quillgraph.llm.divergence import source_divergence, term_counts
from quillgraph.llm.filter_audit import document_failures, filter_audit, text_failures, trie_edges
from tests.conftest import SF
from tests.test_queries import rows


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence", "op13_topk_search"])
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


# --- 11 ---------------------------------------------------------------------------------------------------------------


def brute_audit(flags, names, marks):
    """Each order run over plain lists."""
    out, parts = {}, sorted({f["part"] or "" for f in flags})
    for part in parts:
        mine = [f for f in flags if (f["part"] or "") == part]
        taken = collections.Counter()
        for order in itertools.permutations(names):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[name]]
                left = [f for f in left if not f[name]]
                taken[name] += len(gone)
                before = [f for f in mine if f[name] and any(f[x] for x in order[: step - 1])]
                alone = sum(1 for f in mine if f[name] and not any(f[x] for x in names if x != name))
                out[part, "".join(order), step] = [len(left), len(gone), len(before), alone, *(sum(bool(f[m]) for f in gone) for m in marks)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(taken[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df, marks):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], *(r[f"lost_{m}"] for m in marks), r["shapley"]) for r in df.collect()}


def test_filter_audit_brute(spark):
    rng = random.Random(3)
    names, marks = "ABCD", ("good",)
    flags = [{"part": rng.choice(["x", "y", None, ""]), "good": rng.random() < 0.3} | {n: rng.random() < 0.4 for n in names} for _ in range(300)]
    flags += [{"part": "all gone", "good": True} | dict.fromkeys(names, True)] * 5  # repeated rows; no survivor after any filter
    df = spark.createDataFrame(flags, "part string, good boolean, A boolean, B boolean, C boolean, D boolean")
    got = audit_rows(filter_audit(df, names, marks), marks)
    assert got == brute_audit(flags, names, marks)
    assert len(got) == 4 * math.factorial(4) * 4 - 4 * 24 * (4 - len({k[0] for k in got}))


def test_trie_shares_states(spark):
    df = spark.createDataFrame([("x", True, False, False)], "part string, A boolean, B boolean, C boolean")
    edges = trie_edges(df, "ABC", ()).collect()
    # every set of filters once, and from each an edge to every filter that it lacks
    assert sorted((e["state"], e["filter"]) for e in edges) == sorted((s, f) for s in range(8) for i, f in enumerate("ABC") if not s >> i & 1)
    with pytest.raises(ValueError):
        trie_edges(df, "ABCDEFGH", ())


def test_filter_audit_odd(spark):
    kind = "part string, A boolean, B boolean, extra string"
    assert filter_audit(spark.createDataFrame([], kind), "AB").count() == 0
    got = audit_rows(filter_audit(spark.createDataFrame([(None, None, True, "q"), ("", True, None, "q")], kind), "AB"), ())
    assert got["", "AB", 1] == (1, 1, 0, 1, 2) and got["", "AB", 2] == (0, 1, 0, 1, 2)


def test_document_failures(spark):
    words = [f"w{i}" for i in range(60)]
    plain = " ".join(words)
    docs = [
        (5, plain, "a", 1), (7, plain, "b", 1), (7, plain, "b", 1), (None, plain, "a", 1), (8, plain + " ", None, 1), (1, None, "a", 1), (2, "", "a", 1), (3, " ".join(["one"] * 70), "a", 1),
        (4, "ABC " * 3 + plain, "a", 1), (6, "a|b " + plain, "a", 1), (9, "ÄÖÜ 　 " + "x\x1cy " * 60, "a", 1), (10, "word " * 200_000, "a", 1),
    ]
    marks = [(5, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)]
    got = document_failures(spark.createDataFrame(docs, "doc_id bigint, text string, source string, digest int"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    want = []
    for doc, text, source, _ in docs:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [d for d, t, *_ in docs if (t or "") == text and d is not None and doc is not None and d < doc]
        flags = (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), bool(same))
        assert text_failures(text) == flags[:4]
        want.append((source or "", *flags, doc == 5, doc == 5))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert document_failures(spark.createDataFrame([], "doc_id bigint, text string, source string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


# --- 12 ---------------------------------------------------------------------------------------------------------------


def brute_divergence(docs, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts, df, total, groups = collections.Counter(), collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        ws = terms(text)
        counts.update((lang, source, w) for w in ws)
        total.update((lang, w) for w in ws)
        df.update((lang, w) for w in set(ws))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in df.items() if x == lang and n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        price = lambda n, size: 1 + 1_000_000_000 * (n + 2) // size
        size = {s: sum(counts[lang, s, w] for w in kept) + 2 * len(kept) for s in sources}
        all_size = sum(total[lang, w] for w in kept) + 2 * len(kept)
        p = {(s, w): price(counts[lang, s, w], size[s]) for s in sources for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((sum(f(p[s, w], p[t, w]) for w in kept), t) for t in sources if t != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", t, v, r) for r, (v, t) in enumerate(pair, 1)]
            q = {w: price(total[lang, w], all_size) for w in kept}
            term = sorted(((f(p[s, w], q[w]), w) for w in kept if counts[lang, s, w] and p[s, w] > q[w]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", w, v, r) for r, (v, w) in enumerate(term[:top], 1)]
    return sorted(out)


def divergence_case(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "abcdefg" for b in ("x", "é", "zz", "ß")]
    docs = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", "é", None])
        k = {"s0": 3, "s1": 1}.get(source, 2)
        docs.append((" ".join(rng.choice(vocab[:: k if i % 2 else 1]) + rng.choice(["", "1", ",", "\x00"]) for _ in range(rng.randrange(40))).upper(), lang, source))
    return docs + [(None, "en", "s9"), ("", "xx", "only"), ("rare words", "yy", "a"), ("other ones", "yy", "b"), ("é É " * 5, "en", "s0")] + [docs[0]] * 12


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_brute(spark, seed):
    docs = divergence_case(seed)
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, source string, term string, n int")
    got = [tuple(r) for r in source_divergence(df, min_docs=10, top=10).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == brute_divergence(docs, 10, 10)


def test_divergence_odd(spark):
    kind = "text string, lang string, source string"
    assert source_divergence(spark.createDataFrame([], kind)).count() == 0
    # no kept term: pairs at distance 0, by name
    got = source_divergence(spark.createDataFrame([("a b", "x", "p"), ("c", "x", "q"), (None, "x", None)], kind))
    assert sorted(tuple(r) for r in got.collect()) == [("x", "", "pair", "p", 0, 1), ("x", "", "pair", "q", 0, 2), ("x", "p", "pair", "", 0, 1), ("x", "p", "pair", "q", 0, 2), ("x", "q", "pair", "", 0, 1), ("x", "q", "pair", "p", 0, 2)]


def test_term_counts_in_parts(spark, monkeypatch):
    """Counts that a task passes on before its end add up."""
    from quillgraph.llm import divergence

    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    docs = [("a b c d e a", "x", "p"), ("a b " * 50_000, "x", "p"), ("d e f", "x", "q")]
    got = {(r["source"], r["term"]): (r["n"], r["df"]) for r in term_counts(spark.createDataFrame(docs, "text string, lang string, source string")).collect()}
    assert got == {("p", "a"): (50_002, 2), ("p", "b"): (50_001, 2), ("p", "c"): (1, 1), ("p", "d"): (1, 1), ("p", "e"): (1, 1), ("q", "d"): (1, 1), ("q", "e"): (1, 1), ("q", "f"): (1, 1)}


# --- 13 ---------------------------------------------------------------------------------------------------------------


def brute_topk(vectors, k, scale=256):
    whole = []
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(scale * float(x)) for x in v]))
    out = []
    asks = {}
    for i, v in whole:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, v), v)
    for q, a in asks.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in whole if i != q and len(v) == len(a))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, vectors, k=5, shard_rows=topk.SHARD_ROWS, **options):
    df = spark.createDataFrame([(i, v, 1.5) for i, v in vectors], "vec_id bigint, embedding array<double>, score double")
    asks = df.where("vec_id % 50 = 0").select(df["vec_id"].alias("query_id"), "embedding")
    return sorted(tuple(r) for r in topk.search(topk.build_index(df, shard_rows=shard_rows), asks, k, **options).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shape", ["random", "copies", "near copies", "small numbers", "one large part", "lengths"])
def test_topk_brute(spark, shape):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 24)) / 5
    if shape == "copies":
        x[300:900] = x[0]
    if shape == "near copies":
        x[300:900] = x[50] + rng.normal(size=(600, 24)) / 300
    if shape == "small numbers":
        x /= 100
    if shape == "one large part":
        x[:, 3] += 40_000
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    if shape == "lengths":
        vectors = [(i, v[: 3 + i % 4]) for i, v in vectors] + [(5000, []), (5001, []), (5002, None)]
    assert found(spark, vectors, shard_rows=256, question_bytes=1500) == brute_topk(vectors, 5)


def test_topk_stops_early_on_proof():
    """Vectors with one large part: the first segment tells them apart, and the others aren't read."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (2000, 32))
    x[np.arange(2000), rng.integers(0, 32, 2000)] = rng.integers(2000, 4000, 2000)
    shard = topk.Shard.of(topk._packed(np.arange(2000), x))
    best = topk.Best.none(40, 5)
    read = topk.search_shard(shard, np.arange(40), x[:40], best)
    assert read < 40 * len(shard.segments) / 2
    scores = x[:40] @ x.T
    scores[np.arange(40), np.arange(40)] = -(10**12)
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def test_topk_errors_bound():
    """What an index says of a vector after each segment is never further from it than its error."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(50, 9)) * 10 ** rng.uniform(0, 5, (50, 1))).astype(np.int64)
    shard = topk.Shard.of(topk._packed(np.arange(50), x))
    seen, plane = np.zeros((9, 50)), np.empty((9, 50), np.float32)
    for place in range(len(shard.segments)):
        shard.plane(place, plane)
        seen += plane
        assert (np.sqrt(((x - seen.T) ** 2).sum(1)) <= shard.errors[place]).all()
    assert (np.abs(x - seen.T) <= np.abs(x) / 8 + 1).all()
    assert [s["octave"] for s in shard.segments] == sorted((s["octave"] for s in shard.segments), reverse=True)


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    vectors = [(0, [1.0, -0.001]), (50, [nan, 1.0]), (100, None), (None, [1.0, 1.0]), (1, [inf, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [None, 1.0]), (5, [0.0, 0.0]), (150, [0.0, 0.0])]
    assert found(spark, vectors) == brute_topk(vectors, 5)
    # rows that repeat an id: each a candidate, the least vector asks, none is its own candidate
    vectors = [(0, [2.0]), (0, [1.0]), (7, [3.0]), (7, [4.0]), (7, [4.0]), (8, [-1.0])]
    assert found(spark, vectors) == brute_topk(vectors, 5)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e15]), (1, [1e15])])
    # beyond what floats hold exactly, in integers
    vectors = [(0, [1e6, 3.0]), (1, [1e6 + 1 / 256, -5.0]), (2, [1e6, 7.0])]
    assert found(spark, vectors) == brute_topk(vectors, 5)
    wide = [(50 * i, np.random.default_rng(i).normal(size=3000).tolist()) for i in range(3)]
    assert found(spark, wide) == brute_topk(wide, 5)
