"""Exact, line and near-duplicate removal against brute force, and on odd rows."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import quillgraph.llm.near_dedup as near
from quillgraph.operators.components import connected_components
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.line_dedup import line_dedup
from tests.conftest import SF

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, n_lines string, id string, key string"
ODD = [
    (1, None, "x", "i", "k"),
    (2, "", "x", "i", "k"),
    (3, "Ä Same\nthis is one long common line\n", None, None, None),
    (4, "Ä same\nTHIS is one long common line \n", "x", "i", "k"),
    (5, "ä same\n\tthis is one long common line", "x", "i", "k"),
    (6, "word " * 30_000 + "\n" + "this is one long common line", "x", "i", "k"),
    (6, "word " * 30_000 + "\n" + "this is one long common line", "x", "i", "k"),
    (None, "Ä same\nthis is one long common line\n", "x", "i", "k"),
    (8, " \t\n ", "x", "i", "k"),
]


def write(spark, tmp_path, rows=ODD, parts=3):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(parts).write.mode("overwrite").parquet(path)
    return path


def test_exact_on_odd_rows(spark, tmp_path):
    got = exact_dedup(spark, write(spark, tmp_path)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for digest, rows in by.items():
        ids = [r["doc_id"] for r in rows]
        keep = max((i for i in ids if i is not None), default=None)
        assert all(r["keep_id"] == keep and r["group_size"] == len(rows) for r in rows)
        assert sum(r["kept"] for r in rows) == 1
        texts = {(t or "").translate(AZ) for i, t, *_ in ODD if i in ids}
        assert digest in {hashlib.sha256(t.encode()).hexdigest() for t in texts}


@pytest.mark.parametrize("options", [{"maxFilesPerTrigger": "1"}, None])
def test_exact_in_batches_and_with_colliding_digests(spark, tmp_path, options):
    rows = [(i, f"Text {i % 7}", None, None, None) for i in range(40)]
    path = write(spark, tmp_path, rows, 5)
    for chars in (64, 1):
        got = exact_dedup(spark, path, key_chars=chars, source_options=options)
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == {
            (i, max(j for j in range(40) if j % 7 == i % 7), len([j for j in range(40) if j % 7 == i % 7]), i + 7 >= 40) for i in range(40)
        }


def test_exact_empty(spark, tmp_path):
    assert exact_dedup(spark, write(spark, tmp_path, [])).collect() == []


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i)) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "id", "key", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()), key=repr) == brute_lines(ODD)
    assert line_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_lines_stay_in_the_jvm(spark):
    plan = line_dedup(spark.createDataFrame(ODD, DOCS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["common line of some length", "Another LINE of some length ", "x", "", "third line, found now and then"]), max_size=5).map("\n".join), min_size=1, max_size=9))
def test_lines_against_brute_force(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = line_dedup(spark.createDataFrame(rows, DOCS), min_docs=2)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == brute_lines(rows, min_docs=2)


def brute_near(rows, n, num, den):
    def shingles(text):
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))]
        k = min(n, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets, root = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("n", "num", "small", "block"), [(3, 85, 32, 1024), (5, 80, 1, 4), (3, 60, 1, 7)])
def test_near_against_brute_force(spark, monkeypatch, n, num, small, block):
    monkeypatch.setattr(near, "SMALL_BUCKET", small)
    monkeypatch.setattr(near, "BLOCK", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    # a chain and a crowd of near copies, none of them next to all the others
    base = [f"w{i}" for i in range(60)]
    rows += [(10_000 + k, " ".join([*base[k:], *(f"v{k}{j}" for j in range(k))])) for k in range(12)]
    rows += [(20_000 + k, " ".join(w if (i * 7 + k) % 13 else f"z{k}" for i, w in enumerate(base))) for k in range(40)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), n=n, num=num, den=100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute_near(rows, n, num, 100)


def test_near_on_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "one", "a"), (5, "ONE ", "a"), (6, "a b c d " * 9_000, "a"), (7, "a b c d " * 9_000, None), (None, "one", "a"), (9, "Ä b c", "a"), (10, "ä b c", "a")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, n string"), n=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 4, 6, True), (7, 4, 6, False), (None, 1, None, True), (9, 1, 9, True), (10, 1, 10, True)], key=repr
    )
    assert near.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_estimate_is_close(spark):
    from pyspark.sql import functions as F

    sketcher = near.Sketcher(32, 4, 4, 1)
    a, b = (near.shingle_set(" ".join(f"w{i}" for i in r), 1) for r in (range(400), range(100, 500)))
    sig = [sketcher.packed(sketcher.minima(x)).view("int64").tolist() for x in (a, b)]
    got = spark.createDataFrame([tuple(sig)], "x array<bigint>, y array<bigint>").select(near.estimated(F.col("x"), F.col("y"), 4, sketcher.words, 128)).first()[0]
    assert got == pytest.approx(0.6, abs=0.15)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_dedup_repeated_ids_are_one_document(spark):
    """Links of any text of an id are links of the id, whichever text comes first."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(30)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (5, c), (5, d), (4, d), (6, c + " x"), (7, e), (7, e), (8, f), (9, None), (9, f + " y"), (None, a)]
    for shuffled in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near.near_duplicates(spark.createDataFrame(shuffled, "doc_id bigint, text string"), n=3, num=85, den=100).collect()), key=repr)
        want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 8, None: None}
        # a row without words is linked with nothing, whatever else its id holds
        assert got == sorted(((i, i if t is None else want[i], i is None or (i if t is None else want[i]) == i) for i, t in shuffled), key=repr)
