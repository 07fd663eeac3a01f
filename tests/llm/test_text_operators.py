"""Decontamination, language model, classifiers, URL filter, HTML and mixing against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import html_extract as html
from quillgraph.llm import lm_scoring
from quillgraph.llm.decontaminate import BenchmarkIndex, covered, decontaminate
from quillgraph.llm.common import tokens_of, words_alnum
from quillgraph.llm.lm_scoring import lm_scores, row_key
from quillgraph.llm.mixing import min_cost_flow, mix, route, targets
from quillgraph.llm.quality import Discriminant, fit_quality, quality_scores, statistics
from quillgraph.llm.toxicity import fit_toxicity, nn_risk, toxicity_scores, word_buckets
from quillgraph.llm.url_filter import UrlJudge, host_and_path, judge_urls
from tests.conftest import SF

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
ODD = [(1, None, "x"), (2, "", "x"), (3, "!!! ...", None), (4, "one two three", "x"), (4, "one two three", "x"), (None, "Two three, four; " * 20_000, "x"), (7, "Ä ß é", "x")]
KIND = "doc_id bigint, text string, n_words string"


def brute_decon(rows, items, window=10):
    wins = collections.defaultdict(set)
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wins[tuple(ws[i : i + n])].add(item)
    out = []
    for doc, text, *_ in rows:
        ws, hit, found = words(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(ws) - n + 1):
                if owners := wins.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        names = ",".join(sorted("" if x is None else str(x) for x in found))
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [32_000_000, 0])
def test_decontamination(spark, size):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((30, 12, 10, 9, 4, 1, 0))] + [(1, text(14)), (None, "only this one"), (50, None)]
    docs = ODD + [(100 + i, text(20) + " " + items[i % 9][1].upper() + ", " + text(15), "x") for i in range(20)]
    got = decontaminate(spark.createDataFrame(docs, KIND), spark.createDataFrame(items, "item_id bigint, text string"), max_index_bytes=size).drop("items")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_decon(docs, items)


def test_decontamination_extends_hits():
    rng = random.Random(8)
    text = lambda n, letters="ab": [rng.choice(letters) for _ in range(n)]
    for trial in range(150):
        # few different words: windows repeat, ties between hashes are common, hits overlap
        items = [(i, " ".join(text(rng.randrange(0, 24), "abc"[: 1 + trial % 3]))) for i in range(4)]
        doc = " ".join(text(60, "abc"[: 1 + trial % 3]))
        index = BenchmarkIndex(items, 10, 5)
        got = index.spans(doc.encode().split())
        row = brute_decon([(1, doc)], items)[0]
        assert covered(60, [x[:2] for x in got]) == row[2] and len({x[2] for x in got}) == row[3]


def test_benchmark_index_is_small():
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 300))) for i in range(1500)]
    size = sum(len(t) for _, t in items)
    index = BenchmarkIndex(items, 10, 5)
    assert len(pickle.dumps(index)) < 4 * size and index.nbytes < 4 * size


@pytest.mark.parametrize("size", [32_000_000, 0])
def test_decontamination_of_nothing(spark, size):
    none, items = spark.createDataFrame([], KIND), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(none, items, max_index_bytes=size - 1 if not size else size).collect() == []
    assert not any(r["contaminated"] for r in decontaminate(spark.createDataFrame(ODD, KIND), items).collect())


def brute_lm(rows, order, discount=0.4):
    texts = [words(t) for _, t, *_ in rows]
    grams = [[collections.Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) for n in range(1, order + 1)] for ws in texts]
    total = [sum((g[n] for g in grams), collections.Counter()) for n in range(order)]
    size, out = sum(map(len, texts)), []
    for (doc, *_), ws, own in zip(rows, texts, grams, strict=True):
        left = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(ws)):
            s = max(left((ws[i],)), 1) / max(size - len(ws), 1)
            for n in range(2, min(order, i + 1) + 1):
                g = tuple(ws[i - n + 1 : i + 1])
                s = left(g) / left(g[:-1]) if left(g) > 0 and left(g[:-1]) > 0 else discount * s
            score += math.log(s)
        out.append((doc, len(ws), round(score, 6), round(score / len(ws), 6) if ws else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("order", "settings"), [(3, {}), (3, {"pass_bytes": 60_000}), (3, {"pass_bytes": 60_000, "broadcast_words": 0}), (2, {"broadcast_words": 0}), (2, {"pass_bytes": 100_000}), (1, {}), (1, {"broadcast_words": 0})])
def test_language_model(spark, order, settings):
    rng = random.Random(order)
    docs = ODD + [(10 + i, " ".join(rng.choice(["the", "of", "a", "cat", "dog", f"r{i}"]) for _ in range(40)), "x") for i in range(12)] + [(30 + i, w, None) for i, w in enumerate(("the", "the cat", "the cat of", "r1 r2 r3 r4"))]
    got = lm_scores(spark.createDataFrame(docs, KIND), order=order, **settings)
    rows = sorted(((r[0], r[1], round(r[2], 6), None if r[3] is None else round(r[3], 6)) for r in got.collect()), key=repr)
    for a, b in zip(rows, brute_lm(docs, order), strict=True):
        assert a == pytest.approx(b, abs=1e-5, nan_ok=True) if a[0] is not None and a[3] is not None else a[:2] == b[:2]
    assert not spark.sql("SHOW TABLES").where("tableName LIKE 'lm_counts%'").count()


def test_language_model_of_nothing(spark):
    assert lm_scores(spark.createDataFrame([], KIND)).collect() == []
    with pytest.raises(ValueError, match="order"):
        lm_scores(spark.createDataFrame([], KIND), order=4)


def test_language_model_reads_texts_once(spark):
    """However many passes and slices there are; and the result doesn't depend on them."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(900))) for i in range(60)], "doc_id bigint, text string").repartition(3)
    want = sorted((r[0], r[1], round(r[2], 6)) for r in lm_scores(docs).collect())
    got = sorted((r[0], r[1], round(r[2], 6)) for r in lm_scores(docs.mapInArrow(seen, docs.schema), passes=3, slices=3, pass_bytes=10_000).collect())
    assert got == want and read.value == 60


def shuffled_rows(spark):
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("order", [2, 3])
def test_language_model_shuffles_many_ngrams_a_row(spark, order):
    """Rows cost the CPU seconds of a shuffle: there are far fewer than n-grams, and none is lost."""
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice(["the", "of", f"w{rng.randrange(50_000)}", f"w{rng.randrange(50)}"]) for _ in range(900)), None) for i in range(150)]
    frame = spark.createDataFrame(docs, KIND).coalesce(2)
    before = shuffled_rows(spark)
    got = sorted((r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in lm_scores(frame, order=order, pass_bytes=200_000).collect())
    rows = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    distinct = len({tuple(ws[i : i + n]) for ws in (words(t) for _, t, _ in docs) for n in range(1, order + 1) for i in range(len(ws) - n + 1)})
    assert distinct > 50_000 and rows < distinct / 50
    for a, b in zip(got, sorted(brute_lm(docs, order)), strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_language_model_orders_hashes_that_agree_in_high_bits():
    rng = np.random.default_rng(4)
    for high, low in ((8, 5), (1, 4000), (1 << 40, 1 << 20), (1 << 40, 2), (1, 1)):
        keys = (rng.integers(0, high, 5000, dtype=np.uint64) << np.uint64(24)) + rng.integers(0, low, 5000, dtype=np.uint64)
        for part in (keys, keys[:1], keys[:2], keys[:0], np.full(40, keys[0]), np.array([2**64 - 1, 0, 2**64 - 2, 0], np.uint64)):
            assert lm_scoring._order(part).tolist() == np.argsort(part, kind="stable").tolist()


def test_sums_of_a_large_prefix_need_little_space_and_are_exact():
    import tracemalloc

    rng = np.random.default_rng(3)
    chunks, size = 300, 4_000
    lists = [np.sort(rng.choice(2_000_000, size, replace=False)).astype(np.uint64) << np.uint64(43) for _ in range(chunks)]
    keys, n = np.concatenate(lists).view(np.int64), rng.integers(1, 9, chunks * size).astype(np.int32)
    ends = np.arange(chunks + 1) * size
    rows = pa.table({"prefix": np.zeros(chunks, np.int64), "chunk": np.arange(chunks), "keys": lm_scoring._list(ends, keys), "n": lm_scoring._list(ends, n)})
    tracemalloc.start()
    found = lm_scoring._sums(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    _, of = np.unique(keys.view(np.uint64), return_inverse=True)
    want = np.bincount(of, n).astype(np.int64)[of] - n
    assert lm_scoring._flat(found.column("others")).tolist() == want.tolist()
    assert peak < 24 * len(keys)
    # one chunk's n-grams in other documents, the same in many ranges and in one
    docs = np.sort(rng.integers(0, 50, len(keys)))
    others = rng.integers(0, 9, of.max() + 1)
    each = lm_scoring._elsewhere(keys.view(np.uint64), docs, others, 1_000)
    own = np.unique(of * 50 + docs, return_inverse=True, return_counts=True)
    assert each.tolist() == (others[of] + np.bincount(of)[of] - own[2][own[1]]).tolist()
    with pytest.raises(ValueError):
        lm_scoring._elsewhere(keys.view(np.uint64), docs, others[1:])


def test_language_model_of_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " .,"), (None, None)], "doc_id bigint, text string").coalesce(1)
    assert sorted(map(tuple, lm_scores(docs).collect()), key=repr) == [(1, 0, 0.0, None), (2, 0, 0.0, None), (3, 0, 0.0, None), (None, 0, 0.0, None)]


def test_tokens_of_slices():
    texts = [None, "", "one", "two", "Two, thirteenletters", "é É ß", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 18, " ", "a-b_c", "q" * 100_000, "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped one", *texts], pa.string())], names=["text"]).slice(1)
    for size in (1, 30, 4_000_000):
        seen, back, rows = {}, {}, 0
        for part, tokens in tokens_of(batch, "text", size):
            flat = [(i, w) for i, text in enumerate(part.column("text").to_pylist()) for w in words_alnum(text or "")]
            assert tokens.docs.tolist() == [i for i, _ in flat]
            for (_, word), code in zip(flat, tokens.hashes.tolist(), strict=True):
                assert seen.setdefault(word, code) == code and back.setdefault(code, word) == word
            rows += part.num_rows
        assert rows == len(texts)


def held(rows, label, test):
    kept = [r for r in rows if test(r)]
    pos, neg = ([r["score"] for r in kept if r[label] == c] for c in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    rows = quality_scores(docs, model).join(labels, "doc_id").collect()
    assert held(rows, "quality", lambda r: r["held_out"]) > 0.97
    same = quality_scores(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")).withColumn("score", F.lit("clash")), model).select("doc_id", "score")
    assert same.exceptAll(quality_scores(docs, model).select("doc_id", "score")).isEmpty()


def test_discriminant_against_densities():
    """Scores by a formula of their own: covariances by hand, densities by solving and by determinants."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, (300, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 2]]), rng.normal(1, 0.5, (200, 3))])
    y = np.repeat([0, 1], [300, 200])
    pool, ridge, prior = 0.1, 0.02, 0.4
    covs = [sum(np.outer(r - x[y == c].mean(0), r - x[y == c].mean(0)) for r in x[y == c]) / ((y == c).sum() - 1) for c in (0, 1)]
    pooled = (300 * covs[0] + 200 * covs[1]) / 500
    densities = []
    for c in (0, 1):
        cov = (1 - pool) * covs[c] + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / 3 * np.eye(3)
        far = x - x[y == c].mean(0)
        densities.append(np.exp(-0.5 * (far * np.linalg.solve(cov, far.T).T).sum(1)) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov)))
    want = prior * densities[1] / (prior * densities[1] + (1 - prior) * densities[0])
    assert Discriminant.fit(x, y, prior, pool, ridge).scores(x) == pytest.approx(want, abs=1e-9)


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, KIND)
    labels = spark.createDataFrame([(4, None, None), (7, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for rows in (quality_scores(docs, fit_quality(docs, labels)).collect(), toxicity_scores(docs, fit_toxicity(docs, labels)).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
    none = docs.limit(0)
    assert quality_scores(none, Discriminant(0.0)).collect() == [] and toxicity_scores(none, fit_toxicity(none, labels)).collect() == []


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "A" * 100_000, "\n" * 50, "ä|#\ud800"):
        assert np.isfinite(statistics(text)).all()


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    neutral, bad = [f"word{i}" for i in range(300)], ["vilea", "vileb", "vilec", "viled"]
    rows = []
    for i in range(1200):
        ws = rng.choices(neutral, k=40)
        toxic = rng.random() < 0.15
        if toxic:
            ws[5:8] = rng.choices(bad, k=3)
        rows.append((i, " ".join(ws), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, fit_toxicity(docs, labels)).collect()}
    kept = [(got[i], t) for i, _, t in rows if got[i]["held_out"]]
    assert kept and sum(r["predicted"] == t for r, t in kept) >= 0.97 * len(kept)


def test_risk_and_its_clipped_branch():
    rng = np.random.default_rng(4)
    gp, gu, prior, small = rng.normal(0, 1, 7), rng.normal(0, 1, 30), 0.3, 1e-6
    plus, minus = (lambda g: np.log1p(np.exp(-g))), (lambda g: np.log1p(np.exp(g)))
    parts = lambda a, b: (prior * plus(a).mean(), minus(b).mean() - prior * minus(a).mean())
    for shift, clipped in ((0.0, False), (-6.0, True)):
        # unlabelled rows that all look clean beside positive ones that don't make the second part negative
        b = gu + shift
        risk, dp, du, was = nn_risk(gp, b, prior)
        first, second = parts(gp, b)
        assert was == clipped == (second < 0) and risk == pytest.approx(first + max(0.0, second))
        goal = (lambda a, b: -parts(a, b)[1]) if clipped else (lambda a, b: sum(parts(a, b)))
        for i in range(len(gp)):
            step = np.eye(len(gp))[i] * small
            assert dp[i] == pytest.approx((goal(gp + step, b) - goal(gp - step, b)) / (2 * small), abs=1e-6)
        for i in range(len(b)):
            step = np.eye(len(b))[i] * small
            assert du[i] == pytest.approx((goal(gp, b + step) - goal(gp, b - step)) / (2 * small), abs=1e-6)


def test_training_meets_the_clipped_branch(monkeypatch):
    from quillgraph.llm import toxicity

    seen, risk = [], toxicity.nn_risk
    monkeypatch.setattr(toxicity, "nn_risk", lambda *a: seen.append(risk(*a)) or seen[-1])
    rng = np.random.default_rng(5)
    positive = [np.array([1, 2]) for _ in range(40)]
    unlabelled = [np.array([1, 2]) if rng.random() < 0.1 else np.array([rng.integers(3, 9)]) for _ in range(200)]
    model = toxicity.train_nnpu(positive, unlabelled, np.arange(1, 9), 0.4)
    assert {x[3] for x in seen} == {False, True}
    table = model.table()
    assert table[1] + table[2] + model.bias > np.log(0.3 / 0.7) > table[3:9].max() + model.bias


def test_features_against_sets():
    def plain(text):
        ws = set(words(text))
        return len({(0, w) for w in ws} | {(n, w.encode()[:n]) for w in ws for n in (4, 5, 6) if len(w.encode()) >= n})

    for text in (None, "", "a", "abcd abcde abcdef abcdefg", "Überall überall, ß", "x" * 5000, "abcdefgh abcdefghi abcdefgh"):
        assert len(word_buckets(text)) == plain(text)


def test_word_buckets_mark_prefixes():
    assert len(word_buckets("abcdef")) == 4 and len(word_buckets("abc abc")) == 1 and len(word_buckets(None)) == 0


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")),
        ("no scheme casino", ("", "", None, "block")),
        ("http://A.Example.COM/en/7x?q#f", ("a.example.com", "/en/7x", "example.com/en/7", "allow")),
        ("http://x.com/en/9", ("x.com", "/en/9", "com/en/", "block")),
        ("http://notexample.com/en/7", ("notexample.com", "/en/7", "com/en/", "block")),
        ("http://example.net/de/81", ("example.net", "/de/81", "example.net/de/8", "block")),
        ("http://example.net/de/7", ("example.net", "/de/7", "net/de/", "allow")),
        ("http://xcom/en/", ("xcom", "/en/", None, "allow")),
        ("x://cheap-pills.test", ("cheap-pills.test", "", None, "block")),
        ("x://cheap.test/cheap", ("cheap.test", "/cheap", None, "allow")),
        ("x://cheapest-pillsbury.test", ("cheapest-pillsbury.test", "", None, "allow")),
        ("x://spammer.test/spam", ("spammer.test", "/spam", None, "block")),
        ("://?a://b/c", ("", "", None, "allow")),
        ("x://a.test/%70orn", ("a.test", "/%70orn", None, "block")),
        ("x://a.test/buy%20viagra%20now", ("a.test", "/buy%20viagra%20now", None, "block")),
        ("x://a.test/%2570orn", ("a.test", "/%2570orn", None, "allow")),
        ("x://a.test/100%casino%zz%ff", ("a.test", "/100%casino%zz%ff", None, "block")),
        ("x://a.test/éporn", ("a.test", "/éporn", None, "allow")),
        ("x://a.test/PORN!", ("a.test", "/PORN!", None, "block")),
        ("x://xn--porn-epa.test/", ("xn--porn-epa.test", "/", None, "block")),
        ("x://xn--.test/casino", ("xn--.test", "/casino", None, "block")),
    ],
)
def test_urls(url, want):
    from quillgraph.llm.url_filter import RULES, SOFT_TERMS, STRICT_TERMS

    assert UrlJudge(RULES, STRICT_TERMS, SOFT_TERMS, 2).verdict(url)[:4] == want
    assert host_and_path(url) == want[:2]


def test_url_vocabulary_from_a_table(spark):
    from quillgraph.llm.url_filter import readable, vocabulary

    rows = [(" Loans", "soft", 0.5), ("loans", "soft", None), ("bets", "soft", None), ("bets", "strict", 2.0), ("free", "soft", None), ("", "soft", 1.0), (None, "strict", 1.0), ("other", "odd", 1.0)]
    table = spark.createDataFrame(rows, "term string, kind string, weight double")
    strict, soft = vocabulary(table)
    assert (strict, soft) == (("bets",), {"free": 1.0, "loans": 0.5})
    with pytest.raises(ValueError, match="at most 2"):
        vocabulary(table, most=2)
    assert vocabulary(table.limit(0)) == ((), {})
    urls = spark.createDataFrame([("x://a/free-loans",), ("x://a/free-free",), ("x://a/bets",), ("x://a/" + "free" * 100_000 + "/loans",)] * 2, "url string")
    judged = judge_urls(urls, rules=(), strict=strict, soft=soft, weight_needed=1.5).collect()
    assert [(r.verdict, r.n_strict, r.n_soft, r.soft_weight) for r in judged] == [("block", 0, 2, 1.5), ("allow", 0, 1, 1.0), ("block", 1, 0, 0.0), ("allow", 0, 1, 0.5)] * 2
    assert {r.verdict for r in judge_urls(urls, rules=(), strict=(), soft=soft, weight_needed=2).collect()} == {"allow"}
    assert readable("X://" + "bücher".encode("punycode").decode().join(["xn--", ".test"]) + "/A%C3%A9") == "x://bücher.test/aé"


def test_urls_keep_columns(spark):
    df = spark.createDataFrame([("http://a.com/en/1", "old"), (None, None)], "url string, host string")
    assert [tuple(r)[:4] for r in judge_urls(df).collect()] == [("http://a.com/en/1", "a.com", "/en/1", "com/en/"), (None, "", "", None)]
    assert judge_urls(df.limit(0)).collect() == []


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>{}<aside>Side</aside><form>Mail <input></form><div id="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>'


def test_markup():
    text = lambda page: html.main_text(html.text_lines(page), set())
    assert text(PAGE.format("<article><header><h1>A &amp; B</h1></header><p>one\n two<b>x</b><p>three<br>four &eacute;</article>")) == "A & B one twox three four é"
    assert text(PAGE.format("<p>loose text</p>")) == "loose text"
    assert text(PAGE.format("<article><p>in</p><div class='share'>Share</div><p>end")) == "in end"
    assert text(None) == text("") == text("<nav>only") == ""
    assert text("a < b &am") == "a < b &am"


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.shared_places(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_long_pages():
    began = time.process_time()
    same = [1] * 50_000
    assert len(html.shared_places(same, same[:-7])) == 49_993
    a, b = [1, 2] * 20_000, [2, 1] * 20_000
    assert len(html.shared_places(a, b)) == 39_999 and html.shared_places(a, []) == html.shared_places([], b) == set()
    deep = html.text_lines("<div>" * 60_000 + "</span>" * 60_000 + "<article>in</article>" + "</div>" * 60_000 + "out")
    assert deep == [("in", True, False), ("out", False, False)]
    assert html.text_lines("<section><div class=ad><div><b>x</section>y") == [("x", False, True), ("y", False, False)]
    assert time.process_time() - began < 60


def test_differencing_on_real_pages(spark):
    """Without its article element a page is decided by differencing and by what the markup rules out; copies of an article are lost then."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "</?article[^>]*>", ""))
    want = {r["page_id"]: r for r in html.extract_main_text(pages).collect()}
    got = {r["page_id"]: r for r in html.extract_main_text(bare).collect()}
    assert all(r["n_shared"] == 0 and r["n_by_markup"] > 0 for r in want.values())
    assert sum(got[i]["text"] == r["text"] for i, r in want.items()) >= 0.8 * len(want)
    # and without any markup of its own, lines that neighbours share go
    body = "<div>Menu {0}</div><div>News of the day</div><p>own {1}</p><div>Terms {0}</div>"
    rows = [(i, f"http://h/{i // 3}/{i}", body.format(i // 3, i)) for i in range(9)]
    plain = html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [(r["text"], r["n_shared"], r["n_by_markup"]) for r in sorted(plain)] == [(f"own {i}", 3, 0) for i in range(9)]


def test_differencing_of_declared_articles(spark):
    """Pages that declare an article are differenced too: shared lines go, but for those of the article, which the markup gives back."""
    body = "<nav>Menu</nav><div>News</div><article><p>own {0}</p><p>Said before.</p></article><footer>Made {0}</footer>"
    pages = spark.createDataFrame([(i, f"http://h/{i}", body.format(i)) for i in range(4)] + [(9, "http://alone/9", body.format(9))], "page_id bigint, url string, html string")
    got = {r["page_id"]: tuple(r[2:]) for r in html.extract_main_text(pages).collect()}
    assert got == {i: (f"own {i} Said before.", 18, 0, 3, 3, 1) for i in range(4)} | {9: ("own 9 Said before.", 18, 0, 3, 0, 0)}


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_page_differencing(spark, partitions):
    body = "<div>Top menu of the site</div><p>{}</p><div>Imprint and more</div>"
    rows = [(i, f"http://h/{'a' if i < 4 else 'b'}/{i}", body.format(f"own text {i}")) for i in range(8)]
    rows += [(90, "http://alone/x", body.format("own text 90")), (91, None, None), (92, "", ""), (0, "http://h/a/0", body.format("own text 0"))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        got = html.extract_main_text(pages, broadcast_bytes=8_000_000 if partitions > 1 else 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    want = {i: f"own text {i}" for i in range(8)} | {90: "Top menu of the site own text 90 Imprint and more", 91: "", 92: ""}
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_targets():
    assert targets([100, 100, 100], [5, 2, 1], 300, 3) == pytest.approx([187.5, 75, 37.5])
    got = targets([10, 100, 190], [5, 2, 1], 300, 3)
    assert got == pytest.approx([30, 180, 90]) and sum(got) == pytest.approx(300)
    assert targets([0, 5], [5, 2], 5, 3) == pytest.approx([0, 5]) and targets([], [], 0, 3) == []


def test_flow_repeats_as_little_as_it_can():
    # pattern 1 may serve both sources: source 0 must take it so that source 1 repeats nothing
    assert min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [15, 15], 3) == [{0: 10}, {0: 5, 1: 5}, {1: 10}]
    assert min_cost_flow([10, 10], [[0], [0]], [25], 3) in ([{0: 10}, {0: 15}], [{0: 15}, {0: 10}])
    assert min_cost_flow([4], [[0]], [100], 3) == [{0: 12}]


def test_flow_against_all_flows():
    """The cheapest of all ways to route whole tokens: what each pattern gives in sum decides the cost."""
    rng = random.Random(9)
    cost = lambda given, supply: sum(r * (r + 1) // 2 * max(0, min(given - r * supply, supply)) for r in range(3))
    for _ in range(60):
        supplies = [rng.randrange(1, 4) for _ in range(3)]
        members = [sorted(rng.sample(range(3), rng.randrange(1, 4))) for _ in range(3)]
        quotas = [rng.randrange(0, 5) for _ in range(3)]
        best = None
        ways = [list(itertools.product(range(5), repeat=len(m))) for m in members]
        for way in itertools.product(*ways):
            got = [0, 0, 0]
            for m, given in zip(members, way, strict=True):
                for s, n in zip(m, given, strict=True):
                    got[s] += n
            if any(g > q for g, q in zip(got, quotas, strict=True)) or any(sum(given) > 3 * s for given, s in zip(way, supplies, strict=True)):
                continue
            key = (-sum(got), sum(cost(sum(given), s) for given, s in zip(way, supplies, strict=True)))
            best = key if best is None or key < best else best
        for solve in (min_cost_flow, route):
            flows = solve(supplies, members, quotas, 3)
            assert all(sum(f.get(s, 0) for f in flows) <= quotas[s] for s in range(3)) and all(set(f) <= set(m) for f, m in zip(flows, members, strict=True))
            assert (-sum(sum(f.values()) for f in flows), sum(cost(sum(f.values()), s) for f, s in zip(flows, supplies, strict=True))) == best


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix(docs).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in mix(docs.repartition(3)).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sums = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[source[r["doc_id"]]] += r["taken"]
    by = {source[r["doc_id"]]: r for r in got}
    largest = max(r["size"] for r in got)
    assert all(abs(sums[s] - r["target"]) <= largest for s, r in by.items())
    order = sorted(by)
    total = sum(r["size"] for r in got)
    assert [by[s]["target"] for s in order] == pytest.approx(targets([by[s]["source_size"] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], total, 3))


def test_mix_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "a", "x"), (3, "one two", "a", "x"), (3, "one two", "a", "x"), (None, "b " * 9_000, None, "x"), (5, "c", "é", None)], "doc_id bigint, text string, source string, size string")
    got = mix(docs, keep_columns=True)
    assert got.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    assert got.count() == 6 and mix(docs.limit(0)).collect() == []
    both = mix(docs, memberships=F.when(F.col("doc_id") == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    assert both.count() == 6


@pytest.mark.parametrize(
    "head",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT type='x'>if(a<b && c<d)g('</p>')</Script >",
        "<style>/* a<b ' */ p{}</style>",
        "<textarea>a<b \"quoted</textarea>",
        "<script>x = '<!--'; y = a<b</script>",
        "<svg><style>a<b{}</style><text>no</text></svg>",
        "<title>a<b</title>",
    ],
)
def test_html_less_than_in_raw_elements(head):
    page = f"<html><body>{head}<article><p>One two</p><p>a<i>b</i></p></article></body></html>"
    assert html.text_lines(page) == [("One two", True, False), ("ab", True, False)]


def test_lm_rows_without_id_stay_apart(spark):
    """Half a million texts without an id, or with one, have as many keys; equal rows have one."""
    rows = spark.range(500_000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 1000, F.col("id")).alias("number"))
    d1, d2 = row_key(F.col("number"), F.col("text"))
    assert rows.unionByName(rows.limit(5000)).select(d1.alias("d1"), d2.alias("d2")).distinct().count() == 500_000
    docs = spark.createDataFrame([(None, "a b a b"), (None, "a c"), (None, "a b a b"), (None, None)], "doc_id bigint, text string")
    got = sorted((r["n_tokens"], round(r["log_score"], 6)) for r in lm_scores(docs).collect())
    other = sorted((r["n_tokens"], round(r["log_score"], 6)) for r in lm_scores(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect())
    assert got == other
