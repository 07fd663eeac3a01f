"""The pipeline's stages, each judged on its own input."""

import corpus_pipeline
import quillgraph.llm.near_dedup as near
from quillgraph.llm import queries
from quillgraph.llm.common import words_alnum
from quillgraph.runtime import materialise
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF), "test-stage"))
        if name != "mixing sources":
            assert set(kept[-1].columns) == set(docs.columns), name
    sizes = [df.count() for df in kept]
    assert sizes[0] > sizes[1] > 0 and sizes[1] == sizes[2] >= sizes[3] >= sizes[4] >= sizes[5] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r["doc_id"] for r in docs.collect() if labels.get(r["doc_id"]) == 1}
    assert len(good - {r["doc_id"] for r in kept[1].collect()}) <= 0.05 * len(good)
    rows = [(r["doc_id"], set(near.shingle_set(r["text"], 5).tolist())) for r in kept[3].collect()]
    for i, (_, a) in enumerate(rows):
        for _, b in rows[i + 1 :]:
            shared = len(a & b)
            assert not a or not b or 100 * shared < 80 * (len(a) + len(b) - shared)
    items = [words_alnum(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    for r in kept[4].collect():
        w = words_alnum(r["text"])
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w)))
    assert all(r["taken"] > 0 for r in kept[5].collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert set(queries.ORACLE_SQL) <= set(names) | set(queries.MORE_QUERIES)


def test_bigrams_are_registered(spark):
    import __spark_entry__

    run = __spark_entry__.queries()
    three, two = ({r["doc_id"]: (r["n_tokens"], r["mean_log_score"]) for r in run[name](spark, SF).collect()} for name in ("op4_lm_scoring", "op4_lm_scoring_bigrams"))
    assert two.keys() == three.keys() and all(two[i][0] == three[i][0] for i in two) and two != three
