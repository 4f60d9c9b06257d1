"""The pipeline: stage by stage on its own input, and as a whole."""

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from sendero.llm import simhash
from sendero.llm.common import materialise, table


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_each_stage_takes_effect_on_its_input(spark, stages):
    names = [n for n, _, _ in stages]
    assert names == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    columns = table(spark, SF_SMALL, "documents").columns
    for name, before, after in stages[:-1]:
        assert after.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
    by = {name: (before, after) for name, before, after in stages}
    before, after = by["quality"]
    labels = {r.doc_id: r.quality for r in table(spark, SF_SMALL, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and after.count() < before.count()
    before, after = by["line_dedup"]
    assert after.count() == before.count()
    before, after = by["simhash"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = by["decontamination"]
    from sendero.llm.decontaminate import contamination
    clean = {r.doc_id for r in contamination(before, table(spark, SF_SMALL, "benchmark")).where("not contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = by["mixing"]
    assert after.count() == before.count()


def test_run_is_its_stages(spark, stages):
    whole = corpus_pipeline.run(spark, SF_SMALL)
    last = stages[-1][2]
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, last.collect()), key=repr)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_on_odd_documents(spark, tmp_path, kind):
    rows = [] if kind == "empty" else [(1, None, None, None, None), (None, "a\nb\nc", "x", None, 5), (1, "", "x", "s", 0), (1, "", "x", "s", 0),
                                       (2, "w " * 50_000, None, "s", None), (3, "a\nb\nd", "x", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF_SMALL), "odd")
        assert after.count() <= max(len(rows), 0)
        docs = after
