"""The stages of the pipeline, each on what its predecessor kept, against brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from quantlake.llm import jaccard, runtime
from tests.llm import brute


def test_stages(spark, data):
    docs = runtime.table(spark, data, "documents")
    columns = docs.columns
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in runtime.table(spark, data, "benchmark").select("item_id", "text").collect()]
    expect = {
        "language": lambda x: {d: t for d, t in x.items() if re.search(r"[^\W\d_]", t or "")},
        "near_duplicates": lambda x: {d: x[d] for d in {c for _, c in brute.components(x).values()}},
        "decontamination": lambda x: {d: t for d, t in x.items() if not brute.contamination(t, items)[4]},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = runtime.materialize(stage(spark, docs, data), name)
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if name in expect:
            assert got == expect[name](now)
        else:
            assert got.keys() == now.keys()
            assert all(brute.secrets(got[d])[:3] == (0, 0, 0) for d in got)
            assert all(got[d] == now[d] for d in got if brute.secrets(now[d])[:3] == (0, 0, 0) and "[SECRET]" not in got[d])
        now = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in packed.collect()} == now.keys()


def test_awkward_rows(spark, data):
    rows = [(1, "Some English words of a text.", "en", "s", 5), (1, "Some English words of a text.", "en", "s", 5), (None, "kept, whatever its id", None, None, None), (2, None, None, None, None), (3, "12345", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = runtime.materialize(stage(spark, docs, data), "stage")
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1]


def test_rows_that_share_an_id_alone(spark, data):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in ("a", "b"))
    rows = [(7, one), (7, two), (7, one), (3, two + " more"), (9, one), (9, "five other words than those")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data)
    assert sorted(map(tuple, kept.collect())) == sorted([(3, two + " more"), (7, one), (9, "five other words than those")])


def test_language_of_a_script_nobody_learned(spark, data):
    docs = runtime.table(spark, data, "documents").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, "ꆈꌠꉙ ꆈꌠꁱꂷ ꉬ", None)], docs.schema)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.union(more), data)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}


def test_empty(spark, data):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = runtime.materialize(stage(spark, docs, data), "stage")
    assert docs.count() == 0


def test_near_duplicates_of_groups_whose_leader_links_with_nobody(spark, data, monkeypatch):
    for name in ("SKETCH_LEAST", "SKETCH_MOST", "SKETCH_PART"):
        monkeypatch.setattr(jaccard, name, 1)
    rows = brute.groups_with_a_lone_leader(jaccard.Shingler(), jaccard.prefix_length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, data)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute.components(dict(rows)).values()})
