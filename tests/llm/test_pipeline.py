"""The pipeline against a plain version of each stage."""

import corpus_pipeline
from test_rules import slow_line_dedup
from test_simhash import similar, slow_components, words_set
from test_texts import slow_distance

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import decontam, toxicity
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_the_plain_versions(spark):
    docs = table(spark, SF, "documents").where("n_chars < 4000")
    columns = docs.columns
    lexicon = toxicity.train(docs, table(spark, SF, "labels"))
    automaton = lexicon.automaton()
    want = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]

    docs = stages["toxicity"](spark, docs, SF).persist()
    want = {d: t for d, t in want.items() if lexicon.score(t, automaton) < 0.7}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want

    docs = stages["line_dedup"](spark, docs, SF).persist()
    want = dict(slow_line_dedup(list(want.items())))
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = stages["near_dedup"](spark, docs, SF).persist()
    ids = sorted(want)
    sets = [words_set(want[i]) for i in ids]
    labels = slow_components(ids, np.array([[similar(a, b) for b in sets] for a in sets]))
    want = {i: want[i] for i, c in zip(ids, labels) if i == c}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want

    docs = stages["decontamination"](spark, docs, SF).persist()
    items = [decontam.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    exact = {d for d, t in want.items() if any(i in decontam.normal(t) for i in items)}
    left = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and not left & exact
    for d in set(want) - left - exact:  # what else went holds an item with few edits
        assert any(slow_distance(i, decontam.normal(want[d])) <= int(len(i) * decontam.RATE) for i in items)

    packed = stages["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == left
    assert sum(r.n_tokens for r in packed) == sum(len(want[d].split()) for d in left)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "bin_id" in out.columns


def test_stages_on_odd_input(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables."""
    names = ["label", "runs", "gone", "fp", "row_key", "score", "component_id", "lines_gone"]
    docs = odd.withColumns({n: F.lit(n) for n in names})
    for frame, n in ((docs, 10), (docs.limit(0), 0)):
        got = {name: stage(spark, frame, SF) for name, stage in corpus_pipeline.STAGES}
        for name, out in got.items():
            rows = out.collect()
            if name != "packing":
                assert out.columns == frame.columns and all(r[c] == c for r in rows for c in names)
            assert len(rows) <= 60 and (n or not rows)
        if n:
            assert got["toxicity"].count() == got["decontamination"].count() == got["line_dedup"].count() == 10
            assert sorted(r.doc_id for r in got["near_dedup"].collect() if r.doc_id) == [1, 3, 5, 5, 7]
