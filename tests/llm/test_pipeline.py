"""Each stage against a plainer version of its decision."""

import corpus_pipeline as pipeline
from waymark.llm.common import saved, table
from waymark.llm.secrets import spans


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs, seen = table(spark, sf, "documents"), {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, docs, sf), "test-stage")
        seen[name] = (before, docs)
        if name != "pieces":
            assert docs.columns == pipeline.COLUMNS
    before, after = seen["decontamination"]

    def grams(t):
        w = (t or "").encode().lower().split()
        return set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)}

    items = [grams(r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {r.doc_id for r in before.collect() if not any(len(i & grams(r.text)) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = seen["secrets"]
    assert before.count() == after.count()
    assert not any(spans(r.text or "")[0] for r in after.collect())
    assert seen["pieces"][1].where("not round_trip").count() == 0
