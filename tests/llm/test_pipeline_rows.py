"""Pipeline stages where ids repeat, are null, and rows are equal; empty tables; columns too many."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from waymark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*pairs):
    return [(d, t, "en", "s", len(t or "")) for d, t in pairs]


A = " ".join(f"alpha{i}" for i in range(60))
B = " ".join(f"beta{i}" for i in range(60))
C = " ".join(f"gamma{i}" for i in range(60))


def test_near_duplicates_are_judged_by_row(spark, sf):
    docs = spark.createDataFrame(rows((1, A), (2, A), (2, B), (7, B + " three more words"), (7, C), (8, None), (8, None), (9, ""), (None, C + " x"), (None, "some text that nobody else has at all"), (None, None)), SCHEMA)
    got = sorted(((r.doc_id or -1), r.text or "") for r in pipeline.near_duplicates(spark, docs.withColumn("node", F.lit(1)), sf).collect())
    assert got == sorted([(1, A), (2, B), (7, C), (8, ""), (9, ""), (-1, "some text that nobody else has at all"), (-1, "")])


def test_decontamination_is_by_row(spark, sf):
    item = table(spark, sf, "benchmark").where("text is not null").first().text
    docs = spark.createDataFrame(rows((1, A), (1, f"{A} {item} {B}"), (None, f"x {item}"), (None, C), (3, None)), SCHEMA)
    got = sorted(((r.doc_id or -1), r.text or "") for r in pipeline.decontamination(spark, docs, sf).collect())
    assert got == sorted([(1, A), (-1, C), (3, "")])


def test_empty_and_odd_rows_pass_every_stage(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows((1, None), (2, ""), (2, ""), (None, " \n")), SCHEMA).withColumns({"y": F.lit(1), "_id": F.lit("x"), "score": F.lit(0.5)})
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        got = stage(spark, some, sf)
        assert name == "pieces" or got.columns == pipeline.COLUMNS
        assert got.count() <= 4
    assert pipeline.secrets(spark, some, sf).count() == 4 and pipeline.pieces(spark, some, sf).count() == 4
