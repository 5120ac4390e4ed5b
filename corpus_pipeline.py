"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, pieces.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next one's docs; the tables between are deleted when the last is written. Empty tables pass through; null
texts are handled as the operators state; columns that documents do not have are left out. Ids may repeat or be null: rows
are judged by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import drop_saved, saved, table
from waymark.llm.contain import without_items
from waymark.llm.jaccard import one_of_each
from waymark.llm.pieces import encode_pieces
from waymark.llm.quality import score_quality, train
from waymark.llm.secrets import redact

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[REDACTED]"
WORDS, NUM, DEN = 5, 80, 100  # near copies: five-word shingles, similarity of 0.8 or more


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labelled rows of the source tables."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; each row is judged by its own text."""
    return one_of_each(docs.select(*COLUMNS), WORDS, NUM, DEN)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the lengths follow; no document goes."""
    return redact(docs.select(*COLUMNS), MARK)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining text as piece ids, checked by decoding."""
    return encode_pieces(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]

#: SQL can't express the classifier and the transducer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "work_path"):
            drop_saved(before)
    return docs
