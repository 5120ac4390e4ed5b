"""Operator 6: exact token counts by a length histogram.

Documents are encoded with a public byte-level BPE vocabulary (a path parameter) in one scan, and counted by encoded
length. From the histogram, suffix sums answer for every context limit L: how many documents have L tokens or more, how
many tokens they have, and the total when each document is cut to L. A row of the result is a length that occurs.

The shuffle moves a row for each length and task, whatever the number of documents. Suffix sums are taken in two steps
(inside ranges of 1,024 lengths, then over the ranges), so that no task sorts all lengths.

Null and empty texts have length 0. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import saved, ship_package, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 1024


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str):
    return encoding(ranks_of(path))


def counter(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ranks = held.value
        if getattr(counter, "key", None) != key:  # an encoding is made once in each Python worker
            counter.key, counter.made = key, encoding(ranks)
        encode = counter.made.encode_ordinary
        total = np.zeros(1024, np.int64)
        for batch in batches:
            n = np.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], np.int64)
            if len(n):
                if n.max() >= len(total):
                    total = np.concatenate((total, np.zeros(int(n.max()) + 1, np.int64)))
                total[: int(n.max()) + 1] += np.bincount(n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["length", "n"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(length, n_docs)``, one row a length that occurs."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((os.path.basename(vocabulary), ranks_of(vocabulary)))
    counts = docs.select("text").mapInArrow(counter(held), "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))
    return saved(counts, "op6-histogram")  # read several times: documents are encoded once


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of length L or more, and the total when documents are cut to L tokens."""
    cells = histogram.withColumns({"range": F.floor(F.col("length") / RANGE), "tokens": F.col("length") * F.col("n_docs")})
    ranges = cells.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))  # a row for every 1,024 lengths
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = ranges.select("range", F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"), F.coalesce(F.sum("t").over(before), zero).alias("tokens_before"))
    down = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("range").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    out = cells.join(ranges, "range")
    docs_from, tokens_from = F.sum("n_docs").over(down) + F.col("docs_after"), F.sum("tokens").over(down) + F.col("tokens_after")
    tokens_below = F.coalesce(F.sum("tokens").over(up), zero) + F.col("tokens_before")
    return out.select("length", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), (tokens_below + F.col("length") * docs_from).alias("cut_total"))


def cut_total(sums: DataFrame, limit: int) -> int:
    """Exact total of min(length, limit) for any limit: from the next length that occurs, ``docs_from`` documents reach it."""
    row = sums.where(F.col("length") >= limit).agg(F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("r")).first().r
    total = sums.agg(F.min_by("tokens_from", "length").alias("t")).first().t or 0
    return int(total) if row is None else int(total - row.tokens_from + limit * row.docs_from)


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length L such that a share q of the documents, or more, has at most L tokens."""
    docs = sums.agg(F.max("docs_from")).first()[0]
    if docs is None:
        return None
    return sums.where(F.lit(docs) - F.col("docs_from") + F.col("n_docs") >= F.lit(q) * docs).agg(F.min("length")).first()[0]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
