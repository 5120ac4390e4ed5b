"""Operator 5: quality classifier, a factorisation machine trained here in numpy.

Features of a document: its distinct words hashed into 2**14 buckets (weight 1/sqrt of their number), structure
statistics of the text (letters by case, digits, marks, repeated words and lines, lengths), each as a number and as one
of eight ranges, and the declared length as metadata. Labels, language, source and ids are never inputs. The pairwise
interactions have rank 8; a document is scored in time linear in its features by

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

Training rows are labelled rows with crc32(doc_id as text) mod 3 not 1, at most ``SAMPLE`` of them (the documented
bound; those with the smallest hashes of their ids, and a broadcast of as many ids at most). Executors compute the sample's
features; the driver gets no texts, but a few kilobytes a row of the sample (33 at most). All rows are scored in one scan without a shuffle.

Nulls, empty texts and repeated rows are scored like any other (an empty text by its statistics alone). Without any
labelled row every score is 0.5. Where an id has several labels, each is a training row. A null doc_id is not held out.
Where a labelled id has several documents, each is a training row, beyond the bound if need be. Extra columns are not
read, whatever their names. A score of exactly 0.5 is predicted as 1. A very long text is read whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import WordHash, ship_package, table, texts, word_hashes

SAMPLE, BITS, RANK, EPOCHS, BATCH = 20_000, 14, 8, 6, 512
WORDS = 1 << BITS
RANGES = 8
# ends of the ranges of each statistic, in the order of statistics()
CUTS = np.array([0.001, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
LENGTHS = np.array([2.0, 3.5, 5.0, 6.5, 7.5, 8.5, 10.0])
STATS = ("upper", "digit", "mark", "end_mark", "space", "other_byte", "repeated_words", "top_word", "repeated_lines", "short_words", "long_words", "mark_runs", "upper_words", "log_words", "log_lines", "log_chars_told", "words_a_line")
LOGS = frozenset(("log_words", "log_lines", "log_chars_told", "words_a_line"))
SIZE = WORDS + len(STATS) * (RANGES + 1) + 1  # the last is the constant
BYTES = np.arange(256)
IS_UPPER = (BYTES >= 65) & (BYTES <= 90)
IS_DIGIT = (BYTES >= 48) & (BYTES <= 57)
IS_END = np.isin(BYTES, list(b".,;:?'\"-"))
IS_SPACE = np.isin(BYTES, list(b" \t\n\r\x0b\x0c"))
IS_MARK = (BYTES > 32) & (BYTES < 127) & ~IS_UPPER & ~IS_DIGIT & ~IS_END & ~((BYTES >= 97) & (BYTES <= 122))
IS_HIGH = BYTES >= 128


def statistics(text: bytes, words: np.ndarray, told: int | None) -> np.ndarray:
    n = max(1, len(text))
    codes = np.frombuffer(text, np.uint8)
    count = np.bincount(codes, minlength=256)
    letters = max(1, int(count[IS_UPPER].sum() + count[97:123].sum()))
    kinds, times = np.unique(words, return_counts=True) if len(words) else (words, np.zeros(1, np.int64))
    w = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    space = IS_SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    size = edges[1::2] - edges[::2]
    mark = IS_MARK[codes]
    upper = np.add.reduceat(IS_UPPER[codes], edges[::2]) if len(size) else np.zeros(0)
    return np.array([
        count[IS_UPPER].sum() / letters, count[IS_DIGIT].sum() / n, count[IS_MARK].sum() / n, count[IS_END].sum() / n, count[IS_SPACE].sum() / n, count[IS_HIGH].sum() / n,
        1 - len(kinds) / w if len(words) else 0.0, times.max() / w, 1 - len(set(lines)) / max(1, len(lines)),
        float((size <= 2).sum()) / w, float((size >= 12).sum()) / w, float((mark[1:] & mark[:-1]).sum()) / n, float((upper * 2 > size).sum()) / w,
        np.log1p(len(words)), np.log1p(len(lines)), np.log1p(max(0, told or 0)), np.log1p(len(words) / max(1, len(lines))),
    ])


def features(text: bytes | None, told: int | None, memo: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    text = text or b""
    hashes = word_hashes(text, memo)
    words = np.unique((hashes >> np.uint64(64 - BITS)).astype(np.int32))
    s = statistics(text, hashes, told)
    span = [np.searchsorted(LENGTHS if k in LOGS else CUTS, x, side="right") for k, x in zip(STATS, s, strict=True)]
    base = WORDS + np.arange(len(STATS)) * (RANGES + 1)
    numbers = np.where([k in LOGS for k in STATS], s / 10, s)
    idx = np.concatenate((words, base, base + 1 + np.array(span), [SIZE - 1])).astype(np.int32)
    val = np.concatenate((np.full(len(words), 1 / np.sqrt(max(1, len(words)))), numbers, np.full(len(STATS) + 1, 0.5)))
    return idx, val.astype(np.float32)


class Machine:
    """w0 + w.x + sum of pairwise interactions of rank RANK."""

    def __init__(self, seed: int = 7):
        self.w = np.zeros((SIZE, 1 + RANK), np.float32)  # column 0 is linear
        self.w[:, 1:] = np.random.default_rng(seed).normal(0, 0.05, (SIZE, RANK))

    def raw(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray):
        wx = self.w[idx] * val[:, None]
        sums = np.add.reduceat(wx, at, axis=0)
        squares = np.add.reduceat(wx[:, 1:] ** 2, at, axis=0)
        return sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(axis=1), sums, wx

    def score(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(idx, val, at)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-5, seed: int = 11) -> Machine:
        """Adam on the logistic loss, in an order that a seed fixes."""
        rng, m, v, step = np.random.default_rng(seed), np.zeros_like(self.w), np.zeros_like(self.w), 0
        y = np.array([r[2] for r in rows], np.float32)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            lr = rate * (1 - epoch / (epochs + 1))
            for lo in range(0, len(rows), BATCH):
                pick = order[lo : lo + BATCH]
                idx, val = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                size = np.array([len(rows[i][0]) for i in pick])
                at = np.concatenate(([0], np.cumsum(size)[:-1]))
                raw, sums, wx = self.raw(idx, val, at)
                miss = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
                of = np.repeat(np.arange(len(pick)), size)
                g = val * miss[of]
                grad = decay * self.w
                grad[:, 0] += np.bincount(idx, g, SIZE)
                for f in range(1, 1 + RANK):
                    grad[:, f] += np.bincount(idx, g * (sums[of, f] - wx[:, f]), SIZE)
                step += 1
                m = 0.9 * m + 0.1 * grad
                v = 0.999 * v + 0.001 * grad**2
                self.w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        self.w = self.w.astype(np.float32)
        return self


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words as two bytes each, and the values of all other features: what the driver gets of a text of the sample is bounded by 2**15 bytes and a few."""
    memo = WordHash()
    for batch in batches:
        words, rest = [], []
        for t, n in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
            i, x = features(t, n, memo)
            k = int(np.searchsorted(i, WORDS))
            words.append(i[:k].astype(np.uint16).tobytes())
            rest.append(i[k:].tobytes() + x[k:].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(words, pa.binary()), pa.array(rest, pa.binary())], names=["y", "words", "rest"])


def _row(words: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values again."""
    w, n = np.frombuffer(words, np.uint16).astype(np.int32), len(rest) // 2
    return np.concatenate((w, np.frombuffer(rest[:n], np.int32))), np.concatenate((np.full(len(w), 1 / np.sqrt(max(1, len(w))), np.float32), np.frombuffer(rest[n:], np.float32)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """From labelled rows that are not held out, ``sample`` at most."""
    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y"))
    total = known.count()
    if total == 0:
        return None
    chosen = known if total <= sample else known.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    docs = docs.select(F.col("doc_id").alias("_doc"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    rows = docs.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "n_chars", "y")
    got = rows.mapInArrow(_featured, "y int, words binary, rest binary").collect()
    rows = sorted((bytes(r.words), bytes(r.rest), r.y) for r in got)  # partitions don't change the model
    return Machine().fit([(*_row(w, x), y) for w, x, y in rows]) if rows else None


def scorer(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, machine = WordHash(), Machine()
        machine.w = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
            body, scores = texts(batch), []
            for lo in range(0, len(body), 500):
                rows = [features(t, n, memo) for t, n in zip(body[lo : lo + 500], told[lo : lo + 500], strict=True)]
                size = np.array([len(r[0]) for r in rows])
                scores.append(machine.score(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate(([0], np.cumsum(size)[:-1]))))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(scores))], names=[*keep, "score"])

    return run


def score_quality(docs: DataFrame, model: Machine | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` for each row of ``docs(text, n_chars, ...)``."""
    ship_package(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))
    need = list(dict.fromkeys([*keep, "text", "n_chars"]))
    docs = docs.select(*need).withColumn("n_chars", F.col("n_chars").cast("long"))
    held = docs.sparkSession.sparkContext.broadcast(model.w)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return docs.mapInArrow(scorer(held, keep), schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
