"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

Items are sets of 5-word shingles and fall into size classes (hi/2, hi]. A short item inside a long document has
a Jaccard similarity with it near 0, so MinHash of whole documents cannot find it; the documents are therefore
searched through windows as long as the class: each class cuts a document into strides of hi/2 shingles and takes
every three neighbouring strides as a window, so that a passage of at most hi shingles lies inside one window, and
containment of 0.8 is a Jaccard similarity of about 0.25 or more there. Stride minima under each of 64 permutations
are computed once at the finest stride and combined for the longer ones. An item is a candidate where a window has
one of its minima (64 bands of one row), or where the whole document has a half or more of the shingles that are its
minima, which finds an item of any size, however its shingles are spread: one that is contained has 0.8 of its shingles, so
that of its up to 64 minima more than a half are missing with a probability below 1e-7, and never if all its shingles are
minima, as with items of few. Every candidate is verified: the share of the item's distinct shingles that the whole
document has must reach the threshold.

A window can only have an item's minimum if the document has that shingle, so documents without any item's minima are
passed over after a look at a table, before any permutation; this changes no result.

The documents are only scanned: nothing is shuffled, whatever passage is frequent. The items (not the documents) are
broadcast after a check of their size; more items than the bound are searched in several scans.

Nulls and texts without words match nothing; a null doc_id is kept. Extra columns are not read, or passed through by
``without_items``. A very long text takes memory in proportion to its words. An item of fewer than five words is one shingle, the whole sequence, and
matches documents with just that sequence. Repeated rows give repeated matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import MIX_A, WordHash, mix, ship_package, shingle_hashes, table, texts, word_hashes

WORDS, THRESHOLD, BANDS, FINEST = 5, 0.8, 64, 4
TABLE_BITS = 22  # of the table of minima that a document's shingles are looked up in first
ITEMS = 100_000  # items that one scan searches for, at most
ITEM_CHARS = 64_000_000  # and their characters
SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX_A) | np.uint64(1)


class Index:
    """Items by size class: (band, minimum) keys and the items that have them; and the shingles that are minima of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        memo, classes = WordHash(), {}
        self.ids, self.sets = [], []
        for item, text in items:
            s = np.unique(shingle_hashes(word_hashes((text or "").encode(), memo), WORDS))
            if len(s):
                hi = 2 * FINEST
                while hi < len(s):
                    hi *= 2
                classes.setdefault(hi, []).append(len(self.ids))
                self.ids.append(item)
                self.sets.append(s)
        self.classes = []
        for hi, members in sorted(classes.items()):
            keys = np.stack([band_minima(self.sets[m]) for m in members])  # members x bands
            self.classes.append((hi, Lists(mix(keys + np.arange(BANDS, dtype=np.uint64)).ravel(), np.repeat(np.array(members), BANDS))))
        # the shingles that are minima of items: a document without any of them shares no band
        least = [np.unique(x[permuted(x).argmin(axis=0)]) for x in self.sets]
        self.n_minima = np.array([len(x) for x in least], np.int64)
        self.minima = Lists(np.concatenate([*least, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(least)), self.n_minima))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.minima.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def half(self, s: np.ndarray) -> tuple[bool, np.ndarray]:
        """Whether a document has any item's minimum, and the items of which it has a half or more, wherever in it they are."""
        hit = s[self.table[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]]
        of = self.minima.find(np.unique(hit)) if len(hit) else hit
        items, n = np.unique(of, return_counts=True)
        return len(of) > 0, items[2 * n >= self.n_minima[items.astype(np.int64)]] if len(items) else items


class Lists:
    """Distinct sorted keys and, for each, its members."""

    def __init__(self, keys: np.ndarray, members: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, at = np.unique(keys[order], return_index=True)
        self.members, self.at = members[order], np.append(at, len(keys))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Members of those keys, of which each is asked once, that are held."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, wanted).clip(max=len(self.keys) - 1)
        k = k[self.keys[k] == wanted]
        return np.concatenate([self.members[self.at[i] : self.at[i + 1]] for i in k.tolist()]) if len(k) else np.zeros(0, np.int64)


def permuted(h: np.ndarray) -> np.ndarray:
    """Shingles x bands."""
    x = h[:, None] * SEEDS[None, :]
    return x ^ (x >> np.uint64(32))


def band_minima(h: np.ndarray) -> np.ndarray:
    return permuted(h.ravel()).min(axis=0)


def matches(s: np.ndarray, index: Index, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, its size, shingles found) of the items contained in a document with the shingle sequence s."""
    if not len(s):
        return
    some, spread = index.half(s)
    if not some:
        return
    candidates: set[int] = set(spread.tolist())
    level = np.concatenate([np.minimum.reduceat(permuted(s[at : at + 4096]), np.arange(0, len(s[at : at + 4096]), FINEST), axis=0) for at in range(0, len(s), 4096)])
    stride = FINEST
    for hi, keys in index.classes:
        while stride < hi // 2:
            level = np.minimum.reduceat(level, np.arange(0, len(level), 2), axis=0)
            stride *= 2
        windows = level
        if len(level) > 1:
            windows = np.minimum(level[:-1], level[1:])
            if len(level) > 2:
                windows = np.minimum(windows[:-1], level[2:])
        candidates.update(keys.find(np.unique(mix(windows + np.arange(BANDS, dtype=np.uint64)).ravel())).tolist())
    if candidates:
        own = np.unique(s)
        for m in sorted(candidates):
            item = index.sets[m]
            n = int((own[np.searchsorted(own, item).clip(max=len(own) - 1)] == item).sum())
            if n >= threshold * len(item) - 1e-9:
                yield index.ids[m], len(item), n


def indexed(items) -> Index:
    """Of broadcast items; a Python worker keeps the last one from task to task."""
    key, value = items.value
    if getattr(indexed, "key", None) != key:
        indexed.key, indexed.held = key, Index(value)
    return indexed.held


def finder(items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = indexed(items), WordHash()
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for m in matches(shingle_hashes(word_hashes(t or b"", memo), WORDS), index, threshold)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shingles", "n_found"])

    return run


def passer(items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = indexed(items), WordHash()
        for batch in batches:
            clean = [next(matches(shingle_hashes(word_hashes(t or b"", memo), WORDS), index, threshold), None) is None for t in texts(batch)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def broadcast_items(spark, items: DataFrame) -> Iterator:
    """The items, in as many parts as their number and size need."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    scans = max(1, -(-size.rows // ITEMS), -(-size.chars // ITEM_CHARS))
    for k in range(scans):
        part = items if scans == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(scans)) == k)
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part.collect()]))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` for each document and benchmark item that it contains."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for held in broadcast_items(spark, items):
        found = docs.mapInArrow(finder(held, threshold), "doc_id long, item_id long, n_shingles long, n_found long")
        out = found if out is None else out.union(found)
    return out.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs(text, ...)``, with all their columns, that contain no item; each row is judged by its own text."""
    ship_package(docs.sparkSession)
    schema = docs.schema
    for held in broadcast_items(docs.sparkSession, items):
        docs = docs.mapInArrow(passer(held, threshold), schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
