"""Operator 4: exact n-gram Jaccard join over a forest of count-vector R-trees.

A document is the set of its distinct k-word shingles. Shingles are hashed into 256 groups; the group
counts are a point, and the summed coordinate minima of two points (or of two bounding boxes' upper
corners) bound the overlap of the sets from above. Steps:

1. ``sketch``: one pass over the texts gives each document its set size, a fingerprint of its set (equal
   sets become one *node*, so exact copies are handled once) and its point.
2. Trees are addressed by shingles: under one global order, rarest first, two sets whose similarity reaches the
   threshold share a shingle among the first ``n - ceil(t n) + 1`` of each (prefix principle), so each node is put in the
   trees of these shingles and no link is lost. Rarity is counted exactly, whatever the size of the corpus: every
   shingle of every set is dealt once, packed into some six bytes, to the piece of the hash range that counts it; the
   entries of shingles that several sets have are sent back to their documents' group, where each document takes
   its first ones. A shingle that one set has alone comes first and addresses no tree, so that most documents are in none.
   A shingle that is frequent within some 2,000 documents is one entry of theirs, with its number.
3. The smallest node of each tree is compared with all others there and then leaves the tree: set sizes and points
   bound the overlap, and pairs that may reach the threshold are verified on the whole sets. Most trees have two
   nodes and are finished. Verified links join components, and trees that lie in one component are done.
4. In every tree whose nodes are then not all in one component, pairs from different components are looked for: set
   sizes, then boxes, then points bound the overlap, and survivors are verified. In two turns each node is compared
   with its nearest by bound only, which joins groups of near copies without their pairs; a last turn takes all
   pairs from different components that the bounds still allow. Trees of many nodes are cut into chunks and pairs
   of chunks, each a task's work of bounded size.

Links inside a component that is already known add nothing and are not looked for; the result (components)
is that of all pairs, but the number of a row's links is not known. Nothing is collected to the driver.

Nulls and texts without words have no shingles and link with nothing; documents of fewer than k words are one
shingle, the whole sequence. Repeated rows are equal sets. A null doc_id is kept and counts as an own row. Extra columns are
not read. A very long text takes memory in proportion to its words, in one task. Sets are compared by 64-bit shingle
hashes and identified by a 64-bit fingerprint; a second one is compared with it, and if two unlike sets ever fall together
the sketch is made again with another seed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import WordHash, maybe_broadcast, mix, saved, ship_package, shingle_hashes, small_enough, starts, table, texts, whole_groups, word_hashes
from waymark.llm.components import connected_components

GROUP_BITS = 8
GROUPS = 1 << GROUP_BITS  # coordinates of a point: bounds of unlike sets stay below 0.8 up to some 7,000 shingles
NEAREST = 2  # turns in which each node is compared with the nearest of another component only
CHUNK = 1024  # nodes of a tree that are compared in one piece
LEAF = 32  # points in an R-tree leaf
BROADCAST_ROWS = 1_000_000  # rows of 16 bytes at most that are broadcast
TREE_BITS = 48  # of the hash that addresses a tree; two trees that fall together only share their candidates
BOUNDED = 1 << 13  # pairs whose points are compared at once
MATES = 256  # sets that one copy of a hub's set is compared with, about
FLUSH = 1_000_000  # entries of the documents of one group, about
HOT = 3  # documents of a group that share a shingle are one entry from this number on
PIECE_ENTRIES = 1_000_000  # entries of the piece of the hash range that one task matches, about
FULL = np.uint16(65535)  # a coordinate of this size or more


class Threshold:
    """Similarity at least num/den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def holds(self, overlap, na, nb):
        return self.den * overlap >= self.num * (na + nb - overlap)

    def sizes(self, na, nb):
        return self.den * np.minimum(na, nb) >= self.num * np.maximum(na, nb)


def doc_set(text: bytes | None, memo: WordHash, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text or b"", memo), k))


def fingerprint(s: np.ndarray, seed: int = 0) -> int:
    """Of a set: order-free sums of two mixes, folded with the size."""
    salt = np.uint64((seed + 1) * 0xA5A5A5A5A5A5A5A5 & 0xFFFFFFFFFFFFFFFF)
    a = int(mix(s ^ salt).sum(dtype=np.uint64))
    b = int(mix(s * np.uint64(0xD6E8FEB86659FD93) + salt).sum(dtype=np.uint64))
    x = np.array([a ^ (b >> 1) ^ (len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)], np.uint64)
    return int(mix(mix(x)).view(np.int64)[0])


def point(s: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((s >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=GROUPS), int(FULL)).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima; two coordinates that are cut off at FULL bound nothing."""
    least = np.minimum(a, b)
    return least.sum(axis=-1, dtype=np.int64) + np.where((least == FULL).any(axis=-1), 1 << 40, 0)


SKETCH = "doc_id long, node long, other long, n long, payload binary"
OTHER = 1 << 20  # seed of the second fingerprint, after the first's


def sketcher(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            rows = []
            for t in texts(batch):
                s = doc_set(t, memo, k)
                rows.append((fingerprint(s, seed), fingerprint(s, seed + OTHER), len(s), point(s).tobytes()) if len(s) else (None, None, 0, None))
            nodes, others, sizes, points = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary())], names=["doc_id", "node", "other", "n", "payload"])

    return run


# rows that are dealt to count shingles: a piece of the hash range with packed entries, or (key < 0) a group's documents
ENTRIES = "key long, grp long, payload binary"
HEADER = struct.Struct("<qIIBB")


def pack_bytes(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_bytes(payload: bytes, at: int, size: int, width: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8, size * width, at).reshape(size, width)
    return out.view("<u8").ravel().astype(np.int64)


def width_of(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def pack_entries(tree: np.ndarray, doc: np.ndarray, docs: int, times: np.ndarray) -> bytes:
    """Entries sorted by tree: steps between the trees, numbers of documents in the group (from ``docs`` on: of shared lists), lengths of these lists."""
    steps = np.diff(tree, prepend=tree[:1])
    w, v = width_of(steps), width_of(doc)
    return HEADER.pack(int(tree[0]), len(tree), docs, w, v) + pack_bytes(steps, w) + pack_bytes(doc, v) + times[doc[doc >= docs] - docs].astype("<u4").tobytes()


def unpack_entries(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees, documents, and how many documents each entry stands for."""
    first, size, docs, w, v = HEADER.unpack_from(payload)
    at = HEADER.size
    tree, doc = first + np.cumsum(unpack_bytes(payload, at, size, w)), unpack_bytes(payload, at + size * w, size, v)
    times = np.ones(size, np.int64)
    times[doc >= docs] = np.frombuffer(payload, "<u4", -1, at + size * (w + v))
    return tree, doc, times


def pack_group(nodes: list[int], sizes: list[int], lists: np.ndarray, members: np.ndarray) -> bytes:
    return struct.pack("<II", len(nodes), len(lists)) + np.array([nodes, sizes], np.int64).tobytes() + lists.astype("<u4").tobytes() + members.astype("<u4").tobytes()


def unpack_group(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and set sizes of a group's documents, lengths of its shared lists, and the documents in these."""
    docs, lists = struct.unpack_from("<II", payload)
    nodes, sizes = np.frombuffer(payload, np.int64, 2 * docs, 8).reshape(2, docs)
    rest = np.frombuffer(payload, "<u4", -1, 8 + 16 * docs).astype(np.int64)
    return nodes, sizes, rest[:lists], rest[lists:]


def entry_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, grp, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(grp, pa.int64()), pa.array(payload, pa.binary())], names=["key", "grp", "payload"])


def dealer(k: int, seed: int, pieces: int):
    """All shingles of all sets of this task as ENTRIES; sets that the task has had already are left out."""

    def packed(sets: list[np.ndarray], nodes: list[int], grp: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for x in sets]
        tree, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tree, kind="stable")
        tree, doc = tree[order], doc[order]
        at = np.flatnonzero(np.diff(tree, prepend=-1))
        times = np.diff(np.append(at, len(tree)))
        hot = times >= HOT
        keep, inside = np.ones(len(tree), bool), np.repeat(hot, times)
        keep[inside] = False
        keep[at[hot]] = True
        lists, members = times[hot], doc[inside]
        doc = doc.copy()
        doc[at[hot]] = len(sets) + np.arange(len(lists))
        tree, doc = tree[keep], doc[keep]
        yield entry_rows([(-1 - grp, grp, pack_group(nodes, sizes, lists, members))])
        piece = (tree >> (TREE_BITS - 24)) * pieces >> 24
        at = np.flatnonzero(np.diff(piece, prepend=-1))
        cuts = list(zip(at.tolist(), np.append(at[1:], len(tree)).tolist(), strict=True))
        for lo in range(0, len(cuts), 200):
            yield entry_rows([(int(piece[x]), grp, pack_entries(tree[x:y], doc[x:y], len(sets), lists)) for x, y in cuts[lo : lo + 200]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, grp = WordHash(), TaskContext.get().partitionId() << 33
        seen, sets, nodes, held = set(), [], [], 0
        for batch in batches:
            for text in texts(batch):
                s = doc_set(text, memo, k)
                if not len(s):
                    continue
                node = fingerprint(s, seed)
                if node in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                sets.append((s >> np.uint64(64 - TREE_BITS)).astype(np.int64))
                nodes.append(node)
                held += len(s)
                if held >= FLUSH:
                    yield from packed(sets, nodes, grp)
                    sets, nodes, held, grp = [], [], 0, grp + 1
        if sets:
            yield from packed(sets, nodes, grp)

    return run


def rarity(count: np.ndarray) -> np.ndarray:
    """A byte that orders shingles by their number, roughly where it is large."""
    return np.where(count < 128, count, 128 + np.minimum(127, 8 * np.log2(np.maximum(count, 128) / 128))).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ENTRIES sorted by key: those of trees that several sets have, by group, with a number of the tree and its rarity."""
    for group in whole_groups(batches, ["key"]):
        at = starts(group, ["key"])
        payload, grps, keys = group.column("payload"), group.column("grp").to_numpy(), group.column("key").to_numpy()
        for lo, hi in zip(at.tolist(), np.append(at[1:], group.num_rows).tolist(), strict=True):
            if keys[lo] < 0:
                yield entry_rows([(-1, int(grps[i]), payload[i].as_py()) for i in range(lo, hi)])
                continue
            parts = [unpack_entries(payload[i].as_py()) for i in range(lo, hi)]
            tree, doc, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            of = np.repeat(np.arange(lo, hi), [len(x[0]) for x in parts])
            order = np.argsort(tree, kind="stable")
            first = np.flatnonzero(np.diff(tree[order], prepend=-1))
            count, size = np.add.reduceat(times[order], first), np.diff(np.append(first, len(tree)))
            shared = count > 1
            number, rare = np.repeat(np.cumsum(shared) - 1, size), np.repeat(rarity(count), size)
            keep = np.flatnonzero(np.repeat(shared, size))
            if not len(keep):
                continue
            number, rare, doc, of = number[keep], rare[keep], doc[order[keep]], of[order[keep]]
            by = np.argsort(grps[of], kind="stable")
            number, rare, doc, g = number[by], rare[by], doc[by], grps[of[by]]
            cut = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
            rows = []
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(g)).tolist(), strict=True):
                w, v = width_of(number[x:y]), width_of(doc[x:y])
                rows.append((int(keys[lo]), int(g[x]), struct.pack("<IBB", y - x, w, v) + pack_bytes(number[x:y], w) + pack_bytes(rare[x:y], 1) + pack_bytes(doc[x:y], v)))
            for x in range(0, len(rows), 200):
                yield entry_rows(rows[x : x + 200])


def chooser(t: Threshold):
    """``(tree, node, n)`` of each document's prefix, from what ``counted`` gives, sorted by group and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["grp"]):
            at = starts(table, ["grp"])
            payload, keys = table.column("payload"), table.column("key").to_numpy()
            for lo, hi in zip(at.tolist(), np.append(at[1:], table.num_rows).tolist(), strict=True):
                assert keys[lo] == -1
                nodes, sizes, lists, members = unpack_group(payload[lo].as_py())
                trees, rares, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in range(lo + 1, hi):
                    blob = payload[i].as_py()
                    size, w, v = struct.unpack_from("<IBB", blob)
                    trees.append((keys[i] << 32) + unpack_bytes(blob, 6, size, w))
                    rares.append(unpack_bytes(blob, 6 + size * w, size, 1))
                    docs.append(unpack_bytes(blob, 6 + size * (w + 1), size, v))
                tree, rare, doc = np.concatenate(trees), np.concatenate(rares), np.concatenate(docs)
                many = doc >= len(nodes)
                which = doc[many] - len(nodes)
                begin = np.cumsum(lists) - lists
                span = lists[which]
                inside = np.repeat(begin[which] - (np.cumsum(span) - span), span) + np.arange(int(span.sum()))
                tree, rare, doc = (np.concatenate((x[~many], y)) for x, y in ((tree, np.repeat(tree[many], span)), (rare, np.repeat(rare[many], span)), (doc, members[inside])))
                alone = sizes - np.bincount(doc, minlength=len(nodes))
                need = t.prefix(sizes) - alone
                some = need[doc] > 0
                tree, rare, doc = tree[some], rare[some], doc[some]
                order = np.lexsort((tree, rare, doc))
                tree, doc = tree[order], doc[order]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                take = place < need[doc]
                yield pa.RecordBatch.from_arrays([pa.array(tree[take]), pa.array(nodes[doc[take]]), pa.array(sizes[doc[take]])], names=["tree", "node", "n"])

    return run


def setter(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            sets = [doc_set(t, memo, k) for t in texts(batch)]
            node = batch.column(batch.schema.get_field_index("node"))
            own = pa.array([len(s) > 0 and fingerprint(s, seed) == x for s, x in zip(sets, node.to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([node.filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)], names=["node", "words"])

    return run


def verifier(t: Threshold):
    """Streams (a, salt, b, words): the set of a comes first (b null), then those to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, None
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            words = batch.column(3)
            out_a, out_b = [], []
            for i in range(batch.num_rows):
                s = np.frombuffer(words[i].as_py(), np.uint64)
                if b[i] is None:
                    key, hub = (a[i], salt[i]), s
                    continue
                assert key == (a[i], salt[i])
                both = np.concatenate((hub, s))
                both.sort(kind="stable")
                if t.holds(int((both[1:] == both[:-1]).sum()), len(hub), len(s)):
                    out_a.append(a[i])
                    out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, t: Threshold, seed: int) -> DataFrame:
    """The pairs of nodes whose whole sets reach the threshold. ``pairs(a, b)`` is written, without repeats."""
    involved = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node"), "op4-involved")
    wanted = maybe_broadcast(involved.withColumnRenamed("doc_id", "_id"), BROADCAST_ROWS)
    # ids can repeat: only texts that have the node's set count; where several have it, links repeat, which changes nothing
    sets = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text").mapInArrow(setter(k, seed), "node long, words binary")
    sets = saved(sets, "op4-sets")
    # a node with many pairs is salted: its set is copied once for some MATES of them
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MATES).cast("int").alias("parts"))
    salted = saved(pairs.join(parts, "a").select("a", "b", F.pmod(F.hash("b"), F.col("parts")).alias("salt")), "op4-salted")
    few = small_enough(salted, BROADCAST_ROWS)  # then the sets are shuffled once only, to where they are compared
    keys = salted.select("a", "salt").distinct()
    hubs = sets.join(F.broadcast(keys) if few else keys, F.col("node") == F.col("a")).select("a", "salt", F.lit(None).cast("long").alias("b"), "words")
    others = sets.join(F.broadcast(salted) if few else salted, F.col("node") == F.col("b")).select("a", "salt", "b", "words")
    return hubs.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(verifier(t), "a long, b long")


def bounded(t: Threshold):
    """Keeps the pairs whose points allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            va, vb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, GROUPS) for i in (4, 5))
            keep = t.holds(np.minimum(overlap_bound(va, vb), np.minimum(na, nb)), na, nb)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def tree_pairs(n: np.ndarray, pts: np.ndarray, comp: np.ndarray, side: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one (piece of a) tree that may reach the threshold: side 0 against side 1, or all where there is one side.

    Points are packed into leaves by set size and first coordinate (sort-tile-recursive on two axes); a pair of
    leaves is left out where the minima of their boxes' upper corners cannot reach the least overlap needed. The bound of each pair's similarity comes with it.
    """
    order = np.lexsort((pts[:, 0], n))
    n, pts, comp, side, leaf = n[order], pts[order], comp[order], side[order], np.arange(len(n)) // LEAF
    edge = np.arange(0, len(n), LEAF)
    top, low_n, high_n = np.maximum.reduceat(pts, edge), np.minimum.reduceat(n, edge), np.maximum.reduceat(n, edge)
    out_a, out_b, out_r = [], [], []
    two = side.min() != side.max()
    for i in range(len(edge)):
        js = np.arange(i, len(edge))
        js = js[t.sizes(np.minimum(high_n[i], low_n[js]), low_n[js])]  # leaves are sorted by size
        need = t.holds(overlap_bound(top[i], top[js]), low_n[i], low_n[js])
        js = js[need]
        if not len(js):
            continue
        mine = np.flatnonzero(leaf == i)
        theirs = np.flatnonzero(np.isin(leaf, js))
        a, b = np.repeat(mine, len(theirs)), np.tile(theirs, len(mine))
        ok = (a < b) & (comp[a] != comp[b]) & t.sizes(n[a], n[b])
        if two:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        for at in range(0, len(a), BOUNDED):
            x, y = a[at : at + BOUNDED], b[at : at + BOUNDED]
            most = np.minimum(overlap_bound(pts[x], pts[y]), np.minimum(n[x], n[y]))
            keep = t.holds(most, n[x], n[y])
            out_a.append(order[x[keep]])
            out_b.append(order[y[keep]])
            out_r.append((most / (n[x] + n[y] - most))[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_r)) if out_a else (none, none, none.astype(float))


def nearest(a: np.ndarray, b: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows: for each row the pair of the highest bound."""
    x, y, r = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((ratio, ratio))
    order = np.lexsort((y, -r, x))
    x, y = x[order], y[order]
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first], y[first]


def searcher(t: Threshold, only_nearest: bool):
    """Candidate pairs of sorted runs of (tree, i, j, node, n, comp, side, payload): all, or for each node the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["tree", "i", "j"]):
            at = starts(group, ["tree", "i", "j"])
            ends = np.append(at[1:], group.num_rows)
            node, n, comp, side = (group.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            n = n.astype(np.int64)
            pts = np.frombuffer(b"".join(group.column("payload").to_pylist()), np.uint16).reshape(-1, GROUPS)
            seen: set[tuple[int, int]] = set()

            def add(a, b, r, node=node, seen=seen):
                if only_nearest:
                    a, b = nearest(a, b, r)
                seen.update(zip(np.minimum(node[a], node[b]).tolist(), np.maximum(node[a], node[b]).tolist(), strict=True))

            size = ends - at
            xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in np.unique(size[size <= LEAF]):  # all small trees of one size at once
                p, q = np.triu_indices(int(k), 1)
                xs.append((at[size == k][:, None] + p).ravel())
                ys.append((at[size == k][:, None] + q).ravel())
            x, y = np.concatenate(xs), np.concatenate(ys)
            ok = (comp[x] != comp[y]) & t.sizes(n[x], n[y])
            x, y, found = x[ok], y[ok], []
            for k in range(0, len(x), BOUNDED):
                a, b = x[k : k + BOUNDED], y[k : k + BOUNDED]
                most = np.minimum(overlap_bound(pts[a], pts[b]), np.minimum(n[a], n[b]))
                ok = t.holds(most, n[a], n[b])
                found.append((a[ok], b[ok], (most / (n[a] + n[b] - most))[ok]))
            if found:
                add(*(np.concatenate(c) for c in zip(*found, strict=True)))
            for s in np.flatnonzero(size > LEAF):
                r = slice(at[s], ends[s])
                a, b, ratio = tree_pairs(n[r], pts[r], comp[r], side[r], t)
                if len(a):
                    add(a + at[s], b + at[s], ratio)
            if seen:
                pairs = np.array(sorted(seen), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def sketched(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """The saved sketch, its nodes ``(node, doc_id, n)`` and the seed under which unlike sets have unlike fingerprints."""
    for seed in range(8):
        sketch = saved(docs.mapInArrow(sketcher(k, seed), SKETCH), "op4-sketch")
        nodes = saved(sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), (F.min("other") != F.max("other")).alias("mixed")), "op4-nodes")
        if nodes.where("mixed").isEmpty():
            return sketch, nodes.drop("mixed"), seed
    raise RuntimeError("fingerprints of unlike sets fall together")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, node, root, seed)`` for each row of ``docs(doc_id, text)``; links at similarity num/den or more.

    ``node`` names the set of shingles, under the seed of its hash, and ``root`` the component, by its smallest node; both are null without shingles.
    """
    ship_package(docs.sparkSession)
    t, docs = Threshold(num, den), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    sketch, nodes, seed = sketched(docs, k)
    words = nodes.agg(F.sum("n")).first()[0] or 0
    pieces = min(1 << 24, 1 + words // PIECE_ENTRIES)
    tasks = max(pieces, spark.sparkContext.defaultParallelism)
    dealt = docs.mapInArrow(dealer(k, seed, pieces), ENTRIES).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(counted, ENTRIES)
    own = dealt.repartition(tasks, "grp").sortWithinPartitions("grp", "key").mapInArrow(chooser(t), "tree long, node long, n long")
    shared = saved(own.distinct(), "op4-shared")

    # one node of each tree is compared with all others there, and leaves the tree
    hubs = shared.groupBy("tree").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("most")).where("hub.node <> most").select("tree", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    starred = saved(shared.join(hubs, "tree").where("node <> hub"), "op4-starred")
    met = starred.select("node").union(starred.select("hub")).distinct()
    points = saved(sketch.select("node", "n", "payload").join(met, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("payload").alias("payload")), "op4-points")
    star = starred.where(f"{den} * cast(least(n, hub_n) as long) >= {num} * cast(greatest(n, hub_n) as long)").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    star = star.join(points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("payload").alias("pa")), "a").join(points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("payload").alias("pb")), "b")
    pairs = saved(star.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(bounded(t), "a long, b long"), "op4-star")
    links, known, left = [], None, starred.select("tree", "node", "n")
    for turn in range(NEAREST + 2):
        if not pairs.isEmpty():
            links.append(saved(verify(docs, nodes, pairs, k, t, seed), "op4-links"))
            known = connected_components(reduce(DataFrame.union, links), "op4-cc")
        if turn == NEAREST + 1:
            break
        # trees that hold more than one component: pairs from different ones that the bounds allow
        placed = left.withColumn("comp", F.col("node")) if known is None else left.join(known, "node", "left").select("tree", "node", "n", F.coalesce("root", "node").alias("comp"))
        placed = saved(placed, "op4-placed")
        mixed = placed.groupBy("tree").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y").select("tree", F.ceil(F.col("size") / CHUNK).cast("int").alias("parts"))
        left = saved(placed.join(mixed, "tree"), "op4-left")
        if left.isEmpty():
            break
        work = left.join(points.select("node", "payload"), "node")
        work = work.withColumn("own", F.pmod(F.hash("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        work = work.select("tree", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "comp", (F.col("own") > F.col("other")).cast("int").alias("side"), "payload")
        work = work.repartition("tree", "i", "j").sortWithinPartitions("tree", "i", "j")
        pairs = saved(work.mapInArrow(searcher(t, turn < NEAREST), "a long, b long").distinct(), "op4-pairs")
        left = left.select("tree", "node", "n")

    roots = nodes.select("node", "doc_id", F.col("node").alias("root")) if known is None else nodes.select("node", "doc_id").join(known, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    roots = saved(roots, "op4-roots")
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = saved(roots.join(least, "root").select("node", "component_id", "root"), "op4-named")
    return sketch.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "root", F.lit(seed).alias("seed"))


def named_sets(k: int, seed: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in batches:
            sets = (doc_set(t, memo, k) for t in batch.column(text_at).cast(pa.binary()).to_pylist())
            nodes = pa.array([fingerprint(s, seed) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, "_node"])

    return run


def one_of_each(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` without near copies: of each component the row with the smallest doc_id stays,
    null last. Rows are judged each by its own text, also where ids repeat or are null; of rows that share id and
    shingles one stays. Rows without shingles stay, but of such rows that are equal in all columns one."""
    spark, columns = docs.sparkSession, docs.columns
    groups = saved(jaccard_components(docs, k, num, den), "near-groups")
    seed = int(groups.first().seed) if not groups.isEmpty() else 0
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("keeper")
    roots = saved(groups.where("root is not null").groupBy("root").agg(keeper, F.count("*").alias("size")).select("root", F.col("keeper.doc_id").alias("id"), F.col("keeper.node").alias("first"), "size"), "near-roots")
    twice = groups.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    twice = saved(twice, "near-twice")
    # ids that name one row: those of copies go, and no text is shuffled while they are few enough
    gone = groups.join(roots.where("size > 1"), "root").where("doc_id is not null and not (doc_id <=> id and node = first)").select("doc_id").distinct()
    gone = saved(gone.union(twice.where("doc_id is not null")), "near-gone")
    kept = docs.join(maybe_broadcast(gone, BROADCAST_ROWS), "doc_id", "left_anti").where("doc_id is not null").select(*columns)
    if twice.isEmpty():
        return kept
    # ids that name several rows or none: by id and set
    some = maybe_broadcast(twice.withColumnRenamed("doc_id", "_id"), BROADCAST_ROWS)
    rows = docs.join(some, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    schema = T.StructType([*rows.schema.fields, T.StructField("_node", T.LongType())])
    rows = rows.mapInArrow(named_sets(k, seed, columns.index("text")), schema)
    first = roots.select(F.col("id").alias("_id"), F.col("first").alias("_first"))
    first = rows.join(maybe_broadcast(saved(first, "near-first"), BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_first")), "left_semi")
    one = first.groupBy("doc_id", "_node").agg(F.min(F.struct(*(c for c in columns))).alias("row")).select("row.*")
    bare = rows.where("_node is null").select(*columns).distinct()
    return kept.union(one.select(*columns)).union(bare)


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
