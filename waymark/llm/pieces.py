"""Operator 3: SentencePiece encoding and decoding as a weighted finite-state transducer.

What the model file states is compiled: its normaliser (character map, dummy prefix, extra and escaped white space), its
pieces as a trie of arcs that read characters and write an id, and the byte fallback, an arc that reads any other character
and writes the ids of its bytes. Composed with an input this is a lattice over positions, and the tropical shortest path
through it is the encoding: positions are relaxed from left to right by (min, +), a state being a position with the piece
that was read last, for all words of a batch at once in numpy. Arcs weigh

* in a unigram model minus the piece's score;
* in a merge model 0 or infinity: an arc from piece p to piece q weighs 0 if merging the characters of pq by the model's
  scores ends in exactly p, q. A sequence of pieces is the model's segmentation just when every neighbouring pair is:
  whatever merge would cross a boundary would win inside the pair as well, because scores and positions order the merges of
  a pair as they do in the whole. Summed scores would not give such a model's encoding. Each position then has one state of
  finite distance. Pair weights are computed when first met, many at once, and remembered.

Words that no piece crosses are composed apart and remembered; both memos are bounded. Decoding concatenates pieces and
bytes and drops the dummy prefix. A row round-trips if decoding gives the normalised text.

Null and empty texts have no pieces. U+2581 in a text decodes to a space (the model does not tell them apart); every
other text round-trips under a model that changes no characters. Rows are encoded one by one, whole, in one scan without a
shuffle; extra columns are not read; repeated rows give repeated results. A very long text takes memory in proportion. The
compiled model (under 2 MB) is broadcast, so executors need no model file. Models with user-defined pieces are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ship_package, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
WORD_MEMO, PAIR_MEMO = 100_000, 500_000
CHUNK = 250_000  # characters that are composed at once
PART_BYTES = 1_000_000  # of texts whose words are looked up at once
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # kinds of pieces in a model file (fixed values)
UNIGRAM, MERGES = 1, 2  # kinds of models (fixed values)


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value (an integer, or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = data[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


def character_map(blob: bytes) -> dict[str, str]:
    """Sources and replacements of a precompiled character map: a double-array trie, then the replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, pool = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    out, todo = {}, [(0, b"")]
    while todo:
        node, read = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        if unit >> 8 & 1:
            value = units[base] & 0x7FFFFFFF
            out[read.decode()] = pool[value : pool.index(b"\0", value)].decode()
        for c in range(1, 256):
            if base ^ c < len(units) and units[base ^ c] & 0x800000FF == c:
                todo.append((base ^ c, read + bytes([c])))
    return out


def compiled(path: str = MODEL) -> dict:
    """What the transducer needs of a model file."""
    with open(path, "rb") as f:
        return compiled_proto(f.read())


def compiled_proto(proto: bytes) -> dict:
    told = {1: [], 2: [b""], 3: [b""]}
    for field, value in wire(proto):
        if field in told:
            told[field].append(value)
    trainer, spec = dict(wire(told[2][-1])), dict(wire(told[3][-1]))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, MERGES) or trainer.get(24, 0):
        raise ValueError("a model of unigrams or merges, with white space in front of words, is needed")
    byte_ids, pieces, out, unknown = [None] * 256, {}, [], 0
    for i, raw in enumerate(told[1]):
        f = dict(wire(raw))
        piece, what = f[1], f.get(3, NORMAL)
        out.append(b"")
        if what == USER:
            raise ValueError("user-defined pieces are not supported")
        if what == BYTE:
            out[i] = bytes([int(piece[3:5], 16)])
            byte_ids[out[i][0]] = i
        elif what == NORMAL:
            pieces[piece.decode()], out[i] = (i, float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0])), piece
        elif what == UNKNOWN:
            unknown = i
    whole = None not in byte_ids and trainer.get(35, 0)
    return {"kind": kind, "pieces": pieces, "bytes": byte_ids if whole else None, "unknown": unknown, "out": out, "map": character_map(spec.get(2, b"")), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}


class Normaliser:
    """Longest sources of the character map are replaced; then white space is treated as the model states."""

    def __init__(self, model: dict):
        self.map, self.prefix, self.squeeze, self.escape = model["map"], model["prefix"], model["squeeze"], model["escape"]
        self.sizes = sorted({len(s) for s in self.map}, reverse=True)
        firsts = {s[0] for s in self.map}
        self.any = re.compile("[" + "".join(map(re.escape, sorted(firsts))) + "]") if firsts else None

    def plain(self, text: str) -> str:
        """Without the dummy prefix and escapes."""
        if self.any and (m := self.any.search(text)):
            out, at = [text[: m.start()]], m.start()
            while at < len(text):
                n = next((k for k in self.sizes if text[at : at + k] in self.map and at + k <= len(text)), 0)
                out.append(self.map[text[at : at + n]] if n else text[at])
                at += n or 1
            text = "".join(out)
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def __call__(self, text: str) -> str:
        text = self.plain(text)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text


class Keys:
    """Distinct keys of 0 or more to values of 0 or more, by open addressing; whole arrays are looked up at once."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys=(), values=()):
        self.size, self.bits = 0, 10
        self.key, self.value = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        if len(keys):
            self.add(np.asarray(keys, np.int64), np.asarray(values, np.int32))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are not held yet."""
        self.size += len(keys)
        if self.size * 3 > len(self.key):
            old = self.key >= 0
            keys, values = np.concatenate((self.key[old], keys)), np.concatenate((self.value[old], values))
            self.bits = int(self.size * 4).bit_length()
            self.key, self.value = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int32)
        at = self.slots(keys)
        while len(keys):
            free = self.key[at] < 0
            self.key[at[free]] = keys[free]
            won = self.key[at] == keys
            self.value[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.key) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are not held."""
        at = self.slots(keys)
        held = self.key[at]
        same = held == keys
        out = np.where(same, self.value[at], np.int32(-1))
        more = np.flatnonzero(~same & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.key) - 1)
            held = self.key[at[more]]
            same = held == keys[more]
            out[more[same]] = self.value[at[more[same]]]
            more = more[~same & (held >= 0)]
        return out


class Transducer:
    """Symbols are the ids of pieces, then one for any unknown character, then those characters that only occur inside pieces."""

    def __init__(self, model: dict):
        self.normal, self.out, self.byte_ids, self.unknown, self.merges = Normaliser(model), model["out"], model["bytes"], model["unknown"], model["kind"] == MERGES
        pieces = model["pieces"]
        self.other = len(self.out)
        chars = {p: i for p, (i, _) in pieces.items() if len(p) == 1}
        for c in sorted({c for p in pieces for c in p} - set(chars)):
            chars[c] = self.other + 1 + len(chars) - sum(1 for x in chars.values() if x < self.other)
        self.symbols = self.other + 2 + sum(1 for x in chars.values() if x > self.other)
        self.first = self.symbols - 1  # the state before any piece
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for c, s in chars.items():
            self.symbol_of[ord(c)] = s
        least = min((s for _, s in pieces.values()), default=0.0)
        self.cost = np.full(self.symbols, 10.0 - least)
        rank = np.full(self.symbols, np.iinfo(np.int32).max, np.int32)
        order = {s: k for k, s in enumerate(sorted({s for _, s in pieces.values()}, reverse=True))}
        spelt: list[list[int]] = [[] for _ in range(self.symbols)]  # the characters of each symbol, as symbols; of `first` none
        for s in (*chars.values(), self.other):
            spelt[s] = [s]
        for p, (i, s) in pieces.items():
            self.cost[i], rank[i] = -s, order[s]
            spelt[i] = [chars[c] for c in p]
        self.rank, self.size = rank, np.array([len(x) for x in spelt])
        self.spelt, self.spelt_at = np.array([c for x in spelt for c in x], np.int64), np.cumsum(self.size) - self.size
        # all ways to put a piece together from two symbols, by the pair
        ids = chars | {p: i for p, (i, _) in pieces.items()}
        joins = {ids[p[:k]] * self.symbols + ids[p[k:]]: i for p, (i, _) in pieces.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids} if self.merges else {}
        self.joins = Keys(list(joins), list(joins.values()))
        self.pairs = Keys()
        usable = [i for i, _ in pieces.values()]
        if self.merges:  # a piece that its own characters do not merge into is never written
            usable = np.array([i for i in usable if self.size[i] > 1], np.int64)
            usable = usable[self.stay(np.full(len(usable), self.first), usable) == 1].tolist()
        edges, ends = {}, {}
        for i in usable:
            node = 0
            for s in spelt[i]:
                node = edges.setdefault(node * self.symbols + s, len(edges) + 1)
            ends[node] = i
        self.trie = Keys(list(edges), list(edges.values()))
        self.piece_at = np.full(len(edges) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.words = {}
        # where no piece has a letter before a mark, words are apart from the marks behind them
        near = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        marks = "".join(re.escape(c) for c in ".,;:!?|$%&*#" if not any(x[0].isalpha() and x[1] == c for x in near))
        breaks = "" if any("\n" in p for p in pieces) else "\n"
        alone = all(SPACE not in p[1:] or set(p) == {SPACE} for p in pieces)
        word = f"{SPACE}*[^\\W\\d_]+(?=[{marks}{SPACE}{breaks}]|\\Z)|" if marks else ""
        self.cut = re.compile(f"{word}{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|{breaks}" if breaks else "")).findall if alone else lambda text: [text]
        self.plain = [p.replace(SPACE.encode(), b" ") for p in self.out]

    def stay(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """1 where merging the characters of p and then q, best score first and then leftmost, never joins across their
        boundary and leaves one symbol on each side; all rows at once. ``first`` has no characters."""
        size = self.size[p] + self.size[q]
        out = np.zeros(len(p), np.int32)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 4096):
            rows = order[lo : lo + 4096]
            left, edge = size[rows], self.size[p[rows]]
            wide = int(left.max())
            sym = np.full((len(rows), wide + 1), -1, np.int64)
            for part, shift in ((p[rows], np.zeros_like(edge)), (q[rows], edge)):
                n = self.size[part]
                row, at = np.repeat(np.arange(len(rows)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                sym[row, at + (np.repeat(shift, n))] = self.spelt[self.spelt_at[part][row] + at]
            told = self.told(sym[:, :-1], sym[:, 1:])
            cols = np.arange(wide + 1)
            while len(rows):
                best = np.where(told >= 0, self.rank[told], np.iinfo(np.int32).max)
                at = best.argmin(axis=1)
                n = np.arange(len(rows))
                ready = told[n, at] < 0
                out[rows[ready]] = left[ready] == 1 + (edge[ready] > 0)
                go = ~ready & ((edge == 0) | (at != edge - 1))
                rows, left, edge, at, sym, told = rows[go], left[go] - 1, edge[go], at[go], sym[go], told[go]
                if not len(rows):
                    break
                edge = edge - (at < edge - 1)
                n = np.arange(len(rows))
                sym[n, at] = told[n, at]
                step = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), wide)
                sym = np.take_along_axis(sym, step, axis=1)
                sym[:, -1] = -1
                told = np.take_along_axis(told, np.minimum(step[:, :-1], wide - 1), axis=1)
                told[:, -1] = -1
                told[n, np.minimum(at, wide - 1)] = self.told(sym[n, at], sym[n, np.minimum(at + 1, wide)])
                some = np.flatnonzero(at > 0)
                told[some, at[some] - 1] = self.told(sym[some, at[some] - 1], sym[some, at[some]])
        return out

    def told(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols join into; -1 for none."""
        keys = np.where((a >= 0) & (b >= 0), a * self.symbols + b, 0)
        got = self.joins.get(keys.ravel()).reshape(keys.shape)
        return np.where((a >= 0) & (b >= 0), got, -1)

    def weights(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of the arcs from states whose last piece is p, reading q."""
        if not self.merges:
            return self.cost[q]
        keys = p.astype(np.int64) * self.symbols + q
        got = self.pairs.get(keys)
        got[(p == self.first) | (p == self.other) | (q == self.other)] = 1
        if (got < 0).any():
            new = np.unique(keys[got < 0])
            a, b = new // self.symbols, new % self.symbols
            stay = self.stay(a, b)
            if self.pairs.size + len(new) > PAIR_MEMO:
                self.pairs = Keys()
            self.pairs.add(new, stay)
            lost = got < 0
            got[lost] = stay[np.searchsorted(new, keys[lost])]
        return np.where(got == 1, 0.0, np.inf)

    def compose(self, words: list[str]) -> list[bytes]:
        """The shortest path of each word, as packed ids: (min, +) over the lattices of all words, position by position."""
        text = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        kind = np.int32 if 2 * len(text) < 1 << 31 else np.int64
        ends = np.cumsum(size).astype(kind)
        begin = ends - size.astype(kind)
        sym = self.symbol_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=kind), size)
        # arcs: by trie, for all positions at once; a character that is no piece is an arc as well
        at = np.arange(len(text), dtype=kind)
        arcs, node = [(at, np.ones(len(at), np.int8), sym)], self.trie.get(sym.astype(np.int64))
        at, node = at[node >= 0], node[node >= 0]
        for n in range(2, 1 << 30):
            ok = at + n <= ends[word[at]]
            at, node = at[ok], node[ok]
            node = self.trie.get(node.astype(np.int64) * self.symbols + sym[at + n - 1])
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            piece = self.piece_at[node]
            some = piece >= 0
            arcs.append((at[some], np.full(int(some.sum()), n, np.int8 if n < 128 else np.int64), piece[some]))
        start, length, read = (np.concatenate(x) for x in zip(*arcs, strict=True))
        offset = start - begin[word[start]]
        order = np.argsort(offset.astype(np.int16) if size.max() < 32768 else offset, kind="stable")
        start, length, read = start[order], length[order], read[order]
        cuts = np.searchsorted(offset[order], np.arange(int(size.max()) + 1))
        # a word of n characters has n + 1 positions
        src = start + word[start]
        dst = src + length
        far, last, back = np.full(len(text) + len(words), np.inf), np.full(len(text) + len(words), self.first, np.int32), np.zeros(len(text) + len(words), kind)
        heads = begin + np.arange(len(words), dtype=kind)
        far[heads] = 0.0
        for lo, hi in pairwise(cuts.tolist()):
            u, v, q = src[lo:hi], dst[lo:hi], read[lo:hi]
            total = far[u] + self.weights(last[u], q)
            ok = np.isfinite(total)
            u, v, q, total = u[ok], v[ok], q[ok], total[ok]
            best = total < far[v]
            u, v, q, total = u[best], v[best], q[best], total[best]
            np.minimum.at(far, v, total)
            best = far[v] == total
            last[v[best]], back[v[best]] = q[best], u[best]
        # the path, from each word's end
        on = np.zeros(len(far), bool)
        here, head = ends + np.arange(len(words), dtype=kind), heads
        while len(here):
            on[here] = True
            here = back[here]
            go = here > head
            here, head = here[go], head[go]
        found = np.flatnonzero(on)
        ids, of = last[found], np.searchsorted(heads, found, side="right") - 1
        strange = ids >= self.other
        if strange.any():
            parts = [self.fallback(text[n - 1 - w]) if s else [i] for i, s, n, w in zip(ids.tolist(), strange.tolist(), found.tolist(), of.tolist(), strict=True)]
            of = np.repeat(of, [len(x) for x in parts])
            ids = np.array([x for p in parts for x in p])
        packed = ids.astype(np.int32).tobytes()
        edge = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(words))) * 4)).tolist()
        return [packed[x:y] for x, y in pairwise(edge)]

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words that are not remembered are composed together."""
        cut = [self.cut(self.normal(t)) for t in texts]
        words = set().union(*cut)
        if len(self.words) + len(words) > WORD_MEMO:
            self.words = {}
        got = self.words
        new = sorted(words.difference(got), key=len)  # words of like length together
        late = {}  # not to be remembered
        at = 0
        while at < len(new):
            end = chars = 0
            while at + end < len(new) and (not end or chars + len(new[at + end]) <= CHUNK):
                chars += len(new[at + end])
                end += 1
            part = new[at : at + end]
            keep = late if len(part[-1]) > 64 or len(got) + end > WORD_MEMO else got
            keep.update(zip(part, self.compose(part), strict=True))
            at += end
        if late:
            late |= {w: got[w] for w in words if w in got}
        every = late or got
        return [np.frombuffer(b"".join(map(every.__getitem__, c)), np.int32) for c in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return (raw[1:] if self.normal.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def transducer(model) -> Transducer:
    """Of a broadcast model; a Python worker keeps the last one with its memos from task to task."""
    value = model.value
    key = hash(tuple(value["out"]))
    if getattr(transducer, "key", None) != key:
        transducer.key, transducer.held = key, Transducer(value)
    return transducer.held


def parts_of(body: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of rows of some PART_BYTES together."""
    lo = held = 0
    for i, t in enumerate(body):
        held += len(t or "")
        if held >= PART_BYTES or i == len(body) - 1:
            yield lo, i + 1
            lo, held = i + 1, 0


def coder(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        is_byte = np.zeros(len(t.out), bool)
        is_byte[t.byte_ids or []] = True
        for batch in batches:
            docs, body = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in parts_of(body):
                part = [x or "" for x in body[lo:hi]]
                ids = t.encode_all(part)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                trips = [t.decode(i) == t.normal.plain(x) for i, x in zip(ids, part, strict=True)]
                n_bytes = [int(is_byte[i].sum()) for i in ids]
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(n_bytes, pa.int64()), pa.array(trips, pa.bool_())], names=["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"])

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, n_pieces, n_bytes, round_trip)`` for each row of ``docs(doc_id, text)``."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(compiled(model))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(coder(held), "doc_id long, ids array<int>, n_pieces long, n_bytes long, round_trip boolean")


def decoder(model, id_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for batch in batches:
            column = batch.column(1)
            out = [t.decode(column[i].values.to_numpy(zero_copy_only=False)) if column[i].is_valid else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` for each row of ``encoded(doc_id, ids)``; a null list decodes to null."""
    ship_package(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(compiled(model))
    return encoded.select("doc_id", "ids").mapInArrow(decoder(held, "ids"), "doc_id long, text string")


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
