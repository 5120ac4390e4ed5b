"""Operator 8: masked pseudo-likelihood by a bidirectional window network.

The network predicts every token from two tokens on each side: position-wise embeddings of the four neighbours are
summed, passed through tanh, and a softmax in three steps down a tree of tokens (16 ways each) gives the
conditional probability. A document's score is the sum of its tokens' conditional log-probabilities; the mean is
comparable between lengths.

What it learns from the corpus grows with it: words are counted over all documents, in every task and then, packed by
buckets of their hashes, a bucket at a time; the 3,072 most frequent get tokens of their own. The others share 1,024 tokens by hash; the probability of such a
token is shared evenly by the distinct words that the whole corpus has in it. Texts are turned into tokens once
and saved. The network is trained in numpy where they lie, by parameter averaging: in each of two rounds every task takes
its share of the positions of each of its documents (every second one, the others in the other round, so that every
position of every document is trained on once) through mini-batch gradient steps from the common parameters, and the
results are averaged weighted by positions, added up before and after a shuffle by slices of the parameters. The driver
only gets the average, of a fixed size (some 330,000 numbers), and broadcasts it. The model, and with it each score, thus
depends somewhat on how the rows are dealt to tasks.

Null and empty texts have no tokens; their score is 0 and their mean null. Neighbours beyond a text's ends are a token of
their own. Repeated rows are scored alike and count in training as often as they occur. Long texts are scored in pieces
that see their neighbours' tokens, so that only their tokens are held whole. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop_saved, saved, ship_package, table, texts

WORDS, OWN = 16 * 16 * 16, 3072  # tokens, of which the first are words of their own
SHARED = WORDS - OWN
PAD = WORDS
DIM, SIDES = 16, (-2, -1, 1, 2)
ROUNDS, STEP, RATE = 2, 512, 0.15
SLICES = 16
FLUSH = 200_000  # distinct words that a task counts before it hands them on
SHORT = 8  # rows of a branch of the last level in a mini-batch up to which branches are stepped together
PIECE = 50_000  # tokens that are scored at once
HASH_SEED = 42  # as in the SQL function xxhash64
SHAPES = {"emb": (len(SIDES) * (WORDS + 1), DIM), "w0": (DIM, 16), "b0": (16,), "w1": (16, DIM, 16), "b1": (16, 16), "w2": (256, DIM, 16), "b2": (256, 16)}
SIDE_AT = np.arange(len(SIDES)) * (WORDS + 1)


def _word_counts(buckets: int):
    """Words and their numbers, packed into a row for each bucket of their hashes, so that the JVM sorts few rows, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            at = np.fromiter(map(xxhash.xxh64_intdigest, c, repeat(HASH_SEED)), np.uint64, len(c)) % np.uint64(buckets)
            order = at.argsort(kind="stable")
            words, n, at = np.fromiter(c, object, len(c))[order], np.fromiter(c.values(), np.int64, len(c))[order], at[order]
            first, size = runs_of(at) if len(c) else (order, order)
            runs = list(zip(first.tolist(), (first + size).tolist(), strict=True))
            packs = [b" ".join(words[x:y]) for x, y in runs]  # no word has a space
            return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int64)), pa.array(packs, pa.binary()), pa.array([n[x:y].tobytes() for x, y in runs], pa.binary())], names=["bucket", "words", "n"])

        count: Counter = Counter()
        for batch in batches:
            for t in texts(batch):
                count.update((t or b"").lower().split())
                if len(count) > FLUSH:
                    yield out(count)
                    count = Counter()
        yield out(count)

    return run


def _vocabulary_rows(top: list[tuple[int, bytes]], kinds: np.ndarray) -> pa.RecordBatch:
    """Rows ``(slot, word, n)``: words without a slot, and how many distinct words each slot has, without a word."""
    slots = np.flatnonzero(kinds)
    return pa.RecordBatch.from_arrays([pa.array([None] * len(top) + slots.tolist(), pa.int32()), pa.array([w for _, w in top] + [None] * len(slots), pa.binary()), pa.array([-n for n, _ in top] + kinds[slots].tolist(), pa.int64())], names=["slot", "word", "n"])


def _bucket_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: the most frequent words and the distinct words of each slot. The words of one bucket are held."""
    top, kinds, count, at = [], np.zeros(SHARED, np.int64), {}, -1

    def ended() -> None:
        nonlocal top
        if count:
            least = -top[-1][0] if len(top) == OWN else 1
            top = sorted(top + [(-n, w) for w, n in count.items() if n >= least])[:OWN]
            kinds[at % SHARED] += len(count)
            count.clear()

    for batch in batches:
        for bucket, words, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                ended()
                at = bucket
            for w, k in zip(words.split(), np.frombuffer(n, np.int64).tolist(), strict=True):
                count[w] = count.get(w, 0) + k
    ended()
    yield _vocabulary_rows(top, kinds)


def totals_of(batches: Iterable[pa.RecordBatch]) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """The most frequent words as ``(-n, word)``, in order, and each slot's distinct words, of rows that several tasks made."""
    top, kinds = [], np.zeros(SHARED, np.int64)
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        top = sorted(top + [(-n, w) for slot, w, n in rows if slot is None])[:OWN]
        for slot, _, n in rows:
            if slot is not None:
                kinds[slot] += n
    return top, kinds


def _merged_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _vocabulary_rows(*totals_of(batches))


class Tokens(dict):
    """Word to token, in order of frequency; other words by hash. The memo of others is bounded."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.words = words

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update((x, i) for i, x in enumerate(self.words))
        x = self[w] = OWN + xxhash.xxh64_intdigest(w, HASH_SEED) % SHARED
        return x

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int16, len(words))


def vocabulary(docs: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, and how many other distinct words share each further token."""
    docs = docs.select("text")
    buckets = SHARED * (1 + docs.rdd.getNumPartitions() // 2000)  # several to a slot where there is much input
    packed_counts = docs.mapInArrow(_word_counts(buckets), "bucket long, words binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    schema = "slot int, word binary, n long"
    totals = packed_counts.mapInArrow(_bucket_totals, schema).repartition(SLICES).mapInArrow(_merged_totals, schema).toArrow()  # OWN + SHARED rows a slice
    top, kinds = totals_of(totals.to_batches())
    words = [w for _, w in top]
    for w in words:
        kinds[xxhash.xxh64_intdigest(w, HASH_SEED) % SHARED] -= 1
    return words, np.maximum(kinds, 1)


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(5)
    return {k: (np.zeros(s) if k[0] == "b" else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in SHAPES.items()}


def line_of(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one line with two pads before, between and behind them, and where each begins."""
    pad = np.full(2, PAD, np.int16)
    return np.concatenate([pad, *(x for t in tokens for x in (t, pad))]), np.cumsum([2] + [len(t) + 2 for t in tokens[:-1]])


def contexts(tokens: list[np.ndarray], first: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centres and neighbours (n x 4) of the positions of several documents, or of one in ``stride`` of each from its ``first``."""
    line, begin = line_of(tokens)
    at = np.concatenate([np.arange(first, len(t), stride) + lo for t, lo in zip(tokens, begin, strict=True)]) if tokens else np.zeros(0, np.int64)
    return line[at], np.stack([line[at + d] for d in SIDES], axis=1)


ONES = {16: np.ones(16, np.float32)}


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(np.minimum(x, 60, out=x), out=x)
    x /= (x @ ONES[x.shape[1]])[:, None]
    return x


def hidden(p: dict, near: np.ndarray) -> np.ndarray:
    at = near + SIDE_AT
    h = p["emb"].take(at[:, 0], axis=0)
    for s in range(1, len(SIDES)):
        h += p["emb"].take(at[:, s], axis=0)
    return np.tanh(h, out=h)


def log_share(x: np.ndarray, pick: np.ndarray, shift: bool) -> np.ndarray:
    """Log-softmax of one column of each row; without a shift, no value may be so large that its exponential overflows."""
    if shift:
        x -= x.max(axis=1, keepdims=True)
    got = x[np.arange(len(x)), pick]
    return got - np.log(np.exp(x, out=x) @ ONES[x.shape[1]])


def may_overflow(p: dict) -> bool:
    """Whether a logit can pass 60: hidden values lie between -1 and 1."""
    return any(float((np.abs(p[w]).sum(axis=-2) + np.abs(p[b])).max()) > 60 for w, b in (("w0", "b0"), ("w1", "b1"), ("w2", "b2")))


def log_probs(p: dict, centre: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Conditional log-probability of each centre's token."""
    if not len(centre):
        return np.zeros(0)
    order = np.argsort(centre, kind="stable")
    t, h = centre[order].astype(np.int64), hidden(p, near[order])
    got, wide = np.empty(len(t)), may_overflow(p)
    for lo in range(0, len(t), 4096):  # pieces that stay in the processor's cache
        r = slice(lo, lo + 4096)
        got[r] = log_share(h[r] @ p["w0"] + p["b0"], t[r] >> 8, wide)
    for w, b, shift in (("w1", "b1", 8), ("w2", "b2", 4)):
        edges = np.searchsorted(t >> shift, np.arange(len(p[w]) + 1)).tolist()
        for k, (x, y) in enumerate(pairwise(edges)):
            for lo in range(x, y, 4096):
                r = slice(lo, min(lo + 4096, y))
                got[r] += log_share(h[r] @ p[w][k] + p[b][k], t[r] >> shift - 4 & 15, wide)
    out = np.empty(len(t))
    out[order] = got
    return out


def step(p: dict, centre: np.ndarray, near: np.ndarray, rate: float) -> None:
    """One gradient step on a mini-batch, in place."""
    n = len(centre)
    order = centre.argsort(kind="stable")
    t, at = centre.take(order).astype(np.int64), (near.take(order, axis=0) + SIDE_AT).T.ravel()
    x = p["emb"].take(at, axis=0).reshape(len(SIDES), n, DIM)
    for s in range(1, len(SIDES)):
        x[0] += x[s]
    h = np.ones((n, DIM + 1), np.float32)  # the last one is for the biases
    np.tanh(x[0], out=h[:, :DIM])
    g = less_one(softmax(h @ p["t0"]), t >> 8)
    dh = g @ p["w0"].T
    p["t0"] -= rate / n * (h.T @ g)
    descend(p["t1"], t >> 8, t >> 4 & 15, h, dh, rate, 0)
    descend(p["t2"], t >> 4, t & 15, h, dh, rate, SHORT)
    dx = dh * (1 - h[:, :DIM] * h[:, :DIM])
    # the steps of each neighbour by the root of their number, so that frequent words don't overshoot
    order = at.astype(np.uint16).argsort(kind="stable")  # there are fewer than 2**16 of them
    at = at.take(order)
    first, times = runs_of(at)
    dx = dx.take(order % n, axis=0)
    total = dx.take(first, axis=0)
    often = (times > 1).nonzero()[0]
    if len(often):
        some = times.take(often)
        again = dx.take(np.repeat(times > 1, times).nonzero()[0], axis=0).view(np.complex64)  # two columns in each addition
        total[often] = np.add.reduceat(again, some.cumsum() - some, axis=0).view(np.float32)
    total *= (rate / 4 / np.sqrt(times)).astype(np.float32)[:, None]
    at = at.take(first)
    p["emb"][at] = p["emb"].take(at, axis=0) - total


def less_one(g: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Takes one from a column of each row, in place."""
    at = np.arange(0, g.size, g.shape[1])
    at += pick
    g.ravel()[at] -= 1
    return g


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    edge = (x[1:] != x[:-1]).nonzero()[0]
    first = np.empty(len(edge) + 1, np.int64)
    first[0] = 0
    np.add(edge, 1, out=first[1:])
    size = np.empty(len(first), np.int64)
    np.subtract(first[1:], first[:-1], out=size[:-1])
    size[-1] = len(x) - first[-1]
    return first, size


def descend(w: np.ndarray, branch: np.ndarray, pick: np.ndarray, h: np.ndarray, dh: np.ndarray, rate: float, short: int) -> None:
    """One level of the tree: adds to the gradient of the hidden values, and steps each branch against the mean of its rows (of
    sixteen at least). Rows of a branch lie together; runs of more than ``short`` rows are taken one by one, the others all at
    once, a branch's rows in a block filled up to ``short``. The last row of a branch's weights are its biases."""
    first, size = runs_of(branch)
    of, m = branch.take(first), (rate / np.maximum(16, size)).astype(np.float32)[:, None, None]
    long = size > short
    some = of[long]
    runs = [(slice(x, y), k) for x, y, k in zip(first[long].tolist(), (first + size)[long].tolist(), some.tolist(), strict=True)]
    g, back, by = np.empty((len(branch), w.shape[2]), np.float32), np.empty_like(dh), np.empty((len(some), *w.shape[1:]), np.float32)
    for r, k in runs:
        np.matmul(h[r], w[k], out=g[r])
    few = (~long).nonzero()[0]
    if len(few):
        at = first[few][:, None] + np.arange(short)
        place = (np.arange(short) < size[few][:, None]).ravel().nonzero()[0]
        rest = at.ravel().take(place)
        blocks, own = h.take(np.minimum(at, len(branch) - 1, out=at), axis=0), w.take(of[few], axis=0)
        g[rest] = np.matmul(blocks, own).reshape(-1, w.shape[2]).take(place, axis=0)
    g = less_one(softmax(g), pick)
    for i, (r, k) in enumerate(runs):
        np.matmul(g[r], w[k, :-1].T, out=back[r])
        np.matmul(h[r].T, g[r], out=by[i])
    by *= m[long]
    w[some] -= by
    if len(few):
        full = np.zeros((len(few) * short, w.shape[2]), np.float32)
        full[place] = g.take(rest, axis=0)
        full = full.reshape(len(few), short, -1)
        back[rest] = np.matmul(own[:, :-1], np.ascontiguousarray(full.transpose(0, 2, 1))).transpose(0, 2, 1).reshape(-1, DIM).take(place, axis=0)
        by = np.matmul(blocks.transpose(0, 2, 1), full)
        by *= m[few]
        own -= by
        w[of[few]] = own
    dh += back


def packed(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unpacked(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32).copy()
        at += n
    for k in "012":  # the biases of a level lie behind its weights, as a last row of them
        both = out["t" + k] = np.concatenate([out["w" + k], out["b" + k][..., None, :]], axis=-2)
        out["w" + k], out["b" + k] = both[..., :-1, :], both[..., -1, :]
    return out


def _slices(total: np.ndarray, weight: float) -> pa.RecordBatch:
    parts = np.array_split(total, SLICES)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary()), pa.array([float(weight)] * SLICES)], names=["slice", "payload", "weight"])


def tokenised(batch: pa.RecordBatch, tokens: Tokens | None) -> Iterator[np.ndarray]:
    """Tokens of a batch's rows, from texts or from tokens that are saved already."""
    if "text" in batch.schema.names:
        yield from (tokens.of(x) for x in texts(batch))
    else:
        yield from (np.frombuffer(x, np.int16) for x in batch.column(batch.schema.get_field_index("tokens")).to_pylist())


def _tokens(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in tokenised(batch, tokens)], pa.binary())], names=["doc_id", "tokens"])

    return run


def _trained(held, turn: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = held.value
        tokens, p, seen, kept, waiting, size = Tokens(words), unpacked(flat), 0, [], [], 0

        def steps(last: bool) -> None:
            nonlocal seen, kept, waiting, size
            kept.append(contexts(waiting, turn, rounds))
            centre, near = (np.concatenate(x) for x in zip(*kept, strict=True))
            whole = len(centre) if last else len(centre) - len(centre) % STEP
            for lo in range(0, whole, STEP):
                step(p, centre[lo : lo + STEP], near[lo : lo + STEP], RATE)
            seen += whole
            kept, waiting, size = [(centre[whole:], near[whole:])], [], 0

        for batch in batches:
            for t in tokenised(batch, tokens):
                if len(t):
                    waiting.append(t)
                    size += len(t)
                    if size >= 40 * STEP:
                        steps(False)
        steps(True)
        yield _slices(packed(p) * np.float32(seen), seen)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[np.ndarray, float]] = {}
    for batch in batches:
        for k, x, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = total.get(k, (0.0, 0.0))
            total[k] = (old[0] + np.frombuffer(x, np.float32).astype(np.float64), old[1] + w)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x, _ in total.values()], pa.binary()), pa.array([w for _, w in total.values()])], names=["slice", "payload", "weight"])


def tokens_of(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """``(doc_id, tokens)``, saved."""
    return saved(docs.select("doc_id", "text").mapInArrow(_tokens(docs.sparkSession.sparkContext.broadcast(words)), "doc_id long, tokens binary"), "op8-tokens")


def train_on(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The parameters that all positions of ``rows(tokens)`` give, each trained on in one of the rounds."""
    spark, schema, flat = rows.sparkSession, "slice int, payload binary, weight double", packed(start())
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(([], flat))
        got = rows.select("tokens").mapInArrow(_trained(held, turn, rounds), schema).repartition(SLICES, "slice").mapInArrow(_added, schema).collect()
        parts = {r.slice: np.frombuffer(r.payload, np.float32) / r.weight for r in got if r.weight > 0}
        if len(parts) < SLICES:
            break
        flat = np.concatenate([parts[k] for k in range(SLICES)])
    return flat


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words with tokens of their own, the numbers of words that share the others, and the trained parameters."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words, kinds = vocabulary(docs)
    rows = tokens_of(docs, words)
    flat = train_on(rows, rounds)
    drop_saved(rows)
    return words, kinds, flat


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, flat = held.value
        p, alike = unpacked(flat), np.concatenate((np.zeros(OWN), np.log(kinds)))

        def score(part: list[np.ndarray]) -> list[float]:
            line, begin = line_of(part)
            at = np.flatnonzero(line != PAD)
            sums = np.zeros(len(part))
            for lo in range(0, len(at), PIECE):
                x = at[lo : lo + PIECE]
                c = line[x]
                logs = log_probs(p, c, np.stack([line[x + d] for d in SIDES], axis=1)) - alike[c]
                sums += np.bincount(np.searchsorted(begin, x, side="right") - 1, logs, len(part))
            return sums.tolist()

        for batch in batches:
            sums, sizes, part, held_ = [], [], [], 0
            for t in tokenised(batch, None):
                part.append(t)
                sizes.append(len(t))
                held_ += len(t)
                if held_ >= PIECE:
                    sums += score(part)
                    part, held_ = [], 0
            if part:
                sums += score(part)
            means = [s / n if n else None for s, n in zip(sums, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"])

    return run


def score_documents(docs: DataFrame, model: tuple[list[bytes], np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability)`` for each row of ``docs(doc_id, text)``; without a model, by one of these documents."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words, kinds = model[:2] if model else vocabulary(docs)
    rows = tokens_of(docs, words)
    held = docs.sparkSession.sparkContext.broadcast((kinds, model[2] if model else train_on(rows)))
    return rows.mapInArrow(_scored(held), "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
