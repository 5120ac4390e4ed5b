"""The transducer against the library: merge and unigram models, normalisers, long and repeated rows, clashing columns."""

import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from waymark.llm import pieces


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(scored, kind, byte_fallback=True, squeeze=0, charsmap=b""):
    """A model written by hand, not trained."""
    rows = [field(1, b"<unk>") + field(2, 0.0) + field(3, 2), field(1, b"<s>") + field(2, 0.0) + field(3, 3), field(1, b"</s>") + field(2, 0.0) + field(3, 3)]
    rows += [field(1, f"<0x{b:02X}>".encode()) + field(2, 0.0) + field(3, 6) for b in range(256)] if byte_fallback else []
    rows += [field(1, p.encode()) + field(2, s) + field(3, 1) for p, s in scored.items()]
    trainer = field(3, kind) + field(35, int(byte_fallback))
    spec = field(1, b"own") + field(2, charsmap) + field(3, 1) + field(4, squeeze) + field(5, 1)
    return b"".join(field(1, r) for r in rows) + field(2, trainer) + field(3, spec)


@pytest.mark.parametrize("kind", [pieces.UNIGRAM, pieces.MERGES])
@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_hand_written_models_equal_the_library(kind, byte_fallback, squeeze):
    rng = np.random.default_rng(kind)
    letters = "abcde▁"
    some = sorted({"".join(rng.choice(list(letters), int(rng.integers(2, 5)))) for _ in range(150)})
    some = [p for p in some if "▁" not in p[1:]]
    scored = {c: -20.0 - 0.37 * i for i, c in enumerate(letters)} | {p: float(np.float32(-3 - 11 * rng.random())) for p in some}
    proto = model_file(scored, kind, byte_fallback, squeeze)
    sp, t = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces.Transducer(pieces.compiled_proto(proto))
    texts = ["", " ", "  ab  ba ", "aé日b", "éé"] + ["".join(rng.choice(list("abcde  x"), int(rng.integers(1, 40)))) for _ in range(400)]
    got = t.encode_all(texts)
    if byte_fallback:
        assert [x.tolist() for x in got] == [sp.encode(x) for x in texts]
        assert all(t.decode(i) == t.normal.plain(x) for i, x in zip(got, texts, strict=True))
    else:  # the library writes a run of unknown characters as one
        one = lambda x: [a for i, a in enumerate(x) if not (a == 0 and i and x[i - 1] == 0)]
        assert [one(x.tolist()) for x in got] == [one(sp.encode(x)) for x in texts]


def test_character_map_equals_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = library.serialized_model_proto()
    spec = dict(pieces.wire(next(v for f, v in pieces.wire(proto) if f == 3)))
    model = {"map": pieces.character_map(spec[2]), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    own = pieces.Normaliser(model)
    texts = ["ﬁne  ＡＢＣ①  ", "é Å ガギ", "a\tb\r\nc　d", "½ ㍿ ﷺ", "plain text"]
    assert [own(x) for x in texts] == [library.normalize(x) for x in texts]


def test_long_words_and_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdefghij"), 3000)) + " " + " ".join("".join(rng.choice(list("aeiostrn"), 7)) for _ in range(60_000))
    rows = [(1, long), (2, "x" * 70), (2, "x" * 70), (None, "a b"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n_pieces": F.lit("x")})
    got = sorted((r.doc_id or -1, list(r.ids), r.round_trip) for r in pieces.encode_pieces(df).collect())
    assert got == sorted((d or -1, sp.encode(t or ""), True) for d, t in rows)
