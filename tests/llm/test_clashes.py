"""Every operator with extra columns under its inner names, repeated rows, and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import contain, embeddings, jaccard, langid, lengths, lm, pieces, quality, secrets, urls

EXTRA = ["y", "_id", "_doc", "node", "n", "score", "ids", "tokens", "key", "grp", "vec", "label2", "host", "path", "verdict", "lang2", "root", "length", "range", "tree", "item_id2", "spans", "words", "quality", "own", "a", "b"]


@pytest.fixture(scope="module")
def clash(spark):
    text = "secret = abcdefgh12 and some more words to read here"
    rows = [(1, text, "en", "s.org", 50), (1, text, "en", "s.org", 50), (2, None, None, None, None), (3, "", "fr", "", 0), (None, "un deux trois quatre cinq six", "fr", "t.fr", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def test_document_operators(spark, clash):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (9, None)], "doc_id long, quality int").withColumns({c: F.lit(1) for c in ("text", "y", "_doc", "n_chars")})
    model = quality.train(clash, labels)
    assert quality.score_quality(clash, model, ["doc_id"]).count() == 5
    assert secrets.scan_secrets(clash).count() == 5
    assert pieces.encode_pieces(clash).where("round_trip").count() == 5
    assert jaccard.jaccard_components(clash).count() == 5
    assert lm.score_documents(clash).count() == 5
    assert lengths.with_suffix_sums(lengths.length_histogram(clash)).agg(F.sum("n_docs")).first()[0] == 5
    items = spark.createDataFrame([(1, "and some more words to read"), (1, "and some more words to read"), (2, None), (None, "un deux trois quatre")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert sorted((r.doc_id, r.item_id) for r in contain.contained(clash, items).collect()) == [(1, 1)] * 4
    assert contain.without_items(clash, items).columns == clash.columns
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>x"), (1, "http://a.org/", "<p>x"), (None, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in EXTRA})
    assert urls.filter_urls(pages).count() == 3
    assert langid.identify(clash, pages, clash).count() == 8


def test_embeddings_clash_and_range(spark):
    rows = [(1, 0, [1e-200] * 4), (2, 0, [1.0] * 4), (3, 0, [1e200] * 4), (4, 0, [1.0, 0.0, 0.0, 0.0]), (5, 0, [-0.0, 0.0, 0.0, 0.0]), (6, None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("vec", "node", "grp", "times", "links", "root", "i", "j")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


def test_interactions_equal_the_sum_over_pairs():
    m, rng = quality.Machine(), np.random.default_rng(0)
    m.w = rng.normal(size=m.w.shape).astype(np.float32)
    idx, val = quality.features(b"some Words of a text, 12 of them\nsome words", 40, quality.WordHash())
    pairs = sum(float(m.w[a, 1:] @ m.w[b, 1:]) * float(x) * float(y) for i, (a, x) in enumerate(zip(idx, val, strict=True)) for b, y in zip(idx[:i], val[:i], strict=True))
    assert m.raw(idx, val, np.array([0]))[0][0] == pytest.approx(float(m.w[idx, 0] @ val) + pairs, rel=1e-3)


def test_sample_is_the_smallest_hashes(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 9, 50) for i in range(40)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = quality.train(docs.repartition(7), labels, 10), quality.train(docs.coalesce(1), labels.repartition(5), 10)
    assert np.array_equal(a.w, b.w)


def test_lm_scores_sum_the_conditional_probabilities(spark):
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice([f"w{k}" for k in range(50)], 30))) for i in range(40)], "doc_id long, text string")
    words, kinds, flat = model = lm.train(docs)
    p, tokens = lm.unpacked(flat), lm.Tokens(words)
    text = "w1 w2 unseen w3 w1 w40"
    (row,) = lm.score_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    ids = [lm.PAD, lm.PAD, *tokens.of(text.encode()).tolist(), lm.PAD, lm.PAD]
    want = 0.0
    for i in range(2, len(ids) - 2):
        h = np.tanh(sum(p["emb"][s * (lm.WORDS + 1) + ids[i + d]] for s, d in enumerate(lm.SIDES)).astype(np.float64))
        t = ids[i]
        every = []  # the whole distribution over all tokens, down the tree
        for x, k in ((h @ p["w0"] + p["b0"], t >> 8), (h @ p["w1"][t >> 8] + p["b1"][t >> 8], t >> 4 & 15), (h @ p["w2"][t >> 4] + p["b2"][t >> 4], t & 15)):
            every.append(x[k] - np.log(np.exp(x).sum()))
        want += sum(every) - (np.log(kinds[t - lm.OWN]) if t >= lm.OWN else 0)
    assert row.n_tokens == 6 and row.pseudo_log_likelihood == pytest.approx(want, rel=1e-4)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_containment_of_spread_and_tiny_items(spark):
    rng = np.random.default_rng(9)
    vocab = [f"v{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([5] * 40 + [6] * 10 + [40] * 5)]
    docs = []
    for i, t in items:
        w = t.split()
        noise = lambda n: " ".join(rng.choice(vocab, n))
        docs.append((i, f"{noise(3)} {t} {noise(200)}"))
        if len(w) > 30:  # shingles of the item, far apart
            docs.append((100 + i, " ".join(f"{noise(60)} {' '.join(w[j : j + 5])}" for j in range(len(w) - 4))))
    got = {(r.doc_id, r.item_id) for r in contain.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got >= {(i, i) for i, _ in items} | {(100 + i, i) for i, t in items if len(t.split()) > 30}


def test_many_languages_in_several_scans(spark, monkeypatch):
    words = {"fil": "ang pusa ay nasa mesa", "fi": "kissa on pöydällä tänään", "fr": "le chat est sur la table", "de": "die katze ist auf dem tisch", "es": "el gato duerme en casa"}
    known = spark.createDataFrame(list(words.items()), "lang string, text string")
    pages = spark.createDataFrame([(1, "http://a.org/", "<html lang=fil-PH></html>"), (2, None, None)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(words.values())], "doc_id long, text string, source string")
    one = sorted(map(str, langid.identify(known, pages, docs).collect()))
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert sorted(map(str, langid.identify(known, pages, docs).collect())) == one
    got = {r.doc_id: r for r in langid.identify(known, pages, docs).where("doc_id is not null").collect()}
    assert [got[i].text_lang for i in range(5)] == list(words)
    assert langid.identify(known, pages, docs).where("page_id = 1").first().lang == "fil"


def test_listed_urls_and_levels(spark):
    rows = [(i, f"http://H{i % 50}.org/a/{i}") for i in range(4000)]
    listed = [f"h{i % 50}.ORG/a/{i}" for i in range(0, 4000, 5)] + ["h7.org", "", None, "/x"]
    df, names = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(x,) for x in listed], "key string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(df, listed=names).collect()}
    assert got == {i: "block" if i % 5 == 0 or i % 50 == 7 else "allow" for i in range(4000)}
    universe = urls.universe_of(urls.parsed(df))
    cascade = urls.build_cascade(names.where("key like '%/a/%'").select(F.lower("key").alias("key")), universe.where("not (key like '%/a/%' and cast(regexp_extract(key, '([0-9]+)$', 1) as int) % 5 = 0)"))
    assert len(cascade.levels) > 2
