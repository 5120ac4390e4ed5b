"""Operator 1: language identification by Bayesian fusion of evidence.

Languages are those that ``documents.lang`` names. Evidence for a row (a page or a document):

* text: byte trigrams of the (tag-free, lower-cased) text, hashed to 2**15 buckets, under smoothed per-language
  trigram counts of all labelled documents; tempered, since neighbouring trigrams are not independent;
* declared markup language, its primary subtag (``<html lang=...>``, wherever the element starts) : P(declared | language), estimated by a grouped aggregation of
  what pages declare against what their text says, with additive smoothing;
* host: P(language | host), smoothed hierarchically by grouped aggregation: counts of a host are smoothed towards its
  registered domain's, those towards its address suffix's, those towards the corpus's, those towards uniform. A row's
  own count is taken out of its host's before use (leave-one-out). A document's host is its source.

The posterior is the normalised product. Count tables are small (a row a host, domain or suffix; a piece of fixed size a
language and task, added up before it is dealt); the model that is broadcast has a fixed size for each language, and
more than ``LANGUAGES`` languages are scored in several scans, each by as many at most. Priors are joined by host; a host with a third of all rows
is one key on the small side, and adaptive execution can split the large side.

Nulls and empty texts give no text evidence (the prior and the declaration decide); a null url has no host. Unknown
declarations count as none. Repeated rows count as often as they occur. Without labelled documents there is no language,
and the result's language is null. Languages that tie are taken in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import saved, ship_package, table, texts
from waymark.llm.urls import parsed

BITS, PIECES, LANGUAGES = 15, 4, 200
TEMPER = 0.25  # weight of a trigram's log-likelihood
KAPPA = 4.0  # pseudo-counts that a level gets from the one above
DROPPED = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)
OPENED = re.compile(rb"<(?:(!--)|(html)\b|(script|style|textarea|title|template)\b)", re.IGNORECASE)
LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.IGNORECASE)


def visible(html: bytes) -> bytes:
    return DROPPED.sub(b" ", html)


def declaration(html: bytes) -> str | None:
    """The language that the html element declares, wherever in the page it is; comments, scripts and raw text are passed over if closed."""
    at, unclosed = 0, set()
    while m := OPENED.search(html, at):
        at = m.end()
        if m[2]:
            end = html.find(b">", at)
            if said := LANG.search(html, at, end if end >= 0 else len(html)):
                return said[1].decode().lower()
            if end < 0:
                return None
            at = end
            continue
        kind = (m[1] or m[3]).lower()
        if kind not in unclosed:
            end = html.find(b"-->", m.start() + 2) if m[1] else (c.start() if (c := re.compile(rb"</" + kind + rb"\b", re.IGNORECASE).search(html, at)) else -1)
            if end < 0:
                unclosed.add(kind)
            else:
                at = end + 2
    return None


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram; runs of white space count as one space."""
    b = np.frombuffer(b" ".join(text.lower().split()), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            if lang not in total:
                if len(total) >= LANGUAGES:
                    yield _rows(total)
                    total = {}
                total[lang] = np.zeros(1 << BITS, np.int64)
            g = trigrams(text or b"")
            if len(g):
                total[lang] += np.bincount(g, minlength=1 << BITS)
    yield _rows(total)


def _rows(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    return _table([(k, i, x.tobytes()) for k, v in total.items() for i, x in enumerate(v.reshape(PIECES, -1))])


def _table(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "piece", "payload"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for k, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            v = np.frombuffer(x, np.int64)
            total[k, i] = total[k, i] + v if (k, i) in total else v
    yield _table([(k, i, x.tobytes()) for (k, i), x in total.items()])


def trigram_models(labelled: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Languages in alphabetical order, ``LANGUAGES`` at once, and their log-probabilities, languages x buckets, from ``labelled(lang, text)``; all rows count."""
    ship_package(labelled.sparkSession)
    schema = "lang string, piece int, payload binary"
    counts = labelled.where("lang is not null").select("lang", "text").mapInArrow(_counted, schema)
    counts = saved(counts.repartition(PIECES * 4, "lang", "piece").mapInArrow(_summed, schema), "op1-trigrams")
    every = sorted(r.lang for r in counts.select("lang").distinct().collect())
    for lo in range(0, len(every), LANGUAGES):
        langs = every[lo : lo + LANGUAGES]
        table_ = np.zeros((len(langs), PIECES, (1 << BITS) // PIECES))
        for r in counts.where(F.col("lang").isin(langs)).collect():
            table_[langs.index(r.lang), r.piece] += np.frombuffer(r.payload, np.int64)
        table_ = table_.reshape(len(langs), -1) + 0.1
        yield langs, np.log(table_ / table_.sum(axis=1, keepdims=True)).astype(np.float32)


def trigram_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages at once."""
    parts = list(trigram_models(labelled))
    return [k for langs, _ in parts for k in langs], np.concatenate([x for _, x in parts] or [np.zeros((0, 1 << BITS), np.float32)])


EVIDENCE = "doc_id long, page_id long, host string, html boolean, n_grams long, declared string, likely array<double>, text string"


def _evidence(held, first: bool):
    """Adds the log-likelihoods under some languages, and in the first scan what the markup declares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        flat = np.ascontiguousarray(logs.T)  # buckets x languages
        for batch in batches:
            likely, said, grams = batch.column(6).to_pylist(), batch.column(5).to_pylist(), batch.column(4).to_pylist()
            for i, (t, html) in enumerate(zip(texts(batch), batch.column(3).to_pylist(), strict=True)):
                t = t or b""
                if html and first:
                    said[i] = declaration(t)
                g = trigrams(visible(t) if html else t)
                x = np.zeros(len(logs))
                for lo in range(0, len(g), 1 << 16):
                    x += flat[g[lo : lo + (1 << 16)]].sum(axis=0, dtype=np.float64)
                likely[i], grams[i] = (likely[i] or []) + (x * TEMPER).tolist(), len(g)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(grams, pa.int64()), pa.array(said, pa.string()), pa.array(likely, pa.list_(pa.float64())), batch.column(7)], names=batch.schema.names)

    return run


def _fused(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, channel, channel_of = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            likely = np.array(batch.column(2).to_pylist()).reshape(n, -1)
            prior = np.array(batch.column(5).to_pylist()).reshape(n, -1)
            own = np.array([langs.index(x) if x is not None else -1 for x in batch.column(4).to_pylist()])
            alone = batch.column(6).to_numpy(zero_copy_only=False)  # rows of the host, with this one
            weight = np.where(own >= 0, (alone + KAPPA), 1)
            prior = prior.copy()
            rows = np.flatnonzero(own >= 0)
            prior[rows] *= weight[rows, None]
            prior[rows, own[rows]] -= 1  # leave-one-out
            prior = np.maximum(prior, 1e-6)
            prior /= prior.sum(axis=1, keepdims=True)
            said = np.stack([channel[channel_of.get(x, 0)] for x in batch.column(3).to_pylist()])
            score = likely + np.log(prior) + said
            score -= score.max(axis=1, keepdims=True)
            post = np.exp(score)
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([langs[i] for i in best], pa.string()), pa.array(post[np.arange(n), best]), batch.column(3), batch.column(4), pa.array(prior[np.arange(n), best])], names=["doc_id", "page_id", "lang", "posterior", "declared", "text_lang", "host_prior"])

    return run


RESULT = "doc_id long, page_id long, lang string, posterior double, declared string, text_lang string, host_prior double"


def _smoothed(counts: F.Column, above: F.Column) -> F.Column:
    """(counts + KAPPA above) / (sum + KAPPA), element by element."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, above, lambda n, p: (n + KAPPA * p) / (total + KAPPA))


def identify(labelled: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Languages of ``pages(page_id, url, html)`` and ``documents(doc_id, text, source)``, learnt from ``labelled(lang, text)``."""
    spark = pages.sparkSession
    ship_package(spark)
    none, unsaid = F.lit(None).cast("long"), [F.lit(0).cast("long").alias("n_grams"), F.lit(None).cast("string").alias("declared"), F.array().cast("array<double>").alias("likely")]
    a = parsed(pages.select("page_id", "url", "html")).select(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.concat(F.lit("page:"), "host").alias("host"), F.lit(True).alias("html"), *unsaid, F.col("html").alias("text"))
    b = documents.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("host"), F.lit(False).alias("html"), *unsaid, "text")
    langs, rows = [], a.union(b)
    for some, logs in trigram_models(labelled):
        rows = rows.mapInArrow(_evidence(spark.sparkContext.broadcast(logs), not langs), EVIDENCE)
        langs += some
    if not langs:
        return a.union(b).select("doc_id", "page_id", *(F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("posterior", "double"), ("declared", "string"), ("text_lang", "string"), ("host_prior", "double"))))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("likely", F.array_max("likely")).cast("int"))
    rows = saved(rows.select("doc_id", "page_id", "host", "declared", "likely", F.when(F.col("n_grams") > 0, best).alias("text_lang")), "op1-evidence")

    # grouped aggregation: by host, and from hosts to domains to suffixes to the corpus
    counts = [F.sum(F.when(F.col("text_lang") == k, 1.0).otherwise(0.0)).alias(f"n{i}") for i, k in enumerate(langs)]
    hosts = rows.groupBy("host").agg(*counts, F.count("text_lang").alias("n_host"))
    parts = F.split(F.expr("substring(host, instr(host, ':') + 1)"), r"\.")  # pages and documents have name spaces of their own
    hosts = hosts.withColumns({"domain": F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(F.array_join(parts, ".")), "suffix": F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")})
    hosts = saved(hosts.select("host", "domain", "suffix", "n_host", F.array(*(f"n{i}" for i in range(len(langs)))).alias("own")), "op1-hosts")

    def level(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.array(*(F.sum(F.col("own")[i]) for i in range(len(langs)))).alias("own"))

    domains = level(hosts, "domain", "suffix")
    suffixes = level(domains, "suffix")
    whole = level(suffixes)
    top = whole.select(_smoothed(F.coalesce("own", F.array_repeat(F.lit(0.0), len(langs))), F.array_repeat(F.lit(1.0 / len(langs)), len(langs))).alias("p0"))
    root = top.first()
    p0 = F.array(*(F.lit(float(x)) for x in (root.p0 if root and root.p0 and None not in root.p0 else [1.0 / len(langs)] * len(langs))))
    p1 = suffixes.select("suffix", _smoothed(F.col("own"), p0).alias("p1"))
    p2 = domains.join(p1, "suffix").select("domain", "suffix", _smoothed(F.col("own"), F.col("p1")).alias("p2"))
    priors = hosts.join(p2, ["domain", "suffix"]).select("host", "n_host", _smoothed(F.col("own"), F.col("p2")).alias("prior"))
    # the declaration's channel: P(declared | language) by what texts say
    seen = rows.where("declared is not null and text_lang is not null").where(F.col("declared").isin(langs)).groupBy("declared", "text_lang").count().collect()  # languages x languages at most
    channel, channel_of = np.zeros((len(langs) + 1, len(langs))), {k: i + 1 for i, k in enumerate(langs)}
    table_ = np.full((len(langs), len(langs)), 0.5) + 4.5 * np.eye(len(langs))
    for r in seen:
        table_[channel_of[r.declared] - 1, langs.index(r.text_lang)] += r["count"]
    channel[1:] = np.log(table_ / table_.sum(axis=0, keepdims=True))
    fused = rows.join(priors, "host").select("doc_id", "page_id", "likely", "declared", "text_lang", "prior", "n_host")
    return fused.mapInArrow(_fused(spark.sparkContext.broadcast((langs, channel, channel_of))), RESULT)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents.select("lang", "text"), table(spark, sf_dir, "pages"), documents)
