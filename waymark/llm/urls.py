"""Operator 2: URL filters by longest rule and a Bloom filter cascade.

Rules are (verdict, host, path prefix) and a rule fits its host and all subdomains; the longest rule string wins. Where no
rule fits, a url is blocked if its host, a parent domain, or its host and path together are on the list. The list is encoded
over the corpus's complete key universe (all hosts, parent domains and hosts with paths of its urls): level 1 holds the listed keys, level 2 those other keys that
pass level 1, level 3 the listed keys that pass level 2, and so on until no key passes wrongly. A key's level parity then
is its exact membership, so urls are judged in one scan with the filters at hand, without a join with the list.

Levels are built from distinct keys by aggregating set bits into 64-bit words, and these into slices, where the keys
lie. The filters are broadcast; their total
size is checked against ``FILTER_BYTES``, and a longer list is encoded as several cascades, by a hash of the key, each
of which is applied in a scan of its own.

A null url, or one without ``://``, has an empty host and path, fits no rule and is on no list: it is allowed. Keys are
compared after lower-casing A-Z; empty and null listed keys are ignored. Repeated rows are judged alike. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import saved, ship_package, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Keys to block where no rule fits; a parameter. The query adds a sixteenth of the urls, by a hash, in place of a list of urls.
LISTED = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org")
FILTER_BYTES = 64 << 20
HASHES, BITS_A_KEY = 4, 8
LEVELS = 64
SLICE = 4096  # 64-bit words that the driver gets in one piece


@dataclass
class Cascade:
    """Levels of bit arrays; positions come from two 64-bit hashes of the key and the level."""

    levels: list[tuple[int, np.ndarray]]

    def listed(self, key: str) -> bool:
        for depth, (bits, words) in enumerate(self.levels):
            if not all(int(words[p >> 6]) >> (p & 63) & 1 for p in positions(key, depth, bits)):
                return depth % 2 == 1
        return len(self.levels) % 2 == 1


def positions(key: str, depth: int, bits: int) -> list[int]:
    raw = key.encode()
    a, b = xxhash.xxh64_intdigest(raw, seed=2 * depth + 1), xxhash.xxh64_intdigest(raw, seed=2 * depth + 2) | 1
    return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % bits for i in range(HASHES)]


def _bits_of(depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([p for k in batch.column(0).to_pylist() for p in positions(k, depth, bits)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "mask"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        word, mask, at = (batch.column(i).to_numpy() for i in range(3))
        for k in np.unique(at).tolist():
            own = at == k
            held.setdefault(k, np.zeros(SLICE, np.uint64))[word[own] - k * SLICE] |= mask[own].view(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "words"])


def _passing(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, (bits, words) = held.value
        for batch in batches:
            keep = [all(int(words[p >> 6]) >> (p & 63) & 1 for p in positions(k, depth, bits)) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["key"])

    return run


def build_cascade(listed: DataFrame, others: DataFrame, most_bytes: int = FILTER_BYTES) -> Cascade:
    """From two frames of distinct keys that have none in common."""
    spark = listed.sparkSession
    inside, outside, levels, used = saved(listed.select("key"), "op2-in"), saved(others.select("key"), "op2-out"), [], 0
    for depth in range(LEVELS):
        count = inside.count()
        if not count:
            return Cascade(levels)
        bits = max(64, -(-count * BITS_A_KEY // 64) * 64)
        used += bits // 8
        if used > most_bytes:
            raise ValueError("the cascade passes its size bound; encode the list as more parts")
        words = np.zeros(-(-bits // 64 // SLICE) * SLICE, np.uint64)
        masks = inside.mapInArrow(_bits_of(depth, bits), "word long, mask long").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
        slices = masks.withColumn("slice", F.expr(f"word div {SLICE}")).repartition(max(1, min(200, len(words) // SLICE)), "slice").mapInArrow(_slices, "slice long, words binary")
        for at, part in slices.collect():
            words[at * SLICE : (at + 1) * SLICE] |= np.frombuffer(part, np.uint64)
        levels.append((bits, words))
        held = spark.sparkContext.broadcast((depth, (bits, words)))
        inside, outside = saved(outside.mapInArrow(_passing(held), "key string"), "op2-pass"), inside
    raise RuntimeError("the cascade did not settle")


def parsed(urls: DataFrame) -> DataFrame:
    """Adds host and path, by the rule of the module."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


def keys_of(host: F.Column) -> F.Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def universe_of(rows: DataFrame) -> DataFrame:
    """All distinct keys of ``rows(host, path)``; hosts first, so that few names are cut up."""
    hosts = rows.select("host").where("host <> ''").distinct().select(F.explode(keys_of(F.col("host"))).alias("key"))
    return hosts.union(rows.where("host <> '' and path <> ''").select(F.concat("host", "path"))).distinct()


def by_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """The rule string and its verdict, null where none fits; longer rules are asked first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _judge(held, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade, memo = held.value, {}
        for batch in batches:
            out = []
            for host, path, was in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if host not in memo:
                    if len(memo) > 200_000:
                        memo.clear()
                    names = host.split(".")
                    keys = [".".join(names[i:]) for i in range(len(names))] if host else []
                    memo[host] = any(xxhash.xxh64_intdigest(k.encode()) % parts == part and cascade.listed(k) for k in keys)
                url = host + path if host and path else None
                out.append(was or memo[host] or (url is not None and xxhash.xxh64_intdigest(url.encode()) % parts == part and cascade.listed(url)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.bool_())], names=batch.schema.names)

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: DataFrame | Sequence[str] = LISTED, parts: int | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` for each row of ``pages(page_id, url)``.

    The urls are taken one by one; only distinct keys are aggregated. ``parts``: cascades that the list is cut into, by
    default as many as its size needs.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    rule, verdict = by_rule(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"), F.lit(False).alias("listed"))
    names = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "key string")
    # the host of a key is compared in lower case, a path as it stands
    cut = F.instr("key", "/")
    names = names.select(F.when(cut > 0, F.concat(F.translate(F.expr("left(key, instr(key, '/') - 1)"), UPPER, LOWER), F.expr("substring(key, instr(key, '/'))"))).otherwise(F.translate("key", UPPER, LOWER)).alias("key")).where("key <> ''").distinct()
    universe = saved(universe_of(rows), "op2-universe")
    inside = saved(universe.join(names, "key", "left_semi"), "op2-listed")
    if parts is None:  # the levels together take less than twice the first
        parts = max(1, -(-2 * BITS_A_KEY * max(inside.count(), 1) // 8 // (FILTER_BYTES // 2)))
    others = universe.join(names, "key", "left_anti")
    for part in range(parts):
        mine = _of_part(part, parts)
        cascade = build_cascade(inside.where(mine), others.where(mine)) if parts > 1 else build_cascade(inside, others)
        rows = rows.mapInArrow(_judge(spark.sparkContext.broadcast(cascade), part, parts), "page_id long, host string, path string, rule string, said string, listed boolean")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def _of_part(part: int, parts: int) -> F.Column:
    own = F.pandas_udf(lambda s: s.map(lambda k: xxhash.xxh64_intdigest(k.encode()) % parts == part), "boolean")
    return own(F.col("key"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    url = F.concat("host", "path")
    urls = parsed(pages).where("host <> '' and path <> ''").where(F.md5(url).startswith("0")).select(url.alias("key"))
    return filter_urls(pages, listed=urls.union(spark.createDataFrame([(x,) for x in LISTED], "key string")))


_IN_LIST = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED)
OP2_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, ({_IN_LIST} OR (host <> '' AND path <> '' AND starts_with(md5(host || path), '0'))) AS listed, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM ruled
"""
