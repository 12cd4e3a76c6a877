"""Operator 7: URL rules and host lists by a Bloom filter cascade.

The listed keys (rules, as host plus path) are encoded in level 0; the keys of the corpus that level 0 wrongly
admits in level 1; the listed keys that level 1 wrongly admits in level 2; and so on until a level admits nothing
wrongly. Over the corpus's complete key universe membership is then exact, and a url is judged by probing bits
that each executor holds, without a join.

The bits are broadcast, so their size is estimated before they are built: a universe whose cascade would need more than
`max_bytes` is split by a hash of the key into shards, each with a cascade of its own, and the urls pass the shards one
after the other, so no more than one shard is held at once. Building reads the universe once per level, and what reaches
the driver is one shard's bits alone. Keys are told apart by two independent 64-bit hashes.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; an
empty path fits no rule that has a path; repeated rows are each judged; an empty table gives an empty result; of
two rules that fit, the longer (host and path together) wins, of equally long ones the blocking one. Only the
named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import cut, drop, map_columns, table

MAX_BYTES = 64 << 20
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One Bloom filter: 64-bit words and the number of hashes; its number salts the hashes."""

    number: int
    n_bits: int
    n_hashes: int
    words: np.ndarray

    def places(self, h1: np.ndarray, h2: np.ndarray, k: int) -> np.ndarray:
        salt = np.uint64((self.number * 0x9E3779B97F4A7C15 + k * 0xD6E8FEB86659FD93) & (2**64 - 1))
        return _mix(_mix(h1 ^ salt) + h2 * np.uint64(2 * k + 1)) % np.uint64(self.n_bits)

    def admits(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for k in range(self.n_hashes):
            at = self.places(h1, h2, k)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return out


def levels_admitting(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For each key the number of levels, from the first on, that admit it."""
    depth, live = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
    for level in levels:
        live &= level.admits(h1, h2)
        depth += live
    return depth


def members(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """A key is listed if the first level that refuses it has an odd number, or none refuses and their number is odd."""
    return levels_admitting(levels, h1, h2) % 2 == 1


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _size(n_keys: int, fpr: float) -> tuple[int, int]:
    n_hashes = max(1, round(-math.log2(fpr)))
    return max(64, -(-math.ceil(n_keys * n_hashes / math.log(2)) // 64) * 64), n_hashes


def shards_needed(listed: int, others: int, max_bytes: int) -> int:
    """Level 0 takes most of a cascade; all later ones hold its errors among the others, and half as many listed keys each."""
    first = _first_rate(listed, others)
    bits = _size(listed, first)[0] + 4 * (_size(max(1, int(others * first)), 0.5)[0] + _size(max(1, listed // 2), 0.5)[0])
    return max(1, min(listed, -(-bits // (8 * max(1, max_bytes)))))


def _first_rate(listed: int, others: int) -> float:
    return max(min(0.5, listed / max(1, others) * math.sqrt(0.5)), 1e-6)


def counts_of(universe: DataFrame) -> tuple[int, int]:
    """Listed and other keys."""
    counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    return counts.get(True, 0), counts.get(False, 0)


def build(universe: DataFrame) -> list[Level]:
    """The cascade over universe (h1 long, h2 long, listed boolean; distinct keys)."""
    listed, others = counts_of(universe)
    levels: list[Level] = []
    held = True  # which side the next level encodes
    waiting = {True: listed, False: others}
    spark = universe.sparkSession
    while waiting[held]:
        n_bits, n_hashes = _size(waiting[held], 0.5 if levels else _first_rate(listed, others))
        level = Level(len(levels), n_bits, n_hashes, np.zeros(n_bits // 64, np.uint64))
        known, side = spark.sparkContext.broadcast(levels), held

        def setter(known=known, level=Level(level.number, n_bits, n_hashes, np.zeros(0, np.uint64))):
            def call(h1, h2, listed):
                a, b = np.array(h1, np.int64).view(np.uint64), np.array(h2, np.int64).view(np.uint64)
                keep = levels_admitting(known.value, a, b) == len(known.value)
                at = np.concatenate([level.places(a[keep], b[keep], k) for k in range(level.n_hashes)])
                places = np.unique(at)
                words, start = np.unique(places >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), start) if len(places) else places
                return {"word": words.astype(np.int64), "bits": bits.view(np.int64)}

            return call

        ours = universe.where(F.col("listed") == side)
        got = map_columns(ours, setter, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        levels = [*levels, level]
        known = spark.sparkContext.broadcast(levels)

        def counter(known=known):
            def call(h1, h2, listed):
                a, b = np.array(h1, np.int64).view(np.uint64), np.array(h2, np.int64).view(np.uint64)
                return {"n": [int((levels_admitting(known.value, a, b) == len(known.value)).sum())]}

            return call

        wrong = map_columns(universe.where(F.col("listed") != side), counter, "n long").agg(F.sum("n")).first()[0]
        waiting[not held] = wrong or 0
        held = not held
    return levels


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key a rule for this url could have: each suffix of the host's labels with each prefix of the path
    that is as long as some rule's path."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths)), lambda p: p.isNotNull())
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict. rules: (verdict, host, path), bounded by what a driver holds."""
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col).cast("string"))
    lengths = sorted({len(p) for _, _, p in rules})
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    kinds = sorted({v for v, _, _ in rules}, reverse=True)
    corpus = cut(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    h1, h2 = key_hashes(F.col("key"))
    universes = {}
    for kind in kinds:
        listed = spark.createDataFrame([(h + p,) for v, h, p in rules if v == kind], "key string").distinct()
        both = corpus.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
        universes[kind] = cut(both.groupBy("key").agg(F.max("listed").alias("listed")).select(h1.alias("h1"), h2.alias("h2"), "listed"), "universe")
    drop(corpus)
    shards = max([1, *(shards_needed(*counts_of(u), max_bytes // len(kinds)) for u in universes.values())])
    rows = keyed.withColumns({"rule": F.lit(None).cast("string"), "kind": F.lit(None).cast("string")})
    held = None
    for k in range(shards):
        mine = F.pmod(F.col("h2"), F.lit(shards)) == k
        cascades = spark.sparkContext.broadcast({kind: build(u.where(mine)) for kind, u in universes.items()})
        probes = rows.withColumns({"a": F.transform("keys", lambda x: key_hashes(x)[0]), "b": F.transform("keys", lambda x: key_hashes(x)[1])})
        rows = map_columns(probes, _prober(cascades, kinds, k, shards), "page_id long, host string, path string, keys array<string>, rule string, kind string")
        if k < shards - 1:
            rows = cut(rows, "probed")
            if held is not None:
                drop(held)
            held = rows
    for u in universes.values():
        drop(u)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("kind", F.lit(default)).alias("verdict"))


def _prober(cascades, kinds: list[str], shard: int, shards: int):
    """Adds what one shard's cascades know to each row's best rule so far."""

    def make():
        def call(ids, hosts, paths, keys, rules, found, a, b):
            flat1, flat2 = (np.array([x for row in side for x in row or ()], np.int64) for side in (a, b))
            mine = np.mod(flat2, shards) == shard
            flat1, flat2 = flat1.view(np.uint64), flat2.view(np.uint64)
            by_kind = {kind: members(levels, flat1, flat2) & mine for kind, levels in cascades.value.items()}
            rule, verdict, at = [], [], 0
            for row, best, kind in zip(keys, rules, found, strict=True):
                for key in row or ():
                    for k in kinds:  # "block" first
                        if by_kind[k][at] and (best is None or (len(key), k) > (len(best), kind)):
                            best, kind = key, k
                    at += 1
                rule.append(best)
                verdict.append(kind)
            return {"page_id": ids, "host": hosts, "path": paths, "keys": keys, "rule": rule, "kind": verdict}

        return call

    return make


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l(kind, h, t) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f AS (SELECT page_id, arg_max(h || t, length(h || t)) AS rule, arg_max(kind, length(h || t)) AS kind
      FROM p, l WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)"""

QUERIES = {"op7_url_filters": op7_url_filters}
ORACLES = {"op7_url_filters": ORACLE}
