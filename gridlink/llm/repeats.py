"""Operator 9: removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A window is a string of `length` bytes of one text. Its anchor is the place, among the starts of the k-byte strings in
it, whose hash is least (the leftmost of equals): equal windows have equal anchors at equal offsets, so the suffixes at
anchors are enough. A batch's array holds one entry for each anchor: the hash of its k bytes (the class, by which
the array is sorted), the hash of its context (all bytes of the windows it anchors) and the place of those windows.

Each batch is merge-scanned with the levels that exist: entries of a class that occurs once are done; entries of equal
contexts repeat in all their windows; what is left, contexts that differ within a class, is kept for a last step that
compares their single windows, one entry standing for all of an equal context. Then the batch becomes a level; before the
next batch, levels of equal size are merged into one, sorted as a whole over ranges of entries, so that a common class is
dealt to many tasks and each entry is rewritten a logarithmic number of times.

Counting is by pre-aggregated group-by and plain joins, so neither a common class nor a common text lands in one task.

Defined cases: null text counts as empty; null doc_ids and repeated rows are answered by their text (copies of a text
of `length` bytes or more repeat each other wholly); shorter texts have no window and stay; matches may overlap and lie
in one text; an empty table gives an empty result. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import cut, drop, map_columns, release, table

LENGTH, GRAM, BATCHES = 200, 100, 3
#: Bytes of text that are hashed at once; a call holds up to a hundred times as much in arrays of 8 bytes a place.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bits of a place within a slice of texts, as many as any string can need; the bits above rank anchors, alike in all slices.
_PLACE = 31
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        steps = np.full((2, max(n, SLICE + 1)), [[_BASE], [_INVERSE]], np.uint64)
        steps[:, 0] = 1
        _POWERS[:] = list(np.cumprod(steps, axis=1, dtype=np.uint64))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Some texts as one string, with hashes of any of its parts."""

    def __init__(self, data: list[bytes]):
        self.ends = np.cumsum([len(d) for d in data]).astype(np.int64)
        self.starts = self.ends - np.array([len(d) for d in data], np.int64)
        whole = np.frombuffer(b"".join(data), np.uint8)
        self.n = len(whole)
        power, self.inverse = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(whole.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * power[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def entries(data: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, class, context, first window, windows) of each anchor of each text."""
    s = Slice(data)
    if s.n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    places = np.arange(s.n - gram + 1)
    grams = s.hashes(places, gram)
    keys = grams >> np.uint64(_PLACE) << np.uint64(_PLACE) | places.astype(np.uint64)
    best = (least(keys, length - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    counts = np.maximum(0, s.ends - s.starts - length + 1)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(s.starts, counts)
    text = np.repeat(np.arange(len(data)), counts)
    anchor = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(window)))
    lo, at = window[first], anchor[first]
    context = mix(s.hashes(lo, many - 1 + length) ^ mix(((at - lo) * 65536 + many).astype(np.uint64)))
    return text[first], grams[at].view(np.int64), context.view(np.int64), lo - s.starts[text[first]], many


def _entry_maker(length: int, gram: int):
    def make():
        def call(t1, t2, texts):
            text, c, f, lo, n = entries([t.encode("utf-8", "surrogatepass") for t in texts], length, gram)
            return {"c": c, "f": f, "t1": np.array(t1, np.int64)[text], "t2": np.array(t2, np.int32)[text], "lo": lo, "n": n}

        return call

    return make


_ENTRY = "c long, f long, t1 long, t2 int, lo int, n int"


class IndexFamily:
    """Levels of sorted entries; append() scans a batch against them, found and open grow with it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []
        self.open: list[DataFrame] = []

    def append(self, batch: DataFrame) -> None:
        """Levels of equal size are merged first, so the last batch's own merge is left to the next one. Classes that the
        batch has no part in were settled when their last entry came. Each step's shuffle files go before the next step."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, cut(one.unionByName(two).repartitionByRange("c", "f", "t1", "lo"), "level", ["c", "f"])))
            drop(one)
            drop(two)
        new = cut(batch, "entries", ["c", "f"])
        rows, marked = new, new.select("c", F.lit(1).alias("new"))
        for _, level in self.levels:
            rows, marked = rows.unionByName(level), marked.unionByName(level.select("c", F.lit(0).alias("new")))
        classes = self._kept(marked.groupBy("c").agg(F.count("*").alias("k"), F.max("new").alias("new")).where("k > 1 AND new = 1").select("c"), "classes")
        met = self._kept(rows.join(classes, "c"), "met")
        contexts = self._kept(met.groupBy("c", "f").agg(F.count("*").alias("k"), F.min(F.struct("t1", "t2", "lo", "n")).alias("one")), "contexts")
        mixed = contexts.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
        self.open.append(self._kept(contexts.join(mixed, "c").select("c", "one.*"), "open"))
        self.found.append(self._kept(met.join(contexts.where("k > 1").select("c", "f"), ["c", "f"]).select("t1", "t2", "lo", "n"), "found"))
        for done in (classes, met, contexts):
            drop(done)
        self.levels.append((0, new))

    def close(self) -> None:
        """Removes the levels; what was found and what is open stay."""
        for _, level in self.levels:
            drop(level)
        self.levels = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        release(self.spark)
        return out


def _window_maker(length: int):
    def make():
        def call(t1, t2, texts, lists):
            s = Slice([t.encode("utf-8", "surrogatepass") for t in texts])
            rows = np.array([(i, x["lo"], x["n"], x["c"]) for i, some in enumerate(lists) for x in some], np.int64).reshape(-1, 4)
            many = rows[:, 2]
            text, c = np.repeat(rows[:, 0], many), np.repeat(rows[:, 3], many)
            at = np.repeat(rows[:, 1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            h = s.hashes(s.starts[text] + at, length)
            return {"c": c.astype(np.int32), "h": h.view(np.int64), "t1": np.array(t1, np.int64)[text], "t2": np.array(t2, np.int32)[text], "lo": at.astype(np.int32)}

        return call

    return make


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(t1, t2, lo, n): windows that occur elsewhere, as runs that may repeat. docs: t1, t2 (a text's key), text."""
    family = IndexFamily(docs.sparkSession)
    for k in range(batches):
        batch = docs.where(F.pmod(F.col("t2"), F.lit(batches)) == k) if batches > 1 else docs
        family.append(map_columns(batch, _entry_maker(length, gram), _ENTRY, SLICE))
    family.close()
    found, todo = family.found[0], family.open[0]
    for x in family.found[1:]:
        found = found.unionByName(x)
    for x in family.open[1:]:
        todo = todo.unionByName(x)
    todo = todo.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "n", "c")).alias("list"))  # no more than a text's own anchors
    # copies of a text have one key; one of them will do
    texts = docs.join(todo, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("t1", "t2", "text", "list")
    windows = cut(map_columns(texts, _window_maker(length), "c int, h long, t1 long, t2 int, lo int", SLICE), "windows")
    release(docs.sparkSession)
    # windows are told apart by 96 bits: their own hash and a part of that of their anchor's k bytes
    twice = cut(windows.groupBy("c", "h").agg(F.count("*").alias("k")).where("k > 1").select("c", "h"), "twice")
    release(docs.sparkSession)
    single = cut(windows.join(twice, ["c", "h"]).select("t1", "t2", "lo", F.lit(1).alias("n")), "single")
    for done in (windows, twice):
        drop(done)
    release(docs.sparkSession)
    return found.unionByName(single)


def _cutter(length: int):
    def make():
        def call(ids, texts, lists):
            out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for text, runs in zip(texts, lists, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                packed = np.sort(np.array(runs or (), np.int64))
                first = packed >> 16
                stop = np.maximum.accumulate(first + (packed & 0xFFFF) - 1 + length) if len(first) else first
                new = np.append(True, first[1:] > stop[:-1])[: len(first)]
                spans = list(zip(first[new].tolist(), stop[np.append(np.flatnonzero(new)[1:], len(first)) - 1].tolist() if len(first) else [], strict=True))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rest = b"".join(kept)
                for name, value in (("n_bytes", len(data)), ("n_removed", len(data) - len(rest)), ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("spans", [{"start": a, "end": b} for a, b in spans])):
                    out[name].append(value)
            return out

        return call

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans in bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.hash(text, F.lit("second")).alias("t2"), text.alias("text"))
    runs = repeated(keyed.select("t1", "t2", "text"), length, gram, batches)
    by_text = cut(runs.groupBy("t1", "t2").agg(F.collect_set(F.shiftleft(F.col("lo").cast("long"), 16).bitwiseOR(F.col("n").cast("long"))).alias("runs")), "runs")
    whole = keyed.join(by_text, ["t1", "t2"], "left").select("doc_id", "text", "runs")
    return map_columns(whole, _cutter(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>", SLICE)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Every window of every text as hexadecimal digits, counted by its digest; texts are cut into overlapping parts first.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, 1000 * j AS base, substr(h, 2000 * j + 1, 2398) AS part FROM (SELECT r, h, unnest(range(length(h) // 2000 + 1)) AS j FROM t)),
k AS (SELECT r, base + i AS i, md5(substr(part, 2 * i + 1, 400)) AS m FROM (SELECT r, base, part, unnest(range(least(1000, length(part) // 2 - 199))) AS i FROM p)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM k) WHERE n > 1),
g AS (SELECT r, i, sum(CASE WHEN i <= lag_i + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS lag_i FROM d)),
s AS (SELECT r, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
q AS (SELECT r, run, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY run), 0) AS before FROM s),
c AS (SELECT q.r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS head, max(b) AS last FROM q JOIN t USING (r) GROUP BY q.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.r IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN c USING (r)"""

QUERIES = {"op9_repeats": op9_repeats}
ORACLES = {"op9_repeats": ORACLE}
