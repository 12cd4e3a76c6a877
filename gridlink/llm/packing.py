"""Operator 3: best-two-fit packing of token sequences.

Texts are tokenized once, by Arrow batches; the pieces (a few numbers each) are written to the shared folder. The
packing is then planned on the histogram of lengths alone, at most `capacity` numbers whatever the corpus's size: a
bin is filled greedily with the longest lengths that still fit; then its smallest document is taken out and two
unpacked ones that fit the widened gap more tightly are put in, if there are such. A bin pattern is used as often as
the counts allow, so a plan has a bounded number of patterns, not of bins. Pieces find their place by their rank among
pieces of the same length: ranks are counted within (length, salt) and shifted by the salts before, so no length,
however common, is gathered in one task.

Defined cases: a null text counts as empty and has the end id alone; null doc_ids and repeated rows are packed row by
row; an empty table gives an empty result; texts of any length are cut into pieces of `capacity`; ties in rank are
broken by doc_id, piece and checksum, and equal rows may change places, which changes nothing. Only the named columns
are read, so further columns can't clash.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridlink.llm.common import cut, map_columns, table

CAPACITY, END_ID = 4096, 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers at most; beyond that it starts anew.
CACHED_WORDS = 700_000
#: White space for Python that is none for the tokenizer, and special tokens: such texts are encoded as they are.
_WHOLE = re.compile(r"[\x1c-\x1f]|<\|")
_BEYOND_LATIN = re.compile("[^\x00-\u012f]")
_TAILS = (",", ".")


def _bare(word: str) -> str:
    """The word without a comma or full stop behind a letter or digit, which is a token group of its own."""
    return word[:-1] if len(word) > 1 and word[-1] in _TAILS and word[-2] < "\u0130" and word[-2].isalnum() else word


class _Known(dict):
    """Ids of known words; of words with a tail, put together from both."""

    def __init__(self, tails: dict[str, bytes]):
        super().__init__(tails)
        self.tails = tails

    def __missing__(self, word: str) -> bytes:
        return self[word[:-1]] + self.tails[word[-1]]


#: By tokenizer file: the tokenizer and the ids of known words, kept by each Python worker over its tasks.
_WORKER: dict[str, tuple] = {}


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_bytes(path: str | None):
    """A function from texts to each one's ids as little-endian 32-bit bytes. The vocabulary's rules never look
    across white space and fold case, so ids of white-space-free strings are remembered and joined; new ones are
    encoded together."""
    from tokenizers import Tokenizer

    path = path or tokenizer_file()
    if path not in _WORKER:
        tokenizer = Tokenizer.from_file(path)
        _WORKER[path] = tokenizer, _Known({t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in _TAILS})
    tokenizer, known = _WORKER[path]

    def learn(new: list[str]) -> None:
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            got = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            of = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
            ends = np.searchsorted(of, np.arange(len(some)), "right")
            data = np.array(got.ids, "<u4").tobytes()
            known.update((w, data[4 * a : 4 * b]) for w, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))

    def ids(texts: list[str]) -> list[bytes]:
        whole = [bool(_WHOLE.search(t)) for t in texts]
        split = [[] if w else (t if _BEYOND_LATIN.search(t) else t.lower()).split() for t, w in zip(texts, whole, strict=True)]
        words = set().union(*split)
        new = {b for w in words if w not in known and (b := _bare(w)) not in known}
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            known.update(known.tails)
            new = {b for w in words if (b := _bare(w)) not in known}
        learn(list(new))
        get = known.__getitem__
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else b"".join(map(get, row)) for t, w, row in zip(texts, whole, split, strict=True)]

    return ids


def _piece_maker(path: str | None, capacity: int):
    def make():
        ids, end, step = id_bytes(path), np.array([END_ID], "<u4").tobytes(), 4 * capacity

        def call(doc_ids, texts):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc_id, data in zip(doc_ids, ids([t or "" for t in texts]), strict=True):
                whole = data + end
                for k in range(0, len(whole), step):
                    part = whole[k : k + step]
                    for name, value in zip(out, (doc_id, k // step, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        out[name].append(value)
            return out

        return call

    return make


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_columns(rows, _piece_maker(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of each bin pattern, for counts[length] documents of each length up to capacity."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []
    places = np.arange(capacity + 1)

    def largest() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, places, 0))

    below = largest()
    while below[capacity]:
        used: list[int] = []
        gap = capacity
        while below[gap]:
            x = int(below[gap])
            used.append(x)
            left[x] -= 1
            gap -= x
            if not left[x]:
                below = largest()
        if gap and len(used) > 1:
            room = gap + used[-1]
            first = np.flatnonzero(left[: room + 1] > 0)
            second = below[room - first]
            alone = (second == first) & (left[first] < 2)  # the one document of its length can't be taken twice
            if alone.any():
                for i in np.flatnonzero(alone):
                    second[i] = below[first[i] - 1] if first[i] else 0
            both = np.where(second > 0, first + second, 0)
            best = int(both.argmax()) if len(both) else 0
            if len(both) and both[best] > used[-1]:
                left[used.pop()] += 1
                for x in (int(first[best]), int(second[best])):
                    used.append(x)
                    left[x] -= 1
                below = largest()
        lengths, times = np.unique(used, return_counts=True)
        more = int((left[lengths] // times).min())
        if more:
            left[lengths] -= more * times
            below = largest()
        out.append((more + 1, tuple(used)))
    return out


def _places(patterns) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank, first sequence and offset of each slot that takes documents of this length."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for times, lengths in patterns:
        at = 0
        for x in lengths:
            rank = taken.get(x, 0)
            slots.setdefault(x, []).append((rank, first, at))
            taken[x] = rank + times
            at += x
        first += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in slots.items()}


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32, as pieces() gives them) with sequence_id and offset."""
    spark = rows.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    by_salt = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most one row for each length
        counts[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(shift, ["length", "salt"])

    def make():
        slots = where.value

        def call(doc_id, piece, start, length, crc, rank):
            x, r = np.array(length, np.int64), np.array(rank, np.int64)
            sequence, offset = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
            for n in np.unique(x):
                ranks, firsts, offsets = slots[int(n)]
                mine = x == n
                slot = np.searchsorted(ranks, r[mine], "right") - 1
                sequence[mine], offset[mine] = firsts[slot] + r[mine] - ranks[slot], offsets[slot]
            return {"doc_id": doc_id, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "sequence_id": sequence, "offset": offset}

        return call

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    return map_columns(ranked, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
