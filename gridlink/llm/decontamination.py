"""Operator 8: benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised (lower case; runs of what is no letter or digit become one space). Every part of
`region` bytes of an item is a region, whatever byte it begins at, so a verbatim quote of `region` normalised bytes or
more is always found. A region of m bytes that a text holds with at most e edits shares at least
m + 1 - q (e + 1) q-grams with it in a band of e + 1 neighbouring diagonals; bands overlap by half, of twice that width, so no
match is split. Each item's q-grams are held once, and a window over their places in a band counts for all its regions.
Regions that reach the bound are verified by banded alignment, so nothing rests on the count alone.

The benchmark is the stated query set: it goes to all executors in blocks of at most `max_bytes`, and each block is
held against every whole document where it lies; no row moves.

Defined cases: null and empty texts and items match nothing; items shorter than `region` are one region, items too
short for the bound to be positive must occur whole, those under q bytes as whole words; null ids and repeated rows are matched row by row; of equally good
places the first counts; an empty table gives an empty result. Only the named columns are read, so further columns
can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import map_columns, table

Q, REGION, ERROR_RATE, MAX_BYTES = 12, 100, 0.05, 16 << 20
#: Pairs of a text's and an item's place that are counted at once, unless a part of twice a region's reach has more.
MAX_PLACES = 1 << 21
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace") if text else b""


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the q-gram at each place."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x4 = x[:-2] | x[2:] << np.uint64(16)
    x8 = x4[:-4] | x4[4:] << np.uint64(32)
    n = len(data) - Q + 1
    h = (x8[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (x4[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    return h * np.uint64(0xD6E8FEB86659FD93)


def edits(patterns: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the fewest edits between the pattern and any part of the text, most + 1 if more than `most`, and
    where the first such part ends."""
    row = np.zeros((len(texts), texts.shape[1] + 1), np.int16)
    steps = np.arange(texts.shape[1] + 1, dtype=np.int16)
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (texts != patterns[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        row = np.minimum(new + steps, most + 1)
    end = row.argmin(1)
    return row[np.arange(len(row)), end], end


@dataclass
class Block:
    """A block of items: their q-grams with (item, place), sorted; items under Q bytes as they are."""

    items: list[int]
    data: list[bytes]
    length: np.ndarray  # of the item's regions
    short: dict[bytes, list[int]]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    budget: np.ndarray
    bound: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], region: int = REGION, error_rate: float = ERROR_RATE) -> Block:
        items, data, brief = [], [], {}
        for item, text in rows:
            d = normalise(text)
            if len(d) >= Q:
                items.append(item)
                data.append(d)
            elif d:
                brief.setdefault(d, []).append(item)
        length = np.array([min(region, len(d)) for d in data], np.int64)
        budget = (error_rate * length).astype(np.int64)
        bound = length + 1 - Q * (budget + 1)
        short = bound < 1
        budget[short] = 0
        bound[short] = length[short] + 1 - Q
        keys = [grams(np.frombuffer(d, np.uint8)) for d in data]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        unique, first = np.unique(flat[order], return_index=True)
        held = np.zeros(1 << 22, bool)
        held[unique >> np.uint64(42)] = True
        item_of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order]
        place = np.concatenate([np.arange(len(k)) for k in keys])[order] if keys else np.zeros(0, np.int64)
        return cls(items, data, length, brief, unique, np.append(first, len(flat)), item_of, place, held, budget, bound)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, start, end, regions, edits) for each row of texts and item it holds a region of."""
        data = [normalise(t) for t in texts]
        return self._short(data) + self._long(data)

    def _short(self, data: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        out = []
        sizes = {d.count(b" ") + 1 for d in self.short}
        for i, d in enumerate(data if sizes else ()):
            words = d.split(b" ")
            there = {p for n in sizes for k in range(len(words) - n + 1) if (p := b" ".join(words[k : k + n])) in self.short}
            for p in sorted(there):
                at = b" ".join([b"", d, b""]).find(b" ".join([b"", p, b""]))
                out += [(i, item, at, at + len(p), 1, 0) for item in self.short[p]]
        return out

    def _long(self, data: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        if not len(self.keys):
            return []
        sizes = np.array([len(d) + 1 for d in data])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        whole = np.frombuffer(b"\x00".join([*data, b""]), np.uint8)
        got = grams(whole)
        at = np.flatnonzero(self.filter[got >> np.uint64(42)])
        slot = np.searchsorted(self.keys, got[at])
        good = slot < len(self.keys)
        good[good] = self.keys[slot[good]] == got[at[good]]
        at, slot = at[good], slot[good]
        if not len(at):
            return []
        found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}  # of a row and item: region's begin -> edits, start, end
        # parts of the texts that overlap by more than a region can span, so that repetitive ones need bounded memory
        reach = int(self.length.max()) + 4 * int(self.budget.max() + 1)
        so_far, low = np.cumsum(self.first[slot + 1] - self.first[slot]), 0
        while low < len(at):
            high = np.searchsorted(so_far, (so_far[low - 1] if low else 0) + MAX_PLACES, "right")
            high = int(max(high, np.searchsorted(at, at[low] + 2 * reach)))
            self._match(data, begins, at[low:high], slot[low:high], found)
            low = int(np.searchsorted(at, at[high] - reach)) if high < len(at) else high
        return [(i, item, min(x[1] for x in m.values()), max(x[2] for x in m.values()), len(m), min(x[0] for x in m.values())) for (i, item), m in found.items() if m]

    def _match(self, data: list[bytes], begins: np.ndarray, at: np.ndarray, slot: np.ndarray, found: dict) -> None:
        """Adds to found the regions whose q-grams are among those at the places `at` of all texts."""
        many = self.first[slot + 1] - self.first[slot]
        source = np.repeat(self.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        item, place = self.item[source], self.place[source]
        row = np.searchsorted(begins, at, "right") - 1
        far = 1 << 40
        diagonal = at - begins[row] - place + far  # where the item would begin in the text; shifted to be positive
        width = 2 * (self.budget[item] + 1)
        for shift in (0, 1):
            band = (diagonal + shift * (self.budget[item] + 1)) // width
            order = np.lexsort((place, band, item, row))
            r, g, b, p = row[order], item[order], band[order], place[order]
            same = np.zeros(len(r), bool)
            same[1:] = (r[1:] == r[:-1]) & (g[1:] == g[:-1]) & (b[1:] == b[:-1])
            distinct = ~same
            distinct[1:] |= p[1:] != p[:-1]
            group = np.cumsum(~same)[distinct]
            r, g, b, p = r[distinct], g[distinct], b[distinct], p[distinct]
            # a window of as many places as the bound asks for lies in the regions that begin from `low` to `high`
            last = np.arange(len(r)) + self.bound[g] - 1
            head = np.flatnonzero(last < len(r))
            head = head[group[last[head]] == group[head]]
            m = self.length[g[head]]
            low = np.maximum(0, p[last[head]] - (m - Q))
            high = np.minimum(p[head], np.array([len(d) for d in self.data])[g[head]] - m)
            head, low, high = head[low <= high], low[low <= high], high[low <= high]
            cuts = np.flatnonzero(np.diff(group[head])) + 1
            for part in np.split(np.arange(len(head)), cuts) if len(head) else ():
                h = head[part[0]]
                i, k, e = int(r[h]), int(g[h]), int(self.budget[g[h]])
                corner = int(b[h]) * 2 * (e + 1) - shift * (e + 1) - far - e
                starts = np.unique(np.concatenate([np.arange(low[x], high[x] + 1) for x in part]))
                self._verify(data[i], k, e, corner, starts, found.setdefault((i, self.items[k]), {}))

    def _verify(self, text: bytes, k: int, e: int, corner: int, starts: np.ndarray, best: dict[int, tuple[int, int, int]]) -> None:
        """Adds the regions of item k, of those that begin at starts, that the text holds near corner + their begin."""
        item, m = self.data[k], int(self.length[k])
        span, rest = m + 2 * (e + 1) + 2 * e, []
        for s in starts.tolist():
            if s in best and best[s][0] == 0:
                continue
            begin = max(0, corner + s)
            at = text.find(item[s : s + m], begin, max(0, corner + s + span))
            if at >= 0:
                best[s] = (0, at, at + m)
            elif e:
                rest.append(s)
        for some in range(0, len(rest), 2048):
            s = np.array(rest[some : some + 2048])
            x = np.frombuffer(item, np.uint8)[s[:, None] + np.arange(m)]
            at = corner + s[:, None] + np.arange(span)
            there = (at >= 0) & (at < len(text))
            y = np.where(there, np.frombuffer(text, np.uint8)[np.clip(at, 0, len(text) - 1)], np.uint16(256))
            n, end = edits(x, y, e)
            for j in np.flatnonzero(n <= e).tolist():
                stop = min(len(text), int(corner + s[j] + end[j]))
                new = (int(n[j]), max(0, stop - m), stop)
                if int(s[j]) not in best or new < best[int(s[j])]:
                    best[int(s[j])] = new


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_bytes: int = MAX_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns carry (of longs), doc_id, item_id, where in the normalised text the item's regions stand (in bytes), how many regions (one for each byte they begin at), and the fewest edits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // max_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    out = None
    for k in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        block = spark.sparkContext.broadcast(Block.build(sorted(((r["item"], r["text"]) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))  # about max_bytes of items

        def make(block=block):
            find = block.value.find

            def call(ids, texts, *more):
                got = find(texts)
                cols = list(zip(*got, strict=True)) or [()] * 6
                return {"doc_id": [ids[i] for i in cols[0]], "item_id": cols[1], "start": cols[2], "end": cols[3], "n_regions": cols[4], "edits": cols[5]} | {c: [x[i] for i in cols[0]] for c, x in zip(carry, more, strict=True)}

            return call

        some = map_columns(rows, make, "".join(f"{c} long, " for c in carry) + "doc_id long, item_id long, start long, end long, n_regions int, edits int")
        out = some if out is None else out.unionByName(some)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {}
