"""Operator 2: near-duplicate classes by DartMinHash signatures, banded joining and exact checks.

DartMinHash: each element's weight by the rank axis is an area cut into regions of unit weight and unit rank. A
region's hashed darts (a Poisson number, each with a coordinate, a rank and a fingerprint) depend on the element and
the region alone, so documents that share an area share its darts. A document throws ranks until every coordinate is
hit and keeps the earliest dart of each: a signature whose agreement estimates the weighted Jaccard similarity.

Joining: distinct texts alone take part. Texts that agree in a band of `rows` coordinates share a bucket; of buckets with
the same members one is kept. Each member is first compared with the bucket's least member, exactly, on the whole texts;
in a group of copies that settles nearly all, at one comparison each, and the links become components on the cluster.
Buckets that still hold several components are then compared in blocks of bounded size: every member outside the
component of the least one with every other member, by an inverted list of the block's shingles, so each similarity is
exact and a block emits no more than a forest of links between components. No link is lost and no bucket has to fit in one task.

Similarity: weighted Jaccard over five-word shingles (lower case, parted at white space), each weighted by how often it
stands in the text: the sum of the lesser weights over the sum of the greater ones, 0.8 or more. A text of fewer
than five words is one shingle. With 32 bands of 6 a pair of similarity 0.8 is missed with probability 6e-5.

Defined cases: null text counts as empty; texts without words are alike; null doc_ids and repeated rows belong to
their text's class; a class is named by its least doc_id (all null: by a negative number); an empty table gives an
empty result; very long texts are read whole. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import arrow_of, cut, drop, map_columns, table
from gridlink.llm.components import components

#: BLOCK, BLOCK_BYTES: rows and text of either side that one comparison holds, on average. PART: rows of a bucket dealt together.
WORDS, THRESHOLD, BANDS, ROWS, BLOCK, BLOCK_BYTES, PART = 5, 0.8, 32, 6, 1024, 16 << 20, 512
_COPY = np.uint64(0xA24BAED4963EE407)
CACHED_WORDS = 700_000
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)]) * 2.0**32).astype(np.uint64)
_KNOWN: dict[str, bytes] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's shingles, sorted, and how often each stands there."""
    import xxhash

    words = (text or "").lower().split()
    if not words:
        return np.zeros(1, np.uint64), np.ones(1, np.int64)
    new = set(words).difference(_KNOWN)
    if len(_KNOWN) + len(new) > CACHED_WORDS:
        _KNOWN.clear()
        new = set(words)
    for w in new:
        _KNOWN[w] = xxhash.xxh64_digest(w.encode("utf-8", "replace"))
    h = np.frombuffer(b"".join(map(_KNOWN.__getitem__, words)), np.uint64)
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(mix(out), return_counts=True)


def shingles(text: str | None) -> np.ndarray:
    """The weighted shingles as a set, in which the copies of one shingle are elements of their own: the Jaccard
    similarity of such sets is the weighted one."""
    element, many = weighted(text)
    if many.max() == 1:
        return element
    copy = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    element = np.repeat(element, many)
    return np.sort(np.where(copy > 0, mix(element + copy.astype(np.uint64) * _COPY), element))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """One row of k 32-bit fingerprints for each weighted set (weight 1 where none is given)."""
    out = np.full(len(sets) * k, np.iinfo(np.uint64).max, np.uint64)
    todo, start = np.arange(len(sets)), [0] * len(sets)
    depth = [max(1, math.ceil(k * (math.log(k) + 2) / max(1.0, float(weights[i].sum()) if weights else len(s)))) for i, s in enumerate(sets)]
    while len(todo):
        for i in _batches(todo, sets, start, depth):
            _throw(out, [sets[j] for j in i], [weights[j] for j in i] if weights else None, i, [(start[j], depth[j]) for j in i], k)
        todo = todo[(out.reshape(-1, k)[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        for j in todo:
            start[j], depth[j] = depth[j], 2 * depth[j]
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, k)


def _batches(todo, sets, start, depth, most: int = 1 << 19):
    some, size = [], 0
    for j in todo.tolist():
        n = len(sets[j]) * (depth[j] - start[j])
        if some and size + n > most:
            yield some
            some, size = [], 0
        some.append(j)
        size += n
    if some:
        yield some


def _throw(out: np.ndarray, sets, weights, rows, ranks, k: int) -> None:
    """Throws the darts of ranks start to stop of each set and keeps each coordinate's earliest in out."""
    element = np.concatenate(sets)
    row = np.repeat(np.array(rows, np.int64), [len(s) for s in sets])
    first = np.repeat(np.array([a for a, _ in ranks], np.int64), [len(s) for s in sets])
    many = np.repeat(np.array([b - a for a, b in ranks], np.int64), [len(s) for s in sets])
    share = np.ones(len(element))
    w = np.concatenate(weights) if weights else share
    if weights := (w != 1).any():  # a weight w is floor(w) whole regions and one of which a part w - floor(w) counts
        cells = np.maximum(1, np.ceil(w)).astype(np.int64)
        cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        share = np.minimum(1.0, np.repeat(w, cells) - cell)
        element, row, first, many = (np.repeat(x, cells) for x in (element, row, first, many))
        element = np.where(cell > 0, mix(element + cell.astype(np.uint64) * _COPY), element)
    rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    region = mix(np.repeat(element, many) ^ mix(rank.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    darts = np.searchsorted(_POISSON, region >> np.uint64(32), "right")
    of = np.repeat(np.arange(len(region)), darts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(region[of] + (number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    source = np.repeat(np.arange(len(many)), many)[of]
    if weights:
        inside = (mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share[source]
        of, dart, source = of[inside], dart[inside], source[inside]
    place = row[source] * k + ((dart >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
    when = np.minimum(rank[of], 0xFFFF).astype(np.uint64) << np.uint64(48) | ((dart >> np.uint64(20)) & np.uint64(0xFFFF)) << np.uint64(32)
    np.minimum.at(out, place, when | (dart & np.uint64(0xFFFFFFFF)))


def _signer(bands: int, rows: int):
    def make():
        def call(ids, h1, h2, texts):
            found = [weighted(t) for t in texts]
            sig = signatures([e for e, _ in found], bands * rows, [w for _, w in found]).reshape(-1, bands, rows).astype(np.uint64)
            key = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
            for j in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
            return {"doc_id": ids, "h1": h1, "h2": h2, "keys": [r.tobytes() for r in key]}

        return call

    return make


def _bander(bands: int):
    def make():
        def call(nodes, keys):
            return {"band": np.frombuffer(b"".join(keys), np.int64), "node": np.repeat(np.array(nodes, np.int64), bands)}

        return call

    return make


def _checker():
    known: dict[int, np.ndarray] = {}

    def call(node, rep, a, b):
        out = []
        for r, x, y in zip(rep, a, b, strict=True):
            if r not in known:  # rows of one least member mostly follow each other
                known.clear()
                known[r] = shingles(y)
            out.append(similarity(shingles(x), known[r]))
        return {"node": node, "rep": rep, "similarity": out}

    return call


def _compare(rows: list[tuple[int, int, str]], threshold: float) -> list[tuple[int, int]]:
    """Links between components, a forest, from rows (component, role, text); role & 1: compared with, role & 2: asking."""
    parent = {c: c for c, _, _ in rows}

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    sets = [shingles(t) for _, _, t in rows]
    others = [k for k, r in enumerate(rows) if r[1] & 1]
    if not others:
        return []
    sizes = np.array([len(sets[k]) for k in others])
    owner = np.repeat(np.arange(len(others)), sizes)
    listed = np.concatenate([sets[k] for k in others])
    order = np.argsort(listed, kind="stable")
    listed, owner, out = listed[order], owner[order], []
    for k, (c, role, _) in enumerate(rows):
        if not role & 2:
            continue
        low, high = np.searchsorted(listed, sets[k], "left"), np.searchsorted(listed, sets[k], "right")
        many = high - low
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        both = np.bincount(owner[at], minlength=len(others))
        for j in np.flatnonzero(both / (len(sets[k]) + sizes - both) >= threshold).tolist():
            u, v = root(c), root(rows[others[j]][0])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((max(u, v), min(u, v)))
    return out


def _blocks(threshold: float, schema):
    """mapInArrow over rows sorted by (band, i, j): compares each block's asking rows with its others."""

    def run(batches):
        held: list[tuple] = []
        last, links = None, set()
        for b in batches:
            for band, i, j, component, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, i, j) != last:
                    links.update(_compare(held, threshold))
                    held, last = [], (band, i, j)
                held.append((component, role, text))
            if len(links) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links, strict=True), schema, strict=True)], schema=schema)
                links = set()
        links.update(_compare(held, threshold))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links, strict=True), schema, strict=True)], schema=schema)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_rows."""
    return row_classes(docs, id_col, text_col, threshold, bands, rows).select("doc_id", "class_id", "class_rows")


def text_hashes(text_col: str = "text") -> tuple:
    """h1, h2: what stands for a text in the results of row_classes()."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def row_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """classes() by row: doc_id, h1, h2 (of the text), component (one number a class, also where classes share their
    least doc_id), class_id, class_rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_hashes(text_col), text.alias("text"))
    signed = cut(map_columns(keyed, _signer(bands, rows), "doc_id long, h1 long, h2 long, keys binary"), "signed")
    texts = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("keys").alias("keys"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    all_ = cut(map_columns(texts.select("node", "keys"), _bander(bands), "band long, node long"), "bands")
    # buckets of the same members (alike in number, sum and xor of hashes) need one comparison
    same = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit("second"))).alias("x")
    buckets = all_.groupBy("band").agg(F.min("node").alias("rep"), F.count("*").alias("n"), *same).where("n > 1")
    buckets = buckets.groupBy("rep", "n", "s", "x").agg(F.min("band").alias("band")).select("band", "rep", "n")
    members = cut(all_.join(buckets, "band"), "members")
    drop(all_)
    nodes = members.select("node").distinct().join(texts.select("node", "h1", "h2", "least"), "node")
    # of a text's copies, the rows with the least doc_id alone are read
    same_row = (keyed["h1"] == nodes["h1"]) & (keyed["h2"] == nodes["h2"]) & keyed["doc_id"].eqNullSafe(nodes["least"])
    whole = cut(keyed.join(nodes, same_row).groupBy("node").agg(F.first("text").alias("text")), "whole")
    pairs = members.where("node <> rep").select("node", "rep").distinct()
    both = pairs.join(whole, "node").join(whole.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep")
    star = map_columns(both.select("node", "rep", "text", "rep_text"), _checker, "node long, rep long, similarity double")
    found = cut(components(star.where(F.col("similarity") >= threshold).select(F.col("node").alias("u"), F.col("rep").alias("v"))), "components")
    links = _across(members, whole, found, threshold)
    drop(whole)
    drop(members)
    further = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("component"), F.col("component").alias("last"))
    named = texts.select("h1", "h2", "node", "least", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.join(further, "component", "left").withColumn("component", F.coalesce("last", "component")), "named")
    for done in (texts, found, links):
        drop(done)
    ids = named.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_rows"))
    named = named.join(ids, "component").select("h1", "h2", "component", F.coalesce("class_id", -1 - F.col("component")).alias("class_id"), "class_rows")
    return signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "h1", "h2", "component", "class_id", "class_rows")


def _across(members: DataFrame, whole: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components (node, component) of members (band, node, rep, n) of one bucket."""
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)).cast("int").alias("salt")  # a large bucket's rows are dealt to many tasks
    held = members.join(found, "node", "left").select("band", "node", "rep", "n", salt, F.coalesce("component", "node").alias("component"))
    held = cut(held, "held")
    home, least, most = F.min(F.struct("node", "component")).alias("home"), F.min("component").alias("least"), F.max("component").alias("most")
    mixed = held.groupBy("band", "salt").agg(home, least, most, F.max("n").alias("n"))
    mixed = mixed.groupBy("band").agg(F.min("home")["component"].alias("home"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("n").alias("n"))
    mixed = cut(mixed.where("least <> most AND n > 2").select("band", "home", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1)).alias("salt")), "mixed")
    # the least member has been compared with all others
    rows = held.where("node <> rep AND n > 2").join(mixed, ["band", "salt"]).select("band", "node", "component", "home", "salt")
    sized = cut(rows.join(whole.select("node", F.octet_length("text").alias("size")), "node"), "rows")
    sizes = sized.groupBy("band", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    sizes = sizes.select("band", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = sized.join(mixed.drop("home").join(sizes, "band"), ["band", "salt"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("asks", F.col("component") != F.col("home"))
    span = F.sequence(F.lit(0), F.col("blocks") - 1)
    role = F.when(F.col("asks") & (F.col("i") == F.col("own")), 3).otherwise(1)
    asked = rows.select("*", F.explode(span).alias("i")).select("band", "i", F.col("own").alias("j"), "node", "component", role.alias("role"))
    asking = rows.where("asks").select("band", F.col("own").alias("i"), F.explode(span).alias("j"), "node", "component", F.lit(2).alias("role")).where("i <> j")
    placed = asked.unionByName(asking).join(whole, "node").select("band", "i", "j", "component", "role", "text")
    placed = placed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    kind = "a long, b long"
    links = cut(placed.mapInArrow(_blocks(threshold, arrow_of(kind)), kind).distinct(), "links")
    for done in (held, mixed, sized):
        drop(done)
    return links


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: All pairs of distinct texts that share a shingle, compared exactly.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x85\xA0]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT min(r) AS r, w FROM t GROUP BY w),
s AS (SELECT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM x)),
k AS (SELECT r, hash(g) AS g, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT r, sum(n) AS n FROM k GROUP BY r),
v AS (SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS shared FROM k a JOIN k b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
e AS (SELECT a, b FROM v JOIN z za ON za.r = a JOIN z zb ON zb.r = b WHERE 5 * shared >= 4 * (za.n + zb.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r AS node, r AS least FROM x UNION SELECT u.b, c.least FROM c JOIN u ON u.a = c.node AND u.b > c.least),
m AS (SELECT node, min(least) AS component FROM c GROUP BY node),
f AS (SELECT t.doc_id, m.component FROM t JOIN x USING (w) JOIN m ON m.node = x.r)
SELECT doc_id, min(doc_id) OVER (PARTITION BY component) AS class_id, count(*) OVER (PARTITION BY component) AS class_rows FROM f"""

QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLES = {"op2_near_dedup": ORACLE}
