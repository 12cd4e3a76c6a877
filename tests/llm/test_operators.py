"""Each operator against brute force on small fixtures, with nulls, empty texts, ties, repeated rows and odd columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from gridlink.llm import decontamination, language_id, near_dedup, packing, pii, quality_rules, repeats, toxicity, url_filters, warc
from gridlink.llm.common import scratch_path

SYL = "tion ing the and re er on an st ea ble ou wh sh ha nd th es".split()


def words(rng, n):
    return " ".join("".join(rng.choices(SYL, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    shared = words(rng, 70)
    texts += [texts[0], texts[0], f"{texts[1]} {shared} {texts[2]}", f"{texts[3]} {shared}", shared + shared, None, None, "", "  \n", "x" * 900, "é" * 150 + "é" * 150]
    near = words(rng, 200).split()
    for i in range(5):
        other = list(near)
        other[10 * i + 5] = f"edit{i}"
        texts.append(" ".join(other))
    texts.append(words(rng, 9000))
    rows = [(i, t, "en", "s", 0, 1) for i, t in enumerate(texts)] + [(None, "no id here at all", None, None, None, 2), (5, texts[5], "en", "s", 0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int").repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_rules(docs):
    df, rows = docs
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in quality_rules.ledger(df).collect())

    def slow(text):
        w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        return len(w), sum(map(len, w)), len(cover)

    assert got == sorted((-1 if r[0] is None else r[0], *slow(r[1])) for r in rows)


def test_quality_rules_many_distinct_words():
    w = [f"w{i}" for i in range(5000)] + ["w0", "w1", "w2", "w3", "w4"]
    assert quality_rules.repeated_words(w) == 10


def test_ablations(docs):
    ledger = quality_rules.ledger(docs[0]).cache()
    bits = [r["fail_bits"] & quality_rules.V1.mask for r in ledger.collect()]
    got = {r["rule"]: (r["n_failed"], r["n_alone"], r["n_rejected"]) for r in quality_rules.ablations(ledger).collect()}
    for rule in quality_rules.RULES:
        if rule.name in quality_rules.V1.rules:
            b = 1 << rule.bit
            assert got[rule.name] == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x != 0 for x in bits))


def test_packing_plan_is_whole_and_fits():
    rng = np.random.default_rng(1)
    counts = np.zeros(65, np.int64)
    for x in rng.integers(1, 65, 500):
        counts[x] += 1
    used = np.zeros(65, np.int64)
    for times, lengths in packing.plan(counts, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert (used == counts).all()


def _bin_by_bin(lengths, capacity):
    """Bins one at a time: the longest that still fits, then the smallest one given up for a tighter pair."""
    left, bins = collections.Counter(lengths), 0
    while left:
        used, gap = [], capacity
        while fit := [x for x in left if x <= gap]:
            used.append(max(fit))
            gap -= used[-1]
            left = +collections.Counter({**left, used[-1]: left[used[-1]] - 1})
        if gap and len(used) > 1:
            room = gap + used[-1]
            pairs = [(x + y, x, y) for x in left for y in left if x + y <= room and (x != y or left[x] > 1)]
            if pairs and max(p[0] for p in pairs) > used[-1]:
                total = max(p[0] for p in pairs)
                x = min(p[1] for p in pairs if p[0] == total)
                left.update([used[-1]])
                left.subtract([x, total - x])
                left = +left
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_equals_bin_by_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 64, 100])
    top = rng.choice([capacity, capacity // 2, capacity // 5])
    lengths = [rng.randint(1, top) if rng.random() < 0.8 else capacity for _ in range(rng.choice([1, 50, 300]))]
    counts = np.bincount(lengths, minlength=capacity + 1)
    assert sum(times for times, _ in packing.plan(counts, capacity)) == _bin_by_bin(lengths, capacity)


def test_packing_defined_cases(spark):
    rows = [(None, None, 1), (None, "", 2), (None, "", 2), (3, "a b", 3), (3, "a b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int").withColumn("length", pii.F.lit("x"))
    got = packing.pack(packing.pieces(df)).collect()
    assert len(got) == 5 and len({r["sequence_id"] for r in got}) == 1
    assert sorted(r["length"] for r in got)[:3] == [1, 1, 1] and len({r["offset"] for r in got}) == 5


def test_packing(docs):
    df, rows = docs
    got = packing.pack(packing.pieces(df, capacity=100), capacity=100).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    expected = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 100):
            expected[(r[0], k // 100, k, len(ids[k : k + 100]), zlib.crc32(np.array(ids[k : k + 100], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100


@pytest.mark.parametrize("text", ["don't I'M 's", "a\x1cb\x85c", "x<|endoftext|>y", "ΑΣ. ΟΔΟΣ,", "4.0. 3,", "É.\u0301 , ..", "한글, ²."])
def test_tokens_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.tokenizer_file()).encode(text, add_special_tokens=False).ids
    assert packing.id_bytes(None)([text])[0] == np.array(ids, "<u4").tobytes()


def test_dart_signatures_estimate_weighted_jaccard():
    a = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = near_dedup.signatures([a, a], 8192, [np.array([1, 2.5, 0.5, 3]), np.array([2, 2, 0.5, 1.0])])
    assert abs((s[0] == s[1]).mean() - 4.5 / 8) < 0.03


def test_shingles_are_weighted():
    a, b = "one two three four five " * 4, "one two three four five " * 2 + "six"
    count = lambda t: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    x, y = count(a), count(b)
    s, t = near_dedup.shingles(a), near_dedup.shingles(b)
    assert len(s) == sum(x.values()) and len(np.unique(s)) == len(s)
    assert near_dedup.similarity(s, t) == sum((x & y).values()) / sum((x | y).values())
    assert sorted(near_dedup.weighted(a)[1]) == sorted(x.values())


def test_near_dedup_large_buckets(spark, monkeypatch):
    """One bucket of several components over many blocks and parts, against brute force; bands of one row meet by chance."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "PART", 4)
    rng = random.Random(59)
    head = words(rng, 30)
    texts = []
    for k in range(12):
        own = f"{head} {words(rng, 40)}".split()
        for i in range(6):
            other = list(own)
            other[31 + 5 * i] = f"e{i}"
            texts.append(" ".join(other))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets, parent = [near_dedup.shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = min(root(i), root(j))
                parent[root(j)] = min(root(i), root(j))
    want = collections.defaultdict(set)
    for i in range(len(rows)):
        want[root(i)].add(i)
    got = collections.defaultdict(set)
    for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=64, rows=1).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_dedup(docs):
    df, rows = docs
    sets = [near_dedup.shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    classes = collections.defaultdict(list)
    for i, r in enumerate(rows):
        classes[root(i)].append(r[0])
    got = collections.defaultdict(list)
    for r in near_dedup.classes(df).collect():
        got[r["class_id"]].append(r["doc_id"])
    key = lambda x: (x is None, x)
    assert sorted(map(str, (sorted(v, key=key) for v in got.values()))) == sorted(map(str, (sorted(v, key=key) for v in classes.values())))


def test_repeats(docs):
    df, rows = docs
    data = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    expected = collections.Counter()
    for r, d in zip(rows, data, strict=True):
        mask = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, m in zip(d, mask, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        expected[(r[0], len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest())] += 1
    for batches in (1, 4):
        got = repeats.remove_repeats(df, batches=batches).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected


def test_repeats_defined_cases(spark):
    text = "abcdefghij" * 30
    rows = [(None, text, 1, "x"), (1, text, 2, "y"), (1, text, 2, "y"), (2, None, 3, "z"), (3, "", 4, "z"), (4, text[:199], 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 long, c string").withColumns({"t2": pii.F.lit(1), "lo": pii.F.lit("q"), "h": pii.F.lit(0)})
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(df).collect())
    assert got == [(-1, 300, 300, 1), (1, 300, 300, 1), (1, 300, 300, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 199, 0, 0)]


def test_repeats_merge_levels(spark, monkeypatch):
    """Levels of equal size are merged, and what has been found stays the same."""
    made = []
    cut = repeats.cut
    monkeypatch.setattr(repeats, "cut", lambda df, name, *a: made.append(name) or cut(df, name, *a))
    rng = random.Random(61)
    shared = words(rng, 60)
    df = spark.createDataFrame([(i, f"{words(rng, 20)} {shared} {words(rng, 20)}") for i in range(24)], "doc_id long, text string")
    got = []
    for batches in (2, 5):
        made.clear()
        got.append(sorted(tuple(r)[:5] for r in repeats.remove_repeats(df, batches=batches).drop("spans").collect()))
        assert made.count("level") == (0 if batches == 2 else 3)  # five batches: (1+1), (1+1), (2+2)
    assert got[0] == got[1] and all(r[2] >= len(shared) for r in got[0])


def test_repeats_hashes_bounded_parts(spark, monkeypatch):
    """A partition of 4 MB of text is hashed in parts whose arrays stay small."""
    over, calls, maker = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), repeats._entry_maker

    def traced_maker(length, gram):
        def make():
            call = maker(length, gram)()

            def traced(*columns):
                import tracemalloc

                tracemalloc.start()
                got = call(*columns)
                over.add(int(tracemalloc.get_traced_memory()[1] > 128 << 20))
                tracemalloc.stop()
                calls.add(1)
                return got

            return traced

        return make

    monkeypatch.setattr(repeats, "_entry_maker", traced_maker)
    docs = spark.range(1024).coalesce(1).selectExpr("id t1", "cast(id as int) t2", "array_join(transform(sequence(1, 63), i -> sha2(concat_ws(' ', id, i), 256)), '') text")
    assert repeats.repeated(docs, batches=1).count() == 0
    assert calls.value >= 4 and over.value == 0


def test_warc_rejects_records_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a", "x"), (2, "http://b", fake * 3), (3, None, None), (4, "u WARC/1.0", "WARC/1.0\r\n" * 9), (6, "http://a", "x"), (None, "z", "x"), (7, "q", "")]
    path = scratch_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first.setdefault(h or "", i)
    expected = collections.Counter()
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        expected[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f)] += 1
    got = warc.read_archives(spark, path).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected


@pytest.mark.parametrize("split", ["700", "20000"])
def test_warc_over_many_splits(spark, split):
    """Pointer jumping over splits smaller and larger than records; ids beyond 2^53; clashing columns; repeated rows."""
    rng, big = random.Random(41), 1 << 60
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(big + i, f"http://h/{i}", "".join(rng.choice(["word ", fake, "WARC/1.0\r\n", "é"]) for _ in range(rng.randint(0, 40)))) for i in range(50)]
    rows += [(big + 101, "http://a", "x" * 3000), (big + 100, "http://a", "x" * 3000), (big + 100, "http://a", "x" * 3000), (5, "http://a", None)]
    df = spark.createDataFrame([(*r, 1, "f", "n") for r in rows], "page_id long, url string, html string, first long, same string, n string")
    path = scratch_path(spark, "many")
    warc.write_archives(df.coalesce(2), path, parts=1)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    expected = collections.Counter()
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        expected[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f)] += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected


def test_url_filters(spark):
    urls = ["http://A.example.NET/en/x?q#f", "https://net", "http://x.net/", "http://example.com/de/1", "//x.net/", None, "a://b.org/fr/#", "http://org/en/", "x://../", "http://notnet/"]
    df = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = ["example.net/en/", None, "net/", "example.com/de/", None, None, "org/fr/", None, None, None]
    assert [r["rule"] for r in sorted(url_filters.judge(df).collect(), key=lambda r: r["page_id"])] == want
    assert [r["rule"] for r in sorted(url_filters.judge(df, max_bytes=1).collect(), key=lambda r: r["page_id"])] == want


def test_url_filters_in_shards_equal_brute_force(spark):
    """Many rules, null ids and repeated rows, over several shards."""
    rng = random.Random(43)
    hosts = [f"h{i}.{x}" for i in range(40) for x in ("net", "org", "co.uk")]
    rules = tuple({(h, p): (rng.choice(["block", "allow"]), h, p) for h in [*rng.sample(hosts, 50), "net", "uk"] for p in rng.sample(["/", "/a/", "/b"], 2)}.values())
    urls = [(rng.choice([None, 7, k]), f"http://{rng.choice(['', 'www.', 'x.'])}{rng.choice(hosts).upper()}{rng.choice(['', '/', '/a/1', '/bc?x', '/c#y'])}") for k in range(300)] * 2
    df = spark.createDataFrame([(i, u, "k", "r") for i, u in urls], "page_id long, url string, keys string, rule string")

    def slow(url):
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, _, path = rest.partition("/")
        host, path = host.lower(), "/" + path if "/" in rest else ""
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[:0:-1] if fits else (None, "allow"))

    want = collections.Counter((i, *slow(u)) for i, u in urls)
    assert url_filters.shards_needed(30, 500, 16) > 2
    for most in (1 << 20, 32):
        got = url_filters.judge(df, rules, max_bytes=most).collect()
        assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want


def test_pii_round_trip(spark):
    texts = ["mail the.72@mail3.example.com or +1 (017) 555-7713", "4952935900253052!! 4952935900253053 4111-1111-1111-1111", "169.122.221.182 999.1.2.3", "2020-02-30 2020-02-29 31/12/1999 078-05-1120 000-12-3456", 'token = "841d82b07cb9b9f1fcb7cce52fad63a992695314"', "", None, "clean 3. v1.2.3 text", "4952935900253052"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(df).cache()
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert [r["text"] for r in pii.pseudonymise(out, invert=True).orderBy("doc_id").collect()] == texts
    assert got[5:8] == texts[5:8]
    assert "the.72@" not in got[0] and "555-7713" not in got[0] and "@mail3.example.com" in got[0]
    assert "4952935900253053" in got[1] and got[1].startswith(got[8]) and got[8] != texts[8]
    assert "999.1.2.3" in got[2] and "2020-02-30" in got[3] and "000-12-3456" in got[3] and "2020-02-29" not in got[3]


def test_pii_long_values_are_permuted_whole(spark):
    rng = random.Random(13)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."
    head = "".join(rng.choices(alphabet, k=128))
    long = [head + "".join(rng.choices(alphabet, k=n)) for n in (112, 112, 20_000)]
    local = "".join(rng.choices("abcdefgh.", k=90)) + "x"
    texts = [f'token = "{v}" end' for v in long] + [f"write to {local}@mail.example.com now", "token = " + "a" * 240]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(df).cache()
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert [r["text"] for r in pii.pseudonymise(out, invert=True).orderBy("doc_id").collect()] == texts
    values = [g.split('"')[1] for g in got[:3]]
    for v, w in zip(long, values, strict=True):
        assert len(v) == len(w) and all(v[i : i + 16] != w[i : i + 16] for i in range(0, len(v) - 15, 16))
    assert values[0][:128] != values[1][:128]
    assert local not in got[3] and got[3].endswith("@mail.example.com now")
    assert len({got[4][8:][i : i + 32] for i in range(0, 240, 32)}) == 8


def _feistel_numbers(l, r, a, b, kind, key):
    for i in range(1, pii.ROUNDS + 1):
        f = lambda x: int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:12], 16)  # noqa: B023, E731
        if i % 2:
            l = (l + f(r)) % a  # noqa: E741
        else:
            r = (r + f(l)) % b
    return l, r


def _feistel_text(s, kind, key):
    classes = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

    def shifted(half, seed):
        out = ""
        for k, c in enumerate(half):
            h = seed if k < 32 else hashlib.sha256(f"{seed}|{k // 32}".encode()).hexdigest()
            by = int(h[2 * (k % 32) : 2 * (k % 32) + 2], 16)
            group = next((g for g in classes if c in g), None)
            out += group[(group.index(c) + by) % len(group)] if group else c
        return out

    l, r = s[: len(s) // 2], s[len(s) // 2 :]  # noqa: E741
    for i in range(1, pii.ROUNDS + 1):
        f = lambda x: hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()  # noqa: B023, E731
        if i % 2:
            l = shifted(l, f(r))  # noqa: E741
        else:
            r = shifted(r, f(l))
    return l + r


def _luhn_digit(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def test_pii_equals_an_independent_feistel_network(spark):
    """Thousands of values of each kind: the pseudonym in plain Python, one to one within the kind, and turned back."""
    import datetime as dt

    rng, key, epoch = random.Random(37), "another key", dt.date(1800, 1, 1)
    want = {}
    for _ in range(1500):
        day = rng.randrange(160_000)
        date = epoch + dt.timedelta(day)
        a, b = _feistel_numbers(day // 400, day % 400, 400, 400, "date", key)
        other = epoch + dt.timedelta(400 * a + b)
        for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
            want[date.strftime(form)] = other.strftime(form)
    late = [d for d in (epoch + dt.timedelta(k) for k in range(160_000)) if d.day > 12][: pii.LATE**2]
    for k in [0, 1, pii.LATE**2 - 1, *rng.sample(range(pii.LATE**2), 2500)]:
        a, b = _feistel_numbers(k // pii.LATE, k % pii.LATE, pii.LATE, pii.LATE, "late", key)
        want[late[k].strftime("%m/%d/%Y")] = late[pii.LATE * a + b].strftime("%m/%d/%Y")
    for _ in range(2500):
        o = [rng.randrange(256) for _ in range(4)]
        a, b = _feistel_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip", key)
        want[".".join(map(str, o))] = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        body = "".join(rng.choices("0123456789", k=rng.choice([12, 14, 15, 18])))
        new = _feistel_text(body, "card", key)
        want[body + _luhn_digit(body)] = new + _luhn_digit(new)
        local = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789._", k=rng.randint(1, 40)))
        want[f"{local}@mail.example.com"] = f"{_feistel_text(local, 'email', key)}@mail.example.com"
        value = "".join(rng.choices(rng.choice(["0123456789abcdef", "abcdefgxyz", "xyABZ019-_"]), k=rng.randint(6, 70)))
        want[f"token={value}"] = f"token={_feistel_text(value, 'secret', key)}"
        area = rng.choice([*range(1, 666), *range(667, 900)])
        group, serial = rng.randint(1, 99), rng.randint(1, 9999)
        place = area - 2 if area > 666 else area - 1
        a, b = _feistel_numbers(place * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key)
        first = a // 99
        want[f"{area:03d}-{group:02d}-{serial:04d}"] = f"{first + 2 if first >= 665 else first + 1:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    values = list(want)
    df = spark.createDataFrame([(v,) for v in values], "hit string").repartition(8)
    got = {r["hit"]: (r["new"], r["old"]) for r in df.withColumn("new", pii.pseudonym(df["hit"], key)).withColumn("old", pii.pseudonym(pii.F.col("new"), key, True)).collect()}
    assert len(got) == len(values) and all(got[v] == (want[v], v) for v in values)
    assert len({n for n, _ in got.values()}) == len(values)


def test_pii_odd_values(spark):
    texts = ["010.1.1.1 10.1.1.1 256.1.1.1", "11/25/1999 10/13/2001 31/12/1999 13/13/2000 02/30/2000", "1799-12-31 2240-01-01 0000-01-01", "token=zzzzzz token=xbc123 secret: \"Aa1!Aa1!\"", "x" * 300_000 + " 10.0.0.1"]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "part") for i, t in rows], "doc_id long, text string, hit string")
    out = pii.pseudonymise(df).cache()
    back = pii.pseudonymise(out, invert=True)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=key) == sorted(rows, key=key)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == got[None] and got[0].startswith("010.1.1.1 ") and got[0].endswith(" 256.1.1.1") and " 10.1.1.1 " not in got[0]
    first, second, third, *rest = got[1].split(" ")
    assert first != "11/25/1999" and int(first.split("/")[1]) > 12 and int(second.split("/")[1]) > 12 and rest == ["13/13/2000", "02/30/2000"]
    assert got[2] == texts[2] and "zzzzzz" not in got[3] and got[7] is None and got[8] == ""


def test_pii_key_comes_from_the_session(spark, tmp_path):
    spark.createDataFrame([(1, "10.1.1.1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for key in ("one", "two", "one"):
        spark.conf.set(pii.KEY_SETTING, key)
        got.append(pii.op5_pii(spark, str(tmp_path)).first()["text"])
    spark.conf.unset(pii.KEY_SETTING)
    assert got[0] == got[2] != got[1]
    with pytest.warns(UserWarning, match="no secret"):
        pii.op5_pii(spark, str(tmp_path))


def test_decontamination(spark):
    rng = random.Random(5)
    items = [words(rng, 40) for _ in range(3)] + ["short one here", None, ""]
    edited = items[0].upper().replace(" ", ", ", 3)
    texts = [words(rng, 50), f"{words(rng, 30)} {items[1]} {words(rng, 5)}", f"x {edited} y", f"a {items[2][:60]}ZZ{items[2][62:]} b", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect())
    assert got == [(1, 1), (2, 0), (3, 2)]


def test_decontamination_finds_quotes_at_every_place():
    rng = random.Random(17)
    item = decontamination.normalise(words(rng, 120))[:400].decode().strip()
    block = decontamination.Block.build([(7, item), (8, "ox"), (9, "go up")])
    noise = words(rng, 40)
    quotes = [item[s : s + 100] for s in range(0, len(item) - 99) if item[s] != " " and item[s + 99] != " "]
    assert {g[:2] for g in block.find([f"{noise} {q} {noise}" for q in quotes])} == {(i, 7) for i in range(len(quotes))}

    def fewest(p, t):  # fewest edits between p and any part of t
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    texts = []
    for k in range(14):
        q = list(item[17 * k : 17 * k + 104].strip())
        for _ in range(k % 8):
            j = rng.randrange(len(q))
            q[j : j + 1] = rng.choice([[], ["z"], [q[j], "z"]])
        texts.append(f"ab {''.join(q)} cd")
    want = [min(fewest(item[s : s + 100], decontamination.normalise(t).decode()) for s in range(len(item) - 99)) for t in texts]
    got = {g[0]: g[5] for g in block.find(texts)}
    assert got == {i: n for i, n in enumerate(want) if n <= 5}
    assert sorted(g[:4] for g in block.find(["an OX, here", "oxen", "", None, "let us go up", "go upper"])) == [(0, 8, 3, 5), (4, 9, 7, 12)]


def test_decontamination_in_parts_equals_one(monkeypatch):
    """Repetitive items and texts, counted in parts of bounded size."""
    rng = random.Random(47)
    items = [(1, "ha " * 200), (2, words(rng, 60)), (3, "ab" * 150)]
    texts = ["ha " * 3000, f"{words(rng, 900)} {items[1][1]} {words(rng, 900)} " * 3, "ab" * 4000 + " x", words(rng, 50), ""]
    block = decontamination.Block.build(items)
    want = sorted(block.find(texts))
    assert [(g[0], g[1]) for g in want] == [(0, 1), (1, 2), (2, 3)]
    monkeypatch.setattr(decontamination, "MAX_PLACES", 1000)
    assert sorted(block.find(texts)) == want


def test_decontamination_defined_cases(spark):
    rng = random.Random(53)
    item = words(rng, 40)
    rows = [(None, item, "i"), (1, item, "i"), (1, item, "i"), (2, None, "i"), (3, "", "i"), (4, f"{words(rng, 60_000)} {item}", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item, 0), (None, item, 0), (8, None, 0)], "item_id long, text string, doc_id long")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect())
    assert got == {(None, 9): 1, (None, None): 1, (1, 9): 2, (1, None): 2, (4, 9): 1, (4, None): 1}
    assert decontamination.contaminated(docs.limit(0), bench).count() == decontamination.contaminated(docs, bench.limit(0)).count() == 0
    small = decontamination.contaminated(docs, bench, max_bytes=64)
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in small.collect()) == got


def test_language_id_and_toxicity_held_out(spark):
    rng = random.Random(7)
    pools = {"en": "the of and thing with".split(), "de": "der und schön keit ung".split(), "fr": "le été eux ment oui".split(), "es": "ñ ción el los mente".split()}
    rows = []
    for i in range(400):
        lang = rng.choice(list(pools))
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choices(pools[lang], k=30) + (["idiot", "scum"] if bad else [])), lang, int(bad)))
    df = spark.createDataFrame([r[:3] for r in rows] + [(1000, None, None), (1001, " 12 ", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = language_id.learn(df.where("doc_id % 4 <> 1 AND lang IS NOT NULL AND doc_id < 1000").select("lang", "text"))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows) and got[1000] == got[1001] == "und"
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.learn(df, labels.where("doc_id % 4 <> 1"))).collect()}
    assert all(scored[r[0]] == r[3] for r in rows)


def test_language_id_by_hand(spark):
    """Features and decisions against plain loops over the machines, and accuracy on rows held out of learning."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r for r in language_id.op4_language_id(spark, sf).collect()}
    assert len(got) == docs.count()
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(held) == sorted(i for i in got if got[i]["held_out"])
    held = [i for i in held if langs[i] is not None and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.98 * len(held) > 100
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    model = language_id.learn(some)
    for text in ["The cat and the hat", "der Hund und die Katze", "½ le chat", "", "1 2 3", "½ ² Ⅷ ①", None] + [r["text"] for r in some.limit(40).collect()]:
        if not any(c.isalpha() for c in text or ""):
            assert model.predict(text) == ("und", 1.0)
            continue
        data, x = b" " + text.lower().encode() + b" ", np.zeros(language_id.PLACES)
        for i in range(len(data) - 2):
            x[(int.from_bytes(data[i : i + 3], "little") * 2654435761 % 2**32) >> 19] += 1
        x = np.sqrt(x) / np.sqrt(x.sum())

        def winner(stage):
            wins, chance = collections.Counter({n: 0 for n in stage.names}), collections.Counter()
            for m in stage.machines:
                p = 1 / (1 + np.exp(-m.slope * (x @ m.weights + m.bias)))
                wins[m.one if p >= 0.5 else m.other] += 1
                chance[m.one] += p
                chance[m.other] += 1 - p
            best = max(stage.names, key=lambda n: (wins[n], chance[n]))
            return best, chance[best] / (len(stage.names) - 1) if len(stage.names) > 1 else 1.0

        family, p = winner(model.families)
        lang, q = winner(model.languages[family])
        guess = model.predict(text)
        assert guess[0] == lang and abs(guess[1] - p * q) < 1e-4


def test_language_id_defined_cases(spark):
    rows = [(None, "the thing", "en", 1), (1, None, "en", 2), (2, "", None, 3), (2, "the thing", "en", 4), (2, "the thing", "en", 4), (3, "der und " * 50_000, "de", 5), (4, "½", "en", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = language_id.learn(df.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.predict(df, model).collect())
    assert got == [(-1, "en", True), (1, "und", True), (2, "en", True), (2, "en", True), (2, "und", True), (3, "de", True), (4, "und", True)]


def test_language_id_learns_every_language(spark):
    rng = random.Random(23)
    names = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(66)]
    rows = [(n, " ".join([f"{n}{rng.choice('aeiou')}{n}"] * 12)) for n in names for _ in range(2)] + [(names[0], "hot " * 30)] * 900
    model = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert set(model.languages) == set(names)
    assert all(model.predict(t)[0] == n for n, t in rows[:132])


def test_toxicity_small_tables_and_rare_insults(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, 30) + (" vermin" if i % 7 == 0 else ""), int(i % 7 == 0)) for i in range(70)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, words(rng, 30) + " vermin"), (901, words(rng, 30))], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.learn(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))).collect()}
    assert got[900] == 1 and got[901] == 0
    # an insult in under 3 % of the toxic rows
    rows = [(i, f"{words(rng, 12)} {'scum' if i % 4 == 0 else ''} {'vermin' if i in (1, 101, 301, 501) else ''}", int(i % 4 == 0 or i in (1, 101, 301, 501))) for i in range(800)]
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, "vermin"), (901, words(rng, 12))], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert set(model.index.number) == {t for r in rows for t in toxicity.terms(r[1])}
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert {e["example"] for e in got[900]["evidence"]} == {1, 101, 301, 501} and got[900]["predicted"] == 1


def test_nearest_is_exact():
    rng = random.Random(2)
    idf = {f"t{i}": 1.0 + i / 10 for i in range(30)}
    index = toxicity.Index(idf, {}, {}, 0)
    vectors = [index.vector(collections.Counter(rng.choices(list(idf), k=6))) for _ in range(500)]
    index = toxicity.Index.build(idf, vectors)
    for _ in range(50):
        q = index.vector(collections.Counter(rng.choices(list(idf), k=4)))
        sims = sorted((sum(w * v.get(t, 0) for t, w in q.items()) for v in vectors), reverse=True)[:15]
        assert np.allclose(index.nearest(q, 15)[1], [s for s in sims if s > 0])


def test_toxicity_equals_brute_force_cosine(spark):
    """Scores of a whole table, end to end, against dense vectors in plain NumPy."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    texts, toxic = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, collections.defaultdict(int)
    for r in labels.collect():
        if r["doc_id"] in texts and r["toxic"] is not None:
            toxic[texts[r["doc_id"]]] = max(toxic[texts[r["doc_id"]]], r["toxic"])
    found = {t: collections.Counter(toxicity.terms(t)) for t in set(texts.values())}
    vocabulary = {t: i for i, t in enumerate(sorted({w for x in toxic for w in found[x]}))}
    df = np.zeros(len(vocabulary))
    for t in texts.values():
        for w in found[t]:
            if w in vocabulary:
                df[vocabulary[w]] += 1
    held = np.zeros((len(toxic), len(vocabulary)), bool)
    for i, x in enumerate(toxic):
        held[i, [vocabulary[w] for w in found[x]]] = True
    y = np.array(list(toxic.values()), float)
    n, t, a = len(y), y.sum(), y @ held
    b = held.sum(0) - a
    chi2 = n * (a * (n - t - b) - b * (t - a)) ** 2 / ((a + b) * np.maximum(n - a - b, 1) * t * (n - t))
    factor = (np.log((1 + len(texts)) / (1 + df)) + 1) * np.sqrt(1 + chi2)

    def unit(counter):
        v = np.zeros(len(vocabulary))
        for w, k in counter.items():
            if w in vocabulary:
                v[vocabulary[w]] = (1 + np.log(k)) * factor[vocabulary[w]]
        return v / max(np.linalg.norm(v), 1e-300)

    examples = np.array([unit(found[x]) for x in toxic])
    for i, text in texts.items():
        sims = examples @ unit(found[text])
        best = np.sort(sims)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], best[best > 1e-12], atol=1e-9)
        if len(best) and (sims >= best[-1] - 1e-9).sum() == len(best) and best[-1] > 0:  # no tie at the end
            near = np.argsort(-sims)[: len(best)]
            p = 1 / (1 + np.exp(-(model.slope * toxicity.votes(sims[near], y[near]) + model.shift)))
            assert abs(p - got[i]["score"]) < 1e-6
    # scores don't rest on ids, and where scores lie, so do the labels
    other = docs.withColumn("doc_id", 10**6 - F.col("doc_id"))
    again = toxicity.score(other, toxicity.learn(other, labels.withColumn("doc_id", 10**6 - F.col("doc_id"))))
    assert all(abs(r["score"] - got[10**6 - r["doc_id"]]["score"]) < 1e-9 for r in again.collect())


def test_toxicity_is_calibrated_on_held_out_rows(spark):
    for name, least in (("sf0.001", 2), ("sf0.1", 50)):
        sf = f"/root/testdata/{name}"
        labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        got = toxicity.op1_toxicity(spark, sf).select("doc_id", "held_out", "score").collect()
        assert len({round(r["score"], 9) for r in got}) >= least
        held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
        if name == "sf0.1":
            p, y = (np.array(c, float) for c in zip(*held, strict=True))
            part = np.minimum((p * 10).astype(int), 9)
            gap = sum(abs(p[part == k].mean() - y[part == k].mean()) * (part == k).mean() for k in np.unique(part))
            assert gap < 0.05 and y.sum() > 50


def test_toxicity_defined_cases(spark):
    rng = random.Random(31)
    rows = [(i, words(rng, 20) + (" vermin" if i % 3 == 0 else ""), "x") for i in range(60)]
    rows += [(None, "vermin", "x"), (100, None, "x"), (101, "", "x"), (102, rows[1][1], "x"), (103, "vermin " * 30_000, "x"), (1, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None) for i in range(60)] + [(102, 1, None), (None, 1, None), (2, None, None), (2, 0, None), (999, 1, None)], "doc_id long, toxic int, text string")
    model = toxicity.learn(df, labels)
    assert model.toxic[list(model.ids).index(1)] == 1  # an equal text is toxic
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[100]["evidence"] == by_id[101]["evidence"] == [] and by_id[None]["predicted"] == by_id[103]["predicted"] == 1
    small = toxicity.learn(df, labels, max_examples=20)
    assert small.index.n == 20


def test_empty_tables(spark):
    none = empty(spark)
    assert quality_rules.ledger(none).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0
    assert near_dedup.classes(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert pii.pseudonymise(none).count() == 0
    assert toxicity.learn(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert language_id.predict(none, language_id.learn(none.select("lang", "text"))).count() == 0
    path = scratch_path(spark, "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and sum(r["offset"] == 0 for r in rows) == len({r["sequence_id"] for r in rows})


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    a, b, c, item = words(rng, 80), words(rng, 80), words(rng, 80), words(rng, 40)
    held = f"{words(rng, 30)} {item} {words(rng, 30)}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    form = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, a), (None, a), (4, a), (None, b), (None, b), (7, c), (7, held), (7, held), (8, held), (None, f"{held} x"), (9, words(rng, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], form)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()), key=key)
    assert got == sorted([(4, a), (None, b), (7, c), (7, held), rows[-1]], key=key)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_free(spark, docs, str(tmp_path)).collect()), key=key)
    assert got == sorted([r for r in rows if item not in r[1]], key=key)


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(29)
    stop = "the of and to with that be have".split()
    prose = lambda n: " ".join(f"{words(rng, 6)} {rng.choice(stop)} {rng.choice(stop)}." for _ in range(n))
    item = prose(6)
    base = [prose(25) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(50, base[0]), (None, base[1]), (51, base[2].replace(base[2].split()[9], "other", 1)), (3, prose(25)), (None, prose(25)), (60, f"{base[4]} {item} {prose(20)}"), (None, f"{item} {prose(20)}"), (61, f"{prose(25)} mail the.one@mail.example.com or token = \"{'aB3' * 60}\" now."), (62, None), (63, ""), (64, "$$$ ### 1 2 3")]
    form = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], form)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {r["text"] for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert set(base) <= good and not good & {None, "", "$$$ ### 1 2 3"}
    left = [r for r in texts if r[1] in good]
    sets, classes = [near_dedup.shingles(t) for _, t in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if near_dedup.similarity(sets[i], sets[j]) >= 0.8:
                classes = [classes[j] if c == classes[i] else c for c in classes]
    kept = [min((r for r, k in zip(left, classes, strict=True) if k == c), key=lambda r: (r[0] is None, r[0] or 0)) for c in set(classes)]
    kept = [r for r in kept if decontamination.normalise(item) not in decontamination.normalise(r[1])]
    assert len(kept) < len(left) - 3
    private = pii.pseudonymise(spark.createDataFrame(kept, "doc_id long, text string")).collect()
    assert not any("the.one" in r["text"] or "aB3aB3" in r["text"] for r in private)
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_file()), collections.Counter()
    for r in private:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want
