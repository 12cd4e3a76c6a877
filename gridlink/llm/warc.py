"""Operator 6: WARC archives, written with revisit records and read back by boundary-chain verification.

Writing: payload digests are aggregated to the smallest page_id of each (pre-aggregated; a common payload's rows are a
plain join's skewed side, which adaptive execution splits), and records go out through Spark's text writer, so no task
needs a local file. Payloads are joined in PARTS passes over shares of the digests, each pass's shuffle files going before
the next, so the disk holds the archives and one share. Reading: a file is split at every magic line, also at those inside payloads. Each task emits its
candidates with the offset of their successor, contracts the chains within its split from the right, and pointer
jumping over the splits' entries, from each file's start, finds the one candidate in each split where the true chain
enters. Only records on the chain are kept, so records that a payload quotes are not. A payload that was cut at a
magic line is put together again from the file's ranges.

Defined cases: null html counts as an empty payload and a null url as an empty one; a null page_id is never the
smallest unless a payload has no other, and such rows are responses; rows that repeat the smallest page_id are all
responses; an empty table gives an empty result; payloads of any length that one row can hold are digested whole.
Control characters and spaces in a url are percent-encoded in its header line. In foreign archives a header line may
not end in the magic. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridlink.llm.common import arrow_of, cut, drop, release, scratch_path, table

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PARTS = 3
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 5 hex digits are 4 of base 32, eight times."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", parts: int = PARTS) -> None:
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    payload = F.encode("html", "utf-8")
    rows = rows.withColumn("n", F.octet_length(payload)).withColumn("same", F.sha2(payload, 256))
    firsts = rows.groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    firsts = cut(firsts, "firsts")
    share = F.pmod(F.xxhash64("same"), F.lit(parts))
    for k in range(parts):
        joined = rows.where(share == k).join(firsts.where(share == k), "same", "left")
        _records(joined, min_revisit_bytes, date).write.mode("append" if k else "error").option("lineSep", END).text(path)
        release(pages.sparkSession)
    drop(firsts)


def _records(rows: DataFrame, min_revisit_bytes: int, date: str) -> DataFrame:
    """value: the record of each row (page_id, url, html, n, first: the smallest page_id of its payload, null if alone)."""
    payload = F.encode("html", "utf-8")
    revisit = (F.col("n") >= min_revisit_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    digest = base32_sha1(payload)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    url = F.col("url")
    for c in "\r\n\t ":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    url = F.regexp_replace(url, "WARC/1.0$", "WARC/1.%30")
    is_revisit = rows.withColumn("revisit", revisit)
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html")))

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", _urn(F.col("first"))), line("X-Refers-To-Page-ID", F.col("first").cast("string")), line("WARC-Profile", PROFILE))).otherwise(""),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(F.encode(block, "utf-8")).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return is_revisit.select(record.alias("value"))


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for i, x in enumerate(data[:end].split(b"\r\n")):
        name, colon, value = x.partition(b":")
        if not colon and i == 0 and x.startswith(b"HTTP/"):
            continue
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _parse(fields: dict[str, str], block: bytes) -> tuple:
    """FIELDS of a record with its whole block."""
    at = block.find(b"\r\n\r\n")
    payload = block[at + 4 :] if at >= 0 else block
    kind, number = fields.get("warc-type"), lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "revisit":
        http = _header(block)
        size, digest = int(http[0]["content-length"]) if http else 0, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return number(fields.get("x-page-id")), fields.get("warc-target-uri"), size, digest, kind, number(fields.get("x-refers-to-page-id"))


_CANDIDATE = f"file string, block long, at long, till long, succ long, leaves long, span long, whole boolean, {FIELDS}"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _splits(batches):
    """(file, block, offset in the split, content) of each range between magic lines, in order."""
    last, at = None, 0
    for b in batches:
        for value, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, block) != last:
                last, at = (file, block), 0
            yield file, block, at, value
            at += len(value) + len(MAGIC)


def _candidates(batches, arrow: pa.Schema):
    """at: where a range begins in its split; succ: where its record's successor begins; leaves: the first offset
    beyond the split on the chain from here, or -1 for a dead end. The split's own length is `till` of its last row."""
    names = [f.name for f in arrow]

    def done(rows):
        known = {r["at"]: r for r in rows}
        end = rows[-1]["till"] if rows else 0
        for r in reversed(rows):
            s = r["succ"]
            r["leaves"] = -1 if s is None else s if s >= end else known[s]["leaves"] if s in known else -1
        for k in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=arrow)

    rows, last = [], None
    for file, block, at, value in _splits(batches):
        if (file, block) != last:
            yield from done(rows)
            rows, last = [], (file, block)
        row = dict.fromkeys(names) | {"file": file, "block": block, "at": at, "till": at + len(value) + len(MAGIC), "whole": False}
        if (at or block) and (got := _header(value)):  # what stands before a file's first magic is no record
            fields, start = got
            size = start + int(fields["content-length"]) + len(END)
            row |= {"succ": at + size + len(MAGIC), "span": size}
            if size <= len(value):
                row |= {"whole": True, **dict(zip(names[8:], _parse(fields, value[start : size - len(END)]), strict=True))}
        rows.append(row)
    yield from done(rows)


def _kept(rows: pa.Table) -> pa.Table:
    """Of a split's ranges, those that the chain from the split's entry reaches. Arrow keeps null and large longs as they are."""
    rows = rows.sort_by("at")
    at, succ, reached = rows["at"].to_pylist(), rows["succ"].to_pylist(), np.zeros(rows.num_rows, bool)
    place, x = {v: i for i, v in enumerate(at)}, rows["entry"][0].as_py()
    while x in place:
        i = place[x]
        reached[i] = succ[i] is not None
        x = succ[i]
    return rows.drop_columns(["entry"]).filter(pa.array(reached))


def _split_of(places: DataFrame, splits: DataFrame) -> DataFrame:
    """places (file, x, ...) with block, base and number of the split each lies in. A window over a file's splits and
    places, a few numbers for each split, so that no split meets all places of its file."""
    own = [c for c in places.columns if c not in ("file", "x")]
    rows = places.select("file", "x", F.struct(*(own or ["x"])).alias("own"), F.lit(None).cast("struct<block:long,base:long,number:int>").alias("split"))
    kind = rows.schema["own"].dataType
    marks = splits.select("file", F.col("base").alias("x"), F.lit(None).cast(kind).alias("own"), F.struct("block", "base", "number").alias("split"))
    # a split of no rows begins where the next one does; the later one has the places
    order = W.partitionBy("file").orderBy("x", F.col("own").isNotNull(), F.col("split.number")).rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("split", F.last("split", ignorenulls=True).over(order)).where("own IS NOT NULL AND split IS NOT NULL")
    return both.select("file", "x", *(F.col(f"own.{c}").alias(c) for c in own), "split.block", "split.base", "split.number")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of each record that the chain of boundaries from its file's start reaches."""
    arrow = arrow_of(_CANDIDATE)
    rows = cut(_raw(spark, path).mapInArrow(lambda batches: _candidates(batches, arrow), _CANDIDATE), "candidates")
    splits = rows.groupBy("file", "block").agg(F.max("till").alias("size"))
    order = W.partitionBy("file").orderBy("block")
    splits = splits.withColumn("base", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    splits = cut(splits.withColumn("number", F.row_number().over(order)), "splits")
    # entries: the first range after each file's first magic, and every range that some chain enters from another split
    based = rows.join(splits.select("file", "block", "base"), ["file", "block"])
    firsts = based.where("block = 0 AND at > 0").groupBy("file").agg(F.min("at").alias("x"))
    nodes = based.where("leaves IS NOT NULL").select("file", (F.col("base") + F.col("at")).alias("x"), F.when(F.col("leaves") >= 0, F.col("base") + F.col("leaves")).alias("next"))
    inner = nodes.where("next IS NOT NULL").select("file", F.col("next").alias("x")).unionByName(firsts).distinct()
    jumps = cut(nodes.join(inner, ["file", "x"]), "jumps")
    most = splits.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    reached = firsts
    for _ in range(int(most - 1).bit_length() if most else 0):
        ahead = reached.join(jumps, ["file", "x"]).where("next IS NOT NULL").select("file", F.col("next").alias("x"))
        reached = cut(reached.unionByName(ahead).distinct(), "reached")
        onward = jumps.select("file", F.col("x").alias("next"), F.col("next").alias("next2"))
        jumps = cut(jumps.join(onward, ["file", "next"], "left").select("file", "x", F.col("next2").alias("next")), "jumps")
    entries = _split_of(reached, splits).groupBy("file", "block").agg(F.min(F.col("x") - F.col("base")).alias("entry"))
    chained = rows.join(entries, ["file", "block"]).select(*rows.columns, "entry")
    kept = chained.groupBy("file", "block").applyInArrow(_kept, _CANDIDATE)
    kept = cut(kept, "kept")
    out = kept.where("whole").select(*(x.split()[0] for x in FIELDS.split(", ")))
    if kept.where("NOT whole").limit(1).count():
        out = out.unionByName(_rebuilt(spark, path, kept.where("NOT whole"), splits))
    return out


def _rebuilt(spark: SparkSession, path: str, cut_up: DataFrame, splits: DataFrame) -> DataFrame:
    """Records whose block holds magic lines, from all their ranges. A record is looked for in the splits it lies in."""
    wanted = cut_up.join(splits, ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("first"), "span", F.col("number").alias("begin"))
    wanted = _split_of(wanted.withColumn("x", F.col("first") + F.col("span") - 1), splits)
    wanted = wanted.select("file", "first", "span", F.explode(F.sequence("begin", "number")).alias("number"))

    def ranges(batches):
        for file, block, at, value in _splits(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "at": [at], "value": pa.array([value], pa.binary())})

    parts = _raw(spark, path).mapInArrow(ranges, "file string, block long, at long, value binary").join(splits.select("file", "block", "base", "number"), ["file", "block"])
    parts = parts.withColumn("x", F.col("base") + F.col("at"))
    mine = parts.join(wanted, ["file", "number"]).where("x >= first AND x < first + span")
    whole = mine.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("x", "value"))).alias("parts"), F.first("span").alias("span"))

    arrow = arrow_of(FIELDS)

    def rebuild(batches):
        for b in batches:
            out = []
            for parts, span in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = MAGIC.encode().join(p["value"] for p in parts)[: span - len(END)]
                fields, start = _header(data)
                out.append(_parse(fields, data[start:]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return whole.select("parts", "span").mapInArrow(rebuild, FIELDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  translate(list_aggregate(list_transform(range(8), lambda i: lpad(to_base(('0x' || substr(h, 5 * i::INT + 1, 5))::BIGINT, 32), 4, '0')), 'string_agg', ''),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": ORACLE}
