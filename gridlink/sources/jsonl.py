"""Record sets as JSON Lines, and resolutions written back.

Files are read by the text source, so large ones are split. A line's ordinal is its rank among the file's filled lines:
lines are numbered within their split by the order in which a task reads them, and the splits' counts, one number each,
shift them, so no task sees all lines and none are sorted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridlink.operators.resolve import Resolution

SCHEMA = "name string, latitude double, longitude double, fields map<string,string>, _corrupt string"
_LINES = "file string, block long, line long, filled long, value string"


class MalformedRecordError(ValueError):
    """A line that is no record; the message names file and line."""


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's number, and its number among filled lines, within its split, from 0; a split's lines come in order."""
    last, line, filled = None, 0, 0
    for batch in batches:
        lines, ranks = [], []
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != last:
                last, line, filled = (file, block), 0, 0
            lines.append(line)
            ranks.append(filled)
            line += 1
            filled += bool(value.strip())
        file, block, value = batch.columns
        yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(lines, pa.int64()), pa.array(ranks, pa.int64()), pa.array(value, pa.string())], names=["file", "block", "line", "filled", "value"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (physical, from 1), ordinal (among filled lines, from 0), value of each filled line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    rows = raw.mapInArrow(_numbered, _LINES)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.count_if(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]", "") != "").alias("m"))
    before = W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)  # a row for each split of the input
    shifts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    rows = rows.join(F.broadcast(shifts), ["file", "block"])
    return rows.where(F.regexp_replace("value", r"(?U)[\s\x1c-\x1f]", "") != "").select((F.col("line") + F.col("n") + 1).alias("line"), (F.col("filled") + F.col("m")).alias("ordinal"), "value")


def read_records(spark: SparkSession, path: str, source: str | None = None, side: str = "left") -> DataFrame:
    """Blank lines are skipped and not counted in the ordinal; a missing name or broken JSON is an error. A folder's
    files count as one, in the order of their names."""
    source = source or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    row = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = _lines(spark, path).withColumn("r", row).withColumn("named", F.array_contains(F.json_object_keys("value"), "name"))
    bad = rows.where("r._corrupt IS NOT NULL OR named IS NULL OR NOT named").orderBy("line").first()
    if bad:
        raise MalformedRecordError(f"{path}:{bad['line']}: " + ("record has no 'name' field" if bad["named"] is False else "line is not a JSON record"))
    fields = F.coalesce("r.fields", F.create_map().cast("map<string,string>"))
    return rows.select(F.lit(side).alias("side"), F.lit(source).alias("source"), "ordinal", "r.name", "r.latitude", "r.longitude", fields.alias("fields"))


def write_resolution(result: Resolution, path: str) -> None:
    """One JSON object a line with sorted keys: pairs by left record, then what is left, by side and record. A single
    file by the driver, row by row; write_resolution_parts() is for what one machine shouldn't write."""
    pairs = result.pairs.orderBy("l.source", "l.ordinal").select("merged.*")
    rest = result.unmatched.orderBy("side", "source", "ordinal").drop("side")
    with open(path, "w", encoding="utf-8") as out:
        for status, rows in (("matched", pairs), ("unmatched", rest)):
            for row in rows.toLocalIterator():
                out.write(json.dumps({"status": status, **row.asDict(recursive=True)}, sort_keys=True) + "\n")


def write_resolution_parts(result: Resolution, path: str) -> None:
    """The same objects as a folder of JSON Lines files, written where the rows are, in no order."""
    names = ("fields", "latitude", "longitude", "name", "ordinal", "reason", "source", "sources", "status")
    rows = result.pairs.select("merged.*").withColumn("status", F.lit("matched"))
    rows = rows.unionByName(result.unmatched.drop("side").withColumn("status", F.lit("unmatched")), allowMissingColumns=True)
    optional = ("ordinal", "reason", "source", "sources")  # which of these are there depends on the status
    text = F.to_json(F.struct(*(c for c in names if c not in optional)), {"ignoreNullFields": "false"})
    more = F.to_json(F.struct(*optional))
    rows.select(F.when(more == "{}", text).otherwise(F.concat(F.substring(text, 1, F.length(text) - 1), F.lit(","), F.substring(more, 2, 1 << 30))).alias("value")).write.text(path)
