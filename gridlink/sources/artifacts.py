"""Model files as tables: operator counts of a graph, signatures of its inputs and outputs, sizes and digests of files.

A graph file is a protocol-buffer message; its nodes are read by their field numbers alone, so no further package is
needed. Files are read where Spark reads them (`binaryFile`), one row a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the graph format. Model: graph; graph: node; node: op_type.
GRAPH, NODE, OP_TYPE = 7, 1, 4


def _fields(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Number and content of each length-delimited field of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            varint()
        elif kind == 2:
            size = varint()
            if at + size > len(data):
                raise ValueError("a field ends beyond its message")
            yield number, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")


def operator_types(model: bytes) -> list[str]:
    """op_type of each node, in order."""
    nodes = (n for number, graph in _fields(memoryview(model)) if number == GRAPH for k, n in _fields(graph) if k == NODE)
    return [next((bytes(v).decode() for k, v in _fields(node) if k == OP_TYPE), "") for node in nodes]


def operator_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, op_type, n of every graph file at path."""
    @F.pandas_udf("array<string>")
    def types(content: pd.Series) -> pd.Series:
        return content.map(operator_types)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.explode(types("content")).alias("op_type")).groupBy("path", "op_type").agg(F.count("*").alias("n"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def total_size(files: DataFrame) -> DataFrame:
    """files (size): one row with the sum as a metric; without files it is undefined."""
    # Fixed value: the reason's text.
    return files.agg(F.sum("size").cast("double").alias("value")).withColumn("undefined_reason", F.when(F.col("value").isNull(), "classical arms carry no model artifact"))


def operator_differences(old: DataFrame, new: DataFrame, key: str = "op_type") -> DataFrame:
    """old, new (key, n): key, old_n, new_n, change (added, removed, changed) of each type whose count differs."""
    both = old.select(key, F.col("n").alias("old_n")).join(new.select(key, F.col("n").alias("new_n")), key, "full_outer")
    change = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old_n").eqNullSafe(F.col("new_n"))).withColumn("change", change)


def signature_differences(old: DataFrame, new: DataFrame, old_name: str = "fp32", new_name: str = "int8") -> DataFrame:
    """old, new (kind, name, shape, dtype; shape as text): a row for each difference, sorted by its text."""
    a = old.select("kind", "name", F.col("shape").alias("a_shape"), F.col("dtype").alias("a_dtype"), F.lit(True).alias("a"))
    b = new.select("kind", "name", F.col("shape").alias("b_shape"), F.col("dtype").alias("b_dtype"), F.lit(True).alias("b"))
    head = F.concat(F.col("kind"), F.lit(" '"), F.col("name"), F.lit("' "))

    def differs(what: str) -> Column:
        one, two = F.col(f"a_{what}"), F.col(f"b_{what}")
        text = F.concat(head, F.lit(f"{what} differs: {old_name}="), F.coalesce(one, F.lit("None")), F.lit(f" {new_name}="), F.coalesce(two, F.lit("None")))
        return F.when(F.col("a") & F.col("b") & ~one.eqNullSafe(two), text)

    # The differences' texts.
    gone = F.when(F.col("b").isNull(), F.concat(head, F.lit(f"present in {old_name} graph, absent from {new_name} graph")))
    come = F.when(F.col("a").isNull(), F.concat(head, F.lit(f"present in {new_name} graph, absent from {old_name} graph")))
    found = a.join(b, ["kind", "name"], "full_outer").select(F.explode(F.array(gone, come, differs("shape"), differs("dtype"))).alias("difference"))
    return found.where("difference IS NOT NULL").orderBy("difference")


def write_fragment(folder: str, name: str, content: dict) -> Path:
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(content, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return path


def read_fragment(folder: str, name: str) -> dict:
    return json.loads((Path(folder) / f"{name}.json").read_text(encoding="utf-8"))


def weights_file(names: Column) -> Column:
    """Of the given file names the preferred weights file; none is an error."""
    # Names of weights files, the preferred one first.
    prefer = ("model.safetensors", "pytorch_model.bin")
    found = F.coalesce(*(F.when(F.array_contains(names, n), F.lit(n)) for n in prefer))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no weights file among "), F.array_join(F.array_sort(names), ", "))).cast("string"))
