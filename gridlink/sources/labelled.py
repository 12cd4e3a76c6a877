"""Labelled name pairs from CSV or JSON Lines, in the published three-field schema.

left_name, right_name and label are required; category, pair_id and split are optional. Rows that don't fit are an
error that names file, line of data and field, never dropped. Empty text counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED, OPTIONAL = ("left_name", "right_name", "label"), ("category", "pair_id", "split")
# The column's words and the roles they stand for.
ROLES = {"dev": "development", "calibration": "calibration", "test": "sealed test"}


class MalformedPairError(ValueError):
    """A row that is no labelled pair."""


def read_pairs(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """left_name, right_name, label int, category, pair_id, role. form: csv or jsonl, by default from the path's end."""
    form = form or ("csv" if path.lower().rstrip("/").endswith(".csv") else "jsonl")
    if form == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif form == "jsonl":
        rows = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unknown form {form!r}; known: csv, jsonl")
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise MalformedPairError(f"{path}: no field {missing[0]!r}")
    rows = rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (*REQUIRED, *OPTIONAL)))
    rows = rows.select(*(F.when(F.col(c) != "", F.col(c)).alias(c) for c in rows.columns))
    bad = rows.withColumn("problem", problem()).where("problem IS NOT NULL").first()
    if bad:
        raise MalformedPairError(f"{path}: {bad['problem']} in pair {bad['pair_id'] or (bad['left_name'], bad['right_name'])!r}")
    if rows.where("pair_id IS NOT NULL").groupBy("pair_id").count().where("count > 1").first():
        raise MalformedPairError(f"{path}: a pair_id is given twice")
    role = F.create_map(*(F.lit(x) for item in ROLES.items() for x in item))[F.col("split")]
    return rows.select("left_name", "right_name", F.col("label").cast("int").alias("label"), "category", "pair_id", role.alias("role"))


def problem() -> Column:
    """What is wrong with a row, or null."""
    return F.coalesce(
        *(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in REQUIRED),
        F.when(~F.col("label").isin("0", "1"), F.concat(F.lit("label is "), F.col("label"), F.lit(", not 0 or 1"))),
        F.when(F.col("split").isNotNull() & ~F.col("split").isin(*ROLES), F.concat(F.lit("unknown split "), F.col("split"))),
    )


def split_word(role: Column) -> Column:
    """The column's word for a role."""
    return F.create_map(*(F.lit(x) for word, name in ROLES.items() for x in (name, word)))[role]
