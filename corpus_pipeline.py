"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of `documents`: quality rules drop what
they reject, near-duplicate classes keep their member with the least doc_id (null ids come last; of members with this id
the one with the least hashes of its text, of rows alike in id and text one), documents
that hold a benchmark region are dropped, decided by each row's own text whatever its id, personal data become pseudonyms (n_chars is counted anew), and the last stage
packs what is left into sequences. Null texts fail the quality rules; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm import decontamination, near_dedup, packing, pii, quality_rules
from gridlink.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that policy v1 keeps. The verdict is computed beside the row, so nothing is joined."""
    bits = quality_rules.fail_bits_of(docs, "text", COLUMNS)
    return bits.where(~quality_rules.failed(quality_rules.V1)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class stays."""
    row = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")
    found = near_dedup.row_classes(docs).select("component", *row, "h1", "h2")
    key = ["no_id", "id", "h1", "h2"]
    best = found.groupBy("component").agg(F.min(F.struct(*key)).alias("best")).select("best.*")
    return docs.select(*COLUMNS, *row, *near_dedup.text_hashes()).join(best, key, "left_semi").dropDuplicates(key).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold no region of a benchmark item."""
    keyed = docs.select(*COLUMNS, *near_dedup.text_hashes())
    hits = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), carry=("h1", "h2"))
    hits = cut(hits.select("h1", "h2").distinct(), "hits")
    return keyed.join(hits, ["h1", "h2"], "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data as pseudonyms."""
    return pii.pseudonymise(docs, key=pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of each document and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", benchmark_free), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
