"""Record sets and labelled pairs derived from the test tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL, THRESHOLD = 0.0625, 0.5

RECORDS = """select case when p_partkey % 2 = 0 then 'left' else 'right' end as side,
 case when p_partkey % 2 = 0 then 'left' else 'right' end as source, p_partkey as ordinal,
 case when p_partkey % 13 = 0 then null when p_partkey % 2 = 1 then concat(upper(p_name), ', ', p_type) else p_name end as name,
 case when p_partkey % 11 = 0 then null when p_partkey % 19 = 0 then cast(0.0005 as double) when p_partkey % 23 = 0 then cast(0.00001 as double) else cast((p_partkey * 7) % 640 as double) / 64.0 end as latitude,
 case when p_partkey % 17 = 0 then null else cast((p_partkey * 3) % 320 as double) / 64.0 - 2.5 end as longitude,
 p_brand as f_brand, case when p_partkey % 5 = 0 then '' else p_type end as f_type, cast(p_size as varchar(10)) as f_size
 from part"""

PAIRS = """select a.p_partkey as pair_no, a.p_name as left_name, concat(b.p_name, ' ', b.p_type) as right_name,
 case when split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) then 1 else 0 end as label, a.p_type as category,
 case a.p_partkey % 4 when 0 then 'calibration' when 1 then 'sealed test' else 'development' end as role, a.p_partkey % 5 + 1 as seed
 from part a join part b on b.p_partkey = a.p_partkey + 1"""

#: Arms of the frontier and divergence fixtures: published figures. (family, position, arm, f1, fp, rss in bytes, p50 in seconds)
ARMS = [
    ("abbreviation", 0, "fp32", 0.769, 0.0, 275300000.0, 2.487e-05),
    ("abbreviation", 1, "fuzzy", 0.974, 5.0, 24000000.0, 9.6e-07),
    ("abbreviation", 2, "int8", 0.75, 1.0, 208900000.0, 2.471e-05),
    ("abbreviation", 3, "overlap", 1.0, 115.0, 22500000.0, 2.1e-07),
    ("transliteration", 0, "fp32", 1.0, 0.0, 275300000.0, 2.487e-05),
    ("transliteration", 1, "fuzzy", 0.961, 5.0, 24000000.0, 9.6e-07),
    ("transliteration", 2, "int8", 1.0, 1.0, 208900000.0, 2.471e-05),
    ("transliteration", 3, "overlap", 1.0, 115.0, 22500000.0, 2.1e-07),
    ("character noise", 0, "fp32", None, 0.0, 275300000.0, 2.487e-05),
    ("character noise", 1, "fuzzy", None, 0.0, 24000000.0, 9.6e-07),
    ("character noise", 2, "int8", None, 0.0, 208900000.0, 2.471e-05),
    ("character noise", 3, "overlap", None, 0.0, 22500000.0, 2.1e-07),
]
EXPECTED = [("abbreviation", "fuzzy"), ("transliteration", "overlap"), ("character noise", "fp32")]


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RECORDS.replace("from part", "from {part}"), part=part(spark, sf_dir))
    whole = F.create_map(F.lit("brand"), F.col("f_brand"), F.lit("type"), F.col("f_type"), F.lit("size"), F.col("f_size"))
    short = F.create_map(F.lit("brand"), F.col("f_brand"), F.lit("type"), F.col("f_type"))
    return rows.withColumn("fields", F.when(F.col("side") == "left", short).otherwise(whole)).drop("f_brand", "f_type", "f_size")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    return rows.where("side = 'left'"), rows.where("side = 'right'")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return spark.sql(PAIRS.replace("part a", "{a} a").replace("part b", "{b} b"), a=p, b=p)


def arms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARMS, "family string, position int, arm string, f1 double, fp double, rss double, p50 double")


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTED, "family string, expected string")


def arms_sql() -> str:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in ARMS) + ") arms(family, position, arm, f1, fp, rss, p50)"
