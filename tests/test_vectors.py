import pytest
from pyspark.sql import functions as F

from gridlink.functions import vectors


def test_mean_pool_takes_the_mask_as_a_column(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[4.0, 5.0]], [1])], "tokens array<array<double>>, mask array<int>")
    got = [r["m"] for r in df.select(vectors.mean_pool(F.col("tokens"), F.col("mask")).alias("m")).collect()]
    assert got == [[2.0, 4.0], [4.0, 5.0]]
    masked = spark.createDataFrame([([[1.0, 2.0]], [0])], "tokens array<array<double>>, mask array<int>")
    with pytest.raises(Exception, match="all tokens are masked"):
        masked.select(vectors.mean_pool(F.col("tokens"), F.col("mask")).alias("m")).collect()


def test_agg_mean_pool_equals_its_oracle(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(entry.oracle_sql()["agg_mean_pool"]).fetchall()
    got = [tuple(r) for r in entry.queries()["agg_mean_pool"](spark, sf).collect()]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)]
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(sorted(got), sorted(want)))
