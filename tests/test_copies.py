"""Linkage of tables that repeat their records under other keys: equal to the SQL, no record set broadcast, what is alike
compared once."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlink.operators import resolve as rs

SCHEMA = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"
QUERIES = ["join_unmatched", "join_unmatched_sources", "set_merged", "prj_merged_view", "join_semi_matched", "prj_merge", "resolve", "resolve_sources", "udf_prep_paths"]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Keys are shifted by a multiple of 640, so that the copies lie in the same places."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"COPY (SELECT p.* REPLACE (p_partkey + k * 1280 AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet' p, range(8) t(k)) TO '{folder}/part.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_copies_equal_sql(spark, copies, tmp_path, name):
    got = entry.queries()[name](spark, copies)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    got.write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS FROM '{copies}/part.parquet'")
    con.sql(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    con.sql(f"CREATE VIEW got AS SELECT {', '.join(got.columns)} FROM '{tmp_path}/got/*.parquet'")
    assert con.sql("SELECT count(*) FROM want").fetchall() != [(0,)]
    assert con.sql("FROM want EXCEPT ALL FROM got").fetchall() == con.sql("FROM got EXCEPT ALL FROM want").fetchall() == []


def _counted(spark):
    """A score of equal names, and the number of comparisons it made."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(a, b):
        calls.add(len(a))
        return (a == b).astype("float64")

    return score, calls


def _alike(spark, side, n):
    return spark.range(n).selectExpr(f"'{side}' side", f"'{side}' source", "id ordinal", "'a' name", "0.5D latitude", "0.5D longitude", "map('k', cast(id as string)) fields").select(*(c.split()[0] for c in SCHEMA.split(", ")))


def test_alike_records_are_compared_once(spark):
    score, calls = _counted(spark)
    left, right = _alike(spark, "left", 200), _alike(spark, "right", 200)
    links = rs.best_links(left, right, rs.Scorer("copies-test", lambda name: name, score), 0.5).collect()
    least = min((r["record_id"], r["ordinal"]) for r in rs.with_identity(right).collect())[1]
    assert sorted((r["l_ordinal"], r["r_ordinal"]) for r in links) == [(i, least) for i in range(200)]
    assert 1 <= calls.value <= 2  # not 40,000


@pytest.mark.parametrize("group", [1024, 7])
def test_names_are_compared_once_for_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(rs, "GROUP", group)
    score, calls = _counted(spark)
    left, right = _alike(spark, "left", 60), _alike(spark, "right", 50).withColumn("name", F.when(F.col("ordinal") > 9, "a"))
    rows = rs.candidate_scores(left, right, score).select("l.ordinal", F.col("r.ordinal").alias("other"), "score").collect()
    assert sorted(map(tuple, rows)) == [(i, j, float(j > 9)) for i in range(60) for j in range(50)]
    assert calls.value <= (2 if group == 1024 else 9 * (6 + 2))  # not 3,000
