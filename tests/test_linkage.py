"""Record linkage and evaluation: goldens and properties."""

import json

import pytest
from pyspark.sql import functions as F

from gridlink.functions import identity, text
from gridlink.operators import evaluation as ev
from gridlink.operators import resolve as rs
from gridlink.sources import jsonl

SCHEMA = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"


# The published example's records and result.
def test_golden_files(spark, tmp_path):
    left, right = tmp_path / "left.jsonl", tmp_path / "right.jsonl"
    left.write_text('{"name": "Northbridge Hardware", "latitude": 0.31, "longitude": 32.58, "fields": {"category": "hardware"}}\n\n{"name": "Meridian Foods", "latitude": 0.42, "longitude": 32.61}\n')
    right.write_text('{"name": "Northbridge Hardware Ltd", "latitude": 0.31, "longitude": 32.58, "fields": {"phone": "+000 000 000 000", "hours": "08:00-18:00"}}\n{"name": "Unrelated Traders"}\n')
    result = rs.resolve(jsonl.read_records(spark, str(left)), jsonl.read_records(spark, str(right), side="right"), rs.get_scorer("fuzzy"), 0.8)
    jsonl.write_resolution(result, str(tmp_path / "out.jsonl"))
    rows = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert rows[0] == {"fields": {"category": "hardware", "hours": "08:00-18:00", "phone": "+000 000 000 000"}, "latitude": 0.31, "longitude": 32.58, "name": "Northbridge Hardware Ltd", "sources": ["left", "right"], "status": "matched"}
    assert [(r["ordinal"], r["reason"]) for r in rows[1:]] == [(1, rs.NO_CANDIDATES), (1, rs.NO_COORDINATES)]


def test_malformed_lines(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"name": "a"}\n{"latitude": 1.0}\n')
    with pytest.raises(jsonl.MalformedRecordError, match=r"bad\.jsonl:2: record has no 'name' field"):
        jsonl.read_records(spark, str(bad))


def test_distances(spark):
    km = [identity.haversine_km(*map(F.lit, p)) for p in ((0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 15.0, 25.0))]
    row = spark.range(1).select(*(k.alias(str(i)) for i, k in enumerate(km))).first()
    assert row[0] == pytest.approx(111.195, abs=1e-3) and row[1] == pytest.approx(776.861, abs=1e-3)


def test_candidate_counts(spark):
    def line(side, n, step):
        return spark.createDataFrame([(side, side, i, "a", float(i * step), 0.0, {}) for i in range(n)], SCHEMA)

    assert rs.candidate_pairs(line("left", 9, 1), line("right", 9, 1), 1.0).count() == 25
    assert rs.candidate_pairs(line("left", 12, 0), line("right", 12, 0), 1.0).count() == 144


def test_casefold(spark):
    names = ["Straße", "ΟΔΟΣ", "ﬁx", "İ", "A_b-c", None, "x²"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.casefold(F.col("n"))).collect()] == [n and n.casefold() for n in names]


def test_fuzzy_pins():
    assert text.jaro_winkler("brightwatr", "brightwater") > 0.9 and text.jaro_winkler("meridian", "meirdian") > 0.9
    assert text.token_set_ratio("acme trading co", "trading co acme") == 1.0
    assert text.jaro_winkler("", "a") == 0.0


def test_no_record_is_dropped(spark):
    rows = [("left", "s", 0, "a b", 0.0, 0.0, {}), ("left", "s", 1, None, None, 1.0, {}), ("left", "s", 2, "q", 2.9, 2.9, {}), ("right", "s", 0, "a b", 0.0, 0.0, {"k": "v"}), ("right", "s", 1, "z", 0.001, 0.0, {}), ("right", "s", 2, "a", None, None, {})]
    df = spark.createDataFrame(rows, SCHEMA)
    r = rs.resolve(df.where("side = 'left'"), df.where("side = 'right'"), rs.get_scorer("overlap"), 0.5)
    assert r.pairs.count() == 1 and r.unmatched.count() == 4 and r.merged.count() == 5


def test_unknown_scorer():
    with pytest.raises(ValueError, match="unknown scorer"):
        rs.get_scorer("none")
    with pytest.raises(rs.ScorerUnavailable):
        rs.get_scorer("embed-fp32")


def test_undefined_is_not_zero(spark):
    rows = spark.createDataFrame([("f", 0, 0.1), ("f", 1, 0.2)], "category string, label int, score double")
    got = ev.per_family(rows, 0.5).first()
    assert got["precision"]["value"] is None and got["recall"]["value"] == 0.0 and got["f1"]["undefined_reason"].startswith("precision is undefined")


def test_lowest_of_equal_thresholds(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.7)], "label int, score double")
    assert ev.select_threshold(rows).first()["threshold"] == 0.8
