"""Record and pair files, identities."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridlink.functions import identity, text
from gridlink.operators import resolve as rs
from gridlink.sources import jsonl, labelled

SCHEMA = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"


def test_ordinals_over_many_splits(spark, tmp_path):
    rng = random.Random(1)
    lines = [rng.choice(["", "  ", json.dumps({"name": f"n{i}" * rng.randint(1, 9), "fields": {"a": "b"}})]) for i in range(400)]
    (tmp_path / "set.jsonl").write_text("\n".join(lines))
    want = [(k, json.loads(x)["name"]) for k, x in enumerate(x for x in lines if x.strip())]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = jsonl.read_records(spark, str(tmp_path / "set.jsonl"))
            assert sorted((r["ordinal"], r["name"]) for r in got.collect()) == want and got.first()["source"] == "set"
            (tmp_path / "bad.jsonl").write_text("\n".join([*lines, "{}"]))
            with pytest.raises(jsonl.MalformedRecordError, match=r"bad\.jsonl:401: record has no 'name' field"):
                jsonl.read_records(spark, str(tmp_path / "bad.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "empty.jsonl").write_text("\n\n")
    assert jsonl.read_records(spark, str(tmp_path / "empty.jsonl")).count() == 0


def test_null_names_and_broken_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": null, "latitude": 1}\n')
    row = jsonl.read_records(spark, str(tmp_path / "a.jsonl")).first()
    assert row["name"] is None and row["latitude"] == 1.0 and row["fields"] == {}
    (tmp_path / "b.jsonl").write_text('{"name": "a"}\n{"name": \n')
    with pytest.raises(jsonl.MalformedRecordError, match=r"b\.jsonl:2: line is not a JSON record"):
        jsonl.read_records(spark, str(tmp_path / "b.jsonl"))


def test_canonical_form_is_pythons(spark):
    rng = random.Random(2)
    values = [0.0005, 12345678.0, 1e-05, -0.00012345, 1e16, 1.5e-7, -0.0, 0.001, 1e7, 123456789.125, 9007199254740993.0, None, 32.58] + [rng.uniform(-180, 180) * 10 ** rng.randint(-9, 3) for _ in range(300)]
    names = ["a", None, 'q"\\u000B', "x\x0b\x1f\n", "é\\\x1a", "/"]
    rows = [("left", "s", i, names[i % len(names)], v, values[-1 - i], {"z": "\x1c", "a": "\\\\\x0e"} if i % 2 else {}) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["ordinal"]: r for r in rs.with_identity(df).withColumn("canon", identity.canonical(F.col("fields"), F.col("latitude"), F.col("longitude"), F.col("name"))).collect()}
    for _, source, i, name, lat, lon, fields in rows:
        want = json.dumps({"name": name, "latitude": lat, "longitude": lon, "fields": fields}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if all(v is None or repr(v) == _java_shortest(spark, v) for v in (lat, lon)):
            assert got[i]["canon"] == want
            assert got[i]["record_id"] == hashlib.sha256(f"{source}\0{want}\0{i}".encode()).hexdigest()


_SHORTEST: dict = {}


def _java_shortest(spark, v):
    """Java's digits in Python's form: older runtimes don't always give the shortest digits."""
    if v not in _SHORTEST:
        _SHORTEST[v] = repr(float(spark._jvm.java.lang.Double.toString(v))) if repr(float(spark._jvm.java.lang.Double.toString(v))) == repr(v) and len(spark._jvm.java.lang.Double.toString(v)) <= len(repr(v)) + 6 else None
    return _SHORTEST[v]


def test_sources_of_one_side_may_share_ordinals(spark):
    rows = [("left", "a", 0, "oak", 0.0, 0.0, {}), ("left", "b", 0, "elm", 0.0, 0.0, {}), ("left", "c", 0, "fir", None, 0.0, {}), ("right", "a", 0, "oak", 0.0, 0.0, {}), ("right", "d", 0, "elm", 0.0, 0.0, {}), ("right", "e", 0, "ash", 0.0, 0.0, {})]
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", score string")
    got = rs.resolve(df.where("side = 'left'"), df.where("side = 'right'"), rs.get_scorer("overlap"), 0.5)
    assert sorted((r["l"]["source"], r["r"]["source"]) for r in got.pairs.collect()) == [("a", "a"), ("b", "d")]
    assert sorted((r["side"], r["source"], r["reason"]) for r in got.unmatched.collect()) == [("left", "c", rs.NO_COORDINATES), ("right", "e", rs.NOT_SELECTED)]
    assert got.merged.count() == 4
    plan = got.unmatched._jdf.queryExecution().executedPlan().toString()
    got.unmatched.collect()
    final = got.unmatched._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and final.count("ReusedExchange") >= 1  # the grid join runs once
    before = sorted(map(str, got.merged.collect()))
    assert sorted(map(str, got.keep().merged.collect())) == before
    got.close()


def test_distance_refuses_missing_coordinates(spark):
    df = spark.createDataFrame([(0.0, 0.0, None, 1.0)], "a double, b double, c double, d double")
    with pytest.raises(Exception, match="distance needs both coordinates"):
        df.select(identity.distance_km(*(F.col(c) for c in "abcd"))).collect()


def test_vectorised_scores_equal_the_plain_ones():
    rng = random.Random(3)
    names = ["", "a", "ab", "ba", "straße", "x" * 300] + [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(3000)]
    a, b = map(list, zip(*pairs, strict=True))
    assert text.jaro_winkler_many(a, b).tolist() == pytest.approx([text.jaro_winkler(x, y) for x, y in pairs], abs=1e-12)
    assert text.token_set_many(a, b).tolist() == pytest.approx([text.token_set_ratio(x, y) for x, y in pairs], abs=1e-12)


def test_labelled_pairs(spark, tmp_path):
    (tmp_path / "p.csv").write_text('left_name,right_name,label,category,pair_id,split\n"Acme, Ltd",Acme,1,x,p1,dev\nA,B,0,,p2,test\nC,D,1,y,,\n')
    got = sorted(tuple(r) for r in labelled.read_pairs(spark, str(tmp_path / "p.csv")).fillna("", ["category", "pair_id", "role"]).collect())
    assert got == [("A", "B", 0, "", "p2", "sealed test"), ("Acme, Ltd", "Acme", 1, "x", "p1", "development"), ("C", "D", 1, "y", "", "")]
    (tmp_path / "p.jsonl").write_text('{"left_name": "A", "right_name": "B", "label": 0}\n')
    assert labelled.read_pairs(spark, str(tmp_path / "p.jsonl")).first()["role"] is None
    for content, why in (("left_name,label\nA,1\n", "no field 'right_name'"), ("left_name,right_name,label\nA,B,2\n", "label is 2"), ("left_name,right_name,label\nA,,1\n", "right_name is missing"), ("left_name,right_name,label,split\nA,B,1,train\n", "unknown split train"), ("left_name,right_name,label,pair_id\nA,B,1,p\nC,D,1,p\n", "given twice")):
        (tmp_path / "bad.csv").write_text(content)
        with pytest.raises(labelled.MalformedPairError, match=why):
            labelled.read_pairs(spark, str(tmp_path / "bad.csv"))
    words = spark.createDataFrame([(r,) for r in labelled.ROLES.values()], "role string")
    assert [r[0] for r in words.select(labelled.split_word(F.col("role"))).collect()] == list(labelled.ROLES)
