"""Embedding scorers with a stand-in encoder, model files, and the scorer registry."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlink.operators import embedding
from gridlink.operators import resolve as rs
from gridlink.plans.records import LetterEncoder
from gridlink.sources import artifacts


def test_pool_equals_a_loop():
    rng = np.random.default_rng(1)
    tokens, mask = rng.normal(size=(5, 4, 3)), rng.integers(0, 2, (5, 4))
    mask[:, 0] = 1
    got = embedding.pool(tokens, mask)
    for t, m, v in zip(tokens, mask, got, strict=True):
        mean = np.mean([x for x, k in zip(t, m, strict=True) if k], axis=0)
        assert np.allclose(v, mean / np.linalg.norm(mean))
    assert (embedding.pool(np.zeros((1, 2, 3)), np.ones((1, 2))) == 0).all()
    with pytest.raises(ValueError, match="selects no tokens"):
        embedding.pool(tokens, mask * 0)


class Counting(LetterEncoder):
    def encode(self, texts):
        assert len(set(texts)) == len(texts) and all(t.strip() for t in texts)
        return super().encode(texts)


def test_distinct_names_are_encoded_once_and_blank_ones_never(spark):
    names = ["an oak", "an oak", None, "  ", "elm"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").coalesce(1)
    rows = {r["i"]: r for r in embedding.embed_distinct(df, Counting()).collect()}
    assert rows[0]["prepared"] == rows[1]["prepared"] and rows[2]["prepared"] is None and rows[3]["prepared"] is None
    direct = {r["i"]: r["v"] for r in df.select("i", embedding.embedder(Counting())(F.col("name")).alias("v")).collect()}
    assert all(direct[i] == rows[i]["prepared"] for i in rows)
    scorer = embedding.scorer("letters", Counting())
    both = df.crossJoin(df.select(F.col("name").alias("other")))  # five by five names
    scores = both.select("name", "other", scorer.score(scorer.prepare(F.col("name")), scorer.prepare(F.col("other"))).alias("s")).collect()
    for r in scores:
        given = all(x and x.strip() for x in (r["name"], r["other"]))
        assert (0 < r["s"] <= 1) if given else r["s"] == 0.0
        assert not (given and r["name"] == r["other"]) or r["s"] == pytest.approx(1.0)


def test_a_registered_scorer_resolves(spark):
    scorer = embedding.scorer("letters-test", LetterEncoder())
    rs.register(scorer)
    try:
        with pytest.raises(ValueError, match="registered already"):
            rs.register(scorer)
        schema = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"
        left = spark.createDataFrame([("left", "s", 0, "tall oak", 0.0, 0.0, {})], schema)
        right = spark.createDataFrame([("right", "s", 0, "tall elm", 0.0, 0.0, {}), ("right", "s", 1, "a", 0.0, 0.0, {})], schema)
        assert rs.resolve(left, right, rs.get_scorer("letters-test"), 0.9).pairs.first()["r"]["ordinal"] == 0
    finally:
        del rs.SCORERS["letters-test"]


def test_unavailable_scorers_say_why(monkeypatch, tmp_path):
    monkeypatch.delenv(embedding.FOLDER_SETTING, raising=False)
    with pytest.raises(rs.ScorerUnavailable, match="embed-fp32.*is not set"):
        rs.get_scorer("embed-fp32")
    with pytest.raises(ValueError, match="known: embed-fp32, embed-int8, fuzzy, overlap"):
        rs.get_scorer("none")
    monkeypatch.setenv(embedding.FOLDER_SETTING, str(tmp_path))
    assert embedding.probe("int8") == f"artifact missing at {tmp_path}/int8/model.onnx"
    (tmp_path / "int8").mkdir()
    (tmp_path / "int8" / "model.onnx").write_bytes(b"x")
    assert "checksum mismatch" in embedding.probe("int8") and hashlib.sha256(b"x").hexdigest() in embedding.probe("int8")


def _field(number, data):
    out, n = bytes([number << 3 | 2]), len(data)
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + data


def _graph(ops):
    nodes = b"".join(_field(1, _field(1, b"in") + _field(4, op.encode()) + _field(3, b"name" * 50)) for op in ops)
    return b"\x08\x07" + _field(2, b"maker") + _field(7, nodes + _field(2, b"graph"))


def test_operator_counts(spark, tmp_path):
    ops = ["MatMulInteger"] * 36 + ["MatMul"] * 12 + ["DynamicQuantizeLinear"] * 5 + ["Add"]
    (tmp_path / "model.onnx").write_bytes(_graph(ops))
    counts = artifacts.operator_counts(spark, f"{tmp_path}/model.onnx")
    assert {r["op_type"]: r["n"] for r in counts.collect()} == {"MatMulInteger": 36, "MatMul": 12, "DynamicQuantizeLinear": 5, "Add": 1}
    assert embedding.verify_quantized(counts) == embedding.EXPECTED_CONVERSION
    with pytest.raises(embedding.OperatorMismatch, match="matrix operators"):
        embedding.verify_quantized(counts.withColumn("n", F.col("n") + 1))
    with pytest.raises(embedding.OperatorMismatch, match="quantized operators"):
        embedding.verify_quantized(counts.where("op_type <> 'DynamicQuantizeLinear'"))
    with pytest.raises(ValueError, match="beyond"):
        artifacts.operator_types(_graph(ops)[:-3])
    size = artifacts.digests(spark, f"{tmp_path}/model.onnx").first()
    assert size["size"] == len(_graph(ops)) and size["sha256"] == hashlib.sha256(_graph(ops)).hexdigest()
    assert artifacts.total_size(spark.createDataFrame([], "size long")).first()["undefined_reason"] == "classical arms carry no model artifact"


def test_fragments(tmp_path):
    path = artifacts.write_fragment(str(tmp_path / "x"), "step", {"b": 1, "a": [2]})
    assert path.read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n' and artifacts.read_fragment(str(tmp_path / "x"), "step") == {"a": [2], "b": 1}
