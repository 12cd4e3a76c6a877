"""Thresholds, refusals, variation, frontier reasons, running totals."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridlink.functions import formats
from gridlink.operators import evaluation as ev
from gridlink.operators import ranks
from gridlink.operators import resolve as rs

PAIRS = "left_name string, right_name string, label int, category string, role string, seed int"


def _pairs(spark, n=200):
    rng = random.Random(1)
    words = "amber birch cedar dune ember fern".split()
    rows = []
    for i in range(n):
        a, b = " ".join(rng.sample(words, 2)), " ".join(rng.sample(words, 2))
        rows.append((a, b, int(bool(set(a.split()) & set(b.split())) and rng.random() < 0.8), rng.choice(["x", "y"]), rng.choice([ev.CALIBRATION, ev.SEALED, ev.DEVELOPMENT]), i % 3))
    return spark.createDataFrame(rows, PAIRS), rows


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), round(rng.choice([rng.random(), rng.uniform(-1e6, 1e6)]), 3)) for _ in range(500)]
    rows = list({r: (*r, rng.randint(0, 5)) for r in rows}.values())
    df = spark.createDataFrame(rows, "g string, v double, n long")
    for down in (False, True):
        got = {(r["g"], r["v"]): (r["n"], r["total_n"]) for r in ranks.running_totals(df, "v", ("n",), ("g",), down).collect()}
        for g, v, _ in rows:
            own = [(x, n) for h, x, n in rows if h == g]
            assert got[(g, v)] == (sum(n for x, n in own if (x >= v if down else x <= v)), sum(n for _, n in own))
    assert ranks.running_totals(df.limit(0), "v", ("n",)).count() == 0


def test_order_statistics(spark):
    rng = random.Random(3)
    values = [("a", round(rng.expovariate(0.01), 2)) for _ in range(301)] + [("b", 5.0)] * 4 + [("c", None)]
    places = {"median": (F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)), "p90": (F.least(F.col("n") - 1, F.floor(0.9 * F.col("n"))),)}
    got = {r["k"]: r for r in ranks.order_statistics(spark.createDataFrame(values, "k string, v double"), "v", ("k",), places).collect()}
    own = sorted(v for k, v in values if k == "a")
    assert got["a"]["median"] == statistics.median(own) and got["a"]["p90"] == own[min(300, int(0.9 * 301))] and got["a"]["n"] == 301
    assert got["b"]["median"] == 5.0 and set(got) == {"a", "b"}


def test_threshold_equals_an_exhaustive_search(spark):
    pairs, rows = _pairs(spark)
    scored = ev.score_pairs(pairs.where(F.col("role") == ev.CALIBRATION), rs.get_scorer("fuzzy"))
    own = [(r["score"], r["label"]) for r in scored.collect()]

    def f1(t):
        tp, pp, ap = sum(y for s, y in own if s >= t), sum(s >= t for s, _ in own), sum(y for _, y in own)
        p, r = tp / pp, tp / ap
        return 2 * p * r / (p + r) if p + r else -1.0

    best = max(sorted({s for s, _ in own}), key=lambda t: (f1(t), -t))
    assert ev.select_threshold(scored).first()["threshold"] == best
    chosen = ev.choose_threshold(pairs, rs.get_scorer("fuzzy"))
    assert chosen.value == best and chosen.n_pairs == len(own) and chosen.role == ev.CALIBRATION
    assert ev.select_threshold(scored.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no calibration pairs"):
        ev.choose_threshold(pairs.where(F.col("role") == ev.SEALED), rs.get_scorer("fuzzy"))


def test_refusals(spark):
    pairs, _ = _pairs(spark)
    scorer = rs.get_scorer("overlap")
    wrong = ev.freeze(ev.SelectedThreshold("overlap", 0.5, ev.PROCEDURE, ev.SEALED, 3))
    refused = ev.evaluate_sealed(pairs, scorer, wrong)
    assert isinstance(refused, ev.InvalidRun) and refused.reason.startswith("threshold selection read role 'sealed test', not 'calibration'")
    assert ev.evaluate_sealed_with_variation(pairs, scorer, wrong) == refused
    with pytest.raises(TypeError):
        ev.evaluate_sealed(pairs, scorer, wrong.selected)
    good = ev.freeze(ev.SelectedThreshold("overlap", 0.5, ev.PROCEDURE, ev.CALIBRATION, 3))
    with pytest.raises(ValueError, match="at least one pair"):
        ev.evaluate_sealed(pairs.where("seed > 9"), scorer, good)
    with pytest.raises(ValueError, match="no category"):
        ev.evaluate_sealed(pairs.withColumn("category", F.when(F.col("seed") > 0, F.col("category"))), scorer, good)
    with pytest.raises(ValueError, match="seed 1 lacks 'y'"):
        ev.evaluate_sealed_with_variation(pairs.where("NOT (seed = 1 AND category = 'y')"), scorer, good)


def test_variation_states_why_it_is_undefined(spark):
    pairs, rows = _pairs(spark)
    rows = [r for r in rows if r[3] == "x"] + [("a", "b", 0, "y", ev.SEALED, s) for s in range(3)]
    got = ev.evaluate_sealed_with_variation(spark.createDataFrame(rows, PAIRS), rs.get_scorer("overlap"), ev.freeze(ev.SelectedThreshold("overlap", 0.5, "", ev.CALIBRATION, 1)))
    spread = {r["family"]: r for r in got["variation"].collect()}
    assert spread["y"]["f1_stdev"]["undefined_reason"] == "only 0 of 3 seed(s) produced a defined F1 for this family"
    seeds = [r["precision"]["value"] for r in got["by_seed"].where("family = 'x'").collect()]
    assert spread["x"]["precision_stdev"]["value"] == pytest.approx(statistics.stdev(seeds))
    assert got["aggregate"].first()["n"] == got["pooled"].agg(F.sum("n")).first()[0]


def test_frontier_reasons(spark):
    kinds = "family string, position int, arm string, f1 double, fp long, rss double, p50 double, accuracy_status string, accuracy_reason string, reported boolean, memory_status string, memory_reason string"
    rows = [("f", 0, "a", 0.9, 1, 2e7, 1e-6, "ok", None, True, "ok", None), ("f", 1, "b", 0.8, 1, 3e7, 2e-6, "ok", None, True, "ok", None), ("f", 2, "c", None, 0, 1e6, 1e-7, "invalid", "broken", True, "ok", None), ("f", 3, "d", 0.9, 1, None, 1e-6, "ok", None, True, "unavailable", "gone"), ("f", 4, "e", None, None, 1e6, 1e-7, "ok", None, False, "ok", None), ("g", 0, "a", 0.5, 9, 2e7, 1e-6, "ok", None, True, "ok", None), ("g", 1, "b", 0.4, 9, 2e7, 1e-6, "ok", None, True, "ok", None)]
    points = spark.createDataFrame(rows, kinds)
    got = {(r["family"], r["arm"]): (r["status"], r["reason"]) for r in ev.frontier(points).collect()}
    assert got[("f", "a")] == ("frontier", None)
    assert got[("f", "b")] == ("dominated", "dominated by 'a' (f1=0.900, false_positives=1, peak RSS=20.0 MB, warm p50=1.00µs)")
    assert got[("f", "c")] == ("excluded", "accuracy is invalid — broken")
    assert got[("f", "d")] == ("excluded", "peak memory is unavailable — gone")
    assert got[("f", "e")] == ("excluded", "'f' was not reported in this arm's accuracy")
    none = ev.without_candidates(ev.frontier(points, min_f1=0.6)).collect()
    assert [(r["family"], r["reason"]) for r in none] == [("g", "a (F1 0.500 is below the stated floor 0.600); b (F1 0.400 is below the stated floor 0.600)")]


def test_fixed_equals_pythons_formatting(spark):
    rng = random.Random(5)
    values = [0.125, 2.5, 3.5, 0.35, 1.005, 405.85, 43.645, 0.0, 1e15, 1e18, 0.04, -1.25, -0.3, 1234567.89, 2.675] + [round(rng.uniform(0, 1000), rng.randint(0, 6)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for digits in (0, 1, 2, 3, 9):
        got = {r["v"]: r["t"] for r in df.withColumn("t", formats.fixed(F.col("v"), digits)).collect()}
        assert got.pop(None) is None
        assert {v: t for v, t in got.items() if t != f"{v:.{digits}f}"} == {}


def test_format_facts(spark):
    df = spark.createDataFrame([("Linux", 5), ("DARWIN", 5)], "p string, n long")
    assert [r[0] for r in df.select(formats.peak_bytes(F.col("n"), F.col("p"))).collect()] == [5120, 5]
    with pytest.raises(Exception, match="no known unit"):
        df.select(formats.peak_bytes(F.col("n"), F.lit("beos"))).collect()
    row = spark.sql("SELECT timestamp '2026-08-12 20:17:52+02:00' AS t")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert row.select(formats.record_name(F.col("t"))).first()[0] == "20260812T181752Z-benchmark.json"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
