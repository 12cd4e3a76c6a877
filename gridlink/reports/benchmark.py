"""The benchmark: every arm's accuracy over the published pairs, computed by Spark, and its costs, measured in processes
of its own, as one run record. An arm that can't be had stays in the record with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.operators import embedding
from gridlink.operators import evaluation as ev
from gridlink.operators import resolve as rs
from gridlink.reports import environment, measure, record
from gridlink.sources import artifacts, corpus, published

# Arms in order, which arm was expected to win which family, sizes of the preparation sample's buckets.
CLASSICAL, NEURAL = ("overlap", "fuzzy"), ("embed-fp32", "embed-int8")
ARMS = CLASSICAL + NEURAL
EXPECTED = {
    "exact": "overlap",
    "formatting": "overlap",
    "word order": "overlap",
    "abbreviation": "overlap",
    "character noise": "fuzzy",
    "semantic alias": "overlap",
    "transliteration": "fuzzy",
    "near-miss negative": "embed-fp32",
}
GROUPS = (1, 2, 3, 4)
DERIVATION = "micro-average: counts of all families pooled, then precision, recall and F1 of the sums"


def evaluation_set(pairs: DataFrame) -> dict[str, Any]:
    """Seeds and pairs for each family; a pair without a category is an error."""
    ev.evaluable(pairs)
    mixture = {r["category"]: r["n"] for r in pairs.groupBy("category").agg(F.count("*").alias("n")).collect()}
    return {"seeds": sorted(r["seed"] for r in pairs.select("seed").distinct().collect()), "case_mixture": mixture}


def _rows(families: DataFrame, order: Sequence[str]) -> list[dict[str, Any]]:
    """A row for each family, few."""
    found = {r["family"]: r for r in families.collect()}
    return [{"family": f, **{m: found[f][m].asDict() for m in ev.METRICS}, "true_positives": found[f]["tp"], "predicted_positives": found[f]["pp"], "actual_positives": found[f]["ap"], "false_positives": found[f]["false_positives"]} for f in order if f in found]


def report(families: DataFrame, order: Sequence[str]) -> dict[str, Any]:
    total = ev.aggregate(families).first()
    return {"per_family": _rows(families, order), "aggregate": {m: total[m].asDict() for m in ev.METRICS} | {"derivation": DERIVATION}, "n_pairs": total["n"]}


def accuracy(pairs: DataFrame, scorer: rs.Scorer, frozen: ev.FrozenThreshold) -> dict[str, Any] | ev.InvalidRun:
    found = ev.evaluate_sealed_with_variation(pairs, scorer, frozen)
    if isinstance(found, ev.InvalidRun):
        return found
    order = list(corpus.FAMILIES)
    seeds = [r["seed"] for r in found["by_seed"].select("seed").distinct().orderBy("seed").collect()]
    deviations = {r["family"]: r for r in found["variation"].collect()}
    return record.ok(
        pooled=report(found["pooled"], order),
        by_seed={s: report(found["by_seed"].where(F.col("seed") == s), order) for s in seeds},
        variation=[{"family": f, **{m: deviations[f][f"{m}_stdev"].asDict() for m in ev.METRICS}} for f in order if f in deviations],
    )


def preparation_sample(spark: SparkSession, pairs: DataFrame) -> dict[str, Any]:
    """The first pairs, by id, put into grid cells of 1, 2, 3 and 4 records; every left name meets its cell's right ones."""
    need = sum(GROUPS)
    first = pairs.select("pair_id", "left_name", "right_name").orderBy("pair_id").limit(need).collect()
    if len(first) < need:
        raise ValueError(f"the preparation sample needs {need} pairs, not {len(first)}")
    cell = [float(g) for g, size in enumerate(GROUPS) for _ in range(size)]
    schema = "side string, source string, ordinal long, name string, latitude double, longitude double, fields map<string,string>"
    sides = [spark.createDataFrame([(side, "sample", i, r[name], cell[i], cell[i], {}) for i, r in enumerate(first)], schema) for side, name in (("left", "left_name"), ("right", "right_name"))]
    met = rs.candidate_pairs(*sides).select(F.col("l.ordinal").alias("a"), F.col("r.ordinal").alias("b")).orderBy("a", "b").collect()
    counts = sorted(r["n"] for r in rs.bucket_occupancy(sides[1]).collect())
    return {"lefts": [r["left_name"] for r in first], "rights": [r["right_name"] for r in first], "pairs": [(r["a"], r["b"]) for r in met], "occupancy": {"counts": counts, "cell_size_degrees": rs.CELL_SIZE, "max_occupancy": max(counts)}}


def preparation_paths(spark: SparkSession, scorer: rs.Scorer, left: str, right: str) -> dict[str, Any]:
    """One pair scored with names prepared before the join and within it; the scores are the same."""
    row = spark.createDataFrame([(left, right)], "l string, r string")
    before = row.select(scorer.prepare(F.col("l")).alias("l"), scorer.prepare(F.col("r")).alias("r")).select(scorer.score(F.col("l"), F.col("r")))
    within = row.select(scorer.score(scorer.prepare(F.col("l")), scorer.prepare(F.col("r"))))
    return record.ok(hoisted={"path": "hoisted", "scores": [before.first()[0]]}, naive={"path": "naive", "scores": [within.first()[0]]})


def measure_arm(spark: SparkSession, arm: str, pairs: DataFrame, sample: dict[str, Any], power: str, warmups: int, repetitions: int) -> tuple[dict[str, Any], ev.SelectedThreshold | None]:
    try:
        scorer = rs.get_scorer(arm)
    except (ValueError, rs.ScorerUnavailable) as e:
        figures = ("warm_latency", "peak_memory", "cold_start", "artifact_size", "preparation", "preparation_cost")
        return {"accuracy": ev.InvalidRun(str(e)), **{f: record.Unavailable(arm, str(e)) for f in figures}}, None
    selected = ev.choose_threshold(pairs, scorer)
    left, right = sample["lefts"][0], sample["rights"][0]
    files = [a.path for a in embedding.artifacts(arm.removeprefix("embed-"))] if arm in NEURAL else []
    return {
        "accuracy": accuracy(pairs, scorer, ev.freeze(selected)),
        "warm_latency": measure.warm_latency(arm, left, right, warmups, repetitions),
        "peak_memory": measure.peak_memory(arm, left, right, power),
        "cold_start": measure.cold_start(arm, left, right),
        "artifact_size": measure.artifact_size(files),
        "preparation": preparation_paths(spark, scorer, left, right),
        "preparation_cost": measure.preparation_cost(arm, sample["lefts"], sample["rights"], sample["pairs"], warmups, repetitions),
    }, selected


def _families(result: dict[str, Any]) -> dict[str, dict] | None:
    own = result["accuracy"]
    return {r["family"]: r for r in own["pooled"]["per_family"]} if isinstance(own, dict) and own["status"] == "ok" else None


def contradictions(spark: SparkSession, results: dict[str, dict], expected: dict[str, str] = EXPECTED) -> list[dict[str, Any]]:
    rows = [(arm, f, r["f1"]["value"]) for arm, result in results.items() for f, r in (_families(result) or {}).items()]
    found = ev.contradictions(spark.createDataFrame(list(expected.items()), "family string, expected string"), spark.createDataFrame(rows, "arm string, family string, f1 double"))
    by_family = {r["family"]: r for r in found.collect()}
    return [{"family": f, "expected_winner": expected[f], "actual_winners": list(by_family[f]["actual_winners"])} for f in expected if f in by_family]


def divergence(spark: SparkSession, results: dict[str, dict], baseline: str = NEURAL[0], candidate: str = NEURAL[1]) -> record.Maybe:
    """F1 of the quantized arm less that of the other, by family."""
    sides = []
    for arm in (baseline, candidate):
        own = _families(results[arm]) if arm in results else None
        if own is None:
            return record.Maybe(None, f"{arm!r} did not produce a comparable accuracy report in this run")
        kind = "family string, " + ", ".join(f"{m} struct<value: double, undefined_reason: string>" for m in ev.METRICS)
        sides.append(spark.createDataFrame([(f, *((r[m]["value"], r[m]["undefined_reason"]) for m in ev.METRICS)) for f, r in own.items()], kind))
    return record.Maybe([{"family": r["family"], "delta_f1": r["f1_delta"].asDict()} for r in ev.divergence(*sides).orderBy("family").collect()], None)


def asymmetry(results: dict[str, dict], occupancy: dict[str, Any]) -> dict[str, Any]:
    """Speed-up by preparing names once, of each group's arms that were measured."""
    costs = {arm: r["preparation_cost"] for arm, r in results.items() if isinstance(r["preparation_cost"], dict)}
    groups = {"classical": CLASSICAL, "neural": NEURAL}
    return {"occupancy": occupancy, **{f"{name}_speedups": {a: measure.speedup(c) for a, c in costs.items() if a in arms} for name, arms in groups.items()}}


def run(spark: SparkSession, started_at: datetime, arms: Sequence[str] = ARMS, pairs: DataFrame | None = None, warmups: int = 5, repetitions: int = 20) -> dict[str, Any]:
    pairs = (published.generate(spark) if pairs is None else pairs).persist()
    power, sample = environment.power_mode(), preparation_sample(spark, pairs)
    assembly, results, selected = record.Assembly(EXPECTED), {}, []
    for arm in arms:
        results[arm], threshold = measure_arm(spark, arm, pairs, sample, power, warmups, repetitions)
        assembly.add(arm, results[arm])
        selected += [threshold] if threshold else []
    loaded = {t.scorer_name: embedding.model_identity(t.scorer_name.removeprefix("embed-")) for t in selected if t.scorer_name in NEURAL}
    census = None
    if NEURAL[1] in loaded:
        graph = artifacts.operator_counts(spark, str(embedding.artifacts("int8")[0].path))
        census = {name: {"converted_count": c, "fp32_count": n, "int8_count_remaining": left} for name, (c, n, left) in embedding.verify_quantized(graph).items()}
    out = assembly.build(
        started_at,
        ("gridlink", "benchmark"),
        environment=environment.describe(loaded, census, power, warmups, repetitions),
        evaluation_set=evaluation_set(pairs),
        selected_thresholds=selected,
        contradictions=contradictions(spark, results),
        int8_accuracy_divergence=divergence(spark, results),
        preparation_asymmetry=asymmetry(results, sample["occupancy"]),
    )
    pairs.unpersist()
    return out
