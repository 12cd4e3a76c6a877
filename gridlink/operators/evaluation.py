"""Measurement of scorers on labelled pairs: left_name, right_name, label, category, pair_id, role, seed, score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridlink.functions import formats, metrics
from gridlink.operators import ranks
from gridlink.operators.resolve import Scorer, matches

CALIBRATION, SEALED, DEVELOPMENT = "calibration", "sealed test", "development"
METRICS = ("precision", "recall", "f1")
# Names of metrics in reasons.
METRIC_NAMES = {"precision": "precision", "recall": "recall", "f1": "F1"}


@dataclass(frozen=True)
class SelectedThreshold:
    """A threshold, by which scorer's scores it was found, on which role's pairs, and how many."""

    scorer_name: str
    value: float
    procedure: str
    role: str
    n_pairs: int


@dataclass(frozen=True)
class FrozenThreshold:
    """A threshold that evaluation may use: it is chosen before, and nothing changes it."""

    selected: SelectedThreshold


@dataclass(frozen=True)
class InvalidRun:
    """An evaluation that was refused, and why."""

    reason: str


PROCEDURE = "sweep of all distinct scores: the lowest with the largest F1"


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    return pairs.withColumn("score", scorer.score(scorer.prepare(F.col("left_name")), scorer.prepare(F.col("right_name"))))


def counts(predicted: Column, label: Column) -> list[Column]:
    hit = predicted.cast("int")
    return [F.sum(hit * label).alias("tp"), F.sum(hit).alias("pp"), F.sum(label).alias("ap"), F.count("*").alias("n")]


def with_metrics(rows: DataFrame) -> DataFrame:
    """rows with tp, pp, ap: precision, recall and f1 as metrics, and the false positives."""
    p = metrics.ratio(F.col("tp"), F.col("pp"), metrics.NO_PREDICTED)
    r = metrics.ratio(F.col("tp"), F.col("ap"), metrics.NO_ACTUAL)
    rows = rows.withColumns({"precision": p, "recall": r, "false_positives": F.col("pp") - F.col("tp")})
    return rows.withColumn("f1", metrics.f1(F.col("precision"), F.col("recall")))


def per_family(scored: DataFrame, threshold: float | Column, by: tuple[str, ...] = ()) -> DataFrame:
    predicted = matches(F.col("score"), threshold) if isinstance(threshold, float) else F.col("score") >= threshold
    return with_metrics(scored.groupBy(*by, F.col("category").alias("family")).agg(*counts(predicted, F.col("label"))))


def aggregate(families: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pooled counts of all families, so a micro-average."""
    return with_metrics(families.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "pp", "ap", "n"))))


def threshold_sweep(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each distinct score as threshold the F1 it gives; no task sees all scores."""
    each = scored.groupBy(*by, "score").agg(F.sum("label").alias("tp"), F.count("*").alias("pp"))
    swept = ranks.running_totals(each, "score", ("tp", "pp"), by, down=True).select(*by, "score", "tp", "pp", F.col("total_tp").alias("ap"))
    p, r = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")), F.when(F.col("ap") > 0, F.col("tp") / F.col("ap"))
    return swept.withColumn("f1", metrics.f1_value(p, r))


def select_threshold(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The lowest of the scores with the best F1; the least score where no F1 is defined."""
    best = F.min(F.struct((-F.coalesce("f1", F.lit(-1.0))).alias("down"), "score", "f1")).alias("best")
    swept = threshold_sweep(scored, by).groupBy(*by).agg(best)
    return swept.where("best IS NOT NULL").select(*by, F.col("best.score").alias("threshold"), "best.f1")


def evaluable(pairs: DataFrame) -> DataFrame:
    """The pairs; an error where there are none, or where one has no category."""
    found = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("category").isNull()).alias("bare")).first()
    if not found["n"]:
        raise ValueError("evaluation needs at least one pair")
    if found["bare"]:
        raise ValueError(f"{found['bare']} pair(s) have no category; evaluation by family needs one")
    return pairs


def choose_threshold(corpus: DataFrame, scorer: Scorer) -> SelectedThreshold:
    """select_threshold() on the corpus's calibration pairs."""
    scored = score_pairs(corpus.where(F.col("role") == CALIBRATION), scorer)
    row = select_threshold(scored).first()
    if row is None:
        raise ValueError("the corpus has no calibration pairs to choose a threshold from")
    return SelectedThreshold(scorer.name, row["threshold"], PROCEDURE, CALIBRATION, scored.count())


def freeze(selected: SelectedThreshold) -> FrozenThreshold:
    return FrozenThreshold(selected)


def evaluate_sealed(corpus: DataFrame, scorer: Scorer, frozen: FrozenThreshold, by: tuple[str, ...] = ()) -> DataFrame | InvalidRun:
    """per_family() on the sealed test's pairs; refused where the threshold may have seen them."""
    if not isinstance(frozen, FrozenThreshold):
        raise TypeError("evaluation takes a frozen threshold")
    if (role := frozen.selected.role) != CALIBRATION:
        # Fixed value: the reason's text.
        return InvalidRun(f"threshold selection read role {role!r}, not 'calibration' — the sealed test is not scored with a threshold that may have seen it")
    sealed = evaluable(corpus.where(F.col("role") == SEALED))
    return per_family(score_pairs(sealed, scorer), frozen.selected.value, by)


def evaluate_sealed_with_variation(corpus: DataFrame, scorer: Scorer, frozen: FrozenThreshold) -> dict[str, DataFrame] | InvalidRun:
    """pooled and its aggregate, by_seed, and the variation over seeds, which must cover the pooled families."""
    pooled = evaluate_sealed(corpus, scorer, frozen)
    if isinstance(pooled, InvalidRun):
        return pooled
    by_seed = evaluate_sealed(corpus, scorer, frozen, ("seed",))
    require_equal_families(by_seed)
    return {"pooled": pooled, "aggregate": aggregate(pooled), "by_seed": by_seed, "variation": variation(by_seed)}


def family_gaps(families: DataFrame, by: str = "seed") -> DataFrame:
    """(by, family) for each family that some group has and this one lacks."""
    names, groups = families.select("family").distinct(), families.select(by).distinct()
    return groups.join(F.broadcast(names)).join(families.select(by, "family"), [by, "family"], "left_anti")  # names: a row a family


def require_equal_families(families: DataFrame, by: str = "seed") -> None:
    gaps = family_gaps(families, by).orderBy(by, "family").limit(20).collect()  # for the message
    if gaps:
        raise ValueError("reports don't cover the same families: " + "; ".join(f"{by} {r[by]} lacks {r['family']!r}" for r in gaps))


def variation(families: DataFrame) -> DataFrame:
    """families by seed: sample deviation of each metric over seeds, undefined, with a reason, for fewer than two defined values."""
    out = []
    for m in METRICS:
        value = F.col(f"{m}.value")
        reason = F.concat(F.lit("only "), F.count(value).cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(f" seed(s) produced a defined {METRIC_NAMES[m]} for this family"))
        out.append(metrics.metric(F.when(F.count(value) >= 2, F.stddev_samp(value)), reason).alias(f"{m}_stdev"))
    return families.groupBy("family").agg(*out, F.count_distinct("seed").alias("seeds"))


def divergence(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate minus baseline for each family of the baseline."""
    other = candidate.select("family", *(F.col(m).alias(f"c_{m}") for m in ("precision", "recall", "f1")))
    # Fixed value: the reason's text.
    missing = F.struct(F.lit(None).cast("double").alias("value"), F.concat(F.lit("'"), F.col("family"), F.lit("' was not reported by the candidate arm")).alias("undefined_reason"))
    both = baseline.join(other, "family", "left")
    return both.select("family", *(metrics.delta(F.coalesce(F.col(f"c_{m}"), missing), F.col(m)).alias(f"{m}_delta") for m in ("precision", "recall", "f1")))


def family_winners(known: DataFrame) -> DataFrame:
    """known (arm, family, f1, never null): family, its best F1, all arms that have it, and how many arms there are."""
    top = known.groupBy("family").agg(F.max("f1").alias("top"), F.count("*").alias("arms"))
    return known.join(top, "family").where("f1 = top").groupBy("family").agg(F.first("top").alias("top"), F.array_sort(F.collect_set("arm")).alias("winners"), F.first("arms").alias("arms"))


def contradictions(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected (family, expected); results (arm, family, f1): families in which the expected arm is below the best of two or more."""
    known = results.where("f1 IS NOT NULL")
    own = known.select("family", F.col("arm").alias("expected"), "f1")
    both = expected.join(own, ["family", "expected"]).join(family_winners(known).where("arms > 1"), "family")
    return both.where("f1 < top").select("family", "expected", F.col("winners").alias("actual_winners"))


def _reason(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def constraint_reasons(min_f1: float | None, max_rss: float | None, max_p50: float | None, max_fp: int | None, columns: list[str]) -> Column:
    """Why an arm is no candidate: the first that holds, in this order. Its figures are in the text. Columns that say
    whether a figure is there (<figure>_status, <figure>_reason, f1_reason, reported) are read where points have them."""
    f1, rss, p50, fp = (F.col(c) for c in ("f1", "rss", "p50", "fp"))
    family = F.concat(F.lit("'"), F.col("family"), F.lit("'"))
    why = []

    def failed(figure: str, name: str) -> None:
        if f"{figure}_status" in columns:
            status = F.col(f"{figure}_status")
            why.append(F.when(status != "ok", _reason(f"{name} is ", status, " — ", F.coalesce(F.col(f"{figure}_reason"), F.lit("")))))

    # The reasons' texts.
    failed("accuracy", "accuracy")
    if "reported" in columns:
        why.append(F.when(~F.col("reported"), _reason(family, " was not reported in this arm's accuracy")))
    failed("memory", "peak memory")
    failed("latency", "warm latency")
    if min_f1 is not None:
        undefined = F.col("f1_reason") if "f1_reason" in columns else F.lit("no value")
        why.append(F.when(f1.isNull(), _reason("F1 is undefined for ", family, ": ", undefined, " — cannot be compared against the stated accuracy floor")))
        why.append(F.when(f1 < min_f1, _reason("F1 ", formats.fixed(f1, 3), f" is below the stated floor {min_f1:.3f}")))
    if max_rss is not None:
        why.append(F.when(rss > max_rss, _reason("peak RSS ", formats.fixed(rss, 0), f" bytes exceeds the stated ceiling {max_rss:.0f} bytes")))
    if max_p50 is not None:
        why.append(F.when(p50 > max_p50, _reason("warm p50 ", formats.fixed(p50, 9), f"s exceeds the stated ceiling {max_p50:.9f}s")))
    if max_fp is not None:
        why.append(F.when(fp > max_fp, _reason("false positives ", fp.cast("long").cast("string"), f" exceeds the stated ceiling {int(max_fp)}")))
    return F.coalesce(*why) if why else F.lit(None).cast("string")


def frontier(points: DataFrame, min_f1: float | None = None, max_rss: float | None = None, max_p50: float | None = None, max_fp: int | None = None) -> DataFrame:
    """points (family, position, arm, f1, fp, rss in bytes, p50 in seconds): each with status on the frontier, excluded, or
    dominated, and why. Undefined f1 is excluded only where a floor is stated; the first dominator in order is named."""
    points = points.withColumn("excluded_reason", constraint_reasons(min_f1, max_rss, max_p50, max_fp, points.columns))
    live = points.where("excluded_reason IS NULL").withColumn("all_f1", F.count_if(F.col("f1").isNull()).over(W.partitionBy("family")) == 0)
    a, b = live.alias("a"), live.alias("b")
    # where any arm's F1 is undefined, F1 is no axis of that family
    f1 = [F.when(F.col("a.all_f1"), F.col(f"{x}.f1")).otherwise(0.0) for x in "ab"]
    least = [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in ("fp", "rss", "p50")]
    less = [F.col(f"b.{c}") < F.col(f"a.{c}") for c in ("fp", "rss", "p50")]
    better = reduce(Column.__and__, least, f1[1] >= f1[0]) & reduce(Column.__or__, less, f1[1] > f1[0])
    text = _reason("dominated by '", F.col("b.arm"), "' (", formats.point_text(F.when(F.col("a.all_f1"), F.col("b.f1")), F.col("b.fp"), F.col("b.rss"), F.col("b.p50")), ")")
    first = F.min(F.struct(F.col("b.position"), F.col("b.arm").alias("arm"), text.alias("text"))).alias("first")
    beaten = a.join(b, (F.col("a.family") == F.col("b.family")) & better).groupBy("a.family", "a.arm").agg(first)
    beaten = beaten.select("family", "arm", F.col("first.arm").alias("dominated_by"), F.col("first.text").alias("dominated_reason"))
    out = points.join(beaten, ["family", "arm"], "left")
    status = F.when(F.col("excluded_reason").isNotNull(), "excluded").when(F.col("dominated_by").isNotNull(), "dominated").otherwise("frontier")
    return out.withColumn("status", status).withColumn("reason", F.coalesce("excluded_reason", "dominated_reason"))


def without_candidates(rows: DataFrame) -> DataFrame:
    """Of frontier()'s rows: families in which no arm qualifies, and every arm's reason in order."""
    each = F.struct("position", F.concat(F.col("arm"), F.lit(" ("), F.col("reason"), F.lit(")")).alias("text"))
    found = rows.groupBy("family").agg(F.count_if(F.col("status") == "frontier").alias("n"), F.array_sort(F.collect_list(each)).alias("all"))  # a row an arm
    return found.where("n = 0").select("family", F.array_join(F.transform("all", lambda x: x["text"]), "; ").alias("reason"))
