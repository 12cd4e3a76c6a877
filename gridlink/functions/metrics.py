"""Figures that may be undefined: a value or a reason, never zero for either."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reasons that figures state.
NO_PREDICTED, NO_ACTUAL = "no predicted positives", "no actual positives"
BOTH_ZERO = "precision and recall are both zero"


def metric(value: Column, reason: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), F.when(value.isNull(), reason).alias("undefined_reason"))


def ratio(n: Column, d: Column, reason: str) -> Column:
    return metric(F.when(d != 0, n / d), F.lit(reason))


def f1_value(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def f1(p: Column, r: Column) -> Column:
    """p, r: metrics."""
    reason = F.when(p["value"].isNull(), F.concat(F.lit("precision is undefined: "), p["undefined_reason"])).when(r["value"].isNull(), F.concat(F.lit("recall is undefined: "), r["undefined_reason"])).otherwise(BOTH_ZERO)
    return metric(f1_value(p["value"], r["value"]), reason)


def delta(candidate: Column, baseline: Column) -> Column:
    # The reasons' texts.
    reason = F.when(baseline["value"].isNull(), F.concat(F.lit("baseline F1 is undefined: "), baseline["undefined_reason"])).otherwise(F.concat(F.lit("candidate F1 is undefined: "), candidate["undefined_reason"]))
    return metric(candidate["value"] - baseline["value"], reason)
