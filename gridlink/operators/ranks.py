"""Running totals and order statistics over values that no single task has to hold.

Values are dealt to buckets that keep their order; totals of the buckets, a bounded number of rows for each group, shift
the running totals within them. Equal values must have been aggregated to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Buckets for each unit of asinh(value): so many rows for values below one, a logarithmic number beyond.
SCALE = 1024


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    return F.floor(F.asinh(value.cast("double")) * SCALE)


def running_totals(rows: DataFrame, value: str, sums: tuple[str, ...], by: tuple[str, ...] = (), down: bool = False) -> DataFrame:
    """rows with sums added up over each group's values up to the row's own (from the top if down), as columns of the
    same names, and the groups' totals as total_<name>."""
    rows = rows.withColumn("_bucket", bucket(F.col(value)))
    parts = rows.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    order = F.desc("_bucket") if down else F.asc("_bucket")
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)  # the buckets alone
    shifts = parts.select(*by, "_bucket", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums), *(F.sum(f"_{c}").over(W.partitionBy(*by)).alias(f"total_{c}") for c in sums))
    within = W.partitionBy(*by, "_bucket").orderBy(F.desc(value) if down else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    own = rows.withColumns({f"_own_{c}": F.sum(c).over(within) for c in sums})
    shifts = shifts.withColumnsRenamed({k: f"_by_{k}" for k in (*by, "_bucket")})
    same = F.col("_bucket") == F.col("_by__bucket")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    both = own.join(shifts, same)
    kept = [c for c in rows.columns if c not in sums and c != "_bucket"]
    return both.select(*kept, *((F.col(f"_own_{c}") + F.col(f"_{c}")).alias(c) for c in sums), *(f"total_{c}" for c in sums))


def order_statistics(rows: DataFrame, value: str, by: tuple[str, ...], places: dict[str, tuple[Column, ...]]) -> DataFrame:
    """For each group the mean of the values at the given places, from 0, of its sorted values; places are expressions
    over n, the group's number of values. Null values are left out."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(each.withColumn("many", F.col("n")), value, ("n",), by).withColumnsRenamed({"n": "upto", "total_n": "n"})
    at = {f"{name}_{k}": F.min(F.when(F.col("upto") > place, F.col(value))).alias(f"{name}_{k}") for name, some in places.items() for k, place in enumerate(some)}
    found = ranked.groupBy(*by).agg(F.max("n").alias("n"), *at.values())
    return found.select(*by, "n", *((sum(F.col(f"{name}_{k}") for k in range(len(some))) / len(some)).alias(name) for name, some in places.items()))
