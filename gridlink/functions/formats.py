"""Texts of figures, run names, and facts about a machine, as column expressions.

Null inputs give null unless a reason is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a power source's status texts mean.
CHARGING = ("charging", "full")
UNRESOLVED_LICENSE = "unresolved-see-model-card"


def fixed(value: Column, digits: int) -> Column:
    """value with so many decimals, rounded by its exact binary value (ties to even), as C's printf does. The product
    with a power of ten is taken with its rounding error, so that what lies beside a decimal tie is told from it."""
    scale = float(10**digits)
    x = F.abs(value.cast("double"))
    p = x * scale
    # both factors in halves of 26 bits, whose products are exact
    upper = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    s_up = scale * 134217729.0 - (scale * 134217729.0 - scale)
    s_low, x_up = scale - s_up, upper(x)
    x_low = x - x_up
    error = ((x_up * s_up - p) + x_up * s_low + x_low * s_up) + x_low * s_low
    whole = F.floor(p)
    beyond = (p - whole - 0.5) + error
    n = whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1).otherwise(0)
    tens = F.lit(10**digits).cast("long")
    text = n.cast("string") if digits == 0 else F.concat(((n - n % tens) / tens).cast("long").cast("string"), F.lit("."), F.lpad((n % tens).cast("string"), digits, "0"))
    text = F.when(p < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", x))
    return F.when(value.isNotNull(), F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text))


def megabytes(value: Column) -> Column:
    return F.concat(fixed(value / 1_000_000, 1), F.lit(" MB"))


def microseconds(seconds: Column) -> Column:
    return F.concat(fixed(seconds * 1_000_000, 2), F.lit("µs"))


def metric_text(value: Column, reason: Column) -> Column:
    """Three decimals, or null with its reason."""
    return F.coalesce(fixed(value, 3), F.concat(F.lit("null ("), reason, F.lit(")")))


def point_text(f1: Column, false_positives: Column, rss_bytes: Column, p50_seconds: Column) -> Column:
    """A frontier point's figures; a null f1 is left out."""
    head = F.when(f1.isNull(), "").otherwise(F.concat(F.lit("f1="), fixed(f1, 3), F.lit(", ")))
    return F.concat(head, F.lit("false_positives="), false_positives.cast("long").cast("string"), F.lit(", peak RSS="), megabytes(rss_bytes), F.lit(", warm p50="), microseconds(p50_seconds))


def record_name(started_at: Column, slug: str = "benchmark") -> Column:
    """Name of a run record by the UTC time it began, whatever the session's zone."""
    utc = F.to_utc_timestamp(started_at, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), F.lit(f"-{slug}.json"))


def power_of_battery_report(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("AC Power")), "ac").when(F.contains(text, F.lit("Battery Power")), "battery").otherwise("unknown")


def power_of_supply_status(text: Column) -> Column:
    status = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(status.isin(*CHARGING), "ac").when(status == "discharging", "battery").otherwise("unknown")


def phase(seconds: Column, reason: str) -> Column:
    """A phase's duration, or why there is none."""
    return F.struct(seconds.cast("double").alias("value"), F.when(seconds.isNull(), reason).alias("undefined_reason"))


def peak_bytes(raw: Column, platform: Column) -> Column:
    """A process's peak memory in bytes from what its platform reports; an unknown platform is an error."""
    name = F.lower(platform)
    unknown = F.raise_error(F.concat(F.lit("no known unit of peak memory for platform "), platform)).cast("long")
    return F.when(name == "darwin", raw).when(name == "linux", raw * 1024).otherwise(unknown)


def license_of(card_license: Column, tags: Column) -> Column:
    """struct(license, source): the card's own, else the first filled license tag's, else unresolved."""
    tagged = F.get(F.filter(F.transform(tags, lambda t: F.when(t.startswith("license:"), F.substring(t, 9, 1 << 20))), lambda t: t != ""), F.lit(0))
    own = F.when(card_license != "", card_license)
    source = F.when(own.isNotNull(), "cardData.license").when(tagged.isNotNull(), "tag").otherwise("unresolved")
    return F.struct(F.coalesce(own, tagged, F.lit(UNRESOLVED_LICENSE)).alias("license"), source.alias("source"))
