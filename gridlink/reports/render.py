"""Texts made from a run record alone: the table by family, and a results section that is put between two markers.

Nothing is measured here. A record of another layout is refused. Layout, words and widths are the published ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridlink.reports.record import SCHEMA

# Column widths and texts.
ARM_WIDTH, CELL_WIDTH = 14, 32
NO_REPORT = "no arm in this record produced a comparable aggregate to derive"
BEGIN = "<!-- BEGIN GENERATED RESULTS: do not edit by hand -->"
END = "<!-- END GENERATED RESULTS -->"

Record = Mapping[str, Any]


class UnsupportedSchema(ValueError):
    """A sound record of a layout that isn't rendered here."""


class MissingMarkers(ValueError):
    """A text without the two markers between which results go."""


def _checked(record: Record) -> Record:
    if record["schema"] != SCHEMA:
        raise UnsupportedSchema(f"record carries schema {record['schema']!r}; this build renders {SCHEMA!r}. Run the benchmark again to get a record it can read.")
    return record["results"]


def _sound(results: Record) -> list[tuple[str, Record]]:
    return [(arm, r["accuracy"]["pooled"]) for arm, r in results.items() if r["accuracy"].get("status") == "ok"]


def families(results: Record) -> list[str]:
    """In the order of the first arm that has a report."""
    sound = _sound(results)
    return [row["family"] for row in sound[0][1]["per_family"]] if sound else []


def decimals(value: float, digits: int) -> str:
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN))


def metric(m: Record) -> str:
    return f"null ({m['undefined_reason']})" if m["value"] is None else decimals(m["value"], 3)


def megabytes(value: float) -> str:
    return f"{decimals(value / 1_000_000, 1)} MB"


def microseconds(seconds: float) -> str:
    return f"{decimals(seconds * 1_000_000, 2)}µs"


def _line(first: str, cells: Iterable[str]) -> str:
    return "  " + "  ".join([first.ljust(ARM_WIDTH), *(c.ljust(CELL_WIDTH) for c in cells)])


def _block(heading: str, columns: tuple[str, ...], results: Record, row_of) -> list[str]:
    lines = [heading, _line("arm", columns)]
    for arm, result in results.items():
        accuracy = result["accuracy"]
        if accuracy.get("status") != "ok":
            lines.append(f"  {arm.ljust(ARM_WIDTH)}unavailable — {accuracy['reason']}")
        else:
            row = row_of(accuracy["pooled"])
            lines.append(_line(arm, (str(row[c]) if c == "false_positives" else metric(row[c]) for c in columns)))
    return lines


def family_table(record: Record) -> str:
    """Arms down, metrics across, a block for each family, the aggregate last; contradicted families are marked."""
    results = _checked(record)
    against = {}
    for c in record["contradictions"]:
        against.setdefault(c["family"], c)
    out = [f"run {record['record_id']} (schema {record['schema']})", ""]
    for family in families(results):
        mark = ""
        if c := against.get(family):
            mark = f"  [CONTRADICTED — expected {c['expected_winner']!r} to win; actual winner(s): {', '.join(map(repr, c['actual_winners']))}]"
        out += _block(f"family: {family}{mark}", ("precision", "recall", "f1", "false_positives"), results, lambda pooled, family=family: next(r for r in pooled["per_family"] if r["family"] == family))
        out.append("")
    sound = _sound(results)
    derived = sound[0][1]["aggregate"]["derivation"] if sound else NO_REPORT
    out += _block(f"aggregate — derived: {derived}", ("precision", "recall", "f1"), results, lambda pooled: pooled["aggregate"])
    return "\n".join(out) + "\n"


def points(spark: SparkSession, record: Record) -> DataFrame:
    """A record's arms and families as frontier() takes them."""
    results, rows = _checked(record), []
    for family in families(results):
        for position, (arm, r) in enumerate(results.items()):
            accuracy, memory, latency = r["accuracy"], r["peak_memory"], r["warm_latency"]
            own = {x["family"]: x for x in accuracy["pooled"]["per_family"]} if accuracy.get("status") == "ok" else {}
            row = own.get(family)
            f1 = row["f1"] if row else {"value": None, "undefined_reason": None}
            rows.append((family, position, arm, f1["value"], f1["undefined_reason"], row["false_positives"] if row else None, memory.get("peak_rss_bytes"), latency.get("p50_seconds"), *(x for part in (accuracy, memory, latency) for x in (part.get("status"), part.get("reason"))), row is not None))
    kinds = "family string, position int, arm string, f1 double, f1_reason string, fp long, rss double, p50 double, accuracy_status string, accuracy_reason string, memory_status string, memory_reason string, latency_status string, latency_reason string, reported boolean"
    return spark.createDataFrame([(*r[:6], None if r[6] is None else float(r[6]), None if r[7] is None else float(r[7]), *r[8:]) for r in rows], kinds)


def _latency(r: Record) -> str:
    return microseconds(r["p50_seconds"]) if r.get("status") == "ok" else f"unavailable — {r['reason']}"


def _memory(r: Record) -> str:
    return megabytes(r["peak_rss_bytes"]) if r.get("status") == "ok" else f"unavailable — {r['reason']}"


def _artifact(r: Record) -> str:
    if r.get("status") == "unavailable":
        return f"unavailable — {r['reason']}"
    return f"— ({r['undefined_reason']})" if r["value"] is None else megabytes(r["value"])


def _table(head: tuple[str, ...], results: Record, cells_of) -> list[str]:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    for arm, r in results.items():
        if r["accuracy"].get("status") != "ok":
            lines.append(f"| `{arm}` | unavailable — {r['accuracy']['reason']} |" + " |" * (len(head) - 2))
        else:
            lines.append(f"| `{arm}` | " + " | ".join(cells_of(r)) + " |")
    return lines


def results_section(spark: SparkSession, record: Record, scope: str = "") -> str:
    """Markdown: machine, corpus, aggregate table, and for each family its table, frontier, and who is off it and why."""
    from gridlink.operators import evaluation as ev

    results = _checked(record)
    h, found = record["environment"]["hardware"], record["evaluation_set"]
    machine = f"{h['system']} {h['release']} ({h['machine']}), {h['cpu_count']} cores, {h['total_memory_bytes'] / 1024**3:.1f} GiB RAM, Python {h['python_version']}"
    corpus = f"the built-in synthetic corpus, pooled across seeds {', '.join(map(str, found['seeds']))}; families: {', '.join(sorted(found['case_mixture']))}"
    out = ["## Results", "", f"Generated from `{record['record_id']}`; every figure below is from that record.", "", f"**Reference machine:** {machine}", "", f"**Corpus:** {corpus}", ""]
    out += [scope, ""] if scope else []
    out += ["### Aggregate", "", *_table(("arm", "aggregate F1", "warm p50", "peak RSS", "artifact"), results, lambda r: (metric(r["accuracy"]["pooled"]["aggregate"]["f1"]), _latency(r["warm_latency"]), _memory(r["peak_memory"]), _artifact(r["artifact_size"]))), ""]
    judged: dict[str, list] = {}
    for row in ev.frontier(points(spark, record)).orderBy("position").collect():  # a row for each arm and family
        judged.setdefault(row["family"], []).append(row)
    for family in families(results):
        def cells(r, family=family):
            row = next(x for x in r["accuracy"]["pooled"]["per_family"] if x["family"] == family)
            return metric(row["f1"]), str(row["false_positives"]), _latency(r["warm_latency"]), _memory(r["peak_memory"])

        rows = judged[family]
        best = [r for r in rows if r["status"] == "frontier"]
        # arms that were no candidates come first, then dominated ones
        off = [r for r in rows if r["status"] == "excluded"] + [r for r in rows if r["status"] == "dominated"]
        if best:
            texts = ", ".join(f"`{r['arm']}` (f1={'null' if r['f1'] is None else decimals(r['f1'], 3)}, false_positives={r['fp']})" for r in best)
            line = f"**On the frontier** (no stated constraints — none of these is dominated by another): {texts}."
        else:
            line = "**No arm qualifies** (no stated constraints): " + "; ".join(f"{r['arm']} ({r['reason']})" for r in off)
        out += [f"### {family}", "", *_table(("arm", "f1", "false_positives", "warm p50", "peak RSS"), results, cells), "", line, ""]
        out += [*(f"- `{r['arm']}`: {r['reason']}" for r in off), ""] if off else []
    return "\n".join(out).rstrip() + "\n"


def splice(text: str, section: str, begin: str = BEGIN, end: str = END) -> str:
    """text with the section between the markers; a second call with the same section changes nothing."""
    if begin not in text or end not in text:
        raise MissingMarkers(f"no pair of markers {begin!r} and {end!r} in the text")
    head, rest = text.split(begin, 1)
    return f"{head}{begin}\n\n{section}\n{end}{rest.split(end, 1)[1]}"


def contradiction_lines(found: list[Record]) -> list[str]:
    if not found:
        return ["contradictions: none — every pre-registered expectation held"]
    return [f"contradictions: {len(found)} pre-registered expectation(s) did not hold", *(f"  {c['family']}: expected {c['expected_winner']!r} to win, actual winner(s): {', '.join(map(repr, c['actual_winners']))}" for c in found)]


def asymmetry_lines(asymmetry: Record) -> list[str]:
    o = asymmetry["occupancy"]
    out = ["preparation hoist speed-up (median naive seconds / median hoisted seconds):", f"  measured over candidate-bucket occupancy {list(o['counts'])} (max {o['max_occupancy']}, cell size {o['cell_size_degrees']} degrees); fuller buckets would show a larger one"]
    for label in ("classical", "neural"):
        speeds = asymmetry[f"{label}_speedups"]
        out += [f"  {label} {arm}: {'undefined' if speeds[arm]['value'] is None else format(speeds[arm]['value'], '.2f') + 'x'}" for arm in sorted(speeds)] or [f"  {label}: no arm in this run produced a comparable figure"]
    return out
