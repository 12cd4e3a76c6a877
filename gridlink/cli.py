"""Five commands: resolve, compare, doctor, benchmark, report. `python -m gridlink <command>`."""

from __future__ import annotations

import argparse
import importlib.util
import json
import platform
import sys
import time
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

DEFAULT_THRESHOLD = 0.8


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.appName("gridlink").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _fail(why: object) -> int:
    print(why, file=sys.stderr)
    return 1


def resolve(args: argparse.Namespace) -> int:
    from gridlink.operators import resolve as rs
    from gridlink.sources import jsonl

    try:
        scorer, spark = rs.get_scorer(args.scorer), _session()
        left, right = (jsonl.read_records(spark, str(path), path.stem, side) for side, path in (("left", args.left), ("right", args.right)))
    except (ValueError, rs.ScorerUnavailable) as e:
        return _fail(e)
    result = rs.resolve(left, right, scorer, DEFAULT_THRESHOLD).keep()
    (jsonl.write_resolution_parts if args.parts else jsonl.write_resolution)(result, str(args.output))
    print(f"resolved {left.count()} left record(s) and {right.count()} right record(s) under '{scorer.name}': {result.pairs.count()} matched pair(s), {result.unmatched.count()} unmatched record(s) written to {args.output}")
    result.close()
    return 0


def compare(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from gridlink.operators import resolve as rs

    try:
        scorer = rs.get_scorer(args.scorer)
    except (ValueError, rs.ScorerUnavailable) as e:
        return _fail(e)
    row = _session().createDataFrame([(args.left_name, args.right_name)], "l string, r string")
    started = time.perf_counter()
    score = scorer.score(scorer.prepare(F.col("l")), scorer.prepare(F.col("r")))
    got = row.select(score.alias("score")).select("score", rs.matches(F.col("score"), args.threshold).alias("match")).first()
    took = (time.perf_counter() - started) * 1000
    print(f"scorer: {scorer.name}\nthreshold: {args.threshold}\nscore: {got['score']:.4f}\ndecision: {'match' if got['match'] else 'no match'}")
    print(f"elapsed: {took:.4f} ms (illustrative timing for this single comparison only, never benchmark evidence)")
    return 0


def doctor(args: argparse.Namespace) -> int:
    import pyspark

    profile = "neural" if importlib.util.find_spec("onnxruntime") else "base"
    facts = {
        "architecture": platform.machine(),
        "operating system": f"{platform.system()} {platform.release()}",
        "python version": platform.python_version(),
        "spark version": pyspark.__version__,
        "execution provider": "cpu (no other provider is ever configured)",
        "installed profile": profile,
        "offline status": "no command in this package opens a network connection",
        "benchmark run record": "none (doctor reports the environment, not a run)",
    }
    print("\n".join(f"{name}: {value}" for name, value in facts.items()))
    return 0


def benchmark(args: argparse.Namespace) -> int:
    from gridlink.operators.embedding import OperatorMismatch
    from gridlink.reports import benchmark as bench
    from gridlink.reports import record, render
    from gridlink.sources.labelled import MalformedPairError, read_pairs

    started_at = datetime.now(UTC)
    try:
        pairs = None
        if args.pairs:
            from pyspark.sql import functions as F

            pairs = read_pairs(_session(), str(args.pairs)).withColumn("seed", F.lit(0))
        got = bench.run(_session(), started_at, pairs=pairs)
        path = record.write(got, args.output)
    except (OperatorMismatch, MalformedPairError) as e:
        return _fail(e)
    except FileExistsError as e:
        return _fail(f"a run record already exists at {e.filename}: refusing to overwrite it")
    print(f"wrote {path}")
    print("\n".join(render.contradiction_lines(got["contradictions"]) + render.asymmetry_lines(got["preparation_asymmetry"])))
    return 0


def report(args: argparse.Namespace) -> int:
    from gridlink.reports import record, render

    try:
        found = record.read(args.record)
    except json.JSONDecodeError as e:
        return _fail(f"{args.record} is not a valid JSON run record: {e}")
    except OSError as e:
        return _fail(f"could not read {args.record}: {e}")
    try:
        if args.readme:
            text = args.readme.read_text(encoding="utf-8")
            args.readme.write_text(render.splice(text, render.results_section(_session(), found)), encoding="utf-8")
        else:
            print(render.family_table(found), end="")
    except (render.UnsupportedSchema, render.MissingMarkers) as e:
        return _fail(f"cannot render {args.record}: {e}")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gridlink", description="Links record sets that share no key, and measures how well that works.")
    commands = out.add_subparsers(dest="command")
    p = commands.add_parser("resolve", help="Merge two record sets into one, with a reason for every record left over.")
    for name in ("left", "right", "output"):
        p.add_argument(f"--{name}", required=True, type=Path, help="JSON Lines file")
    p.add_argument("--scorer", default="overlap", help="scorer by name (default: %(default)s)")
    p.add_argument("--parts", action="store_true", help="write a folder of files where the rows are, instead of one file")
    p.set_defaults(call=resolve)
    p = commands.add_parser("compare", help="Score one pair of names and print the decision.")
    p.add_argument("left_name")
    p.add_argument("right_name")
    p.add_argument("--scorer", default="overlap", help="scorer by name (default: %(default)s)")
    p.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD, help="least score of a match (default: %(default)s)")
    p.set_defaults(call=compare)
    commands.add_parser("doctor", help="Print what this machine runs on.").set_defaults(call=doctor)
    p = commands.add_parser("benchmark", help="Measure every scorer and write a run record.")
    p.add_argument("--pairs", type=Path, help="labelled pairs (CSV or JSON Lines) instead of the built-in ones")
    p.add_argument("--output", type=Path, default=Path("benchmarks"), help="folder of records (default: %(default)s)")
    p.set_defaults(call=benchmark)
    p = commands.add_parser("report", help="Print a run record's results by family.")
    p.add_argument("record", type=Path)
    p.add_argument("--readme", type=Path, help="put the results between the markers of this file instead")
    p.set_defaults(call=report)
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.call(args) if args.command else 0
