"""Commands, run records, and what is rendered from them."""

import json
from datetime import UTC, datetime, timedelta, timezone

import pytest

from gridlink import cli
from gridlink.operators import evaluation as ev
from gridlink.reports import benchmark, environment, measure, record, render

LEFT = '{"name": "Northbridge Hardware", "latitude": 0.31, "longitude": 32.58, "fields": {"category": "hardware"}}\n{"name": "Meridian Foods", "latitude": 0.42, "longitude": 32.61}\n'
RIGHT = '{"name": "Northbridge Hardware", "latitude": 0.31, "longitude": 32.58, "fields": {"phone": "1"}}\n\n{"name": "Unrelated Traders"}\n'


def _files(tmp_path):
    (tmp_path / "left.jsonl").write_text(LEFT)
    (tmp_path / "right.jsonl").write_text(RIGHT)
    return ["resolve", "--left", str(tmp_path / "left.jsonl"), "--right", str(tmp_path / "right.jsonl"), "--output", str(tmp_path / "out.jsonl")]


def test_resolve(spark, tmp_path, capsys):
    assert cli.main(_files(tmp_path)) == 0
    assert "resolved 2 left record(s) and 2 right record(s) under 'overlap': 1 matched pair(s), 2 unmatched record(s)" in capsys.readouterr().out
    lines = (tmp_path / "out.jsonl").read_text().splitlines()
    assert lines[0] == '{"fields": {"category": "hardware", "phone": "1"}, "latitude": 0.31, "longitude": 32.58, "name": "Northbridge Hardware", "sources": ["left", "right"], "status": "matched"}'
    assert cli.main([*_files(tmp_path)[:-1], str(tmp_path / "parts"), "--parts"]) == 0
    got = [json.loads(x) for f in (tmp_path / "parts").glob("part-*") for x in f.read_text().splitlines()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(got, key=key) == sorted(map(json.loads, lines), key=key)


def test_resolve_refuses(spark, tmp_path, capsys):
    args = _files(tmp_path)
    assert cli.main([*args, "--scorer", "none"]) == 1 and "unknown scorer" in capsys.readouterr().err
    assert cli.main([*args, "--scorer", "embed-fp32"]) == 1 and "unavailable" in capsys.readouterr().err
    (tmp_path / "left.jsonl").write_text('{"name": "a"}\n\n{"latitude": 1.0}\n')
    assert cli.main(args) == 1 and "left.jsonl:3: record has no 'name' field" in capsys.readouterr().err
    (tmp_path / "left.jsonl").write_text('{"name": "a"}\n{broken\n')
    assert cli.main(args) == 1 and "left.jsonl:2: line is not a JSON record" in capsys.readouterr().err


def test_compare_and_doctor(spark, capsys):
    assert cli.main(["compare", "Acme Trading", "acme trading ltd"]) == 0
    out = capsys.readouterr().out
    assert "scorer: overlap\nthreshold: 0.8\nscore: 1.0000\ndecision: match\n" in out and "never benchmark evidence" in out
    assert cli.main(["compare", "a", "b", "--threshold", "0.1"]) == 0 and "decision: no match" in capsys.readouterr().out
    assert cli.main(["doctor"]) == 0
    out = capsys.readouterr().out
    assert "architecture: " in out and "spark version: " in out and "offline status: no command" in out
    assert cli.main([]) == 0


@pytest.fixture(scope="module")
def run_record(spark):
    return benchmark.run(spark, datetime(2026, 8, 13, 8, 19, 44, tzinfo=UTC), warmups=1, repetitions=3)


def test_benchmark_record(run_record, tmp_path):
    r = json.loads(json.dumps(run_record))
    assert r["schema"] == "benchmark-v7" and r["record_id"] == "20260813T081944Z-benchmark.json" and list(r["results"]) == list(benchmark.ARMS)
    assert r["evaluation_set"]["seeds"] == [1, 2, 3, 4, 5] and sum(r["evaluation_set"]["case_mixture"].values()) == 1800
    assert [(t["scorer_name"], t["role"], t["n_pairs"]) for t in r["selected_thresholds"]] == [("overlap", "calibration", 430), ("fuzzy", "calibration", 430)]
    for arm in benchmark.CLASSICAL:
        own = r["results"][arm]
        assert own["accuracy"]["status"] == "ok" and own["accuracy"]["pooled"]["n_pairs"] == 470 and len(own["accuracy"]["by_seed"]) == 5
        assert {x["family"] for x in own["accuracy"]["variation"]} == {x["family"] for x in own["accuracy"]["pooled"]["per_family"]}
        assert own["warm_latency"]["p50_seconds"] > 0 and own["peak_memory"]["peak_rss_bytes"] > 1e6 and own["cold_start"]["total"]["value"] > 0
        assert own["cold_start"]["session_creation"] == {"value": None, "undefined_reason": "classical arms construct no session"}
        assert own["preparation"]["hoisted"]["scores"] == own["preparation"]["naive"]["scores"] and own["preparation_cost"]["comparison_count"] == 30
    for arm in benchmark.NEURAL:
        own = r["results"][arm]
        assert own["accuracy"]["status"] == "invalid" and own["warm_latency"]["status"] == "unavailable" and own["warm_latency"]["reason"]
    assert r["int8_accuracy_divergence"]["value"] is None and r["environment"]["onnx_threads_observed"]["reason"] == "no neural arm in this run"
    assert r["preparation_asymmetry"]["occupancy"]["counts"] == [1, 2, 3, 4]
    path = record.write(run_record, tmp_path / "records")
    assert path.read_text() == json.dumps(r, indent=2, sort_keys=True) + "\n"
    with pytest.raises(FileExistsError):
        record.write(run_record, tmp_path / "records")


def test_report(spark, run_record, tmp_path, capsys):
    path = record.write(run_record, tmp_path)
    assert cli.main(["report", str(path)]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "run 20260813T081944Z-benchmark.json (schema benchmark-v7)"
    assert lines[2].startswith("family: ") and lines[3].split() == ["arm", "precision", "recall", "f1", "false_positives"]
    assert any(x.startswith("  embed-fp32    unavailable — ") for x in lines) and any(x.startswith("aggregate — derived: ") for x in lines)
    readme = tmp_path / "README.md"
    readme.write_text(f"# x\n{render.BEGIN}\nstale text\n{render.END}\nrest\n")
    assert cli.main(["report", str(path), "--readme", str(readme)]) == 0
    text = readme.read_text()
    assert text.startswith(f"# x\n{render.BEGIN}\n\n## Results\n") and text.endswith(f"{render.END}\nrest\n") and "stale text" not in text
    assert "| arm | aggregate F1 | warm p50 | peak RSS | artifact |" in text and "**On the frontier**" in text
    assert cli.main(["report", str(path), "--readme", str(readme)]) == 0 and readme.read_text() == text
    readme.write_text("no markers")
    assert cli.main(["report", str(path), "--readme", str(readme)]) == 1 and "markers" in capsys.readouterr().err


def test_report_refuses(tmp_path, capsys):
    assert cli.main(["report", str(tmp_path / "none.json")]) == 1 and "could not read" in capsys.readouterr().err
    (tmp_path / "bad.json").write_text("{")
    assert cli.main(["report", str(tmp_path / "bad.json")]) == 1 and "not a valid JSON run record" in capsys.readouterr().err
    (tmp_path / "old.json").write_text('{"schema": "benchmark-v3"}')
    assert cli.main(["report", str(tmp_path / "old.json")]) == 1 and "'benchmark-v3'; this build renders 'benchmark-v7'" in capsys.readouterr().err


def test_family_table_layout():
    m = lambda v, why=None: {"value": v, "undefined_reason": why}
    row = {"family": "exact", "precision": m(1.0), "recall": m(0.5), "f1": m(2 / 3), "false_positives": 0}
    total = {"precision": m(1.0), "recall": m(None, "no actual positives"), "f1": m(None, "x"), "derivation": "sums"}
    results = {"a": {"accuracy": {"status": "ok", "pooled": {"per_family": [row], "aggregate": total}}}, "b": {"accuracy": {"status": "invalid", "reason": "gone"}}}
    text = render.family_table({"schema": record.SCHEMA, "record_id": "r", "results": results, "contradictions": [{"family": "exact", "expected_winner": "b", "actual_winners": ["a", "c"]}]})
    cells = lambda *c: "  " + "  ".join([c[0].ljust(14), *(x.ljust(32) for x in c[1:])])
    assert text.splitlines() == [
        "run r (schema benchmark-v7)",
        "",
        "family: exact  [CONTRADICTED — expected 'b' to win; actual winner(s): 'a', 'c']",
        cells("arm", "precision", "recall", "f1", "false_positives"),
        cells("a", "1.000", "0.500", "0.667", "0"),
        "  " + "b".ljust(14) + "unavailable — gone",
        "",
        "aggregate — derived: sums",
        cells("arm", "precision", "recall", "f1"),
        cells("a", "1.000", "null (no actual positives)", "null (x)"),
        "  " + "b".ljust(14) + "unavailable — gone",
    ]


def test_records_are_strict():
    with pytest.raises(ValueError):
        record.Maybe(None, None)
    with pytest.raises(ValueError):
        record.Metric(1.0, "both")
    with pytest.raises(ValueError, match="time zone"):
        record.record_id(datetime(2026, 1, 1))
    assert record.record_id(datetime(2026, 1, 1, 1, tzinfo=timezone(timedelta(hours=2)))) == "20251231T230000Z-benchmark.json"
    with pytest.raises(ValueError, match="at least one arm"):
        record.Assembly({}).build(datetime.now(UTC), ())
    assert record.plain({"a": {3, 1}, "b": ev.InvalidRun("no"), "c": record.Unavailable("x", "y"), "d": (1,)}) == {"a": [1, 3], "b": {"status": "invalid", "reason": "no"}, "c": {"status": "unavailable", "arm": "x", "reason": "y"}, "d": [1]}
    spike = record.spike_record(datetime(2026, 1, 1, tzinfo=UTC), {"A": "1", "TOKEN": "2"}, ("A",), model={})
    assert spike["environment"]["env"] == {"A": "1"} and spike["record_id"].endswith("-quantization-spike.json")


def test_measurements(monkeypatch):
    assert measure.percentile([3.0, 1.0, 2.0], 0.99) == 3.0 and measure.percentile([1.0], 0.5) == 1.0
    assert measure.warm_latency("none", "a", "b") == record.Unavailable("none", "unknown scorer 'none'")
    for bad in ({"repetitions": 0}, {"warmups": -1}):
        with pytest.raises(ValueError):
            measure.warm_latency("overlap", "a", "b", **bad)
    with pytest.raises(ValueError):
        measure.preparation_cost("overlap", [], ["a"], [(0, 0)])
    assert measure.sum_defined([record.Metric(None, "x")]).undefined_reason == "no phase produced a duration"
    assert measure.speedup({"hoisted_p50_seconds": 0.0, "naive_p50_seconds": 1.0}).value is None
    assert measure.phase_durations({"a": 1.0, "b": 1.5, "c": 4.0}, ("a", "b", "c")) == {"a to b": 0.5, "b to c": 2.5, "total": 3.0}
    with pytest.raises(ValueError, match="missing checkpoint"):
        measure.phase_durations({"a": 1.0}, ("a", "b"))
    monkeypatch.setattr(measure.sys, "executable", "false")
    assert isinstance(measure.peak_memory("overlap", "a", "b", "ac"), record.Unavailable)


def test_power(tmp_path):
    assert [environment.battery_report(t) for t in ("AC Power", "Battery Power", "")] == ["ac", "battery", "unknown"]
    assert environment.power_mode("Linux", tmp_path) == "unknown"
    (tmp_path / "BAT0").mkdir()
    (tmp_path / "BAT0" / "status").write_text("Discharging\n")
    assert environment.power_mode("Linux", tmp_path) == "battery" and environment.power_mode("Other", tmp_path) == "unknown"
