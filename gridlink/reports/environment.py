"""What a run's figures depend on: machine, power, versions, threads, and the models that were loaded."""

from __future__ import annotations

import importlib.metadata
import importlib.util
import os
import platform
import subprocess
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from gridlink.reports.record import Maybe

# Reasons and words of the record.
NO_NEURAL, NO_INT8 = "no neural arm in this run", "no int8 arm in this run"
THREADS_UNSET, THREADS_OBSERVED = "no arm passes thread settings to its session", "automatic pool, unpinned"
CHARGING = ("charging", "full")


def hardware() -> dict[str, Any]:
    return {
        "cpu_count": os.cpu_count() or 1,
        "machine": platform.machine(),
        "python_version": platform.python_version(),
        "release": platform.release(),
        "system": platform.system(),
        "total_memory_bytes": os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"),
    }


def battery_report(text: str) -> str:
    return "ac" if "AC Power" in text else "battery" if "Battery Power" in text else "unknown"


def supply_status(text: str) -> str:
    status = text.strip().lower()
    return "ac" if status in CHARGING else "battery" if status == "discharging" else "unknown"


def power_mode(system: str | None = None, supplies: Path = Path("/sys/class/power_supply")) -> str:
    system = system or platform.system()
    if system == "Darwin":
        return battery_report(subprocess.run(["pmset", "-g", "batt"], capture_output=True, text=True, check=False).stdout)
    found = sorted(supplies.glob("*/status")) if system == "Linux" else []
    return supply_status(found[0].read_text(encoding="utf-8")) if found else "unknown"


def _version(package: str) -> str | None:
    return importlib.metadata.version(package) if importlib.util.find_spec(package) else None


def describe(models: Mapping[str, Any], census: Mapping[str, Any] | None, power: str, warmups: int, repetitions: int) -> dict[str, Any]:
    """models: identities of the neural arms that were loaded; census: the int8 graph's converted operators."""
    neural = bool(models)
    return {
        "hardware": hardware(),
        "runtime_versions": {"onnxruntime": Maybe(_version("onnxruntime"), None) if neural else Maybe(None, NO_NEURAL), "pyspark": _version("pyspark"), "numpy": _version("numpy")},
        "power_mode": power,
        "onnx_threads_configured": Maybe(None, THREADS_UNSET),
        "onnx_threads_observed": Maybe(THREADS_OBSERVED, None) if neural else Maybe(None, NO_NEURAL),
        "warmup_count": warmups,
        "repetition_count": repetitions,
        "models": dict(models),
        "quantized_operators": Maybe(census, None) if census is not None else Maybe(None, NO_INT8),
        "measurement_preparation_path": "hoisted",
    }
