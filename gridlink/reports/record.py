"""Run records: plain values put together in one place, named by their UTC start, written once.

A figure that doesn't exist is a value of None with a reason, never an absent key or a zero. Expectations are given
before any result can be added, so they can't follow from the results.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, is_dataclass
from datetime import UTC, datetime
from pathlib import Path
from types import MappingProxyType
from typing import Any

# Fixed value: the record layout that is written and rendered.
SCHEMA = "benchmark-v7"


@dataclass(frozen=True)
class Maybe:
    """A value, or the reason why there is none."""

    value: Any
    reason: str | None

    def __post_init__(self) -> None:
        if (self.value is None) == (self.reason is None):
            raise ValueError(f"either a value or a reason is needed, not {self.value!r} and {self.reason!r}")


@dataclass(frozen=True)
class Metric:
    value: float | None
    undefined_reason: str | None = None

    def __post_init__(self) -> None:
        if (self.value is None) == (self.undefined_reason is None):
            raise ValueError(f"a metric has a value or a reason, not {self.value!r} and {self.undefined_reason!r}")


@dataclass(frozen=True)
class Unavailable:
    """A measurement that could not be made."""

    arm: str
    reason: str


def ok(**values: Any) -> dict[str, Any]:
    """A measurement that was made."""
    return {"status": "ok", **values}


def record_id(started_at: datetime, slug: str = "benchmark") -> str:
    if started_at.tzinfo is None:
        raise ValueError("started_at needs a time zone")
    return f"{started_at.astimezone(UTC):%Y%m%dT%H%M%SZ}-{slug}.json"


def plain(value: Any) -> Any:
    """Values that JSON can hold: sets sorted, times as text, refusals and failures with their status."""
    from gridlink.operators.evaluation import InvalidRun

    if is_dataclass(value) and not isinstance(value, type):
        status = {"status": "invalid"} if isinstance(value, InvalidRun) else {"status": "unavailable"} if isinstance(value, Unavailable) else {}
        return status | {f.name: plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, set | frozenset):
        return sorted(plain(v) for v in value)
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, datetime) else value


class Assembly:
    """Collects arms' results under expectations stated before."""

    def __init__(self, expected_winners: Mapping[str, str]):
        self.expected = MappingProxyType(dict(expected_winners))
        self._results: dict[str, Any] = {}

    def add(self, arm: str, result: Any) -> None:
        self._results[arm] = result

    def build(self, started_at: datetime, command: Sequence[str], **parts: Any) -> dict[str, Any]:
        """The record as plain values. parts: environment, evaluation_set, selected_thresholds, contradictions and so on."""
        if not self._results:
            raise ValueError("a run record needs at least one arm's result")
        return plain({"schema": SCHEMA, "record_id": record_id(started_at), "started_at": started_at, "command": list(command), "expected_winners": {"winners": self.expected}, "results": self._results, **parts})


def write(record: Mapping[str, Any], folder: str | Path) -> Path:
    """Writes the record under its id; a record that is there already is never overwritten."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / record["record_id"]
    with path.open("x", encoding="utf-8") as out:
        out.write(json.dumps(record, indent=2, sort_keys=True) + "\n")
    return path


def read(path: str | Path) -> dict[str, Any]:
    with Path(path).open(encoding="utf-8") as f:
        return json.load(f)


def spike_record(started_at: datetime, environ: Mapping[str, str], allowed: Sequence[str], **parts: Any) -> dict[str, Any]:
    """An experiment's record, with no more of the environment than the named settings."""
    environment = {**parts.pop("environment", {}), "env": {k: environ[k] for k in allowed if k in environ}}
    return plain({"schema": "quantization-spike-v1", "record_id": record_id(started_at, "quantization-spike"), "started_at": started_at, "environment": environment, **parts})
