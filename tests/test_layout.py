"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_subpackage(tmp_path, pipeline):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'resolve' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(o) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=False)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) > 90


def test_nothing_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "gridlink")):
        for name in files:
            if name.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "gridlink.llm" not in f.read(), name
