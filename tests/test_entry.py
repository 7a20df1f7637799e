"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["i", "u"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_subpackage(tmp_path):
    for f in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / f, tmp_path)
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copytree(ROOT / "gridloom", tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q); e.oracle_sql(); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text()
