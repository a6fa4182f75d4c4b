"""The driver's contract, and that the core stands without the subpackage of corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "language" in frame.columns


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_subpackage():
    core = [p for p in (ROOT / "narrata").rglob("*.py") if "llm" not in p.parts]
    assert core and not [p for p in core if "narrata.llm" in p.read_text()]


def test_entry_imports_without_the_subpackage(tmp_path):
    """A copy of the repository without it still has its core queries."""
    import shutil

    shutil.copytree(ROOT / "narrata", tmp_path / "narrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert min(map(int, done.stdout.split())) > 40
