"""The driver's contract, and that the rest works where the llm folders are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_llm(tmp_path):
    """With both folders and the pipeline gone the entry has the other queries, every other test can be imported, and one file of them passes."""
    for name in ("plumbline", "tests", "pyproject.toml", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for name in ("plumbline/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for what in (["--collect-only", "tests"], ["tests/test_columns.py"]):
        subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *what], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_llm():
    for path in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "plumbline.llm" not in path.read_text()
