"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    env = {**os.environ, "PYTHONPATH": folder, "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout.split()


def test_entry_works_without_the_training_data_operators(tmp_path):
    """Without the subpackage's folders its queries are gone, and so is the pipeline, which needs it."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    bare, rest = str(tmp_path / "bare"), str(tmp_path / "rest")
    shutil.copytree(ROOT, bare, ignore=skip)
    shutil.copytree(bare, rest, ignore=shutil.ignore_patterns("corpus_pipeline.py"))
    names = _names(bare)
    assert names and names == _names(rest)
    assert "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(names) <= set(_names(ROOT))
