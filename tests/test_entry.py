"""The driver's entry module with and without the optional corpus files."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def listed(folder: Path) -> tuple[int, bool]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    n, pipeline = done.stdout.split()
    return int(n), pipeline == "True"


@pytest.mark.parametrize("gone", [("marlstone/llm", "tests/llm", "corpus_pipeline.py"), ("marlstone/llm", "tests/llm"), ("marlstone/llm/registry.py",)])
def test_without_the_corpus_files(tmp_path, gone):
    from marlstone.plans import catalog

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    assert listed(copy) == (len(catalog.queries()), False)
    (copy / "marlstone" / "llm").mkdir(exist_ok=True)  # an empty folder may stay behind
    assert listed(copy) == (len(catalog.queries()), False)
