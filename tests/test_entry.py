"""The grid library without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_other_subpackage(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    said = "import __spark_entry__ as e; q = e.queries(); assert 'search_top5' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", said], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests", "--deselect", "tests/test_entry.py"], cwd=copy, check=True, timeout=120, capture_output=True)
