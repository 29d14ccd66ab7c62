"""What is registered must not depend on the optional text operators being there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [("tradeweave/llm", "tests/llm"), ("tradeweave/llm", "tests/llm", "corpus_pipeline.py")])
def test_core_queries_without_text_operators(tmp_path, gone):
    hidden = shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", *[Path(g).name for g in gone])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=hidden)
    said = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    from tradeweave.plans.catalog import QUERIES
    from tradeweave.plans.oracle import ORACLES

    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLES)), "False"], said.stderr[-800:]
