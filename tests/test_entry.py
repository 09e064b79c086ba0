"""The entry module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), sum(n.startswith('op') for n in q))"


@pytest.mark.parametrize("left", ["nothing", "compiled files", "the pipeline"])
def test_without_the_operators(tmp_path, left):
    shutil.copytree(ROOT / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "quern/llm/__pycache__").mkdir(parents=True)
    if left == "the pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, strangers, operators = map(int, out.stdout.split())
    assert queries > 140 and strangers == 0 and operators == 0
