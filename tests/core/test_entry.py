"""The driver's entry module with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert not set(s) - set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q, 'mps_predict' in q)"


@pytest.mark.parametrize("hidden", [["chainloom/llm"], ["chainloom/llm", "corpus_pipeline.py"], ["chainloom/llm/*.py"]])
def test_queries_without_the_optional_subpackage(tmp_path, hidden):
    shutil.copytree(ROOT / "chainloom", tmp_path / "chainloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for pattern in hidden:
        for path in tmp_path.glob(pattern):
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    found = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0, found.stderr[-2000:]
    assert found.stdout.split()[-3:] == ["0", "False", "True"]
