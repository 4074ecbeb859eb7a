"""The driver contract holds with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


@pytest.mark.parametrize("gone", [("offersieve/llm",), ("offersieve/llm", "corpus_pipeline.py")])
def test_entry_without_the_corpus_subpackage(tmp_path, gone):
    for name in ("offersieve", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert "replay_metrics" in said and "pipeline" not in said and not any(x.startswith("op") and x[2].isdigit() for x in said)
