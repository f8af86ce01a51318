"""The entry without the training-data subpackage, with and without its pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n')"


@pytest.mark.parametrize("left_out", [(), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_subpackage(tmp_path, left_out):
    shutil.copytree(f"{ROOT}/lodeline", tmp_path / "lodeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "grep_documents" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit()]
