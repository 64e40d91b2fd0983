"""The entry works without the corpus operators and their pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') and '_' in n and n[2].isdigit() or n == 'pipeline'))"


@pytest.mark.parametrize("gone", [["qaforge/llm", "tests/llm"], ["qaforge/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_corpus_operators(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda at, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or (Path(at) / n).relative_to(ROOT).as_posix() in gone])
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    n, sql, corpus = done.stdout.split(maxsplit=2)
    assert int(n) > 150 and int(sql) > 130 and corpus.strip() == "[]"
