"""The library without its corpus part: both folders and the pipeline deleted in a copy."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_everything_else_imports(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.json"))
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') or n == 'pipeline' for n in q))"
    run = subprocess.run([sys.executable, "-B", "-c", said], cwd=copy, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, known, corpus = map(int, run.stdout.split())
    assert n >= 150 and known >= 140 and corpus == 0
