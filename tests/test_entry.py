"""The driver's entry points, with and without the training-data part."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    run = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, env=env, capture_output=True, text=True, check=True)
    names, twins = run.stdout.strip().split("\n")[-2:]
    return set(names.split()), set(twins.split())


def test_the_rest_survives_without_the_training_data_part(tmp_path):
    whole = tmp_path / "whole"
    skipped = shutil.ignore_patterns(".git", "__pycache__", "*.json")
    shutil.copytree(ROOT, whole, ignore=skipped)
    names, twins = listed(whole)
    assert twins <= names
    for part in ("linetrace/llm", "tests/llm"):
        shutil.rmtree(whole / part, ignore_errors=True)
    kept = {n for n in names if not n.startswith("op") and n != "pipeline"}
    assert listed(whole) == (kept, twins & kept)
    os.remove(whole / "corpus_pipeline.py") if (whole / "corpus_pipeline.py").exists() else None
    assert listed(whole) == (kept, twins & kept)
