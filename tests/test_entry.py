"""The entry of a checkout that lacks the text operators, the pipeline or both."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
SEEN = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("modelrank/llm", "tests/llm"), ("modelrank/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_core_queries_stay(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", SEEN], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    from modelrank.queries import QUERIES

    assert int(said.stdout.split()[0]) >= len(QUERIES) and said.stdout.rstrip().endswith("True")
    if "modelrank/llm" in gone:
        assert "[]" in said.stdout


def test_other_missing_modules_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", SEEN], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode and "no_such_module" in said.stderr
