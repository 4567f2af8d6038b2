import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_each_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns == ["term", "postings"] and found.count() > 0


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_works_without_the_optional_parts(tmp_path, gone):
    """The two folders named llm are deleted, with or without the pipeline; the other queries, and their tests, stay."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    there = (REPO / "lexigraph" / "llm").exists()
    code = (
        "import __spark_entry__ as e; from lexigraph.plans import catalogue as c; q = e.queries(); o = e.oracle_sql(); "
        f"assert set(o) <= set(q) and set(c.QUERIES) <= set(q) and ('pipeline' in q) == {not gone} and ('op3_exact_dedup' in q) == {there and 'llm' not in gone}, q"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=env)
    collect = [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", *(["--ignore=tests/llm"] if "llm" not in gone else [])]
    subprocess.run(collect, cwd=tmp_path / "repo", check=True, env=env)


def test_an_error_inside_an_optional_part_is_raised(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no numpy", name="numpy")

    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
