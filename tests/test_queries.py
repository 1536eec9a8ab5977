"""Every registered query of the engine against its SQL; the entry point with and without the operators' folder."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from quillspark.queries import ORACLES, QUERIES


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert sorted(want.columns) == columns
    assert plain(found.select(*columns).collect()) == plain(want.fetchall())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_operators(tmp_path):
    shutil.copytree(f"{ROOT}/quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(x.startswith('op') for x in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_the_rest_of_the_suite_without_the_operators(tmp_path):
    """Everything else can be collected, and the kernels' tests and some queries' pass, where both folders are gone."""
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    run = lambda *args: subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path / "repo", capture_output=True, text=True, check=False)
    found = run("tests", "--collect-only")
    assert found.returncode == 0, found.stdout
    found = run("tests/test_kernels.py", "tests/test_queries.py", "-k", "not the_rest and (test_kernels or json_agg or entry)")
    assert found.returncode == 0, found.stdout
