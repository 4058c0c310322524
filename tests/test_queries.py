import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from sparrowmill.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(name, spark, small):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline_too", [False, True])
def test_the_rest_stands_without_the_training_data_part(pipeline_too, tmp_path):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm", *["corpus_pipeline.py"] * pipeline_too)
    shutil.copytree(top, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert s and set(s) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={**os.environ, "PYTHONPATH": ""})
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert found.returncode == 0, found.stdout
