"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.abspath(e.__file__))


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert rows and {"pair_id", "offset", "confidence"} <= set(rows[0].asDict())


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "tidemark"), tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nn_coarse_fine' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
