"""The driver's entry point with and without the training subpackage; intermediates."""

import os
import shutil
import subprocess
import sys

import pytest

from orebody.plans import durable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copied(folder, *without):
    shutil.copytree(ROOT, folder, ignore=lambda d, names: [n for n in names if n in {".git", "tests", "__pycache__", *without}])
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_entry_without_the_subpackage(tmp_path):
    found = copied(tmp_path / "a", "llm", "corpus_pipeline.py")
    assert found.returncode == 0 and found.stdout.split()[1] == "0" and int(found.stdout.split()[0]) > 70


def test_entry_shows_broken_imports(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "orebody", "llm")):
        pytest.skip("the subpackage isn't there")
    shutil.copytree(ROOT, tmp_path / "b", ignore=lambda d, names: [n for n in names if n in {".git", "tests", "__pycache__"}])
    with open(tmp_path / "b" / "orebody" / "llm" / "rules.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "b", env=os.environ | {"PYTHONPATH": str(tmp_path / "b")}, capture_output=True, text=True)
    assert found.returncode != 0 and "a_module_that_is_not_there" in found.stderr


def test_intermediates_are_removed(spark):
    kept = dict(durable._WRITTEN)
    durable._WRITTEN.clear()
    rows = durable.durable(spark.range(5), "five")
    (paths,) = durable._WRITTEN.values()
    assert rows.count() == 5 and os.path.isdir(paths[0].removeprefix("file:"))
    durable.clean(spark)
    assert not os.path.exists(paths[0].removeprefix("file:"))
    durable._WRITTEN.update(kept)
