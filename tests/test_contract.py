"""Driver contract: every query of the library has an oracle."""

import os
import re
import subprocess
import sys

import __spark_entry__ as E


def _own(keys):
    """Without the queries of the optional subpackage."""
    return {k for k in keys if k != "pipeline" and not re.match(r"op\d+_", k)}


def test_oracle_keys_have_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert _own(q) == _own(o)
    assert all(isinstance(v, str) and v.strip() for v in o.values())


def test_library_does_not_import_the_optional_subpackage():
    code = "import sys; from tiergate import registry; registry.load_all(); print([m for m in sys.modules if 'tiergate.llm' in m])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=E.__file__.rpartition("/")[0])
    assert out.stdout.strip() == "[]"


def test_workers_find_the_package_from_another_folder(tmp_path):
    """A driver that runs elsewhere, with the repository only on its own path, ships the package to the workers."""
    root = E.__file__.rpartition("/")[0]
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["rouge_l"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert "ROWS 1" in out.stdout, out.stderr[-2000:]
