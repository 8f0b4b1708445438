"""The entry loads without a session, from another folder, and with Spark's zipped Python package."""

import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path[:0] = [{path!r}, {root!r}]
import __spark_entry__ as entry
import pyspark
assert {zipped!r} == ("pyspark.zip" in pyspark.__file__), pyspark.__file__
from pyspark import SparkContext
names, sql = entry.queries(), entry.oracle_sql()
assert SparkContext._active_spark_context is None
assert len(names) > 100 and set(sql) <= set(names) and all(isinstance(x, str) for x in sql.values())
"""


def loads(tmp_path, zipped):
    lib = Path(pyspark.__file__).parent / "python" / "lib"
    path = [str(p) for p in lib.glob("*.zip")] if zipped else []
    code = CODE.format(path="", root=str(ROOT), zipped=zipped).replace("''", "*" + repr(path), 1)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_loads_without_a_session(tmp_path):
    loads(tmp_path, zipped=False)


def test_loads_with_zipped_spark(tmp_path):
    loads(tmp_path, zipped=True)
