"""The registry imports without a session, a jar or a given working folder, and workers need no package path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

IMPORTS = """
import sys; sys.path.insert(0, {repo!r})
import pyspark; pyspark.__file__ = "/nowhere/pyspark/__init__.py"
import __spark_entry__ as e
assert e.queries() and e.oracle_sql()
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
"""

WITHOUT = """
import sys; sys.path.insert(0, {repo!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "ranktide.llm"):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and set(e.oracle_sql()) <= set(names) and not [n for n in names if n.startswith("op") and n[2].isdigit()]
"""

RUNS = """
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
     .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as e
for name in ("vector_topk", "tfidf_similar", "retrieval_text_clean"):
    assert e.queries()[name](s, "/root/testdata/sf0.001").count() > 0, name
"""


def _run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code.format(repo=REPO)], cwd=cwd, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_registry_imports_without_session_or_jars(tmp_path):
    _run(IMPORTS, tmp_path)


def test_other_queries_remain_without_the_optional_folder(tmp_path):
    _run(WITHOUT, tmp_path)


def test_python_workers_from_another_folder(tmp_path):
    _run(RUNS, tmp_path)
