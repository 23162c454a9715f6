"""The driver imports __spark_entry__ from elsewhere, with a plain session of its own."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
import __spark_entry__ as E
assert E.entry(s).count() > 0
q = E.queries()
n = q['post_payments'](s, '/root/testdata/sf0.001').count()       # runs Python workers
assert n > 0, n
assert set(E.oracle_sql()) <= set(q)
print('OK', n)
"""


def test_entry_from_foreign_directory(tmp_path):
    if not os.path.exists("/root/testdata/sf0.001"):
        return
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env, capture_output=True,
                       text=True, timeout=600)
    assert r.returncode == 0 and "OK" in r.stdout, r.stderr[-2000:]
