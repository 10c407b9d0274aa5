"""The package reaches Python workers of a session that was started from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from mailmetrics.session import local_session
spark = local_session(2, shuffle_partitions=2)
rows = entry.queries()["op9_langid"](spark, "/root/testdata/sf0.001")
print("rows", rows.count())
"""


def test_session_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
