"""bench.py prints one JSON line with a timing per report (smoke run)."""

import json
import os
import subprocess
import sys

from helpers import ROOT, sf_dir


def test_bench_smoke(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR=sf_dir("0.001"), BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_QUERIES="campaign_stats,list_health", BENCH_TMP=str(tmp_path))
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.startswith("{")]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and rec["sf"] == "0.001"
    assert set(rec["queries"]) == {"campaign_stats", "list_health"}
    assert rec["value"] > 0
