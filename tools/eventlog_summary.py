"""Summarise a Spark event log written by ``bench.py`` (BENCH_EVENTLOG_DIR).

For the last timed run of each report: jobs, stages, tasks, bytes read from
files, shuffle bytes written, the longest task, and the stage whose longest
task is the most times its median task.  Usage:
    python tools/eventlog_summary.py <event-log-file-or-folder>
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def main(path: str) -> None:
    stage_report: dict[int, str] = {}
    job_report: dict[int, str] = {}
    last_run: dict[str, int] = {}
    metrics = defaultdict(lambda: defaultdict(float))
    task_ms = defaultdict(lambda: defaultdict(list))
    files = [path]
    if os.path.isdir(path):  # rolling event log (eventlog_v2_*): several event files
        files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(os.path.basename(f).split("_")[1]))
    events = []
    for f in files:
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        events.extend(json.loads(line) for line in raw.decode().splitlines() if line.strip())
    for ev in events:
        if ev["Event"] == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description")
            if not desc or "#" not in desc:
                continue
            name, run = desc.rsplit("#", 1)
            last_run[name] = max(last_run.get(name, 0), int(run))
            job_report[ev["Job ID"]] = desc
            for sid in ev.get("Stage IDs", []):
                stage_report[sid] = desc
    for ev in events:
        if ev["Event"] == "SparkListenerJobStart" and ev["Job ID"] in job_report:
            metrics[job_report[ev["Job ID"]]]["jobs"] += 1
        if ev["Event"] == "SparkListenerStageCompleted":
            desc = stage_report.get(ev["Stage Info"]["Stage ID"])
            if desc:
                metrics[desc]["stages"] += 1
        if ev["Event"] == "SparkListenerTaskEnd":
            desc = stage_report.get(ev["Stage ID"])
            tm = ev.get("Task Metrics") or {}
            if not desc or not tm:
                continue
            m = metrics[desc]
            m["tasks"] += 1
            m["input_bytes"] += tm.get("Input Metrics", {}).get("Bytes Read", 0)
            m["shuffle_write_bytes"] += tm.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
            m["max_task_ms"] = max(m["max_task_ms"], tm.get("Executor Run Time", 0))
            task_ms[desc][ev["Stage ID"]].append(tm.get("Executor Run Time", 0))
    print("| report | jobs | stages | tasks | input MB | shuffle written MB | longest task ms | most uneven stage: longest / median ms |")
    print("|---|---|---|---|---|---|---|---|")
    for name, run in last_run.items():
        m = metrics[f"{name}#{run}"]
        pairs = [(max(x), statistics.median(x)) for x in task_ms[f"{name}#{run}"].values() if len(x) > 1]
        top, mid = max(pairs, key=lambda p: p[0] / max(p[1], 1), default=(0, 0))
        print(f"| {name} | {int(m['jobs'])} | {int(m['stages'])} | {int(m['tasks'])} | "
              f"{m['input_bytes'] / 1e6:.2f} | {m['shuffle_write_bytes'] / 1e6:.3f} | {int(m['max_task_ms'])} | {top} / {mid:g} |")


if __name__ == "__main__":
    main(sys.argv[1])
