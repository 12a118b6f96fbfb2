"""Summarise a Spark event log: wall time per job and the slowest stages.

    python tools/stage_times.py <event-log-file> [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def _lines(path: str):
    """Lines of an event log: a file, or a rolling-log folder (events_* files)."""
    files = ([os.path.join(path, n) for n in sorted(os.listdir(path)) if n.startswith("events")]
             if os.path.isdir(path) else [path])
    for fp in files:
        if fp.endswith(".zstd"):
            import io

            import zstandard
            with open(fp, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(fp, encoding="utf-8") as f:
                yield from f


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages, jobs = {}, {}
    for line in _lines(path):
        e = json.loads(line)
        kind = e.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = e["Stage Info"]
            t0, t1 = info.get("Submission Time"), info.get("Completion Time")
            if t0 and t1:
                stages[info["Stage ID"]] = (t1 - t0, info["Stage Name"], info["Number of Tasks"])
        elif kind == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None]
        elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    total = sum((b - a) for a, b in jobs.values() if b)
    print(f"jobs: {len(jobs)}, summed job time {total / 1000:.1f}s, stages: {len(stages)}")
    for sid, (ms, name, n) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"stage {sid:5d} {ms / 1000:7.2f}s tasks={n:5d} {name[:90]}")


if __name__ == "__main__":
    main()
