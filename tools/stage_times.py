"""Stage times and shuffle volumes from a Spark event log (no UI needed).

Run a query with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir``
pointing at a scratch folder, then:

    python tools/stage_times.py /tmp/run-XXXX [job-group]

Prints, per job (optionally only one job group): start offset, duration,
and per stage: tasks, duration, shuffle bytes written/read.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    root = sys.argv[1]
    group = sys.argv[2] if len(sys.argv) > 2 else None
    files = sorted(p for p in glob.glob(os.path.join(root, "**"), recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    jobs, stages, stage_job = {}, {}, {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            ev = e["Event"]
            if ev == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                if group is None or g == group:
                    jobs[e["Job ID"]] = {"start": e["Submission Time"], "end": None, "stages": e["Stage IDs"]}
                    for sid in e["Stage IDs"]:
                        stage_job[sid] = e["Job ID"]
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]]["end"] = e["Completion Time"]
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                acc = {a["Name"]: a.get("Value") for a in si.get("Accumulables", [])}
                read = sum(int(acc.get(k, 0) or 0) for k in ("internal.metrics.shuffle.read.remoteBytesRead",
                                                              "internal.metrics.shuffle.read.localBytesRead"))
                stages[si["Stage ID"]] = {
                    "tasks": si["Number of Tasks"],
                    "dur": ((si.get("Completion Time") or 0) - (si.get("Submission Time") or 0)) / 1000,
                    "write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
                    "read": read}
    if not jobs:
        print("no jobs found")
        return
    t0 = min(j["start"] for j in jobs.values())
    for jid, j in sorted(jobs.items()):
        dur = ((j["end"] or j["start"]) - j["start"]) / 1000
        print(f"job {jid}: +{(j['start'] - t0) / 1000:.2f}s dur {dur:.2f}s")
        for sid in j["stages"]:
            s = stages.get(sid)
            if s:
                print(f"  stage {sid}: tasks {s['tasks']} dur {s['dur']:.2f}s "
                      f"shuffle write {s['write']:,} B read {s['read']:,} B")


if __name__ == "__main__":
    main()
