"""Stage and task times of registered queries, from Spark's event log.

Runs each query once (after one warm-up call) with the event log written under the
shared checkpoint folder, then summarises per query: stages, tasks, executor time,
the largest task against the median task of each stage (skew), shuffle bytes written
and bytes spilled.  Writes STAGES.md.

usage: python scripts/stage_times.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adlens.plans import catalog  # noqa: E402
from adlens.session import build_session  # noqa: E402

DEFAULT = ["keywords_top10", "top_keywords_per_category", "search_both", "pages_per_hour",
           "classify", "classify_bucketed", "collection_roundtrip"]


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.1"
    names = args or DEFAULT
    log_dir = tempfile.mkdtemp(prefix="adlens-eventlog-")  # a local measurement tool
    spark = build_session("local[8]", 8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.compress": "false",
                                                 "spark.eventLog.dir": log_dir})
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        spark.sparkContext.setJobGroup(name, name)
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup("", "")
    spark.stop()

    stage_query: dict[int, str] = {}
    tasks: dict[int, list[dict]] = {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id") or ""
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_query[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    info, m = ev.get("Task Info", {}), ev.get("Task Metrics") or {}
                    tasks.setdefault(ev["Stage ID"], []).append({
                        "ms": info.get("Finish Time", 0) - info.get("Launch Time", 0),
                        "shuffle_w": (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0),
                        "spill": m.get("Memory Bytes Spilled", 0) + m.get("Disk Bytes Spilled", 0),
                    })

    out = ["# Stage and task times (from Spark's event log)", "",
           f"`scripts/stage_times.py` on `{sf_dir}`, `local[8]`, one run after a warm-up.",
           "Per stage: tasks, max and median task time (max/median near 1 means no skew),",
           "shuffle bytes written, bytes spilled.", ""]
    for name in names:
        sids = sorted(s for s, q in stage_query.items() if q == name and s in tasks)
        out += [f"## {name}", "", "| stage | tasks | max ms | median ms | shuffle written | spilled |",
                "| --- | --- | --- | --- | --- | --- |"]
        for s in sids:
            t = tasks[s]
            ms = [x["ms"] for x in t]
            out.append(f"| {s} | {len(t)} | {max(ms)} | {int(statistics.median(ms))} | "
                       f"{sum(x['shuffle_w'] for x in t):,} | {sum(x['spill'] for x in t):,} |")
        out.append("")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(os.path.join(root, "STAGES.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
