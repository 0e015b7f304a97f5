"""Per-query input and shuffle volume, read from Spark's event log.

Usage: python tools/shuffle_report.py [sf_dir] [query ...]

Runs each registered query (to the ``noop`` sink) under its own job group
with the event log written to a fresh scratch folder, then sums the task
metrics per query: records read from files, records and bytes written to
shuffles, and the largest single-task shuffle read (a skew signal). Prints
one JSON line per query and a markdown table. The ratio of shuffle records
to input records is what extrapolates to large inputs.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlens import registry  # noqa: E402
from eventlens.session import build_session  # noqa: E402


def _roll_index(path: str) -> tuple:
    m = re.search(r"events_(\d+)_", os.path.basename(path))
    return (int(m.group(1)) if m else 0, path)


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh:
            reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            yield from reader
    elif not path.endswith((".lz4", ".snappy", ".lzf")):
        with open(path, encoding="utf-8") as fh:
            yield from fh


def parse(log_dir: str) -> dict[str, dict]:
    stage_group: dict[int, str] = {}
    totals: dict[str, dict] = defaultdict(lambda: defaultdict(int))
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    files.sort(key=_roll_index)
    for path in files:
        for line in _lines(path):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        if group:
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if not group or not m:
                        continue
                    t = totals[group]
                    inp = m.get("Input Metrics", {})
                    sw = m.get("Shuffle Write Metrics", {})
                    sr = m.get("Shuffle Read Metrics", {})
                    t["tasks"] += 1
                    t["input_records"] += inp.get("Records Read", 0)
                    t["input_bytes"] += inp.get("Bytes Read", 0)
                    t["shuffle_records"] += sw.get("Shuffle Records Written", 0)
                    t["shuffle_bytes"] += sw.get("Shuffle Bytes Written", 0)
                    read = sr.get("Total Records Read", 0)
                    if read == 0:
                        read = sr.get("Local Records Read", 0) + sr.get("Remote Records Read", 0)
                    t["max_task_shuffle_read"] = max(t["max_task_shuffle_read"], read)
    return {k: dict(v) for k, v in totals.items()}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    only = sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="run-eventlog-")
    spark = build_session("local[8]", app_name="eventlens-shuffle-report", shuffle_partitions=8,
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false"})
    sc = spark.sparkContext
    for name, fn in registry.QUERIES.items():
        if only and name not in only:
            continue
        sc.setJobGroup(name, name)
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001 - report and go on (e.g. a layout a query does not read)
            print(f"skipped {name}: {str(exc).splitlines()[0][:200]}", file=sys.stderr)
    sc.setJobGroup("done", "done")
    spark.stop()
    names = set(registry.QUERIES)
    report = {k: v for k, v in parse(log_dir).items() if k in names}
    print("| Query | Input records | Shuffle records | Shuffle bytes | Shuffle records / input record | Max task shuffle read |")
    print("|---|---|---|---|---|---|")
    for name in sorted(report):
        r = report[name]
        ratio = r.get("shuffle_records", 0) / r["input_records"] if r.get("input_records") else 0
        print(f"| `{name}` | {r.get('input_records', 0)} | {r.get('shuffle_records', 0)} | "
              f"{r.get('shuffle_bytes', 0)} | {ratio:.4f} | {r.get('max_task_shuffle_read', 0)} |")
    print(json.dumps({"sf_dir": sf_dir, "event_log": log_dir, "queries": report}))


if __name__ == "__main__":
    main()
