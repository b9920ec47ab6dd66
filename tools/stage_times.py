"""Print stage durations from a Spark event log (zstd or plain JSON lines).

Usage: python tools/stage_times.py <event-log-dir-or-file>
"""

import glob
import io
import json
import os
import sys


def lines(path):
    if os.path.isdir(path):
        files = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True))
        files = [f for f in files if os.path.isfile(f)]
    else:
        files = [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        yield from raw.decode("utf-8").splitlines()


def main():
    total = 0.0
    for line in lines(sys.argv[1]):
        e = json.loads(line)
        if e["Event"] != "SparkListenerStageCompleted":
            continue
        si = e["Stage Info"]
        d = (si["Completion Time"] - si["Submission Time"]) / 1000
        total += d
        acc = {a.get("Name"): a.get("Value") for a in si.get("Accumulables", [])}
        print(f'{si["Stage ID"]:4d} tasks={si["Number of Tasks"]:4d} {d:7.2f}s '
              f'in={acc.get("internal.metrics.input.bytesRead", 0)} '
              f'shuf_r={acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or acc.get("internal.metrics.shuffle.read.localBytesRead", 0)} '
              f'{si["Stage Name"][:40]}')
    print(f"sum of stage durations {total:.2f}s")


if __name__ == "__main__":
    main()
