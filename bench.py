"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

``python bench.py sweep cpus|split|size [QUERY]``: the same query over numbers of cores, sizes of splits or sizes of tables,
one JSON line a setting, each in a session of its own, with speedup and efficiency against the first one.
``python bench.py modes [QUERY]``: the same query over the same table in each mode, with speedup over one core and whether its
result is that of one core; the last line is one verdict for all modes.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import time

HEADLINE = ["byte_histogram", "nucleotide_count", "nucleotide_count_by_record", "invalid_detail", "diff_summary", "diff_density", "first_k_diffs", "pair_records", "interleave", "pattern_count", "zone_density", "clean_offsets", "position_to_record", "interval_union", "overlap_seconds", "speedup", "resource_summary", "fasta_counts"]
SWEEPS = {"cpus": ("BENCH_CPUS", ["1", "2", "4", "8"]), "split": ("BENCH_SPLIT", ["1m", "4m", "16m", "64m"]), "size": ("BENCH_SF_DIR", [f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1")])}
MODES = {"one core": {"BENCH_CPUS": "1"}, "all cores": {}, "all cores, splits of 1 MB": {"BENCH_SPLIT": "1m"}, "all cores, not adaptive": {"BENCH_ADAPTIVE": "false"}}


def timed(names: list[str]) -> dict:
    from pyspark.sql import SparkSession

    from strandspark.operators.measurement import digest
    from strandspark.plans.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": os.environ.get("BENCH_SPLIT", "4m"), "spark.sql.adaptive.enabled": os.environ.get("BENCH_ADAPTIVE", "true"), "spark.local.dir": tempfile.mkdtemp(prefix="spark-bench-")}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    digests: dict[str, list] = {}
    for name in names:
        best = None
        for _ in range(2):  # the first run compiles code
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        times[name] = round(best, 3)
        if os.environ.get("BENCH_DIGEST"):
            digests[name] = list(digest(QUERIES[name](spark, folder)).first())
    return {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]} | ({"digests": digests} if digests else {})


def apart(name: str, settings: dict[str, str]) -> dict:
    """What ``timed`` gives in a session of its own."""
    done = subprocess.run([sys.executable, __file__, name], env=os.environ | settings, capture_output=True, text=True, check=True)
    return json.loads(done.stdout.strip().splitlines()[-1])


def modes(name: str) -> bool:
    base, same = None, True
    for mode, settings in MODES.items():
        run = apart(name, settings | {"BENCH_DIGEST": "1"})
        base = base or run
        equal = run["digests"] == base["digests"]
        same &= equal
        row = {"query": name, "mode": mode, "seconds": run["value"], "speedup": round(base["value"] / run["value"], 3), "rows": run["digests"][name][0], "result_ok": equal}
        print(json.dumps(row), flush=True)
    print(json.dumps({"query": name, "modes": len(MODES), "all_equal": same}), flush=True)
    return same


def sweep(kind: str, name: str) -> None:
    variable, settings = SWEEPS[kind]
    base = None
    for setting in settings:
        seconds = apart(name, {variable: setting})["value"]
        base = base or seconds
        row = {"query": name, kind: setting, "seconds": seconds, "speedup": round(base / seconds, 3)}
        print(json.dumps(row | ({"efficiency_pct": round(100 * base / seconds / int(setting), 1)} if kind == "cpus" else {})), flush=True)


if __name__ == "__main__":
    if sys.argv[1:2] == ["sweep"]:
        sweep(sys.argv[2], (sys.argv[3:] or ["nucleotide_count"])[0])
    elif sys.argv[1:2] == ["modes"]:
        sys.exit(not modes((sys.argv[2:] or ["nucleotide_count"])[0]))
    else:
        print(json.dumps(timed(sys.argv[1:] or HEADLINE)))
