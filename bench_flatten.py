"""The whole flattening flow at the published size: the mesh over `orders`, 7 rings of 12 samples, default schedule. One JSON line.

$BENCH_SF_DIR names the tables (sf0.1: 149,769 vertices). The kernel of a mesh is one task; $BENCH_TASK_CPUS cores are given to it, the other steps run on
local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import threading
import time

from pyspark.sql import SparkSession

from meshql.operators import flatten
from meshql.operators.checkpoints import settled
from meshql.plans.meshgen import table_mesh


def peak_of_workers(seen: list[int], stop: threading.Event) -> None:
    """The largest resident size in MB that any Python worker has had."""
    while not stop.wait(1.0):
        for pid in filter(str.isdigit, os.listdir("/proc")):
            try:
                with open(f"/proc/{pid}/cmdline") as f:
                    worker = "pyspark.daemon" in f.read() and int(pid) != os.getpid()
                if worker:
                    with open(f"/proc/{pid}/status") as f:
                        seen[0] = max(seen[0], *[int(x.split()[1]) // 1024 for x in f if x.startswith("VmHWM")])
            except (OSError, ValueError, TypeError):
                continue


def main() -> None:
    sf_dir, cpus, own = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_TASK_CPUS", "1")

    def session(task_cpus: str) -> SparkSession:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("bench_flatten").config("spark.task.cpus", task_cpus)
            .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        return spark

    spark, took, peak, stop = session(own), {}, [0], threading.Event()
    threading.Thread(target=peak_of_workers, args=(peak, stop), daemon=True).start()
    mesh = table_mesh(spark, sf_dir)
    job = flatten.Flattener()
    began = time.perf_counter()
    job.load(settled(mesh.vertices), settled(mesh.faces))
    took["load"] = time.perf_counter() - began
    began = time.perf_counter()
    job.compute_distances()
    took["distances"] = time.perf_counter() - began
    n_pairs = job.kring.count()
    began = time.perf_counter()
    shots = job.run()
    took["run"] = time.perf_counter() - began
    (end,) = flatten.run_metrics(shots, job.kring, job.vertices).collect()
    steps = shots.agg({"step": "max"}).first()[0]
    out = {"metric": "published_size_seconds", "value": round(took["run"], 1), "unit": "sec", "steps": {k: round(v, 1) for k, v in took.items()}, "kernel": round(end["elapsed_s"], 1), "iterations": steps, "task_cpus": int(own)}
    out |= {"vertices": job.vertices.count(), "pairs": n_pairs, "flipped": [end["flipped_initial"], end["flipped_final"]], "pct_error": round(end["pct_error"], 2)}
    spark.stop()
    stop.set()
    print(json.dumps({**out, "worker_peak_mb": peak[0]}))


if __name__ == "__main__":
    main()
