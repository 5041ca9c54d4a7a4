"""Wall time of every operator; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of threads. Each
query runs whole, into a sink that drops the rows: once to warm the JVM up and
once for the clock.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.registry import HEADLINE


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(query) -> float:
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for query in HEADLINE.values():
        run(query)
    seconds = {name: round(run(query), 3) for name, query in HEADLINE.items()}
    spark.stop()
    print(json.dumps({
        "metric": "wall time of all operators, warm",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")),
    }))


if __name__ == "__main__":
    main()
