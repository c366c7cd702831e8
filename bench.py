"""Time every bookkeeping query and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query is planned from scratch and its whole result is computed and thrown away. One
untimed run of the first query warms the JVM up. Each time goes to the error output as it comes. After
BENCH_SECONDS (default 1500) no further query is begun; the line then names those not reached.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload import QUERIES  # noqa: E402

HEADLINE = ["quarterly_net", "quarterly_net_items", "ledger_lines", "rule_match_general", "review_flags", "comparison"]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE + sorted(set(QUERIES) - set(HEADLINE))
    begun, limit = time.perf_counter(), float(os.environ.get("BENCH_SECONDS", "1500"))
    QUERIES["quarterly_net"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        if start - begun > limit:
            break
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    missed = {"not_reached": names[len(seconds):]} if len(seconds) < len(names) else {}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"), **missed,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
