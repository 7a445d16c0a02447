"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="riskspark-bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from riskspark.plans import registry as q
    from riskspark.plans.renewals import ranked_renewals
    from riskspark.sources.standins import standin_tables

    queries = {
        "ranked_renewals": lambda: ranked_renewals(standin_tables(spark, SF_DIR)),
        "features_and_scores": lambda: q.i4_score_all(spark, SF_DIR),
        "portfolio_totals": lambda: q.d14_portfolio_totals(spark, SF_DIR),
        "portfolio_insights": lambda: q.i6_portfolio_insights(spark, SF_DIR),
        "score_histogram": lambda: q.d13_score_histogram(spark, SF_DIR),
        "note_resolution": lambda: q.c9_resolve_notes(spark, SF_DIR),
        "keyword_signals": lambda: q.i7_note_signals(spark, SF_DIR),
        "rescore": lambda: q.i5_rescore(spark, SF_DIR),
        "account_narratives": lambda: q.i8_account_narrative(spark, SF_DIR),
    }
    times = {}
    for name, build in queries.items():
        laps = []
        for _ in range(RUNS + 1):  # the first lap warms up
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        times[name] = round(statistics.median(laps[1:]), 3)
    print(json.dumps({"metric": "median wall time, sum over headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
