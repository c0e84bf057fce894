"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query is run once to warm up the JVM on its plan
shape and then timed once, writing all its columns to the no-op sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "technical_features", "forward_returns", "asof_fundamentals", "feature_label_dataset", "universe_membership",
    "market_feature_ranks", "universe_ranking", "top_fraction_selection", "book_summary", "total_return_index",
    "evidence_matching", "nearby_disclosures", "labelled_rows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from asofia.plans import catalog
    known = catalog()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in known:
            continue
        for _ in range(2):
            start = time.perf_counter()
            known[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
