"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Shared stages are dropped before every query, so each time includes its own
scan, bar building and features. One untimed pass over the smallest query warms
the JVM. Only the result is forced (noop sink); nothing is collected.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from panelwright.plans import catalog

HEADLINE = ["bars_supplier", "labels_forward", "features_momentum", "features_complete", "panel_zscore", "fold_summary",
            "permuted_labels", "ledger"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             # Very wide projections: let methods past the JIT limit fall back to split ones.
             .config("spark.sql.codegen.hugeMethodLimit", "8000").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        catalog.forget(spark)
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("bars_index")
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
