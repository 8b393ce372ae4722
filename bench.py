"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Every query is materialised in full; the first run of each warms the JVM and the
second one counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from navspark.catalogue import all_queries  # noqa: E402
from navspark.session import build_session  # noqa: E402

HEADLINE = [
    "nmea_checksum", "nmea_parse_gga", "epoch_merge", "epoch_dynamics", "nearest_pairing",
    "recording_features", "window_features", "inject_drift", "column_profile",
    "impute_clip_scale", "ks_two_sample", "feature_auc_screen", "policy_evaluation", "split_kfold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = all_queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
