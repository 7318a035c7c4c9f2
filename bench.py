"""Headline queries over the tables in $BENCH_SF_DIR; prints one JSON line.

Every query is run to completion into a sink that discards its rows, so nothing is collected. The
first two entries build what the others read: the registry text and its cleaned, classified form.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "k1_quality_datasets_written",
    "b1_quality_classes",
    "b5_flag_total",
    "f4_dataset_splits",
    "a1_department_year_stats",
    "a2_municipality_year_stats",
    "a3_property_kind_year_stats",
    "a6_department_summary",
    "a8_error_types",
    "a10_metric_table",
    "a14_column_profile",
    "a17_market_comparison",
    "a23_filter_funnel",
    "q1_risk_class_shares",
    "q2_departments_by_anomaly_rate",
    "q10_properties_with_anomalies",
    "b14_property_score",
    "b20_property_report",
    "b21_batch_analysis",
    "e3_rural_above_urban",
    "e6_relative_values",
    "e8_unified_anomalies",
    "e19_segment_outliers",
    "m1_transaction_features",
    "m8_forest_scores",
    "m9_novelty_scores",
    "m21_table_scored",
    "r4_nearest_documents",
    "t1_files_cleaned_and_loaded",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from folioscope.catalog import QUERIES
    from folioscope.catalog.base import cl, raw
    from folioscope.session import build_session

    shared = tempfile.TemporaryDirectory(prefix="bench-")
    memory = os.environ.get("BENCH_MEMORY", "16g")
    spark = build_session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": memory, "spark.checkpoint.dir": shared.name})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name:40s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)

    wanted = sys.argv[1:] or HEADLINE
    timed("registry_stored", lambda: run(raw(spark, FOLDER).limit(1)))
    timed("registry_cleaned_and_classified", lambda: run(cl(spark, FOLDER).limit(1)))
    for name in wanted:
        timed(name, lambda: run(QUERIES[name](spark, FOLDER)))
    rows = cl(spark, FOLDER).count()
    total = round(sum(seconds.values()), 3)
    rates = {
        f"{name}_rows_per_sec": round(rows / seconds[name])
        for name in ("registry_cleaned_and_classified", "k1_quality_datasets_written", "m8_forest_scores", "m21_table_scored")
        if name in seconds
    }
    found = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
        "rows": rows,
        **rates,
    }))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
