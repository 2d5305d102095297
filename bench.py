"""Headline benchmark: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default all headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "agg01_kpis",
    "agg04_pareto",
    "agg04_pareto_filtered_units",
    "agg11_handling_box",
    "agg14_heatmap",
    "agg16_completeness_by_field",
    "agg17_anomaly_matrix",
    "flt05_filter_options",
    "win02_pareto_table",
    "prf02_duplicate_report",
    "prf03_iqr_outliers_price",
    "prf04_infer_types",
    "prf07_profile_columns",
    "dq07_quality_score",
    "dq08_violations",
    "dq13_quality_report",
    "sta01_describe_price",
    "sta05_chi_square",
    "sta08_shapiro_by",
    "rca01_identify_main_cause",
    "pii02_mask_text",
    "val01_quarantined",
    "val03_migration_failures",
    "ops15_send_outcomes",
    "ops18_replay_transitions",
    "ops27_check_decisions_in_order",
    "ml05_risk_report",
    "ext05_cusum",
    "ext06_daily_anomalies",
    "src22_ingest_run",
)


def main() -> None:
    from casemill.session import local_session
    from casemill.workload import load_all
    from casemill.workload.registry import QUERIES

    load_all()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    # One small run starts the executor threads and loads the classes that every query needs.
    QUERIES["agg01_kpis"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
