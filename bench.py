"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``build_states`` and ``window_states`` run from the raw events; the other queries start from the written state table or
the written forecast, as they would in use.
"""
from __future__ import annotations

import json
import os
import time

from netstate.operators.grid import build_states
from netstate.plans import registry
from netstate.plans.events import event_flows
from netstate.session import local_session

QUERIES = ["window_states", "regular_states", "source_info", "csv_ingest", "packet_idle_flows", "split_summary",
           "future_targets", "scaler_params", "scaled_states", "forecast_scores", "timeline", "forecast_long", "alert_log",
           "alert_open_at", "incident_table", "binary_metrics", "metrics_per_horizon", "onset_metrics", "stage_metrics",
           "threshold_choice", "episodes", "lead_time_summary", "drift_psi", "attributions", "scenario_summary",
           "source_coverage", "top_ports_of_windows", "observed_history", "traffic_checks"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    run(event_flows(spark, sf).groupBy("source").count())              # start the session and its code paths
    times = {}
    start = time.time()
    run(build_states(event_flows(spark, sf), registry.T3600))
    times["build_states"] = round(time.time() - start, 3)
    for name in QUERIES:
        start = time.time()
        run(registry.QUERIES[name](spark, sf))
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
