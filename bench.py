"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from tallyloom.session import session
from workload.queries import REGISTRY

HEADLINE = (
    "patterns_by_size",
    "top_patterns",
    "patterns_two_populations",
    "patterns_wide",
    "size_distribution",
    "size_by_band1_margins",
    "roster_matrix",
    "roster_persons",
    "margin_type_given_head_size",
    "margin_type_from_sheet",
    "margin_child",
    "fit_size",
    "fit_band_by_size",
    "shortfall",
    "group_variance",
    "fill_down",
    "row_ids",
    "draw_weighted",
    "draw_conditional",
    "draw_normal",
    "dist_joint",
    "derived_age",
    "replicate_fit",
    "drift_monitor",
    "drift_by_stratum",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="16g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first pass compiles code; the median of the three after it counts.
    for name in HEADLINE:
        run(name)
    times = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
