"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1),
BENCH_QUERIES (comma-separated names, or ``all``), BENCH_SHARED_DIR (folder for intermediate tables; default: the
warehouse of the local session).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.catalog import QUERIES  # noqa: E402
from tideline.session import clean, get_session  # noqa: E402

HEADLINE = [
    "agg_summary", "agg_box", "agg_collapse", "cast_wide", "join_baseline", "join_multi_key", "melt_ids",
    "win_first_ties", "win_peak", "win_topn", "topk_global", "level_by_order",
    "stat_km", "stat_logrank", "stat_ranksum", "stat_kruskal", "stat_dunn", "stat_holm", "stat_bh", "stat_gated",
    "coh_peak", "coh_first_detection", "coh_extremes", "coh_endpoint_titer", "coh_percent_reduction",
    "txt_temperature", "txt_chemistry", "txt_subject_table",
    "mat_filter", "mat_tmm", "mat_logcpm", "mat_oneway", "mat_lm", "mat_batch", "mat_ebayes", "mat_pca", "mat_voom",
    "omx_conc_de", "omx_count_de",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            **({"spark.checkpoint.dir": os.environ["BENCH_SHARED_DIR"]} if "BENCH_SHARED_DIR" in os.environ else {}),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["coh_peak"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    took = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    line = {"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))
    clean(spark)
    spark.stop()


if __name__ == "__main__":
    main()
