"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanledger import build_session  # noqa: E402
from spanledger.catalog import REGISTRY  # noqa: E402

HEADLINE = (
    "future_label", "timed_totals", "stay_totals_fold", "counted_services", "income_total", "window_features",
    "anchor_grid", "lag_assembly", "static_features", "client_collapse", "episode_export", "client_basics",
    "assessment_export", "modules_listagg", "answers_pivot", "question_roots", "onehot_multi", "standard_scale",
    "decile_bins", "hash_split", "kfold_assign", "oversample_parity", "roc_auc_fine", "prf_thresholds",
    "minority_knn", "rule_importance", "greedy_pick", "kproto_assign", "kproto_update", "silhouette", "explain_batch",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("spanledger-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/region.parquet").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
