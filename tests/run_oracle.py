"""Command line: run_oracle.py [sf] [name ...]"""

import sys
import time

from conftest import build_session
from oracle import compare, connect

from spanledger.catalog import REGISTRY

if __name__ == "__main__":
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for q in REGISTRY.values():
        if names and q.name not in names:
            continue
        t0 = time.time()
        try:
            if q.sql:
                msg = compare(q, spark, con, sf) or "ok"
            else:
                msg = f"rows {q.run(spark, f'/root/testdata/{sf}').count()}"
        except Exception as ex:  # noqa: BLE001
            msg = "ERROR " + str(ex).split("JVM stacktrace")[0][:700]
        print(f"{q.name:28s} {time.time() - t0:6.1f}s {msg}", flush=True)
