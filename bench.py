"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

import numpy as np
from pyspark.sql import functions as F

from tracelab.operators import changepoint
from tracelab.plans import catalog
from tracelab.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("bead_stats", "bead_qc_selected", "bm_sliding", "moving_average", "lag_variance_curve", "variance_kinetics", "psd", "kaplan_meier", "changepoint_exhaustive", "changepoint_gd", "em_pem", "em_gpem", "em_by_state", "ols_fit", "min_distance_filter", "track_gaussian", "pca_mixture")


def cubic(spark):
    """340 points of the cubic 10 x + 3 x^2 + x^3 with noise of deviation 30."""
    x = -9 + 0.05 * np.arange(340)
    y = 10 * x + 3 * x**2 + x**3 + np.random.default_rng(1).normal(0, 30, 340)
    return spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = build_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).agg(F.sum("id")).collect()
    seconds: dict[str, float] = {}

    def run(name, call):
        began = time.perf_counter()
        call()
        seconds[name] = round(time.perf_counter() - began, 3)

    for name in HEADLINE:
        run(name, lambda name=name: catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    points = cubic(spark)
    run("cubic_batch_descent", lambda: changepoint.cubic_descent(points))
    run("cubic_minibatch_descent", lambda: changepoint.cubic_minibatch(points))
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
