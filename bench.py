"""Headline queries on the sample tables; prints one line of JSON.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) set the
data and the cores.  Every query is run ``BENCH_RUNS`` times (default 2) into a sink that
computes all rows and keeps none; the best time counts.
"""

from __future__ import annotations

import json
import os
import time

from gridloom.catalog import tables as tb
from gridloom.operators import aggregates, factors, products, sampling
from gridloom.plans import cp, incremental
from gridloom.session import local_session
from gridloom.sources import densify, random_factors, slice_window
from gridloom.model import make_model


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))

    events = tb.events_tensor(spark, folder).store()
    sales = tb.sales_tensor(spark, folder).store()
    sizes = tb.brand_sizes(spark, folder, (sales.shape[1], 51)).store()
    model = make_model(random_factors(spark, events.shape, 10, 6), events.shape, 10)
    months = sales.shape[2]
    old = slice_window(sales, 2, 0, months * 2 // 3)
    new = slice_window(sales, 2, months * 2 // 3, months)

    def sample():
        weights = aggregates.slice_weights(events)
        half = incremental.sample_sizes(events.shape, 2)
        maps = sampling.sample_modes(weights, half, events.shape, 5, 2)
        return sampling.sample_subtensor(events, maps, half, 2)

    def step():
        start = cp.cp_als(old, rank=5, max_iter=1)
        state = incremental.incremental_step(
            incremental.start_state(old, start), new, 2, factor=2, reps=2, max_iter=5, tol=1e-4
        )
        return state.model.table()

    def wide():
        """As if no factor could be broadcast: cells in blocks, factor rows sent to them."""
        spark.conf.set("gridloom.broadcast.maxBytes", "0")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return cp.cp_als(sales, rank=5, max_iter=2, tol=0.0).table()
        finally:
            spark.conf.unset("gridloom.broadcast.maxBytes")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    queries = {
        "events_tensor": lambda: tb.events_tensor(spark, folder, shaped=False).frame,
        "sales_tensor": lambda: tb.sales_tensor(spark, folder, shaped=False).frame,
        "densify": lambda: densify(events).frame,
        "slice_weights": lambda: aggregates.slice_weights(events),
        "sample_subtensor": sample,
        "mode_multiply": lambda: products.mode_multiply(sales, 1, sizes, 0).frame,
        "subtract": lambda: (events - events).frame,
        "gramian_64": lambda: factors.gramian(tb.vectors_factor(spark, folder), 64),
        "mttkrp_rank10": lambda: cp.mttkrp(events, model, 0),
        "relative_error_rank10": lambda: cp.relative_error(events, model),
        "reconstruct_rank10": lambda: cp.reconstruct(model).frame,
        "als_rank5_5_sweeps": lambda: cp.cp_als(sales, rank=5, max_iter=5, tol=0.0).table(),
        "incremental_step_rank5": step,
        "als_unbroadcast_rank5_2_sweeps": wide,
    }
    times = {}
    for name, build in queries.items():
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
