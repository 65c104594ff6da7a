"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query's full result is computed through the
``noop`` sink (no collection to the driver)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkbars.plans import catalog  # noqa: E402
from sparkbars.session import build  # noqa: E402

HEADLINE = [
    "core_features",
    "regime_stats",
    "meta_labels",
    "trade_kpis",
    "nearest_bar_join",
    "grid_216",
    "best_policy",
    "trade_review",
    "wide_features",
    "price_metrics",
    "trading_signals",
    "resample_bars",
    "log_trade_entries",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
