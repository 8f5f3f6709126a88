"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the threads. Every query runs to a sink that discards its rows, so all
columns of all rows are computed.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from avalista.catalog import QUERIES  # noqa: E402
from avalista.session import get_session  # noqa: E402

HEADLINE = [
    "default_rate_by_amount_bucket", "portfolio_summary", "multi_segment_rates", "top_risk_sectors", "describe",
    "histogram_amount", "box_stats", "build_features", "rule_expected_loss", "quote", "quote_summary",
    "apply_segment_factors", "risk_summary", "cumulative_loss_curve", "roc_curve", "evaluate_pd", "model_report",
    "train_risk_model",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # start-up of the session is not part of any query
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
