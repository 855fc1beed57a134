"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and the cores.
"""

import json
import os
import time

from barwise.plans import catalog
from barwise.session import local_session

HEADLINE = [
    # ingestion
    "cleanse_bars", "dedup_bars", "dq_report", "ingest_quality_report",
    # feature engineering
    "returns", "feature_set", "silver_features", "rolling_beta", "rolling_sharpe", "ema_exact",
    # market analysis
    "sector_performance", "top_performers", "equity_rankings", "volatility_regime", "market_breadth",
    "correlation_pairs", "sector_correlation",
    # risk and scenarios
    "risk_metrics", "sector_var", "portfolio_vs_benchmark", "scenario_returns_long",
    "sector_scenario_agg",
    # reporting
    "investment_signals", "m_risk", "m_horizon", "m_rolling", "report_kpis", "market_summary", "report_bundle", "layer_audit",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors
    seconds = {}
    for name in names:
        start = time.time()
        catalog.BUILDERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
