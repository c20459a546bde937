"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (cores), BENCH_QUERIES (names,
space-separated, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyspark.queries import QUERIES  # noqa: E402
from tallyspark.session import local_session  # noqa: E402

HEADLINES = [
    "monthly_summary",
    "running_balance",
    "upsert_current_prices",
    "totals_by_period",
    "position_values",
    "bars_5_minutes",
    "moving_averages",
    "bollinger_bands",
    "relative_strength",
    "exponential_averages",
    "forward_back_fill",
    "interpolated_readings",
    "quality_columns",
    "quality_scores",
    "zscore_outliers",
    "iqr_outliers",
    "density_noise",
    "change_points",
    "seasonal_anomalies",
    "card_risk_scores",
    "amount_frequency",
    "v_outliers",
    "census_features",
    "article_relevance",
    "article_sentiment",
    "news_feed",
    "vote_states",
    "course_progress",
    "portfolio_analytics",
    "consensus_prices",
    "coin_lookup",
    "login_risk",
    "unusual_hours",
    "lockouts",
    "rate_limits",
    "ranking_metrics",
    "description_vectors",
    "streamed_bars",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split() or HEADLINES
    spark = local_session(cpus, "bench")
    # One small query first, so that starting up is not charged to the first headline.
    QUERIES["bar_coverage"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
