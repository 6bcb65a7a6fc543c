"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crawlframe.plans.catalog import queries  # noqa: E402
from crawlframe.session import build_session  # noqa: E402

HEADLINE = (
    "outlinks_raw",
    "outlinks_resolved",
    "link_summary",
    "outlinks_by_context",
    "frontier_insert",
    "frontier_select",
    "robots_gate",
    "fetch_gate",
    "sitemap_entries",
    "robots_state",
    "politeness",
    "fetch_schedule",
    "warc_records",
    "warc_roundtrip",
    "crawl_round",
    "stream_robots",
    "stream_politeness",
    "stream_frontier",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/pages.parquet").selectExpr("max(length(html))").collect()
    known = queries()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
