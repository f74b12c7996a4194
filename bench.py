"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Nothing is cached between queries."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactline.plans import catalog, shared  # noqa: E402
from pactline.session import build_session  # noqa: E402

HEADLINE = ["flagship", "filter_deal_headlines", "deal_classify", "agg_cluster_rollup", "agg_best_deal", "tag_industries", "firm_match",
            "dedupe_canonical_url", "norm_urls", "dq_copied_runs", "dq_private_overlap", "geo_place_advisers",
            "cc_story", "stream_daily_counts", "cc_same_deal"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    budget = float(os.environ.get("BENCH_SECONDS", "900"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    start = time.time()
    for name in HEADLINE:
        if time.time() - start > budget:
            break
        fn = (lambda s, d: catalog.flagship(s, d)) if name == "flagship" else catalog.QUERIES[name]
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        shared.forget()
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
