"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wageband.session import local_session
from workload.queries import QUERIES

HEADLINE = [
    "salary_band_distribution", "salary_parse_documents", "keyword_flags", "proxy_dataset",
    "rf_ready", "dedup_keep_last", "seen_url_anti_join", "merge_latest_wins", "balance_cap",
    "quota_accept", "keyword_cap", "low_band_augment", "stratified_split", "class_deficit",
    "classification_report", "page_cards", "page_text", "merge_session", "merge_first_wins",
    "impute_embeddings", "delimited_layouts", "keyword_cap_known", "stream_dedup_quota",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))[2:],
    }))


if __name__ == "__main__":
    main()
