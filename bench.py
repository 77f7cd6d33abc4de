"""Headline queries, wall-clock seconds each, one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

from threadweave.session import build_session

QUERIES = [
    "support_pairs", "pair_quality_counters", "brand_linked_posts", "thread_roots", "conversation_table",
    "tag_strong_intents", "theme_counts", "pattern_overlap", "top_bigrams", "weak_labels", "weak_intent_counts",
    "stratified_split", "tfidf_vocabulary", "tfidf_topk", "classification_report", "train_logreg",
    "draft_replies", "escalation_rates", "judge_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from registry.queries import QUERIES as registered

    # Start-up (JVM warm-up, first scan) is not part of any query.
    registered["classification_metrics"](spark, folder).collect()
    took: dict[str, float] = {}
    for name in QUERIES:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
