"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores;
query names on the command line replace the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpusweave.plans import load_all
from corpusweave.plans.registry import CATALOG
from corpusweave.session import get_session

HEADLINE = (
    "text_terms", "dedup_canonical", "chunk_packed", "chunk_statistics", "html_blocks", "dense_topk", "page_constrained_topk",
    "card_ranking", "fused_page_evidence", "router_metrics", "bm25_topk", "hybrid_topk", "hybrid_metrics", "phrase_owners",
    "contamination_runs", "lexical_rerank", "evidence_rerank", "context_items", "evidence_scores", "extractive_answers",
    "grounding_check", "novel_sentences", "followup_resolution", "auroc", "threshold_sweep", "percentile_variants",
    "log_summary", "rate_limit_decisions", "sessions", "hierarchy_descendants",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__driver__extraJavaOptions="-Dlog4j2.level=error",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder}
        )
    )


if __name__ == "__main__":
    main()
