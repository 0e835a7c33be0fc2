"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tessera.plans import registry

HEADLINE = (
    "bm25_topk", "bm25_all", "stored_bm25", "stored_retrieve", "rrf_fusion", "lexical_rerank", "hybrid_retrieve", "context_assembly", "cosine_topk", "tokens_count", "stem_vocab", "fnv_hash",
    "url_dedupe", "library_stats", "palette_search", "upsert_sources", "replace_chunks", "query_rewrite", "citation_resolve", "sentences", "chunks", "html_extract", "builtin_embedding", "robots_decision",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    spark = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    # One run of each family goes untimed: code is compiled, and the stored library written.
    for name in ("tokens_count", "hybrid_retrieve", "stored_retrieve"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
