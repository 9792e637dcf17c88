"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from talentloom.plans import catalog

HEADLINE = ("rank_topk", "skill_stats", "authenticity_parts", "behavioral", "jd_competencies",
            "ingest_jsonl", "percentile_rank", "dedup_best")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        begin = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    candidates = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    jobs = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "pairs_per_second": round(candidates * jobs / seconds["rank_topk"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
