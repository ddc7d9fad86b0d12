"""Headline queries, timed: one JSON line with the seconds of each, cold, over all of its rows."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = [
    "security_by_type", "security_issues_patches", "chunks_function", "chunks_code", "chunk_numbers", "classified_imports",
    "file_summaries", "diff_lines", "comments_on_diff", "pr_rollup", "token_batches", "nearest_vectors_other_file",
    "embedded_chunks", "context_texts", "dash_cumulative_cost_by_repo", "dash_error_rate", "rollup_by_type",
    "deliveries_routed", "signatures", "stream_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.queries import QUERIES

    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up of the session is not measured
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
