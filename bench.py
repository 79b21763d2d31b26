"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores; names on the command line choose queries.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "theme_report",
    "theme_report_completed",
    "theme_report_vectors",
    "theme_assignment",
    "theme_centroids",
    "theme_review_lists",
    "partial_final_equivalence",
    "best_example_per_theme",
    "reconcile_rows",
    "volume_per_product",
    "volume_buckets",
    "positive_ratio_min_reviews",
    "playtime_stats",
    "playtime_histogram",
    "playtime_global",
    "clean_text",
    "clean_html",
    "json_flatten",
    "json_rollup_summary",
    "product_identity",
    "capped_sample",
    "chunk_texts",
    "merged_lists",
    "text_join_fanout",
    "resume_remaining",
    "checkpoint_merge",
    "hashed_vectors",
    "tfidf_top_terms",
    "class_tfidf_terms",
    "seeded_kmeans",
    "seeded_text_kmeans",
    "guided_text_topics",
    "density_topics",
    "windowed_event_counts",
    "sketched_days",
    "extractive_summary_by_theme",
    "incremental_theme_counts",
    "incremental_centroids",
    "incremental_labels",
]


# The large case repeats the English reviews under new keys until there are this many.
LARGE_REVIEWS = 300_000


def large_cases(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, float]]:
    """The theme report over at least LARGE_REVIEWS reviews, and summaries of a fifth of them: seconds and reviews a second."""
    from reviewspark.catalogue.binding import english_reviews, themes
    from reviewspark.operators.summaries import hierarchical_summary
    from reviewspark.operators.themes import assign_by_text
    from reviewspark.plans.report import KEYS, theme_report

    few = english_reviews(spark, sf_dir)
    n = few.count()
    copies = -(-LARGE_REVIEWS // max(1, n))
    folder = tempfile.mkdtemp(prefix="reviewspark-bench-")
    many = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    many.withColumn("review_id", F.col("review_id") * copies + F.col("copy")).drop("copy").write.parquet(f"{folder}/reviews")
    reviews = spark.read.parquet(f"{folder}/reviews")
    some = assign_by_text(reviews.filter(F.col("review_id") % 5 == 0), themes(spark))
    some.select("review_id", *KEYS, "voted_up", "review").write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    cases = {
        "large_theme_report": (n * copies, lambda: theme_report(reviews, themes(spark))),
        "large_summaries": (assigned.count(), lambda: hierarchical_summary(assigned, [*KEYS, "voted_up"], "review_id", "review", 50)),
    }
    found = {}
    for name, (rows, make) in cases.items():
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        found[name] = {"reviews": rows, "seconds": round(took, 3), "reviews_per_second": round(rows / took, 1)}
    shutil.rmtree(folder, ignore_errors=True)
    return found


def main(names: list[str]) -> None:
    from reviewspark.catalogue import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("reviewspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # Small tables in splits for all cores.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM, the Python workers and the Parquet reader before the clock runs.
    for warm in ("row_count", "partition_function"):
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    large = {} if names else large_cases(spark, sf_dir)
    print(
        json.dumps(
            large
            | {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
