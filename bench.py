"""Times the headline queries and prints one JSON line; set BENCH_SF_DIR and BENCH_CPUS to change the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog.queries import QUERIES  # noqa: E402
from catalog.relations import CUSTOMERS, PARTS, SEGMENTS, SUPPLIER  # noqa: E402
from softdeps.functions.distances import measures_for  # noqa: E402
from softdeps.operators.pairs import profile_vectors, staged_profiles  # noqa: E402
from softdeps.plans.discover import combinations, vector_front  # noqa: E402
from softdeps.session import stage_counted  # noqa: E402

HEADLINE = [
    "discover_supplier",
    "discover_segments",
    "discover_months",
    "discover_customers",
    "discover_lines",
    "discover_parts",
    "discover_grid",
    "discover_users",
    "discover_taxonomy",
    "minimal_rfds",
    "rfd_check_lines",
    "rfd_violations",
    "value_distances",
    "top_k_per_window",
    "score_lexicon",
    "flatten_message",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("softdeps-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sizes(spark: SparkSession, sf_dir: str) -> dict:
    """Row pairs of distinct rows, distinct vectors and front rows (all right sides) of four relations."""
    out = {}
    for rel in (SUPPLIER, SEGMENTS, CUSTOMERS, PARTS):
        df = rel.load(spark, sf_dir).select(*rel.names)
        rows, n = staged_profiles(df, measures_for(df))
        vectors, n_vectors = stage_counted(profile_vectors(rows, n, measures_for(df)), "bench")
        _, n_front = vector_front(vectors, combinations(rel.names))
        out[rel.name] = {"pairs": n * (n - 1) // 2, "vectors": n_vectors, "front": n_front}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["discover_segments"](spark, sf_dir).collect()  # start the JVM's and Python's workers
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "sizes": sizes(spark, sf_dir),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
