"""Helpers of the operators: staged tables, bounded Arrow batches, distributed ranks and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from softdeps import session

# The words of all operators are runs of anything but ASCII white space; so are those of ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"

# Rows handed to Python at once: texts can be very long, so batches are short.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return a scan of it: cuts the lineage, survives lost executors, known to ``drop_staged``."""
    return session.stage(df, label, by, compression="zstd")


def stage_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stage`` and the number of rows, seen while they are written."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return staged, seen.get["n"]


def map_batches(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose task sees at most ``rows`` rows at once; Spark itself bounds a batch by its bytes."""

    def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return task(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(in_slices, schema)


def arrow(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    """A batch from lists (or numpy arrays) and types by name."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: the row's place (from 1) in the order over all rows, without gathering them in one task.

    Rows are range-partitioned and staged, so that each partition keeps its rows; the partitions' sizes (a row each) give the offsets.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("#part", F.spark_partition_id()), "rank")
    sizes = ranged.groupBy("#part").agg(F.count(F.lit(1)).alias("#n"))
    before = sizes.select("#part", (F.sum("#n").over(Window.orderBy("#part")) - F.col("#n")).alias("#before"))
    local = ranged.withColumn("#local", F.row_number().over(Window.partitionBy("#part").orderBy(*order)))
    return local.join(before, "#part").withColumn(name, F.col("#before") + F.col("#local")).drop("#part", "#before", "#local")


def ranks_within(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``#rank`` (from 0, in ``order`` among the rows of one ``key``) and ``#n`` (the key's rows); a key may hold any share of all rows.

    Rows are range-partitioned by key and order, sorted and numbered in their partitions, and staged.  A key's first place in a partition and its
    rows in earlier ones (one row per key and partition) turn these numbers into ranks.
    """
    ordered = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    numbered = stage(ordered.withColumn("#id", F.monotonically_increasing_id()), "ranks").withColumn("#part", F.shiftright("#id", 33))
    runs = numbered.groupBy(key, "#part").agg(F.min("#id").alias("#first"), F.count(F.lit(1)).alias("#c"))
    own = Window.partitionBy(key)
    before = F.sum("#c").over(own.orderBy("#part")) - F.col("#c")
    starts = runs.select(key, "#part", (before - F.col("#first")).alias("#shift"), F.sum("#c").over(own).alias("#n"))
    return numbered.join(starts, [key, "#part"]).withColumn("#rank", F.col("#id") + F.col("#shift")).drop("#id", "#part", "#shift")


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``(node, component)`` for every node of ``edges(a long, b long)``; the component is its smallest node.

    Alternates the large-star and small-star steps until nothing changes.  Every round is staged, so a lost executor costs a re-read;
    nodes are join keys only next to a one-row-per-node side, so that a hub's edges can be split by adaptive execution.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now, state = _told_edges(edges.where("a <> b").select(high, low).distinct())
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new = _told_edges(small.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _told_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Staged edges with their number and a sum of their hashes, seen while they are written."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes"))
    return stage(told, "edges"), (seen.get["n"], seen.get["hashes"])


def more_components(known: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``components`` of all edges behind ``known`` and the new ``edges``, staged; only edges between different known components are looked at anew."""
    if known is None:
        return stage(components(edges), "components")
    named = lambda k: known.select(F.col("node").alias(k), F.col("component").alias(f"#{k}"))
    placed = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    moved = placed.select(F.coalesce("#a", "a").alias("a"), F.coalesce("#b", "b").alias("b")).where("a <> b").distinct()
    moved, n = stage_counted(moved, "moved")
    if not n:
        return known
    top = stage(components(moved), "tops")
    higher = top.select(F.col("node").alias("component"), F.col("component").alias("#top"))
    old = known.join(higher, "component", "left").select("node", F.coalesce("#top", "component").alias("component"))
    return stage(old.unionByName(top.join(known, "node", "left_anti")), "components")


def parts(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))
