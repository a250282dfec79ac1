"""Top rows, overall and per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_window(df: DataFrame, ts: str, width: str, order: list[Column], k: int = 5) -> DataFrame:
    """The first ``k`` rows of every tumbling window of ``ts``, with ``window_start`` and ``rank``.

    The rank limit is applied by each task before the shuffle, so a crowded window
    sends at most ``k`` rows per task.
    """
    rows = df.withColumn("window_start", F.window(ts, width)["start"])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("window_start").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def append(result: DataFrame, batch: DataFrame) -> DataFrame:
    return result.unionByName(batch)
