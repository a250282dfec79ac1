"""Dependency profile over many tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.functions.formatting import combo_label
from softdeps.operators.stats import rfd_counts, table_profile
from softdeps.plans.discover import combinations, discover_all


def combination_frame(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    labels = F.array(*[combo_label(r, ls) for r, ls in combinations(columns)])
    return df.sparkSession.range(1).select(F.lit(name).alias("ds_name"), F.explode(labels).alias("combination"))


def dependency_profile(tables: dict[str, DataFrame], with_bytes: bool = False, **options) -> DataFrame:
    """One row per table and combination: table size, candidate pairs and number of dependencies found."""
    lines, counts, labels = [], [], []
    for name, df in tables.items():
        columns = [c for c in df.columns if c != options.get("key")]
        lines.append(table_profile(df, name, len(columns), with_bytes))
        labels.append(combination_frame(df, name, columns))
        found = rfd_counts(discover_all(df, **options), ["combination"])
        counts.append(found.select(F.lit(name).alias("ds_name"), "combination", "rfd_count"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    named = union(labels).join(union(counts), ["ds_name", "combination"], "left").na.fill(0, ["rfd_count"])
    return union(lines).join(named, "ds_name")
