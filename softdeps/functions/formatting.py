"""Result shapes: readable rules, labels, long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns of results that are no attributes; discovery refuses attributes of these names.
RESERVED = ("rhs", "rhs_threshold", "combination", "rfd_id", "rule")


def _attributes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def number_text(value: Column) -> Column:
    """A double in plain notation with at least one decimal, whatever its size."""
    plain = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    size = F.abs(value)
    exponent = ((size >= 1e7) & (size < 1e25)) | ((size < 1e-3) & (size > 0))
    return F.when(exponent, plain).otherwise(value.cast("string"))


def rule_text(names: list[str], digits: int = 2) -> Column:
    """``a(<= t), b(<= u) -> c(<= v)`` with rounded thresholds."""
    limit = lambda name, value: F.concat(name, F.lit("(<= "), number_text(F.round(value, digits)), F.lit(")"))
    left = F.concat_ws(", ", *[limit(F.lit(c), F.col(f"`{c}`")) for c in names])
    return F.concat(left, F.lit(" -> "), limit(F.col("rhs"), F.col("rhs_threshold")))


def format_rfd(rfds: DataFrame, digits: int = 2) -> DataFrame:
    """Wide dependencies with a readable ``rule`` column."""
    return rfds.withColumn("rule", rule_text(_attributes(rfds), digits))


def combo_label(rhs: str, lhs: list[str]) -> Column:
    """``{"lhs":[...],"rhs":[...]}``."""
    return F.to_json(F.struct(F.array(*[F.lit(c) for c in lhs]).alias("lhs"), F.array(F.lit(rhs)).alias("rhs")))


def to_long(rfds: DataFrame) -> DataFrame:
    """``rfd_id, rhs, rhs_threshold, lhs`` with the lhs thresholds in a map."""
    names = _attributes(rfds)
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in names])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    raw = F.to_json(F.struct("rhs", "rhs_threshold", *[F.col(f"`{c}`") for c in names]))
    return rfds.select(
        F.md5(raw).alias("rfd_id"), "rhs", "rhs_threshold", F.map_from_entries(present).alias("lhs")
    )


def to_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per attribute, null where it is absent from the lhs."""
    return long.select("rhs", "rhs_threshold", *[F.try_element_at("lhs", F.lit(c)).alias(c) for c in names])


def order_sides(df: DataFrame, lhs: list[str], rhs: str = "rhs") -> DataFrame:
    """Lhs columns first, rhs last."""
    return df.select(*[F.col(f"`{c}`") for c in lhs], F.col(f"`{rhs}`"))
