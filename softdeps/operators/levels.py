"""Level-wise operators over a front: pools, running minima, caps and hits.

A front holds ``rhs_name, rhs, l0..lm`` (see ``skyline``).  One front serves every
level: a row is in the pool of level ``b`` exactly while ``kill <= b < rhs``, where
``kill`` is the largest rhs among the rows at or below it, so pools are kept as
intervals and no level loop is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softdeps.operators.dominance import boxed, covered
from softdeps.operators.pairs import cross_cells, q
from softdeps.operators.skyline import FRONT_TILE_ROWS, front_columns
from softdeps.session import ceil_div

RANGES = 64


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def at_or_below(width: int, low: str = "b", high: str = "a") -> Column:
    """Struct ``low`` is at or below struct ``high`` on every lhs column."""
    return all_of([F.col(f"{low}.l{j}") <= F.col(f"{high}.l{j}") for j in range(width)])


def tiles_for(rows: DataFrame) -> int:
    """Tiles that keep about ``FRONT_TILE_ROWS`` rows each; counts the frame, which should be staged."""
    return ceil_div(rows.count(), FRONT_TILE_ROWS)


def pool_intervals(front: DataFrame, width: int, tiles: int | None = None) -> DataFrame:
    """Front rows with ``kill``: in the pool of level b while ``kill <= b < rhs`` (kill is null when nothing lies below).

    Tiles follow from the front's size unless given, so that one right side's rows are never one join key.
    """
    tiles = tiles or tiles_for(front)
    lows = front_columns(width)
    every = ["rhs_name", "rhs"] + lows
    side = lambda name: F.struct(*[F.col(f"{name}.l{j}") for j in range(width)])
    below = at_or_below(width) & (side("b") != side("a"))  # one comparison: the optimizer multiplies out a negated conjunction
    pairs = cross_cells(front, front, ["rhs_name"], below, (tiles, tiles))
    kills = pairs.select(*[F.col(f"a.{c}").alias(c) for c in every], F.col("b.rhs").alias("kill"))
    own = front.select(*every, F.lit(None).cast("double").alias("kill"))
    return own.unionAll(kills).groupBy(*every).agg(F.max("kill").alias("kill"))


def pools(front: DataFrame, width: int, levels: DataFrame, tiles: int | None = None) -> DataFrame:
    """Every (rhs_name, level) with the rows of its pool; ``levels`` holds ``rhs_name, level``, at most one row for each of the front."""
    tiles = tiles or tiles_for(front)
    intervals = pool_intervals(front, width, tiles)
    alive = (F.col("b.rhs") > F.col("a.level")) & (F.col("b.kill").isNull() | (F.col("b.kill") <= F.col("a.level")))
    joined = cross_cells(levels, intervals, ["rhs_name"], alive, (tiles, tiles))
    return joined.select("a.rhs_name", "a.level", *[f"b.{c}" for c in front_columns(width)], "b.rhs")


def cap_at_median(df: DataFrame, columns: list[str], medians: dict[str, float]) -> DataFrame:
    """Distances above their column's median become null."""
    return df.withColumns({c: F.when(F.col(c) <= F.lit(medians[c]), F.col(c)) for c in columns})


def range_minima(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Minimum of every column per level, nulls skipped."""
    return df.groupBy(*by).agg(*[F.min(c).alias(c) for c in columns])


def prior_min(level_minima: DataFrame, columns: list[str], by: str, order: str, ranges: int = RANGES) -> DataFrame:
    """Minimum of every column over the levels strictly above the current one, as ``prior_<column>``.

    With ``ranges=1`` this is one running minimum per group, for groups of a checked
    size.  Otherwise it is a prefix scan in two steps: levels are cut into value ranges, the minima of the
    at most ``ranges`` ranges above are taken per group, and a running minimum is
    kept only inside a range, so no task orders all levels of a group.
    """
    if ranges == 1:
        above = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return level_minima.withColumns({f"prior_{c}": F.min(c).over(above) for c in columns})
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = level_minima.groupBy(by).agg(F.percentile_approx(order, cuts, 10_000).alias("#cuts"))
    ranged = level_minima.join(bounds, by).withColumn(
        "#range", F.size(F.filter("#cuts", lambda cut: cut <= F.col(order)))
    )
    above = Window.partitionBy(by).orderBy(F.desc("#range")).rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranged.groupBy(by, "#range").agg(*[F.min(c).alias(f"#m_{c}") for c in columns])
    carried = per_range.select(by, "#range", *[F.min(f"#m_{c}").over(above).alias(f"#up_{c}") for c in columns])
    inside = Window.partitionBy(by, "#range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(carried, [by, "#range"])
        .withColumns({f"prior_{c}": F.least(F.min(c).over(inside), F.col(f"#up_{c}")) for c in columns})
        .select(*level_minima.columns, *[f"prior_{c}" for c in columns])
    )


def min_hits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep a value where it attains its level's new minimum (``min_<c>`` below ``prior_<c>``), else null."""
    hit = lambda c: F.when(
        (F.col(c) == F.col(f"min_{c}")) & (F.col(f"min_{c}") < F.col(f"prior_{c}")), F.col(c)
    )
    return df.withColumns({c: hit(c) for c in columns})


def complement(df: DataFrame, hits: list[str], originals: list[str]) -> DataFrame:
    """Original values where ``hits`` is null, null elsewhere."""
    return df.withColumns({h: F.when(F.col(h).isNull(), F.col(o)) for h, o in zip(hits, originals)})


def slice_row(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``slice_<c>`` to rows ``a`` matched with pool rows ``b``: the value where it is at or below the pool row's, else null."""
    return pairs.withColumns(
        {f"slice_{c}": F.when(F.col(f"a.{c}") <= F.col(f"b.{c}"), F.col(f"a.{c}")) for c in columns}
    )


def null_count(columns: list[str]) -> Column:
    """Number of null values among ``columns``."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def singletons(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row per present attribute: the diagonal expansion."""
    cells = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("threshold")) for c in columns])
    return df.select(*keep, F.inline(cells)).where(F.col("threshold").isNotNull())


def not_dominating(df: DataFrame, pool: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Rows of ``df`` with no pool row of the same group at or below them on every column (a null is at or below nothing, and nothing below it)."""
    return _by_pool(df, pool, columns, by, "left_anti")


def dominates_subset(
    df: DataFrame, pool: DataFrame, columns: list[str], by: list[str], strict: bool = False
) -> DataFrame:
    """Rows that lie at or above some pool row on every present attribute (null is unconstrained)."""
    return _by_pool(df, pool, columns, by, "left_semi", strict=strict, free_nulls=True)


def _by_pool(df: DataFrame, pool: DataFrame, columns: list[str], by: list[str], how: str, **demands: bool) -> DataFrame:
    """Semi or anti join of rows with a pool; repeated rows stay as they are."""
    rows, _ = boxed(df, by, columns)
    below, _ = boxed(pool.select(*[q(c) for c in dict.fromkeys(by + columns)]).distinct(), by, columns)
    return rows.join(covered(rows, below, columns, by, **demands), "#id", how).select(*[q(c) for c in df.columns])
