"""Which rows have a row of a pool at or below them on every column.

Rows and pool are sorted into boxes of bounded size, and only the boxes' bounds are compared at first: a box that lies wholly above another is decided without
its rows, boxes that cannot reach each other never meet, and the rest meet pair by pair, each pair of boxes under a join key of its own.  A group with any
share of all rows fills many boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.operators.pairs import cross_cells, q
from softdeps.session import ceil_div, slots, stage, stage_counted

BOX_ROWS = 4_096
PARTITION_ROWS = 131_072
BOUNDS_TILE = 2_048
PLACE_STEP = 1 << 33  # row numbers of different partitions are this far apart


def box_order(rows: DataFrame, columns: list[str], boxes: int) -> list[Column]:
    """Sort columns that gather rows into about ``boxes`` boxes: the first log2(boxes) columns are cut at quantiles, nulls before all."""
    cut = columns[: max(1, boxes.bit_length() - 1)]
    slices = round(boxes ** (1 / len(cut)))
    if slices < 2:
        return [q(c) for c in columns]
    bounds = rows.agg(*[F.percentile_approx(q(c), [i / slices for i in range(1, slices)], 10_000) for c in cut]).first()
    places = [sum(((q(c) > F.lit(v)).cast("int") for v in known or []), F.lit(0)) for c, known in zip(cut, bounds)]
    return [*places, *[q(c) for c in columns]]


def boxed(rows: DataFrame, by: list[str], columns: list[str], box_rows: int = BOX_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with ``#id`` and ``#box``, staged, and their number; a box holds at most ``box_rows`` rows of one group and few of another."""
    numbered, n = stage_counted(rows.withColumn("#id", F.monotonically_increasing_id()), "rows")
    if n <= box_rows:
        return numbered.withColumn("#box", F.lit(0).cast("bigint")), n
    raw = numbered.drop("#id")
    order = [q(k) for k in by] + box_order(raw, columns, ceil_div(n, box_rows))
    parts = max(ceil_div(n, PARTITION_ROWS), min(slots(rows.sparkSession), ceil_div(n, box_rows)))
    place = q("#id")
    box = place - F.pmod(place, F.lit(PLACE_STEP)) + F.floor(F.pmod(place, F.lit(PLACE_STEP)) / box_rows)
    spread = raw.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("#id", F.monotonically_increasing_id())
    return stage(spread.withColumn("#box", box), "boxes"), n


def box_bounds(boxes: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, int]:
    """Bounds of every column and whether it holds nulls, one row per group and box."""
    bounds = [
        made
        for i, c in enumerate(columns)
        for made in (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"), F.max(q(c).isNull()).alias(f"open{i}"))
    ]
    return stage_counted(boxes.groupBy(*[q(k) for k in by], "#box").agg(*bounds), "bounds")


def every(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def covered(
    rows: DataFrame, pool: DataFrame, columns: list[str], by: list[str], strict: bool = False, free_nulls: bool = False, apart: bool = False
) -> DataFrame:
    """``#id`` of the rows (once each) with a row of the pool in the same group at or below them (``strict``: below) on every column.

    Both come from ``boxed``.  A row's null is below nothing, or free of any demand with ``free_nulls``; a pool row's null is below
    nothing.  With ``apart`` rows and pool are one frame of distinct rows and a row doesn't meet itself.  Null groups meet nothing.
    """
    below = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    free = lambda test, null: (null | test) if free_nulls else test
    numbers = range(len(columns))
    mine, n_mine = box_bounds(rows, by, columns)
    theirs, n_theirs = (mine, n_mine) if apart else box_bounds(pool, by, columns)

    reach = every([free(below(F.col(f"b.lo{i}"), F.col(f"a.hi{i}")), F.col(f"a.open{i}")) for i in numbers])
    within = [below(F.col(f"b.hi{i}"), F.col(f"a.lo{i}")) & ~F.col(f"b.open{i}") for i in numbers]
    if free_nulls:
        within = [F.col(f"a.lo{i}").isNull() | w for i, w in enumerate(within)]
    else:
        within = [w & ~F.col(f"a.open{i}") for i, w in enumerate(within)]
    if apart:
        within.append(F.col("a.`#box`") != F.col("b.`#box`"))
    met = cross_cells(mine, theirs, by, reach, (ceil_div(n_mine, BOUNDS_TILE), ceil_div(n_theirs, BOUNDS_TILE)))
    pairs = stage(
        met.select(
            *[F.col(f"a.`{k}`").alias(f"#by{i}") for i, k in enumerate(by)],
            F.col("a.`#box`").alias("ra"),
            F.col("b.`#box`").alias("rb"),
            *[F.col(f"a.hi{i}").alias(f"hi{i}") for i in numbers],
            *[F.col(f"a.open{i}").alias(f"open{i}") for i in numbers],
            *[F.col(f"b.lo{i}").alias(f"lo{i}") for i in numbers],
            F.coalesce(every(within), F.lit(False)).alias("whole"),
        ).withColumn("cell", F.monotonically_increasing_id()),
        "pairs",
    )
    keys = [f"#by{i}" for i in range(len(by))]
    whole = pairs.where("whole").select(*keys, F.col("ra").alias("#box")).distinct()
    # What a box that is wholly above another could beat, the other beats too, so between boxes of one frame it needn't be asked.
    shut = whole.withColumnRenamed("#box", "ra")
    open_ = pairs.join(shut, [*keys, "ra"], "left_anti")
    if apart:
        open_ = open_.join(whole.withColumnRenamed("#box", "rb"), [*keys, "rb"], "left_anti")

    def side(boxes: DataFrame, box: str, name: str, keep: Column) -> DataFrame:
        held = boxes.select(
            *[q(k).alias(key) for k, key in zip(by, keys)], q("#box").alias(box), q("#id").alias("id"), *[q(c).alias(f"c{i}") for i, c in enumerate(columns)]
        )
        return held.join(open_, [*keys, box]).where(keep).select("cell", F.struct("id", *[f"c{i}" for i in numbers]).alias(name))

    y = side(rows, "ra", "y", every([free(below(F.col(f"lo{i}"), F.col(f"c{i}")), F.col(f"c{i}").isNull()) for i in numbers]))
    x = side(pool, "rb", "x", every([free(below(F.col(f"c{i}"), F.col(f"hi{i}")), F.col(f"open{i}")) for i in numbers]))
    x = x.withColumnRenamed("cell", "other")
    test = every([free(below(F.col(f"x.c{i}"), F.col(f"y.c{i}")), F.col(f"y.c{i}").isNull()) for i in numbers])
    if apart:
        test = test & (F.col("x.id") != F.col("y.id"))
    single = y.join(x, (F.col("cell") == F.col("other")) & test, "left_semi").select(F.col("y.id").alias("#id"))
    decided = rows.select(*[q(k).alias(key) for k, key in zip(by, keys)], "#box", "#id").join(whole, [*keys, "#box"], "left_semi")
    return single.unionAll(decided.select("#id")).distinct()
