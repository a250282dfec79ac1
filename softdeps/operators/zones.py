"""Tile pairs ruled out by their bounds.

Rows are sorted into tiles of bounded size, each tile keeps the value range of
every attribute, and a pair of tiles is only joined when its bounds leave room for
a pair that matters.  A hot key fills many tiles instead of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.functions.distances import Measure
from softdeps.operators.meeting import Meeting
from softdeps.operators.pairs import pair_distances, q
from softdeps.operators.skyline import front_columns, local_fronts, merge_fronts
from softdeps.session import ceil_div, slots, stage, stage_counted

MOST_ZONE_ROWS = 4_096
LEAST_ZONE_ROWS = 512
PARTITION_ROWS = 131_072
PLACE_STEP = 1 << 33  # row numbers of different partitions are this far apart
GOOD_ZONE_COUNT = 16_384
SEEDS = 512
SEED_ZONE_ROWS = 128
CELLS_PER_SHARE = 64


def zone_size(n: int) -> int:
    """Rows per tile: small tiles have tight bounds, large ones keep the number of tile pairs down."""
    return min(MOST_ZONE_ROWS, max(LEAST_ZONE_ROWS, ceil_div(n, GOOD_ZONE_COUNT)))


def zone_tiles(rows: DataFrame, n: int, order: list[Column], zone_rows: int | None = None) -> DataFrame:
    """``rows`` sorted by ``order`` into tiles of about ``zone_rows``; staged with ``#tile``."""
    size = zone_rows or zone_size(n)
    parts = max(ceil_div(n, PARTITION_ROWS), min(slots(rows.sparkSession), ceil_div(n, size)))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return stage(spread.withColumn("#tile", place - F.pmod(place, F.lit(PLACE_STEP)) + F.floor(F.pmod(place, F.lit(PLACE_STEP)) / size)), "zones")


def zone_bounds(tiled: DataFrame, measures: list[Measure], extra: list[Column] | None = None) -> DataFrame:
    """One row per tile: bounds of every measured column."""
    stats = [c for m in measures for c in m.bound_aggregates()]
    return stage(tiled.groupBy("#tile").agg(*stats, *(extra or [])), "bounds")


def tile_pairs(bounds: DataFrame, group: int = 2_048) -> DataFrame:
    """All unordered pairs of tile summaries (a tile with itself included), through cells of about ``group`` tiles a side."""
    groups = ceil_div(bounds.count(), group)
    row = F.struct(*[q(c) for c in bounds.columns])
    mine = F.pmod(F.xxhash64("#tile"), F.lit(groups))
    zero, last = F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")
    left = bounds.select(
        row.alias("a"), mine.alias("ga"), F.explode(F.transform(F.sequence(mine, last), lambda g: mine * groups + g)).alias("cell")
    )
    right = bounds.select(
        row.alias("b"), mine.alias("gb"), F.explode(F.transform(F.sequence(zero, mine), lambda g: g * groups + mine)).alias("cell")
    )
    once = (F.col("ga") != F.col("gb")) | (F.col("a.`#tile`") <= F.col("b.`#tile`"))
    return left.join(right, "cell").where(once).select("a", "b")


def join_cells(tiled: DataFrame, cells: DataFrame, keep: list[str], meeting: Meeting | None = None) -> DataFrame:
    """Row pairs of the chosen tile pairs (``cells``: staged ``ta, tb``), as structs ``a`` and ``b``.

    A tile that occurs in many cells is handed out in shares of about ``CELLS_PER_SHARE``
    cells.  With ``meeting``, a row of the first tile only meets rows of the second that reach its home.
    """
    spark = tiled.sparkSession
    numbered, n = stage_counted(cells.select("ta", "tb").withColumn("cell", F.monotonically_increasing_id()), "cells")
    parts = max(1, min(n, max(4 * slots(spark), ceil_div(n, 8))))
    row = F.struct(*[q(c) for c in keep + ["#id", "#tile"]])
    at_home = tiled.withColumn("#home", meeting.home() if meeting else F.lit(0))
    reaching = meeting.reaching(tiled) if meeting else at_home

    def side(tile: str, name: str, homes: DataFrame) -> DataFrame:
        rows = homes.select(row.alias("row"), q("#tile").alias("tile"), F.col("#home").alias("home"))
        mine = numbered.select(F.col(tile).alias("tile"), "cell")
        shares = mine.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_SHARE).alias("shares"))
        shared_rows = rows.join(shares, "tile").select(
            "row", "home", "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share")
        )
        shared_cells = mine.join(shares, "tile").select(
            "tile", "cell", F.pmod(F.xxhash64("cell"), F.col("shares")).alias("share")
        )
        met = shared_rows.join(shared_cells, ["tile", "share"])
        key = F.xxhash64("cell", "home") if meeting else F.col("cell")
        return met.select(F.col("row").alias(name), F.col("cell").alias(f"cell_{name}"), F.col("home").alias(f"home_{name}"), key.alias("key")).repartition(parts, "key")

    # Written as differences so that they stay filters and the join keeps the partitioning above.
    same_cell = (F.col("cell_a") - F.col("cell_b") == 0) & (F.col("home_a").bitwiseXOR(F.col("home_b")) == 0)
    once = (F.col("a.`#tile`") != F.col("b.`#tile`")) | (F.col("a.`#id`") < F.col("b.`#id`"))
    return side("ta", "a", at_home).join(side("tb", "b", reaching).hint("shuffle_hash"), "key").where(same_cell & once)


def grid_order(rows: DataFrame, n: int, measures: list[Measure], zone_rows: int) -> list[Column]:
    """Sort columns that gather rows into boxes: every ordered attribute is cut at quantiles, about one box per tile.

    Sorting by the values themselves would keep only the first attribute's range narrow.
    """
    ordered = [q(m.name) for m in measures if m.kind in ("numeric", "numeric32", "days")]
    texts = [q(m.name) for m in measures if m.kind in ("text", "bytes")]
    slices = round(ceil_div(n, zone_rows) ** (1 / len(ordered))) if ordered else 1
    if slices < 2:
        return ordered + texts + [q("#id")]
    cuts = [i / slices for i in range(1, slices)]
    bounds = rows.agg(*[F.percentile_approx(c, cuts, 10_000) for c in ordered]).first()
    boxes = [
        F.coalesce(sum(((c > F.lit(cut)).cast("int") for cut in known or []), F.lit(0)), F.lit(-1))
        for c, known in zip(ordered, bounds)
    ]
    return boxes + ordered + texts + [q("#id")]


def pruned_front(
    rows: DataFrame,
    n: int,
    measures: list[Measure],
    combos: list[tuple[str, list[str]]],
    medians: dict[str, float],
    integral_below: dict | None = None,
    zone_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """The front of all pair distances without keeping the distance vectors.

    For every rhs, pairs of rows close on its lhs give a first front.  A pair of tiles is
    then skipped when, for every combination, one row of that front is at or below the
    smallest possible lhs distances and at or above the largest possible rhs distance:
    nothing in it could enter the front.  The filter uses at most ``SEEDS`` front rows per
    rhs; fewer rows only skip less.
    """
    width = len(combos[0][1])
    names = [m.name for m in measures]
    zeros = rows.agg(F.max("#copies").alias("most")).where("most > 1").select(*[F.lit(0.0).alias(c) for c in names])
    first = local_fronts(zeros, combos, integral_below)
    for right, left in combos:
        close = zone_tiles(rows, n, grid_order(rows, n, [m for m in measures if m.name in left], SEED_ZONE_ROWS), SEED_ZONE_ROWS)
        own = close.select(q("#tile").alias("ta"), q("#tile").alias("tb")).distinct()
        first = first.unionByName(local_fronts(pair_distances(join_cells(close, own, names), measures), combos, integral_below))
    first, _ = merge_fronts(first, width)

    size = zone_rows or zone_size(n)
    tiled = zone_tiles(rows, n, grid_order(rows, n, measures, size), size)
    seeds = _seeds(first, combos, medians)
    limits = {m.name: m.bounds() for m in measures}
    boxes = tile_pairs(zone_bounds(tiled, measures)).select(
        F.col("a.`#tile`").alias("ta"),
        F.col("b.`#tile`").alias("tb"),
        *[limits[c][0].alias(f"lo#{c}") for c in names],
        *[limits[c][1].alias(f"hi#{c}") for c in names],
    )
    open_cells = stage(_open_cells(boxes, seeds, names, combos), "open")
    far = pair_distances(join_cells(tiled, open_cells, names), measures)
    return merge_fronts(local_fronts(far, combos, integral_below).unionByName(first), width)


def _seeds(front: DataFrame, combos: list[tuple[str, list[str]]], medians: dict[str, float]) -> dict[str, np.ndarray]:
    """Up to ``SEEDS`` front rows per rhs as arrays (lhs..., rhs), those likely to beat most pairs first."""
    lows = front_columns(len(combos[0][1]))
    out = {}
    for right, left in combos:
        reach = F.col("rhs") if np.isinf(medians[right]) else F.least(F.col("rhs"), F.lit(4.0 * medians[right]))
        for c, name in zip(lows, left):
            unit = medians[name] if 0 < medians[name] < np.inf else 1.0
            reach = reach / (1 + F.col(c) / unit)
        best = front.where(F.col("rhs_name") == right).orderBy(reach.desc(), F.desc("rhs"), *lows).limit(SEEDS)
        out[right] = np.array([tuple(r) for r in best.select(*lows, "rhs").collect()], dtype=float)
    return out


def _open_cells(
    boxes: DataFrame, seeds: dict[str, np.ndarray], names: list[str], combos: list[tuple[str, list[str]]]
) -> DataFrame:
    plan = [(names.index(r), [names.index(c) for c in ls], seeds[r]) for r, ls in combos]
    k = len(names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            wanted = np.zeros(len(data), dtype=bool)
            for at, lhs, known in plan:
                shut = np.zeros(len(data), dtype=bool)
                for s in known:
                    shut |= (data[:, lhs] >= s[:-1]).all(axis=1) & (data[:, k + at] <= s[-1])
                wanted |= ~shut
            yield batch.select(["ta", "tb"]).filter(pa.array(wanted))

    return boxes.mapInArrow(keep, "ta bigint, tb bigint")
