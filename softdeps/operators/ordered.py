"""Counting far pairs of numbers inside groups by their order, without forming the pairs."""

from __future__ import annotations

from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.functions.distances import MICROS_PER_DAY, Measure
from softdeps.operators.pairs import q
from softdeps.session import slots

ORDERED = ("numeric", "numeric32", "days")


def far_weight(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, limit: float) -> int:
    """Weight of the pairs with ``y - x > limit``; both sorted.

    The difference is that of the distance itself: the place found with ``x + limit``, which rounds elsewhere, is moved until it fits.
    """
    if not len(x) or not len(y):
        return 0
    with np.errstate(invalid="ignore", over="ignore"):
        place = np.searchsorted(y, x + limit, side="right")
        while (down := (place > 0) & (y[np.maximum(place - 1, 0)] - x > limit)).any():
            place -= down
        while (up := (place < len(y)) & ~(y[np.minimum(place, len(y) - 1)] - x > limit)).any():
            place += up
    total = np.concatenate([[0], np.cumsum(wy)])
    return sum(map(mul, wx.tolist(), (total[-1] - total[place]).tolist()))


def ordered_counts(tiled: DataFrame, cells: DataFrame, equal: list[str], measure: Measure, limit: float) -> DataFrame:
    """``n``: weighed pairs of the tile pairs ``cells(ta, tb)`` that agree on ``equal`` and lie further apart than ``limit``, cell by cell.

    A cell holds at most two tiles.  One missing value is infinitely far from a present one, two are equal.
    """
    days = measure.kind == "days"
    infinite = limit == float("inf")
    reach = limit if not days else np.iinfo(np.int64).max >> 2 if infinite else (int(limit) + 1) * MICROS_PER_DAY - 1
    kind = {"days": np.int64, "numeric32": np.float32}.get(measure.kind, np.float64)
    numbered = cells.select("ta", "tb").withColumn("cell", F.xxhash64("ta", "tb"))
    rows = tiled.select(q("#tile").alias("tile"), F.xxhash64(*[q(c) for c in equal]).alias("key"), q(measure.name).alias("value"), q("#copies").alias("copies"))
    side = lambda tile, number: numbered.select("cell", "ta", "tb", F.col(tile).alias("tile")).join(rows, "tile").withColumn("side", F.lit(number))
    both = side("ta", 0).unionByName(side("tb", 1)).repartition(4 * slots(tiled.sparkSession), "cell")

    def count(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).to_numpy()
        key, copies, of, null = get("key"), get("copies"), get("side"), table.column("value").is_null().to_numpy()
        value = table.column("value").fill_null(0).to_numpy().astype(kind)
        same = table.column("ta")[0] == table.column("tb")[0]
        order = np.lexsort((value, null, key))
        key, copies, of, null, value = key[order], copies[order], of[order], null[order], value[order]
        found = 0
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            part = slice(start, end)
            a, b = of[part] == 0, of[part] == 1
            there = ~null[part]
            x, y, w = value[part], value[part], copies[part]
            left, right = a & there, b & there
            found += far_weight(x[left], w[left], y[right], w[right], reach)
            if not same:
                found += far_weight(y[right], w[right], x[left], w[left], reach)
            if not infinite:
                weight = lambda flags, w=w: int(w[flags].sum())
                found += weight(a & ~there) * weight(right) + (0 if same else weight(left) * weight(b & ~there))
        return pa.table({"n": [str(found)]})

    # a tile that meets itself appears on both sides: its far pairs are counted from the smaller value alone
    return both.groupBy("cell", "ta", "tb").applyInArrow(count, "n string").select(F.col("n").cast("decimal(38,0)").alias("n"))
