"""Pareto fronts: smallest on some columns, largest on one, per group.

A front is built in two steps.  Each task reduces its own Arrow batches to a
local front (so nothing but front candidates is ever shuffled), and hands it on
and starts anew whenever it has grown to ``HELD_ROWS``.  The candidates then
eliminate each other inside boxes of bounded size, and the boxes' survivors
between boxes whose bounds leave room for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.operators.dominance import boxed, covered
from softdeps.session import stage, stage_counted

FRONT_TILE_ROWS = 4_096
BLOCK = 8_192
HELD_ROWS = 16_384
GUARDS = 1_024


def _beaten_within(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mask of rows that an earlier row of the same sorted chunk matches or beats."""
    hit = high[:, None] >= high[None, :]
    for j in range(low.shape[1]):
        hit &= low[:, None, j] <= low[None, :, j]
    return np.triu(hit, 1).any(axis=0)


def _beaten(by_low: np.ndarray, by_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mask of rows (low, high) that some row of ``by`` matches or beats on every column."""
    out = np.zeros(len(low), dtype=bool)
    for start in range(0, len(low), BLOCK):
        part = slice(start, start + BLOCK)
        hit = by_high[:, None] >= high[None, part]
        for j in range(low.shape[1]):
            hit &= by_low[:, None, j] <= low[None, part, j]
        out[part] = hit.any(axis=0)
    return out


def front_rows(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Indices of the rows no other row beats (lower ``low``, higher ``high``); equal rows are kept once.

    Rows are visited in an order in which no row can be beaten by a later one.
    """
    infinite = np.isinf(low)
    total = np.where(infinite, 0.0, low).sum(axis=1)
    keys = [-high] + [low[:, j] for j in range(low.shape[1] - 1, -1, -1)] + [total, infinite.sum(axis=1)]
    todo = np.lexsort(keys)
    kept: list[np.ndarray] = []
    chunk = 32
    while len(todo):
        head, todo = todo[:chunk], todo[chunk:]
        chunk = min(chunk * 2, 512)
        head = head[~_beaten_within(low[head], high[head])]
        kept.append(head)
        if len(todo):
            todo = todo[~_beaten(low[head], high[head], low[todo], high[todo])]
    return np.concatenate(kept) if kept else np.empty(0, dtype=int)


class RunningFront:
    """Front of the rows seen since the last restart, fed batch by batch."""

    def __init__(self, width: int):
        self.low = np.empty((0, width))
        self.high = np.empty(0)

    def restart(self) -> tuple[np.ndarray, np.ndarray]:
        """Hand out the front; evenly spread rows of it stay as guards, so what they beat is not collected again."""
        low, high = self.low, self.high
        guards = np.linspace(0, len(high) - 1, min(GUARDS, len(high) // 2)).astype(int)
        self.low, self.high = low[guards], high[guards]
        return low, high

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        if len(self.low) and len(low):
            fresh = ~_beaten(self.low, self.high, low, high)
            low, high = low[fresh], high[fresh]
        if not len(low):
            return
        low, high = np.vstack([self.low, low]), np.concatenate([self.high, high])
        keep = front_rows(low, high)
        self.low, self.high = low[keep], high[keep]


def front_columns(width: int) -> list[str]:
    return [f"l{j}" for j in range(width)]


def front_schema(width: int) -> str:
    return ", ".join(["rhs_name string", "rhs double"] + [f"{c} double" for c in front_columns(width)])


def local_fronts(vectors: DataFrame, combos: list[tuple[str, list[str]]], integral_below: dict | None = None) -> DataFrame:
    """Per task, the front of every (rhs, lhs) combination of the vectors it reads; no shuffle.

    ``integral_below`` maps an rhs to a limit under which fractional distances are left out.
    """
    width = len(combos[0][1])
    names = vectors.columns
    plan = [(r, names.index(r), [names.index(c) for c in ls]) for r, ls in combos]
    limits = integral_below or {}

    def found(r: str, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([r] * len(high), pa.string()), pa.array(high)]
        columns += [pa.array(low[:, j]) for j in range(width)]
        return pa.RecordBatch.from_arrays(columns, names=["rhs_name", "rhs"] + front_columns(width))

    held = HELD_ROWS

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fronts = {r: RunningFront(width) for r, _, _ in plan}
        for batch in batches:
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for r, at, lhs in plan:
                rows = data
                if r in limits:
                    b = data[:, at]
                    rows = data[(b > limits[r]) | (b == np.floor(b))]
                fronts[r].add(rows[:, lhs], rows[:, at])
                if len(fronts[r].high) >= held:
                    yield found(r, *fronts[r].restart())
        for r, front in fronts.items():
            if len(front.high):
                yield found(r, front.low, front.high)

    return vectors.mapInArrow(reduce, front_schema(width))


def merge_fronts(candidates: DataFrame, width: int, tile_rows: int = FRONT_TILE_ROWS) -> tuple[DataFrame, int]:
    """The front of all candidates per ``rhs_name``, staged, and its size.

    Candidates are sorted into boxes and reduce each other there first.  With more candidates than one box holds, a box's survivors then meet
    those of the boxes that can beat one of them; boxes that lie wholly above another go without a look at their rows.
    """
    lows = front_columns(width)
    every = ["rhs_name", "rhs"] + lows
    staged, n = stage_counted(candidates.select(*every), "candidates")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[front_rows(pdf[lows].to_numpy(), pdf["rhs"].to_numpy())]

    if n <= tile_rows:
        return stage_counted(staged.groupBy("rhs_name").applyInPandas(reduce, front_schema(width)), "front")
    turned = staged.dropDuplicates().withColumn("up", -F.col("rhs"))  # low on every column
    boxes, _ = boxed(turned, ["rhs_name"], lows + ["up"], tile_rows)
    rows = stage(boxes.groupBy("rhs_name", "#box").applyInPandas(reduce, boxes.schema), "survivors")
    beaten = covered(rows, rows, lows + ["up"], ["rhs_name"], apart=True)
    return stage_counted(rows.join(beaten, "#id", "left_anti").select(*every), "front")


def skyline(df: DataFrame, min_cols: list[str], max_col: str, tile_rows: int = FRONT_TILE_ROWS) -> DataFrame:
    """Rows of ``df`` (projected, distinct) that no other row beats: low on ``min_cols``, high on ``max_col``."""
    vectors = df.select(*[F.col(c).cast("double").alias(c) for c in [max_col] + min_cols])
    front, _ = merge_fronts(local_fronts(vectors, [(max_col, min_cols)]), len(min_cols), tile_rows)
    return front.select(
        *[F.col(f"l{j}").alias(c) for j, c in enumerate(min_cols)], F.col("rhs").alias(max_col)
    )


def max_reduce(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """The largest rhs distance of every lhs vector."""
    return df.groupBy(*lhs).agg(F.max(rhs).alias(rhs))
