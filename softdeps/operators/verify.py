"""Checking a given dependency and listing the pairs that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.functions.distances import Measure, measures_for
from softdeps.operators.levels import all_of
from softdeps.operators.meeting import Meeting, equal_names, join_texts, meeting_for, meeting_tiles, meets_by_text
from softdeps.operators.ordered import ORDERED, ordered_counts
from softdeps.operators.pairs import distinct_profiles, encode, pair_distances, q, staged_profiles
from softdeps.operators.zones import join_cells, tile_pairs, zone_bounds, zone_tiles
from softdeps.session import stage, stage_counted


def _measures(df: DataFrame, lhs: dict[str, float], rhs: str, distances, options: dict) -> list[Measure]:
    if not lhs or rhs in lhs:
        raise ValueError("give lhs thresholds, and an rhs outside the lhs")
    return measures_for(df, list(lhs) + [rhs], None, distances, **options)


def _sort(measures: list[Measure], lhs: dict[str, float], rhs: str) -> list[Column]:
    """Tile order: exact-match attributes, then the tightest limits, then the rhs, so that bounds are narrow."""
    usable = {m.name for m in measures if m.kind not in ("paths", "custom")}
    names = [c for c in sorted(lhs, key=lambda c: lhs[c]) if c in usable]
    return [q(c) for c in names + ([rhs] if rhs in usable else [])] + [q("#id")]


def _cells(tiled: DataFrame, measures: list[Measure], lhs: dict[str, float], rhs: str, limit: float, meeting: Meeting | None, extra=None):
    """Tile pairs that may hold a violation, with ``sure`` where every pair of rows is one.

    Tiles are paired by the homes of their rows; all of them only if no threshold narrows where rows meet.
    """
    bounds = {m.name: m.bounds() for m in measures}
    possible = all_of([bounds[c][0] <= F.lit(float(t)) for c, t in lhs.items()]) & (bounds[rhs][1] > F.lit(float(limit)))
    certain = all_of([bounds[c][1] <= F.lit(float(t)) for c, t in lhs.items()]) & (bounds[rhs][0] > F.lit(float(limit)))
    known = zone_bounds(tiled, measures, extra)
    if meeting is None:
        pairs = tile_pairs(known)
    else:
        row = F.struct(*[q(c) for c in known.columns])
        first, second = known.select(q("#tile").alias("ta"), row.alias("a")), known.select(q("#tile").alias("tb"), row.alias("b"))
        pairs = meeting_tiles(tiled, meeting).join(first, "ta").join(second, "tb").select("a", "b")
    return pairs.where(possible).withColumn("sure", certain & (F.col("a.`#tile`") != F.col("b.`#tile`")))


def _broken(lhs: dict[str, float], rhs: str, limit: float) -> Column:
    return all_of([q(c) <= F.lit(float(t)) for c, t in lhs.items()]) & (q(rhs) > F.lit(float(limit)))


def rfd_violations(
    df: DataFrame,
    lhs_thresholds: dict[str, float],
    rhs: str,
    rhs_threshold: float,
    key: str,
    distances=None,
    zone_rows: int | None = None,
    **options,
) -> DataFrame:
    """Row pairs within all lhs thresholds whose rhs distance exceeds ``rhs_threshold``: both keys and the distances.

    Rows are told apart by numbers of their own, so repeated and null keys lose no pair; a null key comes second.
    """
    measures = _measures(df, lhs_thresholds, rhs, distances, options)
    names = [m.name for m in measures]
    more = [] if key in names else [key]
    rows, n = stage_counted(encode(df, measures, more).withColumn("#id", F.monotonically_increasing_id()), "rows")
    meeting = meeting_for(rows, measures, lhs_thresholds)
    if meets_by_text(rows, meeting):
        met = join_texts(rows, meeting, names + more)
    else:
        tiled = zone_tiles(rows, n, _sort(measures, lhs_thresholds, rhs), zone_rows)
        cells = _cells(tiled, measures, lhs_thresholds, rhs, rhs_threshold, meeting)
        cells = stage(cells.select(F.col("a.`#tile`").alias("ta"), F.col("b.`#tile`").alias("tb")), "violations")
        met = join_cells(tiled, cells, names + more, meeting)
    first, second = F.col(f"a.`{key}`"), F.col(f"b.`{key}`")
    both = first.isNotNull() & second.isNotNull()
    ids = [F.least(first, second).alias(f"{key}_a"), F.when(both, F.greatest(first, second)).alias(f"{key}_b")]
    pairs = pair_distances(met, measures, ids)
    return pairs.where(_broken(lhs_thresholds, rhs, rhs_threshold))


def rfd_check(
    df: DataFrame,
    lhs_thresholds: dict[str, float],
    rhs: str,
    rhs_threshold: float,
    distances=None,
    zone_rows: int | None = None,
    **options,
) -> DataFrame:
    """One row ``violations, holds`` over all row pairs.

    Where all attributes must be equal, pairs are counted from the sizes of groups; where those on the left must be and the right one is a number or
    a date, from its order.  Otherwise equal rows are folded and weighed by their number, tile
    pairs whose bounds settle the question are counted as products, and only the rest is joined.
    """
    measures = _measures(df, lhs_thresholds, rhs, distances, options)
    names = [m.name for m in measures]
    if set(equal_names(measures, {**lhs_thresholds, rhs: rhs_threshold})) == set(names):
        return _verdict(_unequal_pairs(distinct_profiles(df, measures), list(lhs_thresholds)))
    rows, n = staged_profiles(df, measures)
    broken = _broken(lhs_thresholds, rhs, rhs_threshold)
    weighed = lambda met: pair_distances(met, measures, [(F.col("a.`#copies`") * F.col("b.`#copies`")).alias("#pairs")])
    counted = lambda met: weighed(met).where(broken).agg(F.sum("#pairs").alias("n"))
    meeting = meeting_for(rows, measures, lhs_thresholds)
    if meets_by_text(rows, meeting):
        return _verdict(counted(join_texts(rows, meeting, names + ["#copies"])))
    tiled = zone_tiles(rows, n, _sort(measures, lhs_thresholds, rhs), zone_rows)
    weight = F.sum("#copies").alias("#weight")
    cells = _cells(tiled, measures, lhs_thresholds, rhs, rhs_threshold, meeting, [weight])
    cells = stage(
        cells.select(
            F.col("a.`#tile`").alias("ta"),
            F.col("b.`#tile`").alias("tb"),
            "sure",
            (F.col("a.`#weight`") * F.col("b.`#weight`")).alias("pairs"),
        ),
        "cells",
    )
    settled = cells.where("sure").agg(F.sum("pairs").alias("n"))
    unsettled = cells.where("NOT sure").select("ta", "tb")
    own = next(m for m in measures if m.name == rhs)
    if set(equal_names(measures, lhs_thresholds)) == set(lhs_thresholds) and own.kind in ORDERED and own.scale is None and rhs_threshold >= 0:
        return _verdict(settled.unionByName(ordered_counts(tiled, unsettled, list(lhs_thresholds), own, rhs_threshold)))
    met = join_cells(tiled, unsettled, names + ["#copies"], meeting)
    return _verdict(settled.unionByName(counted(met)))


def _unequal_pairs(profiles: DataFrame, lhs: list[str]) -> DataFrame:
    """Pairs that agree on ``lhs`` but not on the rest, by group: half of what its size squared has beyond the squares of its equal parts."""
    size = F.col("#copies").cast("decimal(20,0)")
    total = F.sum(size)
    return profiles.groupBy(*[q(c) for c in lhs]).agg(((total * total - F.sum(size * size)) / 2).cast("decimal(38,0)").alias("n"))


def _verdict(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))
    return total.withColumn("holds", F.col("violations") == 0)


def rfd_holds(df: DataFrame, lhs_thresholds: dict[str, float], rhs: str, rhs_threshold: float, **options) -> bool:
    """Whether no pair of rows breaks the dependency."""
    return rfd_check(df, lhs_thresholds, rhs, rhs_threshold, **options).first()["holds"]
