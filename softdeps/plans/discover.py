"""Discovery of relaxed functional dependencies.

rows -> distinct profiles -> tiled pairs -> distinct distance vectors (staged)
     -> exact medians, one Pareto front per rhs (staged, small)
     -> single-attribute and composite dependencies, all levels and all rhs in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.functions.bitsets import WORD, BitSets
from softdeps.functions.distances import measures_for
from softdeps.functions.formatting import RESERVED
from softdeps.operators.dominance import boxed, covered
from softdeps.operators.levels import RANGES, all_of, pool_intervals, prior_min, tiles_for
from softdeps.operators.pairs import cross_cells, profile_vectors, q, staged_profiles
from softdeps.operators.skyline import FRONT_TILE_ROWS, front_columns, local_fronts, merge_fronts
from softdeps.operators.stats import approximate_medians, median_values
from softdeps.operators.taxonomy import attach_paths, taxonomy_measures
from softdeps.session import ceil_div, stage, stage_counted

Combo = tuple[str, list[str]]
Strategy = Callable[[DataFrame], DataFrame]
SMALL_WIDTH = 6


def combinations(columns: list[str], rhs=None, lhs=None) -> list[Combo]:
    """All (rhs, lhs) splits: every column as rhs, one given rhs against the rest, or exactly the given sides."""
    name = lambda c: columns[c] if isinstance(c, int) else c
    for c in ([] if rhs is None else [rhs]) + list(lhs or []):
        if (c if isinstance(c, str) else None) not in columns and not (isinstance(c, int) and 0 <= c < len(columns)):
            raise ValueError(f"no such attribute: {c!r}")
    if rhs is None:
        if lhs:
            raise ValueError("lhs attributes need an rhs attribute")
        return [(c, [o for o in columns if o != c]) for c in columns]
    right = name(rhs)
    left = [name(c) for c in lhs] if lhs else [c for c in columns if c != right]
    if right in left or len(set(left)) != len(left):
        raise ValueError("the rhs must not occur in the lhs, nor an attribute twice")
    return [(right, left)]


def split_sides(vectors: DataFrame, rhs: str, lhs: list[str]) -> DataFrame:
    """Rhs first (renamed to ``rhs``), then the lhs columns; duplicates stay."""
    return vectors.select(q(rhs).alias("rhs"), *[q(c).alias(c) for c in lhs])


def discover_rfds(
    df: DataFrame,
    rhs=None,
    lhs=None,
    key: str | None = None,
    columns: list[str] | None = None,
    distances=None,
    taxonomies=None,
    float32: bool = False,
    bytes: bool = False,
    scale: int | None = None,
    integral_levels: bool = False,
    medians: dict[str, float] | None = None,
    tiles: int | None = None,
    front: Strategy | None = None,
    rules: Strategy | None = None,
    median_accuracy: int | None = None,
) -> DataFrame:
    """Dependencies of ``df`` in wide form: ``rhs, rhs_threshold``, one threshold column per attribute (null = absent).

    With ``medians`` given, the distance vectors are never materialised: the front
    is searched over tile pairs that cannot be ruled out by their bounds.

    Two steps are open, each a callable from frame to frame.  ``front`` gets the distances of every combination (``rhs_name, rhs, l0, l1, ...``) and returns
    the rows that stand for them, same columns.  By default these are the rows that no other beats; levels are read off what stands, so other rows give other rules.
    ``rules`` gets the dependencies and returns those to report, for instance ``minimal_rfds``.  With ``median_accuracy`` the medians come from sketches
    (``approximate_medians``), so levels and left thresholds end at a value near the median.
    """
    if front is not None and (medians is not None or integral_levels):
        raise ValueError("a front of one's own needs the distance vectors of all levels")
    if median_accuracy is not None and medians is not None:
        raise ValueError("medians are either given or approximated")
    names = columns or [c for c in df.columns if c != key]
    combos = combinations(names, rhs, lhs)
    if taken := set(RESERVED) & set(names):
        raise ValueError(f"attributes may not be named as columns of the result: {sorted(taken)}")
    if len(names) < 2:
        raise ValueError("a dependency needs at least two attributes")
    measures = taxonomy_measures(
        df, measures_for(df, names, None, distances, float32, bytes, scale), taxonomies or {}
    )
    rows, n = staged_profiles(df, measures, lambda r: attach_paths(r, measures, taxonomies or {}))
    if medians is not None:
        from softdeps.operators.zones import pruned_front

        limits = {r: medians[r] for r, _ in combos} if integral_levels else None
        found, size = pruned_front(rows, n, measures, combos, medians, limits)
        told = dependencies(found, size, combos, medians, names)
    else:
        vectors, size = stage_counted(profile_vectors(rows, n, measures, tiles), "vectors")
        told = discover_from_vectors(vectors, combos, integral_levels, size, front, median_accuracy)
    return told if rules is None else rules(told)


def discover_all(df: DataFrame, **options) -> DataFrame:
    """Dependencies of every combination in one table, keyed by its label."""
    names = options.get("columns") or [c for c in df.columns if c != options.get("key")]
    return with_combination(discover_rfds(df, **options), combinations(names, options.get("rhs"), options.get("lhs")))


def with_combination(rfds: DataFrame, combos: list[Combo]) -> DataFrame:
    from softdeps.functions.formatting import combo_label

    label = F.lit(None).cast("string")
    for right, left in combos:
        label = F.when(F.col("rhs") == right, combo_label(right, left)).otherwise(label)
    return rfds.withColumn("combination", label)


def discover_from_vectors(
    vectors: DataFrame,
    combos: list[Combo],
    integral_levels: bool = False,
    size: int | None = None,
    front: Strategy | None = None,
    median_accuracy: int | None = None,
) -> DataFrame:
    """Dependencies from a staged frame of distinct distance vectors (about ``size`` rows); the options are those of ``discover_rfds``."""
    known = median_values(vectors, size) if median_accuracy is None else approximate_medians(vectors, median_accuracy).first().asDict()
    medians = {c: float("inf") if known.get(c) is None else known[c] for c in vectors.columns}
    if front is None:
        found, n = vector_front(vectors, combos, medians, integral_levels)
    else:
        found, n = stage_counted(front(combination_distances(vectors, combos)), "front")
    return dependencies(found, n, combos, medians, vectors.columns)


def combination_distances(vectors: DataFrame, combos: list[Combo]) -> DataFrame:
    """The vectors seen from every combination: ``rhs_name, rhs, l0, l1, ...``."""
    seen = lambda r, ls: F.struct(
        F.lit(r).alias("rhs_name"),
        q(r).cast("double").alias("rhs"),
        *[q(c).cast("double").alias(low) for c, low in zip(ls, front_columns(len(ls)))],
    )
    return vectors.select(F.inline(F.array(*[seen(r, ls) for r, ls in combos])))


def relational_front(distances: DataFrame) -> DataFrame:
    """A front strategy of joins and aggregates alone: the largest ``rhs`` of every left vector, then those that no other is at or beyond, found by boxes."""
    lows = [c for c in distances.columns if c not in ("rhs_name", "rhs")]
    largest = distances.groupBy("rhs_name", *lows).agg(F.max("rhs").alias("rhs"))
    measured = [*lows, "down"]
    rows, _ = boxed(largest.withColumn("down", -F.col("rhs")), ["rhs_name"], measured)
    return rows.join(covered(rows, rows, measured, ["rhs_name"], apart=True), "#id", "left_anti").select("rhs_name", "rhs", *lows)


def vector_front(
    vectors: DataFrame, combos: list[Combo], medians: dict[str, float] | None = None, integral_levels: bool = False
) -> tuple[DataFrame, int]:
    """The staged front of every combination and its size."""
    limits = {r: medians[r] for r, _ in combos} if integral_levels else None
    return merge_fronts(local_fronts(vectors, combos, limits), len(combos[0][1]))


def _by_combo(combos: list[Combo], value) -> Column:
    """``value(combo)`` as a column, chosen by ``rhs_name``."""
    out = F.lit(None).cast("double")
    for combo in combos:
        out = F.when(F.col("rhs_name") == combo[0], F.lit(float(value(combo)))).otherwise(out)
    return out


def candidate_levels(front: DataFrame, size: int, combos: list[Combo], medians: dict[str, float]) -> DataFrame:
    """Front rows with their level's capped minima (``min_``), the minima above it (``prior_``) and ``capped_`` values.

    Only levels up to the rhs median with at least one row above them remain.
    """
    lows = front_columns(len(combos[0][1]))
    capped = {f"capped_{c}": F.when(F.col(c) <= _by_combo(combos, lambda x, j=j: medians[x[1][j]]), F.col(c))
              for j, c in enumerate(lows)}
    rows = front.withColumns(capped)
    minima = rows.groupBy("rhs_name", "rhs").agg(
        *[F.min(c).alias(c) for c in lows], *[F.min(f"capped_{c}").alias(f"min_{c}") for c in lows]
    )
    ranges = 1 if size <= FRONT_TILE_ROWS else RANGES
    above = prior_min(minima, lows, "rhs_name", "rhs", ranges).drop(*lows)
    in_scope = (F.col("rhs") <= _by_combo(combos, lambda x: medians[x[0]])) & F.col(f"prior_{lows[0]}").isNotNull()
    return rows.join(above.where(in_scope), ["rhs_name", "rhs"])


def single_rfds(levels: DataFrame, width: int) -> DataFrame:
    """Dependencies with one lhs attribute: a level's capped minimum below every value above it."""
    lows = front_columns(width)
    per_level = levels.groupBy("rhs_name", "rhs").agg(
        *[F.first(f"min_{c}").alias(f"min_{c}") for c in lows],
        *[F.first(f"prior_{c}").alias(f"prior_{c}") for c in lows],
    )
    found = F.array(
        *[
            F.when(F.col(f"min_{c}") < F.col(f"prior_{c}"), F.struct(F.lit(j).alias("#j"), F.col(f"min_{c}").alias("#t")))
            for j, c in enumerate(lows)
        ]
    )
    one = per_level.select("rhs_name", "rhs", F.inline(F.filter(found, lambda s: s.isNotNull())))
    return one.select("rhs_name", "rhs", *[F.when(F.col("#j") == j, F.col("#t")).alias(c) for j, c in enumerate(lows)])


def composite_rfds(levels: DataFrame, intervals: DataFrame, width: int, tiles: int | None = None) -> DataFrame:
    """Dependencies with several lhs attributes; tiles follow from the number of intervals unless given.

    A row is compared with its pool once; each comparison is summarised by two
    bit sets over the row's open attributes: where the row is at or below the pool
    row (``under``) and where it is at or above it (``over``).  A slice ``under`` is
    sound when no other pool row has ``over`` covering it.
    """
    lows = front_columns(width)
    hit = lambda c: F.coalesce(
        (F.col(f"min_{c}") < F.col(f"prior_{c}")) & (F.col(f"capped_{c}") == F.col(f"min_{c}")), F.lit(False)
    )
    sets = BitSets(width)
    every = ["rhs_name", "rhs"] + lows
    rows = levels.select(*every, sets.of([~hit(c) for c in lows]).alias("open")).where(sets.size(F.col("open")) >= 2)
    if not sets.single:  # else every use of a set would repeat its whole expression
        rows, intervals = stage(rows, "open"), stage(intervals, "intervals")

    alive = (F.col("b.rhs") > F.col("a.rhs")) & (F.col("b.kill").isNull() | (F.col("b.kill") <= F.col("a.rhs")))
    cut = tiles or tiles_for(intervals)
    met = cross_cells(rows, intervals, ["rhs_name"], alive, (cut, cut))
    open_bits = F.col("a.open")
    under = sets.both(sets.of([F.col(f"a.{c}") <= F.col(f"b.{c}") for c in lows]), open_bits)
    over = sets.both(sets.of([F.col(f"b.{c}") <= F.col(f"a.{c}") for c in lows]), open_bits)
    row_key = every + ["open"]
    compared = met.select(*[F.col(f"a.{c}").alias(c) for c in row_key], under.alias("under"), over.alias("over"))
    masks = (
        (compared if sets.single else stage(compared, "compared"))
        .groupBy(*row_key, "under", "over")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    slices = _sound_slices(masks, row_key, width) if width <= SMALL_WIDTH else _sound_slices_joined(masks, row_key, width)
    keep = lambda j, c: F.when(sets.has(F.col("kept"), j), F.col(c)).alias(c)
    return slices.select("rhs_name", "rhs", *[keep(j, c) for j, c in enumerate(lows)])


def _sound_slices(masks: DataFrame, row_key: list[str], width: int) -> DataFrame:
    """Sound slices per row, or the row's open attributes when it has none.

    A row has at most ``3 ** width`` distinct mask pairs, so they fit in one array.
    """
    entry = F.struct("under", "over", "n")
    rows = masks.groupBy(*row_key).agg(F.collect_list(entry).alias("met"))
    sets = BitSets(width)
    beaten = F.exists("met", lambda z: z["over"] == F.col("open")) & (F.col("open") != sets.full())

    def unsound(s: Column) -> Column:
        another = lambda z: (z["over"] != s["over"]) | (z["under"] != s["under"]) | (z["n"] >= 2)
        return F.exists("met", lambda z: sets.covers(z["over"], s["under"]) & another(z))

    sound = F.array_distinct(F.transform(F.filter("met", lambda s: ~unsound(s)), lambda s: s["under"]))
    rows = rows.where(~beaten).withColumn("sound", sound)
    kept = F.when(F.size("sound") > 0, F.col("sound")).otherwise(F.array("open"))
    return rows.select(*row_key, F.explode(kept).alias("kept"))


def _sound_slices_joined(masks: DataFrame, row_key: list[str], width: int) -> DataFrame:
    """The same as ``_sound_slices`` by joins, for wide tables whose mask pairs may not fit in one array."""
    masks = stage(masks, "masks")
    sets = BitSets(width)
    beaten = masks.where((F.col("over") == F.col("open")) & (F.col("open") != sets.full())).select(*row_key).distinct()
    usable = masks.join(beaten, row_key, "left_anti")
    s, z = usable.alias("s"), usable.alias("z")
    same = all_of([F.col(f"s.{c}") == F.col(f"z.{c}") for c in row_key])
    covered = sets.covers(F.col("z.over"), F.col("s.under"))
    another = (F.col("s.over") != F.col("z.over")) | (F.col("s.under") != F.col("z.under")) | (F.col("z.n") >= 2)
    slices = s.join(z, same & covered & another, "left_anti").select(*row_key, F.col("under").alias("kept"))
    whole = usable.select(*row_key).distinct().join(slices.select(*row_key).distinct(), row_key, "left_anti")
    return slices.unionByName(whole.withColumn("kept", F.col("open")))


def dependencies(
    front: DataFrame, size: int, combos: list[Combo], medians: dict[str, float], names: list[str]
) -> DataFrame:
    """Single and composite dependencies of every combination, wide, without duplicates."""
    width = len(combos[0][1])
    tiles = ceil_div(size, FRONT_TILE_ROWS)
    levels = candidate_levels(front, size, combos, medians)
    if tiles > 1 or width > WORD:
        levels = stage(levels, "levels")
    found = single_rfds(levels, width)
    if width >= 2:
        found = found.unionByName(composite_rfds(levels, pool_intervals(front, width, tiles), width, tiles))
    return to_attributes(found, combos, names).dropDuplicates()


def to_attributes(found: DataFrame, combos: list[Combo], names: list[str]) -> DataFrame:
    """Positional thresholds under their attribute names; an infinite threshold constrains nothing and is dropped."""

    def threshold(name: str) -> Column:
        out = F.lit(None).cast("double")
        for right, left in combos:
            if name in left:
                value = F.col(f"l{left.index(name)}")
                out = F.when(F.col("rhs_name") == right, F.when(value != float("inf"), value)).otherwise(out)
        return out.alias(name)

    return found.select(
        F.col("rhs_name").alias("rhs"), F.col("rhs").alias("rhs_threshold"), *[threshold(c) for c in names]
    )
