"""Where rows that lie within the thresholds of a dependency can meet.

Every row has one *home* and reaches some homes; a row's partner within all thresholds has its home among them, exactly once.  Attributes that must be
equal are part of the home.  One further attribute narrows it: a number or date by bands as wide as its threshold (a row reaches the neighbouring
bands too), or a text by the values within its edits.  Tile pairs are taken from the homes that tiles hold and reach, so that no plan pairs all tiles.
Rows that meet by text are joined by the pairs of values themselves, unless a value has very many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.functions.distances import MICROS_PER_DAY, Measure
from softdeps.operators.edits import edit_pairs
from softdeps.operators.pairs import cross_cells, q
from softdeps.session import ceil_div, stage

# Bands are counted up to this number from 0, beyond which a double can't tell neighbours; and tiles of a home that meet in one key.
FARTHEST, HOME_TILES = float(1 << 50), 2_048

# Rows of one text that meet those of another in one key.
TEXT_ROWS = 4_096

EXACT = ("numeric", "numeric32", "text", "bytes")


def equal_names(measures: list[Measure], lhs: dict[str, float]) -> list[str]:
    """Attributes whose threshold means equality."""
    zero = lambda m: lhs[m.name] < 1 if m.kind in ("text", "bytes") else lhs[m.name] == 0
    return [m.name for m in measures if m.name in lhs and m.kind in EXACT and m.scale is None and zero(m)]


@dataclass(frozen=True)
class Meeting:
    """``equal`` attributes, and one of: a ``band`` (attribute with its width), a ``text`` (attribute with its similar values ``v < w``), or neither."""

    equal: list[str]
    band: tuple[Measure, float] | None = None
    text: str | None = None
    similar: DataFrame | None = None

    def _home(self, narrowed: Column) -> Column:
        return F.xxhash64(*[q(c) for c in self.equal], narrowed)

    def home(self) -> Column:
        if self.band:
            return self._home(band_of(*self.band))
        return self._home(q(self.text) if self.text else F.lit(0))

    def reaching(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``#home``, once for every home that a row reaches."""
        if self.band:
            b = band_of(*self.band)
            homes = F.array_distinct(F.array(*[self._home(b + d) for d in (-1, 0, 1)]))
            return rows.select("*", F.explode(homes).alias("#home"))
        if not self.text:
            return rows.withColumn("#home", self.home())
        both = F.explode(F.array(F.struct("v", "w"), F.struct(F.col("w").alias("v"), F.col("v").alias("w"))))
        own, near = rows.withColumn("#value", q(self.text)), self.similar.select(both.alias("p")).select("p.v", "p.w")
        met = own.join(near.select(F.col("v").alias("#value"), F.col("w").alias("#near")), "#value")
        return own.unionByName(met.drop("#value").withColumnRenamed("#near", "#value")).withColumn("#home", self._home(F.col("#value"))).drop("#value")


def band_width(m: Measure, limit: float) -> float:
    """Rows within ``limit`` lie in the same or in neighbouring bands."""
    slack = 0 if m.scale is None else 10.0**-m.scale
    if m.kind == "days":
        return (int(limit + slack) + 1) * MICROS_PER_DAY
    return 2 * (limit + slack)  # twice the limit: rounding can't move a row by a band


def band_of(m: Measure, width: float) -> Column:
    value = q(m.name)
    if m.kind == "days":
        w = F.lit(int(width)).cast("bigint")
        return F.call_function("div", value - F.pmod(value, w), w)
    place = value.cast("double") / F.lit(float(width))
    return F.floor(F.greatest(F.least(place, F.lit(FARTHEST)), F.lit(-FARTHEST)))


def meeting_for(rows: DataFrame, measures: list[Measure], lhs: dict[str, float]) -> Meeting | None:
    """The narrowest meeting that the thresholds allow; None if no threshold narrows anything."""
    equal = equal_names(measures, lhs)
    rest = [m for m in measures if m.name in lhs and m.name not in equal and lhs[m.name] < float("inf")]
    bands = [(m, band_width(m, lhs[m.name])) for m in rest if m.kind in ("numeric", "numeric32", "days")]
    bands = [(m, w) for m, w in bands if 0 < w < float("inf")]
    if bands:
        finite = lambda m: F.when(F.abs(q(m.name).cast("double")) < float("inf"), q(m.name).cast("double"))
        spreads = rows.agg(*[F.coalesce((F.max(finite(m)) - F.min(finite(m))) / w, F.lit(0.0)).alias(f"s{i}") for i, (m, w) in enumerate(bands)]).first()
        best = max(range(len(bands)), key=lambda i: spreads[i])
        if spreads[best] > 4 or equal:
            return Meeting(equal, band=bands[best])
    texts = [m for m in rest if m.kind in ("text", "bytes") and m.scale is None]
    if texts and not equal:
        tightest = min(texts, key=lambda m: lhs[m.name])
        pairs = edit_pairs(rows.select(q(tightest.name).alias("v")), int(lhs[tightest.name]))
        return Meeting(equal, text=tightest.name, similar=stage(pairs.select(F.col("value_a").alias("v"), F.col("value_b").alias("w")), "similar"))
    if bands:
        return Meeting(equal, band=bands[best])
    return Meeting(equal) if equal else None


def meets_by_text(rows: DataFrame, meeting: Meeting | None) -> bool:
    """Whether rows meet by similar texts, none of which has more than ``TEXT_ROWS`` rows: then they need no tiles."""
    if meeting is None or not meeting.text:
        return False
    most = rows.groupBy(q(meeting.text)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return most <= TEXT_ROWS


def join_texts(rows: DataFrame, meeting: Meeting, keep: list[str]) -> DataFrame:
    """Row pairs of equal or similar texts, each once, as structs ``a`` and ``b``; a row reaches no others.  Missing texts are equal."""
    row = F.struct(*[q(c) for c in [*keep, "#id"]])
    first, second = (rows.select(row.alias(s), q(meeting.text).alias(v)) for s, v in (("a", "v"), ("b", "w")))
    same = first.join(second, F.col("v").eqNullSafe(F.col("w"))).where(F.col("a.`#id`") < F.col("b.`#id`"))
    near = first.join(meeting.similar, "v").join(second, "w")
    return same.select("a", "b").unionAll(near.select("a", "b"))


def meeting_tiles(tiled: DataFrame, meeting: Meeting) -> DataFrame:
    """``(ta, tb)``, ``ta <= tb``: pairs of tiles of which one holds a home that the other reaches."""
    tile = q("#tile").alias("tile")
    held = stage(tiled.select(meeting.home().alias("#home"), tile).distinct(), "homes")
    reached = meeting.reaching(tiled).select("#home", tile).distinct() if meeting.band or meeting.text else held
    most = held.groupBy("#home").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cells = ceil_div(most, HOME_TILES)
    met = cross_cells(held, reached, ["#home"], F.lit(True), (cells, cells))
    low, high = F.least("a.tile", "b.tile"), F.greatest("a.tile", "b.tile")
    return met.select(low.alias("ta"), high.alias("tb")).distinct()
