"""Per-attribute distances as Column expressions.

Every measured attribute is first *encoded* (numbers to double, dates to epoch
microseconds, text as it is) so that the pair join only does cheap arithmetic,
and then compared by a distance that follows one null rule: both missing is 0,
one missing is infinity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
Builder = Callable[[Column, Column], Column]


def infinity() -> Column:
    return F.lit(float("inf"))


def with_null_rule(a: Column, b: Column, distance: Column) -> Column:
    return (
        F.when(a.isNull() & b.isNull(), F.lit(0.0))
        .when(a.isNull() | b.isNull(), infinity())
        .otherwise(distance.cast("double"))
    )


def numeric_distance(a: Column, b: Column) -> Column:
    return with_null_rule(a, b, F.abs(difference(a, b)))


def difference(a: Column, b: Column) -> Column:
    """``a - b``, and 0 for two equal infinities."""
    return F.when(a == b, F.lit(0)).otherwise(a - b)


def edit_distance(a: Column, b: Column, bytes: bool = False) -> Column:
    """Levenshtein distance over characters, or over UTF-8 bytes."""
    if bytes:
        a, b = utf8_units(a), utf8_units(b)
    return with_null_rule(a, b, F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b)))


def day_distance(a: Column, b: Column) -> Column:
    """Whole days between two date or timestamp columns, truncated toward zero."""
    return with_null_rule(a, b, F.abs(F.timestamp_diff("DAY", a, b)))


def utf8_units(c: Column) -> Column:
    """One character per UTF-8 byte, so that character functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def whole_days(micros: Column) -> Column:
    day = F.lit(MICROS_PER_DAY)
    return (micros - micros % day) / day


def epoch_micros(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, c.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Measure:
    """How one attribute is encoded, compared, and bounded over a tile of rows."""

    name: str
    kind: str  # numeric | numeric32 | text | bytes | days | paths | memo | custom
    data_type: T.DataType
    scale: int | None = None
    builder: Builder | None = None

    def encode(self, c: Column) -> Column:
        if self.kind in ("numeric", "numeric32"):
            wide = c.cast("double")
            clean = F.when(~F.isnan(wide), wide + F.lit(0.0))
            return clean.cast("float") if self.kind == "numeric32" else clean
        if self.kind == "bytes":
            return utf8_units(c)
        if self.kind == "days":
            return epoch_micros(c, self.data_type)
        return c

    def distance(self, a: Column, b: Column) -> Column:
        if self.kind == "custom":
            raw = with_null_rule(a, b, self.builder(a, b))
        elif self.kind == "days":
            raw = with_null_rule(a, b, whole_days(F.abs(a - b)))
        elif self.kind in ("text", "bytes"):
            raw = edit_distance(a, b)
        elif self.kind == "memo":
            raw = with_null_rule(a, b, F.get(a["to"], b["code"]))
        elif self.kind == "paths":
            raw = with_null_rule(a, b, path_distance(a, b))
        else:
            raw = numeric_distance(a, b)
        return self.rounded(raw)

    def rounded(self, c: Column) -> Column:
        return c if self.scale is None else F.round(c, self.scale)

    # -- bounds over tiles of rows, used to skip tile pairs ------------------

    def bound_aggregates(self) -> list[Column]:
        """Tile statistics: value range, length range, and whether nulls and values occur."""
        c = F.col(f"`{self.name}`")
        flags = [
            F.max(c.isNull()).alias(f"{self.name}#nulls"),
            F.max(c.isNotNull()).alias(f"{self.name}#vals"),
        ]
        if self.kind in ("text", "bytes"):
            return flags + [
                F.min(F.length(c)).alias(f"{self.name}#lo"),
                F.max(F.length(c)).alias(f"{self.name}#hi"),
                F.min(c).alias(f"{self.name}#first"),
                F.max(c).alias(f"{self.name}#last"),
            ]
        if self.kind in ("paths", "custom"):
            return flags
        return flags + [F.min(c).alias(f"{self.name}#lo"), F.max(c).alias(f"{self.name}#hi")]

    def _stat(self, side: str, stat: str) -> Column:
        return F.col(f"{side}.`{self.name}#{stat}`")

    def _value_range(self) -> tuple[Column, Column]:
        """Smallest and largest distance between two present values of tiles ``a`` and ``b``."""
        if self.kind in ("paths", "custom"):
            return F.lit(0.0), infinity()
        lo_a, hi_a = self._stat("a", "lo"), self._stat("a", "hi")
        lo_b, hi_b = self._stat("b", "lo"), self._stat("b", "hi")
        gap = F.greatest(difference(lo_b, hi_a), difference(lo_a, hi_b))
        if self.kind in ("text", "bytes"):
            first_a, last_a = self._stat("a", "first"), self._stat("a", "last")
            first_b, last_b = self._stat("b", "first"), self._stat("b", "last")
            apart = F.when((last_a < first_b) | (last_b < first_a), F.lit(1)).otherwise(F.lit(0))
            one_value = (first_a == last_a) & (first_b == last_b) & (first_a == first_b)
            least = F.greatest(gap, apart)
            most = F.when(one_value, F.lit(0)).otherwise(F.greatest(hi_a, hi_b))
            return least.cast("double"), most.cast("double")
        least = F.greatest(gap, F.lit(0).cast(self._width()))
        most = F.greatest(difference(hi_b, lo_a), difference(hi_a, lo_b))
        if self.kind == "days":
            return whole_days(least), whole_days(most)
        return least.cast("double"), most.cast("double")

    def _width(self) -> str:
        return {"days": "bigint", "numeric32": "float"}.get(self.kind, "double")

    def bounds(self) -> tuple[Column, Column]:
        """Lower and upper bound of the distance between any row of tile ``a`` and any row of tile ``b``."""
        least, most = self._value_range()
        nulls_a, nulls_b = self._stat("a", "nulls"), self._stat("b", "nulls")
        vals_a, vals_b = self._stat("a", "vals"), self._stat("b", "vals")
        mixed = (nulls_a & vals_b) | (vals_a & nulls_b)
        lower = F.least(
            F.when(nulls_a & nulls_b, F.lit(0.0)).otherwise(infinity()),
            F.when(vals_a & vals_b, least).otherwise(infinity()),
        )
        upper = F.greatest(
            F.when(mixed, infinity()).otherwise(F.lit(0.0)),
            F.when(vals_a & vals_b, most).otherwise(F.lit(0.0)),
        )
        return self.rounded(lower), self.rounded(upper)


def path_distance(a: Column, b: Column) -> Column:
    """``1 - 1/(p+1)`` for the shortest path ``p`` through a shared ancestor; 1 when there is none.

    ``a`` and ``b`` map every ancestor of the value (itself included) to its depth.
    """
    shortest = F.aggregate(
        F.map_keys(a),
        infinity(),
        lambda best, node: F.least(best, a[node] + F.coalesce(F.try_element_at(b, node), infinity())),
    )
    return F.lit(1.0) - F.lit(1.0) / (shortest + F.lit(1.0))


def distance_for(
    field: T.StructField,
    builder: Builder | None = None,
    float32: bool = False,
    bytes: bool = False,
    scale: int | None = None,
) -> Measure:
    """Choose the distance of a column by its type; ``builder`` overrides it."""
    dt = field.dataType
    if builder is not None:
        return Measure(field.name, "custom", dt, scale, builder)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return Measure(field.name, "numeric32" if float32 else "numeric", dt, scale)
    if isinstance(dt, T.StringType):
        return Measure(field.name, "bytes" if bytes else "text", dt, scale)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Measure(field.name, "days", dt, scale)
    raise TypeError(f"Unrecognized dtype: column {field.name} has type {dt.simpleString()}")


def measures_for(
    df: DataFrame,
    columns: list[str] | None = None,
    key: str | None = None,
    distances: dict[str, Builder] | None = None,
    float32: bool = False,
    bytes: bool = False,
    scale: int | None = None,
) -> list[Measure]:
    """One measure per column of ``df`` except ``key``, in column order."""
    wanted = columns or [c for c in df.columns if c != key]
    overrides = distances or {}
    return [distance_for(df.schema[c], overrides.get(c), float32, bytes, scale) for c in wanted]
