"""Sets of small numbers as columns: one bigint while it is wide enough, an array of words beyond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 62


class BitSets:
    """Sets over ``0 .. width - 1``; all sets of one object have the same form, so that they can be compared and grouped."""

    def __init__(self, width: int, word: int = WORD) -> None:
        self.width, self.word = width, word
        self.single = width <= word

    def _chunks(self, of: list) -> list[list]:
        return [of[i : i + self.word] for i in range(0, self.width, self.word)] or [[]]

    def of(self, flags: list[Column]) -> Column:
        """The numbers whose flag is true; null counts as false."""
        word = lambda part: sum((F.when(f, F.lit(1 << j)).otherwise(F.lit(0)) for j, f in enumerate(part)), F.lit(0)).cast("bigint")
        words = [word(part) for part in self._chunks(flags)]
        return words[0] if self.single else F.array(*words)

    def full(self) -> Column:
        words = [F.lit((1 << len(part)) - 1).cast("bigint") for part in self._chunks(list(range(self.width)))]
        return words[0] if self.single else F.array(*words)

    def both(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b) if self.single else F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))

    def covers(self, a: Column, b: Column) -> Column:
        """Every member of ``b`` is one of ``a``."""
        return self.both(a, b) == b

    def size(self, a: Column) -> Column:
        return F.bit_count(a) if self.single else F.aggregate(a, F.lit(0), lambda n, x: n + F.bit_count(x))

    def has(self, a: Column, j: int) -> Column:
        word = a if self.single else F.get(a, F.lit(j // self.word))
        return word.bitwiseAND(F.lit(1 << (j if self.single else j % self.word))) != 0
