"""Distances of all row pairs of a cell, block by block in numpy.

A task gets the rows of its cells one cell after the other (two tiles at most), and hands on Arrow batches of pairs; it never holds
more than a cell's rows and one batch.  What numpy doesn't measure (own distances, ancestors, texts of over ``WORD`` characters
behind what all share) is left to the joins of ``pairs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softdeps.functions.distances import MICROS_PER_DAY, Measure

KINDS = ("numeric", "numeric32", "text", "bytes", "days", "memo")
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)
WORD = 64
LEFT_ROWS = 128
RIGHT_ROWS = 512
HELD_VECTORS = 1 << 20


class Numbers:
    """Numbers of a cell's rows; ``between`` gives the distances of two ranges of rows, one row of the result for each on the left."""

    def __init__(self, column: pa.Array, dtype: type):
        self.missing = np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), dtype=bool)
        self.values = np.asarray(pc.fill_null(column, 0).to_numpy(zero_copy_only=False), dtype=dtype)
        self.infinite = bool(dtype is not np.int64 and np.isinf(self.values).any())
        self.order = (self.values, self.missing)

    def sort(self, order: np.ndarray) -> None:
        self.values = self.values[order]

    def measured(self, left: slice, right: slice) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            gap = np.abs(self.values[left, None] - self.values[None, right]).astype(np.float64, copy=False)
        if self.infinite:
            gap[np.isnan(gap)] = 0.0  # two equal infinities
        return gap


class Days(Numbers):
    def __init__(self, column: pa.Array):
        super().__init__(column, np.int64)

    def measured(self, left: slice, right: slice) -> np.ndarray:
        micros = np.abs(self.values[left, None] - self.values[None, right])
        return (micros - micros % MICROS_PER_DAY).astype(np.float64) / float(MICROS_PER_DAY)


class Memos:
    """Codes of values, and of every value the distances to all codes."""

    def __init__(self, column: pa.Array):
        self.missing = np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), dtype=bool)
        self.codes = np.asarray(pc.fill_null(pc.struct_field(column, "code"), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        firsts = {int(c): i for i, c in reversed([*enumerate(self.codes)]) if not self.missing[i]}
        to = pc.struct_field(column, "to")
        rows = {c: np.asarray(to[i].values.to_numpy(zero_copy_only=False), dtype=np.float64) for c, i in firsts.items()}
        self.table = np.zeros((max(rows, default=0) + 1, max(map(len, rows.values()), default=1)))
        for c, row in rows.items():
            self.table[c, : len(row)] = row
        self.order = (self.codes, self.missing)

    def sort(self, order: np.ndarray) -> None:
        self.codes = self.codes[order]

    def measured(self, left: slice, right: slice) -> np.ndarray:
        return self.table[self.codes[left]][:, self.codes[right]]


class Texts:
    """Texts as numbers of their characters; edit distances by bit vectors (Myers 1999, Hyyro 2003), a word for every pair of texts."""

    def __init__(self, column: pa.Array):
        self.missing = np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), dtype=bool)
        texts = [(v or b"").decode("utf-8", "surrogateescape") for v in column.cast(pa.binary()).to_pylist()]
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        width = max(1, int(self.lengths.max(initial=0)))
        points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
        known, codes = np.unique(points, return_inverse=True)
        self.codes, self.known = codes.reshape(points.shape), len(known)
        self.word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if width <= np.iinfo(w).bits)
        self.order = (*reversed(self.codes.T), self.lengths, self.missing)

    def sort(self, order: np.ndarray) -> None:
        self.codes, self.lengths = self.codes[order], self.lengths[order]

    def measured(self, left: slice, right: slice) -> np.ndarray:
        sizes, texts, patterns = self.lengths[right], self.codes[right], self.codes[left]
        long_first = None
        if len(sizes) and sizes.min() < sizes.max():
            long_first = np.argsort(-sizes, kind="stable")
            sizes, texts = sizes[long_first], texts[long_first]
        found = self._edits(patterns, self.lengths[left], texts, sizes)
        if long_first is None:
            return found
        out = np.empty_like(found)
        out[:, long_first] = found
        return out

    def _edits(self, patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Edit distances of all patterns to all texts, the longest text first."""
        word, one = self.word, self.word(1)
        n, m = len(patterns), len(texts)
        places = np.zeros((n, self.known), dtype=word)
        rows = np.arange(n)
        for p in range(int(lengths.max(initial=0))):
            has = lengths > p
            places[rows[has], patterns[has, p]] |= word(1 << p)
        last = np.where(lengths > 0, one << np.maximum(lengths - 1, 0).astype(word), word(0)).astype(word)[:, None]
        score = np.repeat(lengths.astype(np.int16)[:, None], m, axis=1)
        up, down = np.full((n, m), np.iinfo(word).max, dtype=word), np.zeros((n, m), dtype=word)
        for k in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sizes, -k, side="left"))  # texts of more than k characters
            pv, mv = up[:, :live], down[:, :live]
            eq = np.take(places, texts[:live, k], axis=1)
            xv = eq | mv
            eq_or = eq & pv
            eq_or += pv
            eq_or ^= pv
            eq_or |= eq
            ph = ~(eq_or | pv)
            ph |= mv
            mh = pv & eq_or
            score[:, :live] += (ph & last) != 0
            score[:, :live] -= (mh & last) != 0
            ph <<= one
            ph |= one
            mh <<= one
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            np.bitwise_and(ph, xv, out=mv)
        score[lengths == 0] = sizes.astype(np.int16)
        return score.astype(np.float64)


def column_of(measure: Measure, column: pa.Array):
    if measure.kind in ("text", "bytes"):
        return Texts(column)
    if measure.kind == "memo":
        return Memos(column)
    if measure.kind == "days":
        return Days(column)
    return Numbers(column, np.float32 if measure.kind == "numeric32" else np.float64)


class Cell:
    """The rows of one cell of ``tiles`` tiles: those of its first tile in front, each tile in an order that gathers equal values (or sorts keys)."""

    def __init__(self, table: pa.Table, tiles: int, measures: list[Measure], key: str | None):
        flat = lambda c: pa.concat_arrays(table.column(c).chunks)
        self.alone = table.column("#cell")[0].as_py() % (tiles + 1) == 0
        second = flat("#second").to_numpy(zero_copy_only=False).astype(bool)
        self.columns = [column_of(m, flat(m.name)) for m in measures]
        self.key = self.rank = None
        if key is None:
            many = sorted(self.columns, key=lambda c: isinstance(c, Texts))
            order = np.lexsort([*[o for c in reversed(many) for o in c.order], second])
        else:
            self.key = flat(key)
            plain = self.key.cast(pa.binary()) if pa.types.is_string(self.key.type) or pa.types.is_large_string(self.key.type) else self.key
            self.rank = np.empty(len(plain), dtype=np.int64)
            self.rank[pc.sort_indices(plain, null_placement="at_end").to_numpy()] = np.arange(len(plain))
            order = np.lexsort([self.rank, second])
            self.rank, self.key = self.rank[order], self.key.take(pa.array(order))
        for c in self.columns:
            c.sort(order)
            c.missing = c.missing[order]
        self.n, self.first = len(second), int((~second).sum())

    def distances(self, left: slice, right: slice) -> list[np.ndarray]:
        out = []
        for c in self.columns:
            found = c.measured(left, right)
            if c.missing[left].any() or c.missing[right].any():
                a, b = c.missing[left, None], c.missing[None, right]
                found = np.where(a & b, 0.0, np.where(a | b, np.inf, found))
            out.append(found)
        return out

    def blocks(self) -> Iterator[tuple[slice, slice, bool]]:
        """Pairs of ranges of rows, and whether both are of one tile and only pairs with the smaller place on the left count."""
        for x in range(0, self.first, LEFT_ROWS):
            left = slice(x, min(x + LEFT_ROWS, self.first))
            for y in range(x if self.alone else self.first, self.n, RIGHT_ROWS):
                right = slice(y, min(y + RIGHT_ROWS, self.n))
                yield left, right, self.alone and y < left.stop

    def runs(self) -> Iterator[list[pa.Array]]:
        """A key, and in lists the keys that follow it in another block with their distances; each pair once, null keys last."""
        for left, right, own in self.blocks():
            found = self.distances(left, right)
            a, b = self.rank[left], self.rank[right]
            if a[0] < b[-1]:
                yield self._run(left, right, np.searchsorted(b, a, side="right"), found)
            if not own and b[0] < a[-1]:
                yield self._run(right, left, np.searchsorted(a, b), [f.T for f in found])

    def _run(self, firsts: slice, seconds: slice, starts: np.ndarray, found: list[np.ndarray]) -> list[pa.Array]:
        """Lists for ``firsts``, each with what is from its start on in ``seconds``."""
        m = seconds.stop - seconds.start
        keys = np.broadcast_to(np.arange(seconds.start, seconds.stop), (len(starts), m))
        if starts.any():
            keep = np.arange(m) >= starts[:, None]
            keys, found = keys[keep], [f[keep] for f in found]
        ends = pa.array(np.concatenate([[0], np.cumsum(m - starts)]).astype(np.int32))
        lists = [self.key.take(pa.array(keys.ravel())), *[pa.array(f.ravel()) for f in found]]
        return [self.key.slice(firsts.start, len(starts)), *[pa.ListArray.from_arrays(ends, values) for values in lists]]

    def vectors(self) -> Iterator[list[np.ndarray]]:
        """Distances of all pairs, without most of the repeats."""
        tried = left_over = 0
        for left, right, own in self.blocks():
            found = [f.ravel() for f in self.distances(left, right)]
            if own:
                keep = (np.arange(left.start, left.stop)[:, None] < np.arange(right.start, right.stop)[None, :]).ravel()
                found = [f[keep] for f in found]
            if not len(found[0]):
                continue
            if tried < HELD_VECTORS or 2 * left_over < tried:
                tried += len(found[0])
                found = fewer(found)
                left_over += len(found[0])
            yield found


def fewer(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The rows without those that equal the row in their place of a table of hashes; no row is lost, some repeats may stay."""
    mixed = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bits = max(4, int(len(mixed)).bit_length() + 1)
    place = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    row = np.arange(len(mixed))
    held = np.zeros(1 << bits, dtype=np.int64)
    held[place] = row
    held = held[place]
    kept = np.zeros(len(mixed), dtype=bool)
    for c in columns:
        kept |= c != c[held]
    kept |= held == row
    return [c[kept] for c in columns]


def cell_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other from batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column("#cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and held[0].column("#cell")[0].as_py() != cells[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def measurable(measures: list[Measure], longest: dict[str, int]) -> bool:
    """Whether numpy measures all of them; ``longest`` holds the characters of each text column's longest text."""
    return all(m.kind in KINDS and longest.get(m.name, 0) <= WORD for m in measures)


def in_cells(rows: DataFrame, tiles: int, partitions: int) -> DataFrame:
    """``rows`` (with ``#id``, ``#tile``) once for every cell of their tile, dealt and sorted by cell; ``#second`` marks the cell's second tile."""
    tile, low, high = F.col("#tile"), F.col("#low"), F.col("#high")
    cells = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.struct(F.least(tile, t).alias("#low"), F.greatest(tile, t).alias("#high")))
    met = rows.withColumn("#of", F.explode(cells)).withColumns({"#low": F.col("#of.#low"), "#high": F.col("#of.#high")})
    told = met.withColumns({"#cell": low * F.lit(tiles) + high, "#second": tile != low})
    # Cells are numbered without gaps, so that each partition gets as many as any other, or one more.
    number = F.pmod(low * F.lit(tiles) - F.shiftright(low * (low + 1), 1) + high, F.lit(partitions))
    dealt = told.repartitionById(partitions, number.cast("int"))
    return dealt.drop("#id", "#tile", "#of", "#low", "#high").sortWithinPartitions("#cell")


def cell_pairs(rows: DataFrame, tiles: int, partitions: int, measures: list[Measure], key: str) -> DataFrame:
    """``key_a``, ``key_b`` and the distances of every unordered pair of rows.

    Tasks hand on a row for each key and block, with the other keys and the distances in arrays that a generator unfolds: much cheaper than Arrow rows.
    """
    kind, numbers = rows.schema[key].dataType, range(len(measures))
    names = ["a", "b", *[f"d{i}" for i in numbers]]
    lists = [T.ArrayType(kind), *[T.ArrayType(T.DoubleType(), False) for _ in measures]]
    schema = T.StructType([T.StructField("a", kind), *[T.StructField(c, x) for c, x in zip(names[1:], lists)]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cell_tables(batches):
            for columns in Cell(table, tiles, measures, key).runs():
                yield pa.RecordBatch.from_arrays(columns, names=names)

    runs = in_cells(rows, tiles, partitions).mapInArrow(measured, schema)
    each = runs.select("a", *names[2:], F.posexplode("b").alias("at", "b"))
    found = [m.rounded(F.get(f"d{i}", F.col("at"))).alias(m.name) for i, m in zip(numbers, measures)]
    return each.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), *found)


def cell_vectors(rows: DataFrame, tiles: int, partitions: int, measures: list[Measure]) -> DataFrame:
    """The distances of all row pairs, most repeats within a task left out."""
    names = [m.name for m in measures]
    schema = T.StructType([T.StructField(c, T.DoubleType(), False) for c in names])
    most = HELD_VECTORS

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for table in cell_tables(batches):
            for columns in Cell(table, tiles, measures, None).vectors():
                held.append(columns)
                n += len(columns[0])
                if n >= most:
                    told = fewer([np.concatenate(parts) for parts in zip(*held)])
                    held, n = [told], len(told[0])
                    if 2 * n > most:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, told)], names=names)
                        held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([*map(pa.array, fewer([np.concatenate(parts) for parts in zip(*held)]))], names=names)

    found = in_cells(rows, tiles, partitions).mapInArrow(measured, schema)
    return found.select(*[m.rounded(F.col(f"`{m.name}`")).alias(m.name) for m in measures])
