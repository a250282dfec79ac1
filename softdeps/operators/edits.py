"""Pairs of texts within an edit distance, by an index instead of all pairs.

Texts within ``k`` edits agree once the characters that differ are blotted out and those that only one has are taken out.  Texts with few such leavings meet by
them, so that hardly more is measured than what is found, whatever parts all texts share.  Longer texts meet by grams: those within ``k`` edits share all but ``k * q`` of their grams of ``q`` characters, so of the ``k * q + 1`` grams of each that are rarest in the whole
column they share one.  These prefixes are joined by gram and length, and only what meets is measured, with a bound.  Texts too short to have a prefix of
that size are all within reach of each other's length and meet by length alone.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softdeps.operators.pairs import cross_cells
from softdeps.session import ceil_div, slots, stage

# Characters of a gram: short ones for short texts, and longer, rarer ones from this mean length on.
GRAMS, LONG = (2, 3), 12

# Most leavings of a text; those of longer texts would outgrow it.  A text that holds the blot itself only meets more than it has to.
LEAVINGS, BLOT = 64, "\0"

# Entries of a gram (or of a length, for short texts) that meet in one key, and rows of gram counts that are broadcast.
ENTRIES, BROADCAST_GRAMS = 4_096, 200_000


def numbered_grams(values: DataFrame, q: int) -> DataFrame:
    """``(v, n, gram)`` with ``n`` the text's length; a gram's further occurrences in a text carry their number, so that a text's grams are a set."""
    n = F.length("v")
    at = F.sequence(F.lit(1), n - q + 1)
    every = values.where(n >= q).select("v", n.alias("n"), F.posexplode(F.transform(at, lambda i: F.substring(F.col("v"), i, F.lit(q)))).alias("pos", "gram"))
    occurrence = F.row_number().over(Window.partitionBy("v", "gram").orderBy("pos"))
    return every.select("v", "n", F.concat(F.col("gram"), occurrence.cast("string")).alias("gram"))


def gram_prefixes(values: DataFrame, k: int, q: int) -> DataFrame:
    """``(v, n, gram)``: the ``k * q + 1`` rarest grams of every text that has as many."""
    grams = stage(numbered_grams(values.where(F.length("v") >= k * q + q), q), "grams")
    counts = stage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "gram-counts")
    if counts.count() <= BROADCAST_GRAMS:
        counts = F.broadcast(counts)
    rarest = F.row_number().over(Window.partitionBy("v").orderBy("c", "gram"))
    ranked = grams.join(counts, "gram").withColumn("#r", rarest)
    return ranked.where(F.col("#r") <= k * q + 1).select("v", "n", "gram")


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that agree on ``keys``, as ``a.v`` and ``b.v``; a key with many entries is cut into cells."""
    most = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    tiles = ceil_div(most, ENTRIES)
    if tiles == 1:
        return left.alias("a").join(right.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys])
    return cross_cells(left, right, keys, F.lit(True), (tiles, tiles))


def longest_cut(k: int) -> int:
    """Length up to which a text has at most ``LEAVINGS`` leavings."""
    many = lambda n: sum(comb(n, s) * comb(n, d) for s in range(k + 1) for d in range(k + 1 - s))
    return max((n for n in range(LEAVINGS) if many(n) <= LEAVINGS), default=0)


def leavings(values: DataFrame, k: int) -> DataFrame:
    """``(v, left, d, most)``: a hash of all that is left of a text with ``s`` characters blotted out and ``d`` taken out, ``s + d <= k``; ``most`` is ``k - s``.

    Two texts are within ``k`` edits when they agree after as many blots and ``da`` and ``db`` takings, ``da + db <= most``.
    """

    def each(texts: Column, mark: str) -> Column:
        changed = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.lit(mark), F.substring(t, i + 1, F.length(t)))
        places = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: changed(t, i))
        return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: F.length(t) > 0), places)))

    def entry(s: int, d: int) -> Callable[[Column], Column]:
        return lambda t: F.struct(F.xxhash64(t, F.lit(s)).alias("left"), F.lit(d).alias("d"), F.lit(k - s).alias("most"))

    found, blotted = [], F.array("v")
    for s in range(k + 1):
        taken = blotted
        for d in range(k + 1 - s):
            found.append(F.transform(taken, entry(s, d)))
            taken = each(taken, "")
        blotted = each(blotted, BLOT)
    return values.select("v", F.explode(F.concat(*found)).alias("x")).select("v", "x.left", "x.d", "x.most")


def cut_candidates(values: DataFrame, k: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of ``values(v)`` that agree on what is left of them."""
    spread = values.repartition(4 * slots(values.sparkSession), "v")
    cut = stage(leavings(spread, k), "leavings")
    others = F.explode(F.sequence(F.lit(0), F.col("most") - F.col("d")))
    met = _meet(cut.select("v", "left", "d"), cut.select("v", "left", others.alias("d")), ["left", "d"])
    return met.where("a.v < b.v").select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))


def edit_candidates(values: DataFrame, k: int, q: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of the distinct texts ``values(v)`` that hold all pairs within ``k`` edits; a pair may be met more than once.

    Texts up to ``longest_cut(k)`` characters meet by their leavings; a pair with a longer one by grams.
    """
    cut, n = longest_cut(k), F.length("v")
    by_leavings = cut_candidates(values.where(n <= cut), k)
    if (values.agg(F.max(n)).first()[0] or 0) <= cut:
        return by_leavings
    return by_leavings.unionAll(gram_candidates(values.where(n > cut - k), k, q))


def gram_candidates(values: DataFrame, k: int, q: int) -> DataFrame:
    """The pairs that ``edit_candidates`` takes from grams, and from lengths where texts are short."""
    prefixes = stage(gram_prefixes(values, k, q), "prefixes")
    lengths = F.explode(F.sequence(F.col("n") - k, F.col("n")))
    longer = prefixes.select("v", "gram", lengths.alias("n"))
    by_gram = _meet(prefixes.select("v", "gram", "n"), longer, ["gram", "n"])
    short = k * q + q - 1
    some = stage(values.select("v", F.length("v").alias("n")).where(F.col("n") <= short + k), "short")
    by_length = _meet(some.where(F.col("n") <= short), some.select("v", lengths.alias("n")), ["n"])
    met = by_gram.select("a.v", F.col("b.v").alias("w")).unionAll(by_length.select("a.v", F.col("b.v").alias("w")))
    return met.where("v <> w").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"))


def edit_pairs(values: DataFrame, k: int, q: int | None = None) -> DataFrame:
    """``(value_a, value_b, distance)``, ``value_a < value_b``: every pair of distinct texts of ``values(v)`` within ``k`` edits.  Nulls pair with nothing."""
    if k < 0:
        raise ValueError("the number of edits must not be negative")
    distinct = values.where("v IS NOT NULL").distinct()
    if k == 0:
        return distinct.where("false").select(F.col("v").alias("value_a"), F.col("v").alias("value_b"), F.lit(0).alias("distance"))
    kept = stage(distinct, "values")
    if q is None:
        q = GRAMS[(kept.agg(F.avg(F.length("v"))).first()[0] or 0) >= LONG]
    tested = edit_candidates(kept, k, q).withColumn("distance", F.levenshtein("a", "b", k))
    return tested.where("distance >= 0").select(F.col("a").alias("value_a"), F.col("b").alias("value_b"), "distance").distinct()
