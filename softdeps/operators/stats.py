"""Exact medians, levels, counts and table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softdeps.operators.pairs import q
from softdeps.session import stage

MEDIAN_IN_ONE_PASS = 2_000_000
BAND = 0.01  # share of the rows between a bracket's ends and the middle
SKETCH = 2_000  # a sketch's ranks are off by 1 / SKETCH at most, a twentieth of BAND; what is exact is counted behind it


def medians(vectors: DataFrame) -> DataFrame:
    """Exact median of every column (the two middle values averaged; nulls don't count), as one row.

    Values of all columns are counted under their column's number, spread by range and ranked by running counts: one plan for all columns, and no task holds a
    map of values.
    """
    names = vectors.columns
    middle = _middles(_unpivoted(vectors, {c: F.lit(True) for c in names}, names))
    return middle.agg(*[F.max(F.when(F.col("c") == i, F.col("median"))).alias(c) for i, c in enumerate(names)])


def approximate_medians(vectors: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """A value of every column whose rank is at most ``1 / accuracy`` of the rows away from the middle, as one row; mergeable sketches of bounded size."""
    return vectors.agg(*[F.percentile_approx(q(c).cast("double"), 0.5, accuracy).alias(c) for c in vectors.columns])


def median_values(vectors: DataFrame, size: int | None = None, limit: int = MEDIAN_IN_ONE_PASS) -> dict[str, float]:
    """Exact medians of a staged frame as numbers; ``size`` is its approximate number of rows.

    Up to ``limit`` rows one aggregate holds the values.  Larger frames are narrowed, all columns at once: quantile sketches bracket the middles, one pass
    counts what lies below each bracket, and this repeats inside the brackets until each holds at most ``limit`` values; only those are ranked exactly.
    """
    names = vectors.columns
    if (vectors.count() if size is None else size) <= limit:
        row = vectors.agg(*[F.median(q(c)).alias(c) for c in names]).first().asDict()
        return {} if None in row.values() else row
    n = vectors.count()
    if not n:
        return {}
    first, second = (n - 1) // 2, n // 2
    low, high = dict.fromkeys(names, float("-inf")), dict.fromkeys(names, float("inf"))
    below, inside = dict.fromkeys(names, 0), dict.fromkeys(names, n)
    within = lambda c: (q(c) >= low[c]) & (q(c) <= high[c])
    found: dict[str, float] = {}
    open_ = [c for c in names if inside[c] > limit]
    while open_:
        picks = lambda c: [min(1.0, max(0.0, (second - below[c]) / inside[c] + step)) for step in (-BAND, BAND)]
        ends = vectors.agg(*[F.percentile_approx(F.when(within(c), q(c).cast("double")), picks(c), SKETCH) for c in open_]).first()
        tests = [t for c, (lo, hi) in zip(open_, ends) for t in (F.count_if(q(c) < lo), F.count_if((q(c) >= lo) & (q(c) <= hi)))]
        counts = vectors.agg(*tests).first()
        going = []
        for i, (c, (lo, hi)) in enumerate(zip(open_, ends)):
            under, between = counts[2 * i : 2 * i + 2]
            if not under <= first <= second < under + between:
                continue  # the sketch missed the middle: the last bracket is ranked whole
            if lo == hi:
                found[c] = lo
            elif between < inside[c]:
                low[c], high[c], below[c], inside[c] = lo, hi, under, between
                going += [c] if between > limit else []
        open_ = going
    rest = [c for c in names if c not in found]
    if rest:
        values = _unpivoted(vectors, {c: within(c) for c in rest}, rest)
        for row in _middles(values, [(first - below[c], second - below[c]) for c in rest]).collect():
            found[rest[row["c"]]] = row["median"]
    return {c: found[c] for c in names}


def _unpivoted(vectors: DataFrame, kept: dict[str, Column], names: list[str]) -> DataFrame:
    """``c`` (the column's number) and ``v`` of the values that are kept."""
    cells = [F.when(kept[c], F.struct(F.lit(i).alias("c"), q(c).cast("double").alias("v"))) for i, c in enumerate(names)]
    return vectors.select(F.inline(F.filter(F.array(*cells), lambda x: x["v"].isNotNull())))


def _middles(values: DataFrame, ranks: list[tuple[int, int]] | None = None) -> DataFrame:
    """``c, median``: mean of the values at two ranks of every column (its middle ones unless given), from running counts inside ranges."""
    counts = values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    spread = stage(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "ranks")
    own = Window.partitionBy("c")
    sizes = spread.groupBy("c", "part").agg(F.sum("n").alias("size"))
    sizes = sizes.select("c", "part", (F.sum("size").over(own.orderBy("part")) - F.col("size")).alias("offset"), F.sum("size").over(own).alias("total"))
    running = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v")) + F.col("offset")
    ends = spread.join(sizes, ["c", "part"]).select("c", "v", "n", "total", running.alias("end"))
    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    if ranks is not None:
        first, second = (F.element_at(F.array(*[F.lit(pair[side]) for pair in ranks]), F.col("c") + 1) for side in (0, 1))
    hit = lambda rank: F.max(F.when((F.col("end") > rank) & (F.col("end") - F.col("n") <= rank), F.col("v")))
    return ends.groupBy("c").agg(((hit(first) + hit(second)) / 2).alias("median"))


def levels(vectors: DataFrame, rhs: str) -> DataFrame:
    """Distinct distances of one column."""
    return vectors.select(q(rhs).alias(rhs)).distinct()


def above_median(vectors: DataFrame, rhs: str, median: float) -> DataFrame:
    return vectors.where(q(rhs) > median)


def up_to_median(vectors: DataFrame, rhs: str, median: float) -> DataFrame:
    return vectors.where(q(rhs) <= median)


def key_is_unique(df: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` occurs twice."""
    return df.groupBy(q(key)).count().where("count > 1").isEmpty()


def rfd_counts(rfds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of dependencies per rhs (or per ``by``)."""
    return rfds.groupBy(*(by or ["rhs"])).agg(F.count(F.lit(1)).alias("rfd_count"))


def table_profile(df: DataFrame, name: str, columns: int | None = None, with_bytes: bool = False) -> DataFrame:
    """Rows, columns, candidate pairs and (for file scans) bytes of one table, in one pass."""
    if with_bytes:
        files = df.groupBy(F.col("_metadata.file_path"), F.col("_metadata.file_size")).agg(F.count(F.lit(1)).alias("n"))
        n, size = F.coalesce(F.sum("n"), F.lit(0)), F.sum("file_size")
    else:
        files, n, size = df, F.count(F.lit(1)), F.lit(None).cast("bigint")
    return files.agg(
        F.lit(name).alias("ds_name"),
        n.alias("ds_len"),
        F.lit(len(df.columns) if columns is None else columns).cast("bigint").alias("ds_attr_size"),
        size.cast("bigint").alias("ds_file_size_B"),
        F.floor(n * (n - 1) / 2).cast("bigint").alias("pairs"),
    )


def metrics_summary(metrics: DataFrame, values: list[str], by: list[str], sort_by: str | None = None) -> DataFrame:
    """Means of run metrics per group, optionally sorted by one of them, largest first."""
    out = metrics.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
    return out.orderBy(F.desc(sort_by), *by) if sort_by else out
