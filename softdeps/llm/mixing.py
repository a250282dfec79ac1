"""Mixing sources to target weights by systematic sampling.

Inside a source every document is expected ``target / source_size`` times.  The documents are put in a fixed order, their expected copies are
summed from the first on, a random offset is added once, and a document is emitted once for each whole number its interval crosses.  The order is by
size: the error of a source's words is then below the size of its longest document.

Everything is a DataFrame expression.  The order inside a source is by size, then doc_id (nulls last), at every size of the input.  A place in it is the
number of smaller documents (counts of distinct sizes) plus the place among those of the same size; where one size of a source has many documents, it is the
place in the order over all rows, cut into ranges, less the earlier sources' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softdeps.llm.common import WORD, global_rank, stage

# Fixed values of the mix: weights by the source's place, repeating; the mix's size against the input's; the most a document is repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2

# The most rows of a source's size that one window takes.
BUCKET_ROWS = 100_000


def source_targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to ``sources(source, source_size)``: water-filling.

    Each round one aggregate gives the level ``target / weight`` of the sources that are not full yet; it only rises, and ends after as many rounds as
    it takes for no further source to fill up.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "#rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("#rank") - 1) % len(weights) + 1).cast("int"))
    table = stage(ranked.withColumn("#weight", weight).drop("#rank"), "sources")
    room = F.col("source_size") * most
    level = -1.0
    while True:
        full = F.lit(level) * F.col("#weight") > room
        total, taken, open_weight = table.agg(
            F.sum("source_size"), F.sum(F.when(full, room).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("#weight")))
        ).first()
        if not open_weight or (new := (share * total - taken) / open_weight) == level:
            break
        level = new
    full = F.lit(level) * F.col("#weight") > room
    return table.withColumn("target", F.when(full, room.cast("double")).otherwise(F.lit(level) * F.col("#weight"))).drop("#weight")


def mix_counts(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document: 0, 1 or 2).

    Null text: size 0.  A null source is a source of its own, after all others.  Repeated rows are rows of their own.  An empty table gives no rows.
    Further columns pass through; columns of these names are replaced.
    """
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    clean = docs.drop("size", "source_size", "target", "copies")
    sized = clean.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("#key", key)
    by_size = stage(sized.groupBy("#key", "source", "size").agg(F.count(F.lit(1)).alias("#n")), "sizes")
    targets = source_targets(by_size.groupBy("#key", "source").agg(F.sum(F.col("size") * F.col("#n")).alias("source_size")))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("#key"))), 1, 8), 16, 10).cast("double") / 4294967296
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    targets = stage(targets.withColumn("#u", u).withColumn("#rate", rate).drop("source"), "targets")

    in_order = F.col("doc_id").asc_nulls_last()
    if (by_size.agg(F.max("#n")).first()[0] or 0) <= BUCKET_ROWS:
        smaller = Window.partitionBy("#key").orderBy("size")
        places = by_size.select("#key", "size", (F.sum("#n").over(smaller) - F.col("#n")).alias("#before")).join(targets, "#key")
        own = Window.partitionBy("#key", "size").orderBy(in_order)
        placed = sized.withColumn("#own", F.row_number().over(own)).join(places, ["#key", "size"])
    else:
        totals = by_size.groupBy("#key").agg(F.sum("#n").alias("#n"))
        places = totals.select("#key", (F.col("#n") - F.sum("#n").over(Window.orderBy("#key"))).alias("#before")).join(targets, "#key")
        order = [F.col("#key").asc(), F.col("size").asc(), in_order, F.col("#tie").asc()]
        placed = global_rank(sized.withColumn("#tie", F.xxhash64("text")), order, "#own").join(places, "#key")
    place = (F.col("#before") + F.col("#own")).cast("double")
    upto = lambda p: F.floor(F.col("#rate") * p + F.col("#u"))
    counted = placed.withColumn("copies", (upto(place) - upto(place - 1)).cast("int"))
    return counted.select(*clean.columns, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_counts`` says, with the columns of ``docs``, also those that are named like its figures."""
    own = [c for c in docs.columns if c in ("size", "source_size", "target", "copies")]
    counted = mix_counts(docs.withColumnsRenamed({c: f"#own_{c}" for c in own}), seed).where("copies > 0")
    taken = counted.withColumn("#copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(f"#own_{c}" if c in own else c).alias(c) for c in docs.columns))
