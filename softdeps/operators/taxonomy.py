"""Semantic distance over a taxonomy given as tables.

``senses(term, node[, rank])`` names the node of each term (lowest rank first);
``edges(child, parent)`` is the is-a relation.  Every term carries the map of its
ancestors to their depth, so comparing two terms needs no further join.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.functions.distances import Measure, path_distance
from softdeps.operators.pairs import MEMO_VALUES, q, row_pairs
from softdeps.session import stage, stage_counted

Taxonomy = tuple[DataFrame, DataFrame]


def first_senses(senses: DataFrame) -> DataFrame:
    order = F.struct("rank", "node") if "rank" in senses.columns else F.col("node")
    return senses.groupBy("term").agg(F.min_by("node", order).alias("node"))


def ancestor_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest is-a depth of every ancestor of every node: ``node, ancestor, depth`` (the node itself at 0).

    Breadth first, one job per level of the taxonomy (its rows are counted while they are written); a pair is kept
    at the level it first appears, so cycles end and several ways to an ancestor do not multiply, as they would in a recursive query.
    """
    frontier, n = stage_counted(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct(), "depth")
    seen = frontier
    while n:
        step = (
            frontier.join(edges, frontier["ancestor"] == edges["child"])
            .select("node", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
            .distinct()
            .join(seen, ["node", "ancestor"], "left_anti")
        )
        frontier, n = stage_counted(step.select("node", "ancestor", "depth"), "depth")
        seen = seen.unionByName(frontier)
    return seen


def node_maps(terms: DataFrame, senses: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(term, node)`` for each term that has a sense, and ``(node, paths)``: the ancestors of these nodes with their depths."""
    known = terms.join(first_senses(senses), "term")
    depths = ancestor_depths(known.select("node").distinct(), edges)
    entries = F.map_from_entries(F.collect_list(F.struct("ancestor", "depth")))
    return known.select("term", "node"), depths.groupBy("node").agg(entries.alias("paths"))


def ancestor_maps(terms: DataFrame, senses: DataFrame, edges: DataFrame) -> DataFrame:
    """``term, paths``: the ancestors of each term that has a sense, with their depths."""
    known, maps = node_maps(terms, senses, edges)
    return known.join(maps, "node").select("term", "paths")


def node_distances(maps: DataFrame) -> DataFrame:
    """``node, code, to``: a number for each of few nodes, and the node's distances to all of them in the order of these numbers."""
    every = maps.agg(F.collect_list(F.struct("node", "paths")).alias("all"))
    numbered = every.select(F.posexplode("all").alias("code", "own"), "all")
    return numbered.select("own.node", "code", F.transform("all", lambda other: path_distance(F.col("own.paths"), other["paths"])).alias("to"))


def taxonomy_distance(terms: DataFrame, senses: DataFrame, edges: DataFrame, tiles: int | None = None) -> DataFrame:
    """``term_a, term_b, distance`` for every unordered pair of distinct terms with a sense.

    Where terms have at most ``MEMO_VALUES`` nodes, distances are computed once per pair of nodes and looked up.
    """
    known, maps = node_maps(terms.select("term").distinct(), senses, edges)
    maps, n = stage_counted(maps, "paths")
    memo = n <= MEMO_VALUES
    rows = stage(known.join(node_distances(maps) if memo else maps, "node").drop("node"), "terms")
    pairs = row_pairs(rows, "term", tiles)
    looked_up, computed = F.get(F.col("a.to"), F.col("b.code")), path_distance(F.col("a.paths"), F.col("b.paths"))
    return pairs.select(F.col("a.term").alias("term_a"), F.col("b.term").alias("term_b"), (looked_up if memo else computed).alias("distance"))


def covers_column(df: DataFrame, column: str, senses: DataFrame) -> bool:
    """Whether every present value of ``column`` has a sense."""
    values = df.select(q(column).alias("term")).where("term IS NOT NULL").distinct()
    return values.join(senses, "term", "left_anti").isEmpty()


def taxonomy_measures(df: DataFrame, measures: list[Measure], taxonomies: dict[str, Taxonomy]) -> list[Measure]:
    """Text columns with a taxonomy become path measures; one word without a sense keeps edit distance for the column."""
    out = []
    for m in measures:
        usable = m.name in taxonomies and m.kind in ("text", "bytes") and covers_column(df, m.name, taxonomies[m.name][0])
        out.append(replace(m, kind="paths") if usable else m)
    return out


def attach_paths(rows: DataFrame, measures: list[Measure], taxonomies: dict[str, Taxonomy]) -> DataFrame:
    """Replace the values of path-measured columns by their ancestor maps."""
    for m in measures:
        if m.kind == "paths":
            senses, edges = taxonomies[m.name]
            terms = rows.select(q(m.name).alias("term")).where("term IS NOT NULL").distinct()
            maps = ancestor_maps(terms, senses, edges).withColumnRenamed("term", m.name).withColumnRenamed("paths", "#paths")
            rows = rows.join(maps, m.name, "left").withColumn(m.name, F.col("#paths")).drop("#paths")
    return rows
