"""Merkle manifest of a table: a tree per source, a tree over the sources, and a proof for every row.

Leaves are ranked inside their source and the ranks are written with digits to base 16.  A block holds the 4,096 leaves that share all but the last three
digits.  Inside a block the digits are grouped away one after the other: 16 nodes become a struct that nests them, so one shuffle by block serves
all three levels.  Blocks are the nodes of the next tier, which is rolled up in the same way, until a tree fits in one block.  On the way down a transform
over the nested structs names the siblings of every node and an explode emits the nodes with their paths: inside a block no join is needed, and between
tiers one row per block meets the block's own path.

Everything is a DataFrame expression; no row grows beyond a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import ranks_within, stage

# Nodes per parent; the fields of a leaf, in order.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels inside a block, which then holds FAN ** DIGITS nodes.
DIGITS = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of fields, each ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded), 256)


def _parent(level: int) -> Column:
    """Hash of the nodes in ``kids``: as long as a tree has several nodes at a level, runs of them, even of one, become their hash."""
    joined = F.sha2(F.concat_ws("", F.transform("kids", lambda k: k["hash"])), 256)
    return F.when(F.col("#n") > FAN ** (level - 1), joined).otherwise(F.col("kids")[0]["hash"])


def _blocks(nodes: DataFrame, digits: int) -> DataFrame:
    """Nested blocks ``(#tree, #n, #block, kids, hash)`` of ``nodes(#tree, #rank, #n, hash, item)``."""
    size = FAN**digits
    names = [f"#d{k}" for k in range(digits)]
    digit = [(F.shiftright("#rank", 4 * k) % FAN).cast("int").alias(n) for k, n in enumerate(names)]
    rows = nodes.select("#tree", "#n", F.floor(F.col("#rank") / size).cast("long").alias("#block"), *digit, "hash", "item")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now, held = rows.repartition(tasks, "#tree", "#block"), ["hash", "item"]
    for level in range(1, digits + 1):
        inside = F.sort_array(F.collect_list(F.struct(F.col(names[level - 1]).alias("d"), *held))).alias("kids")
        now = now.groupBy("#tree", "#n", "#block", *names[level:]).agg(inside).withColumn("hash", _parent(level))
        held = ["hash", "kids"]
    return now


def _step(kids: Column, i: Column, n: Column, level: int) -> Column:
    """The siblings left and right of node ``i``, or null where the level isn't hashed."""
    text = lambda a: F.concat_ws("", F.transform(a, lambda k: k["hash"]))
    sides = F.struct(text(F.slice(kids, F.lit(1), i)).alias("left"), text(F.slice(kids, i + 2, F.lit(FAN))).alias("right"))
    return F.when(n > FAN ** (level - 1), sides)


def _unnested(digits: int) -> Column:
    """Array of a block's nodes ``(hash, item, path)``; ``path`` goes up to the block."""

    def inside(kids: Column, level: int, above: list[Column]) -> Column:
        def one(kid: Column, i: Column) -> Column:
            path = [_step(kids, i, F.col("#n"), level), *above]
            if level == 1:
                return F.struct(kid["hash"].alias("hash"), kid["item"].alias("item"), F.array_compact(F.array(*path)).alias("path"))
            return inside(kid["kids"], level - 1, path)

        found = F.transform(kids, one)
        return found if level == 1 else F.flatten(found)

    return inside(F.col("kids"), digits, [])


def merkle_tiers(nodes: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """Nested blocks of every tier, from the leaves up; a tree's root is the hash of its only block in its last tier."""
    tiers = [stage(_blocks(nodes, digits), "blocks")]
    size = FAN**digits
    while not (open_ := tiers[-1].where(F.col("#n") > size)).isEmpty():
        upper = open_.select(
            "#tree", F.col("#block").alias("#rank"), F.ceil(F.col("#n") / size).cast("long").alias("#n"), "hash", F.struct("#block").alias("item")
        )
        tiers.append(stage(_blocks(upper, digits), "blocks"))
    return tiers


def merkle_roots(tiers: list[DataFrame], digits: int = DIGITS) -> DataFrame:
    """``(#tree, root)``."""
    tops = [t.where(F.col("#n") <= FAN**digits).select("#tree", F.col("hash").alias("root")) for t in tiers]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionAll(t)
    return out


def merkle_paths(tiers: list[DataFrame], above: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``(#tree, hash, item, path, *rest)`` for every leaf; ``above(#tree, path, *rest)`` tells how each tree's root goes on.

    ``path`` lists the siblings ``(left, right)`` of every hashed level from the leaf up.  ``rest`` is carried to every leaf.
    """
    rest = [c for c in above.columns if c not in ("#tree", "path")]
    tops = above.withColumn("#block", F.lit(0).cast("long"))
    lower = None
    for i, tier in reversed(list(enumerate(tiers))):
        ended = tier.where(F.col("#n") <= FAN**digits).join(tops, ["#tree", "#block"])
        met = ended if lower is None else ended.unionByName(tier.where(F.col("#n") > FAN**digits).join(lower, ["#tree", "#block"]))
        nodes = met.select("#tree", "path", *rest, F.explode(_unnested(digits)).alias("#node"))
        path = F.concat(F.col("#node.path"), F.col("path")).alias("path")
        if i == 0:
            return nodes.select("#tree", "#node.hash", "#node.item", path, *rest)
        lower = stage(nodes.select("#tree", F.col("#node.item.#block").alias("#block"), path, *rest), "paths")
    raise ValueError("no tiers")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text as the audit tampers with it: in lower case (A-Z) where 5 divides the id's checksum."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def merkle_manifest(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row per document: ``doc_id, leaf, tampered_leaf, path, subroot, root``.

    Nulls in any field are hashed as ``-``; a null source is a source of its own, before all others; inside a source null ids come last.  Rows that share
    an id are ordered by their leaf, so repeated rows are leaves of their own with equal hashes.  An empty table gives no rows.  Long texts are only
    hashed.  Further columns, whatever their names, are left out.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = [tampered_text(F.col("doc_id"), f) if c == "text" else f for c, f in zip(FIELDS, fields, strict=True)]
    tree = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    leaves = docs.select(tree.alias("#tree"), "doc_id", leaf_hash(fields).alias("hash"), leaf_hash(changed).alias("tampered"))
    ranked = ranks_within(leaves, "#tree", [F.col("doc_id").asc_nulls_last(), F.col("hash").asc()])
    tiers = merkle_tiers(ranked.select("#tree", "#rank", "#n", "hash", F.struct("doc_id", "tampered").alias("item")), digits)
    subroots = stage(merkle_roots(tiers, digits), "subroots")
    ordered = ranks_within(subroots.select(F.lit("").alias("all"), "#tree", F.col("root").alias("hash")), "all", [F.col("#tree").asc()])
    top = merkle_tiers(ordered.select(F.lit("").alias("#tree"), "#rank", "#n", "hash", F.struct(F.col("#tree").alias("source")).alias("item")), digits)
    end = merkle_roots(top, digits).select("#tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), "root")
    above = merkle_paths(top, end, digits).select(F.col("item.source").alias("#tree"), "path", F.col("hash").alias("subroot"), "root")
    found = merkle_paths(tiers, stage(above, "above"), digits)
    return found.select("item.doc_id", F.col("hash").alias("leaf"), F.col("item.tampered").alias("tampered_leaf"), "path", "subroot", "root")


def merkle_audit(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``merkle_manifest`` with digests in place of paths, and the root that each (tampered) leaf gives with its siblings."""
    found = merkle_manifest(docs, digits)
    out = found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
