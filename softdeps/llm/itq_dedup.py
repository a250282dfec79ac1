"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

Rotations learned on a bounded sample turn vectors into balanced binary codes.  A code is cut into one chunk per table; vectors that agree on a chunk share
a bucket of that table (with m tables, every pair of codes within Hamming distance m - 1 does).  The number of tables follows from the length of the chunks and
the wanted recall at the threshold's angle.  Inside buckets the cosine of the original vectors decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, components, map_batches, stage

THRESHOLD, RECALL, SAMPLE, ROUNDS, TILE = 0.95, 0.999, 8192, 30, 512


def iterative_quantisation(sample: np.ndarray, bits: int, seed: int = 3, rounds: int = ROUNDS) -> np.ndarray:
    """Projection (d x bits).  Each rotation of up to d bits alternates codes of the centred sample and the best rotation to them (orthogonal Procrustes)."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    centered = sample - sample.mean(0)
    _, axes = np.linalg.eigh(centered.T @ centered)
    flat, blocks = centered @ axes[:, ::-1], []
    while sum(b.shape[1] for b in blocks) < bits:
        rotation, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
            rotation = (u @ vt).T
        blocks.append(axes[:, ::-1] @ rotation)
    return np.concatenate(blocks, 1)[:, :bits]


def table_shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a chunk (so that chance meetings stay few) and number of tables for ``n`` vectors."""
    bits = min(40, math.ceil(math.log2(max(n, 2))) + 4)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def keys_of(codes: list[bytes], bits: int, tables: int) -> np.ndarray:
    """Bucket of each code in each table, numbered so that tables don't mix."""
    flat = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)[:, : bits * tables]
    chunks = flat.reshape(len(codes), tables, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return chunks * tables + np.arange(tables)


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the graph of ``pairs``: what a group tells about its links without listing them."""
    parent, edges = list(range(n)), []
    for a, b in pairs.tolist():
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((a, b))
    return edges


def linked_in_cell(vectors: np.ndarray, codes: np.ndarray, table: int, tiles: np.ndarray, cell: tuple[int, int], threshold: float) -> np.ndarray:
    """Pairs of a cell's rows that link and share no bucket of an earlier table, where they were found before."""
    left = np.flatnonzero(tiles == cell[0])
    right = left if cell[0] == cell[1] else np.flatnonzero(tiles == cell[1])
    if not len(left) or not len(right):
        return np.empty((0, 2), np.int64)
    new = np.triu(np.ones((len(left), len(left)), bool), 1) if right is left else np.ones((len(left), len(right)), bool)
    for t in range(table):
        new &= codes[left, t][:, None] != codes[right, t][None, :]
        if not new.any():
            return np.empty((0, 2), np.int64)
    a, b = np.nonzero(new & (vectors[left] @ vectors[right].T >= threshold))
    return np.stack([left[a], right[b]], 1)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without id, link with nothing.  Equal vectors are folded and
    counted; they always link.  Vectors of different lengths never link.  Buckets of any size are cut into tiles, and pairs of tiles are compared in tasks of
    bounded size which report counts and a spanning forest, never the pairs.  Distinct vectors go by numbers of their own, so rows that share an id keep
    the links of their own vectors.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite & F.col(id_col).isNotNull(), x).alias("v"))
    known = rows.where("v is not null")
    folded = stage(known.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    sizes = folded.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length of vectors
    found = [links_of_dim(folded.where(F.size("v") == s["dim"]), s["n"], threshold, recall) for s in sizes if s["n"] > 1]
    if found:
        told = found[0]
        for f in found[1:]:
            told = told.unionByName(f)
        told = stage(told, "links")
        counts = told.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        joined = components(told.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
        reps = folded.join(counts, "rep", "left").join(joined, "rep", "left")
    else:
        reps = folded.withColumn("n", F.lit(0)).withColumn("component", F.col("rep"))
    reps = reps.withColumn("component", F.coalesce("component", "rep"))
    least = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    result = reps.join(least, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = known.join(result, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_of_dim(folded: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """Link counts ``(a, null, n)`` and forest edges ``(a, b, null)`` among vectors of one length."""
    bits, tables = table_shape(n, threshold, recall)
    unit = lambda m: m / np.sqrt((m**2).sum(1, keepdims=True))
    scale = lambda m: m / np.abs(m).max(1, keepdims=True)  # noqa: E731  keeps squares finite
    sample = folded.orderBy(F.xxhash64("least"), "least", "v").limit(SAMPLE).select("v").collect()  # bounded by SAMPLE
    # Only rotations come from the sample.  Codes are of the vectors as they are: around a mean the angles of linked vectors would be wider than the
    # threshold's, for which the tables are counted.
    project = iterative_quantisation(unit(scale(np.array([r["v"] for r in sample]))), bits * tables)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit(scale(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)))
                codes = [c.tobytes() for c in np.packbits(v @ project >= 0, axis=1)]
                keys = keys_of(codes, bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * tables, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                named = {"rep": batch.column(1), "copies": batch.column(2), "v": pa.array([r.tobytes() for r in v], pa.binary())}
                yield pa.RecordBatch.from_arrays([*named.values(), pa.array(codes, pa.binary()), lists], names=[*named, "code", "keys"])

    schema = "rep long, copies long, v binary, code binary, keys array<long>"
    indexed = stage(map_batches(folded.select("v", "rep", "copies"), coded, schema), "codes")
    entries = indexed.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = entries.join(buckets, "key").select("rep", "key", tiles.alias("tiles"), F.pmod(F.xxhash64("rep"), tiles).cast("int").alias("tile"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    cells = placed.select("rep", "key", "tile", other).select("rep", "key", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    met = cells.join(indexed.drop("keys"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def close(cell: tuple, group: list[tuple]) -> None:
            if len(group) < 2:
                return
            reps, copies, tile = [g[0] for g in group], np.array([g[1] for g in group]), np.array([g[4] for g in group])
            v = np.frombuffer(b"".join(g[2] for g in group)).reshape(len(group), -1)
            pairs = linked_in_cell(v, keys_of([g[3] for g in group], bits, tables), cell[0] % tables, tile, cell[1:], threshold)
            if len(pairs):
                n = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(group)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(group))
                out.extend((reps[i], None, int(n[i])) for i in np.flatnonzero(n))
                out.extend((reps[a], reps[b], None) for a, b in forest(len(group), pairs))

        now, group = None, []
        for batch in batches:
            for key, i, j, tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    close(now, group)
                    now, group = (key, i, j), []
                group.append((*row, tile))
            if out:
                yield told(out)
                out.clear()
        close(now, group)
        yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return arrow({n: (list(c), pa.int64()) for n, c in zip(("a", "b", "n"), columns, strict=True)})

    return map_batches(met.select("key", "i", "j", "tile", "rep", "copies", "v", "code"), compared, "a long, b long, n long")
