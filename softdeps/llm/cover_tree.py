"""Exact top-k search by inner product with two cover trees.

Rows lie in blocks of bounded size, each with a cover tree; queries are streamed past every block in groups with a tree of their own.  A pair of nodes is
dropped when the largest inner product that their covering radii allow is below the worst k-th score of the node's queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, map_batches, parts

BLOCK, GROUP, LEAF, SEEDS = 4096, 512, 48, 2048
EXACT = float(1 << 53)
LONG = 1 << 63


class Node:
    """Points within ``radius`` of ``center``; ``own`` are those that lie in no child."""

    def __init__(self, center: np.ndarray, radius: float, points: np.ndarray, own: np.ndarray, children: list[Node]):
        self.center, self.radius, self.points, self.own, self.children = center, radius, points, own, children
        self.norm = float(np.linalg.norm(center))


def cover_tree(data: np.ndarray, points: np.ndarray | None = None, center: np.ndarray | None = None) -> Node:
    """Children's centers are more than half the node's radius apart and cover its points at that distance; they are picked farthest first."""
    points = np.arange(len(data)) if points is None else points
    at = data[points]
    center = at[0] if center is None else center
    away = np.sqrt(((at - center) ** 2).sum(1))
    radius = float(away.max()) * (1 + 1e-9)
    if len(points) <= LEAF or radius == 0:
        return Node(center, radius, points, points, [])
    scale, owner, picks = radius / 2, np.zeros(len(points), np.int64), [None]
    while True:
        far = int(np.argmax(away))
        if away[far] <= scale:
            break
        d = np.sqrt(((at - at[far]) ** 2).sum(1))
        nearer = d < away
        owner[nearer], away[nearer] = len(picks), d[nearer]
        picks.append(at[far])
    sizes, order = np.bincount(owner, minlength=len(picks)), np.argsort(owner, kind="stable")
    ends = np.cumsum(sizes)
    single = [order[ends[k] - 1] for k in range(len(picks)) if sizes[k] == 1]
    several = [k for k in range(len(picks)) if sizes[k] > 1]
    children = [cover_tree(data, points[order[ends[k] - sizes[k] : ends[k]]], center if k == 0 else picks[k]) for k in several]
    return Node(center, radius, points, points[np.array(single, np.int64)], children)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles where they fit, else in Python's integers, held to the range of a long."""
    if a.size == 0 or b.size == 0 or a.shape[1] * np.abs(a).max() * np.abs(b).max() < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, 1 - LONG, LONG - 1).astype(np.int64)


class Best:
    """The k best (score, smaller id first) of every query; ``worst`` starts at a score known to be reached."""

    def __init__(self, ids: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, floors.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.worst[queries][:, None]) & (ids[None, :] != self.ids[queries][:, None])
        for row in np.flatnonzero(good.any(1)):
            q, at = queries[row], good[row]
            new = self.found[q] + list(zip((-scores[row, at]).tolist(), ids[at].tolist(), strict=True))
            self.found[q] = sorted(new)[: self.k]
            if len(self.found[q]) == self.k:
                self.worst[q] = max(self.worst[q], -self.found[q][-1][0])


def search(queries: np.ndarray, q_root: Node, data: np.ndarray, ids: np.ndarray, r_root: Node, best: Best) -> None:
    def limit(q: Node, r: Node) -> float:
        slack = q.radius * r.norm + r.radius * q.norm + q.radius * r.radius
        return max(1 - float(LONG), float(q.center @ r.center) + slack + 1e-9 * (q.norm + q.radius) * (r.norm + r.radius) + 1)

    def compare(q: Node, q_points: np.ndarray, r_points: np.ndarray) -> None:
        if len(q_points) and len(r_points):
            rows = data[r_points]
            reach = rows @ q.center + q.radius * np.sqrt((rows**2).sum(1)) * (1 + 1e-9) + 1
            r_points = r_points[np.maximum(reach, -float(LONG)) >= best.worst[q_points].min()]  # scores are held to the range of a long
            best.offer(q_points, products(queries[q_points], data[r_points]), ids[r_points])

    work = [(q_root, r_root)]
    while work:
        q, r = work.pop()
        if limit(q, r) < best.worst[q.points].min():
            continue
        if not r.children and not q.children:
            compare(q, q.own, r.own)
        elif r.children and (r.radius >= q.radius or not q.children):
            compare(q, q.points, r.own)
            work += sorted(((q, c) for c in r.children), key=lambda pair: limit(*pair))
        else:
            compare(q, q.own, r.points)
            work += [(c, r) for c in q.children]


def scaled(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """``id, dim, v`` (doubles, whole numbers): vectors that are null, empty, or hold null or non-finite components are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: c * factor - F.pmod(c * factor, F.lit(1.0)))  # floor as a double: what floor() makes of very large ones is no double
    return vectors.where(F.col(id_col).isNotNull() & finite & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), v.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` highest inner products with all other rows.

    Components are ``floor(factor * x)``; ties go to the smaller id.  Rows with a null id or an unusable vector take no part; vectors of another length
    than the query's are no candidates.  Rows that share an id are candidates each, but never of their own id; of such queries the smallest vector is
    taken.  Fewer candidates than ``k``: all of them.
    """
    rows = scaled(vectors, id_col, vector_col, factor)
    queries = rows.where(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v")).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("id", "s.*")
    total = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(1).collect()
    blocks = parts(total[0]["n"], block) if total else 1
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(SEEDS).collect()  # a bounded sample: its k-th score is one that every query reaches
    by_dim: dict[int, list] = {}
    for s in seeds:
        by_dim.setdefault(s["dim"], []).append((s["id"], s["v"]))
    seed_rows = {d: (np.array([i for i, _ in s]), np.array([v for _, v in s])) for d, s in by_dim.items()}

    def floors(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        low = np.full(len(ids), -LONG, np.int64)
        if vectors.shape[1] in seed_rows:
            other, at = seed_rows[vectors.shape[1]]
            scores = np.where(other[None, :] == ids[:, None], -LONG, products(vectors, at))
            if len(other) > k:
                low = np.partition(scores, len(other) - k, axis=1)[:, len(other) - k]
        return low

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come first, then the queries; both in the order of the block."""
        now, kept, tree, data, ids, waiting = None, [], None, None, None, []

        def answers() -> pa.RecordBatch:
            q_ids, q = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            best = Best(q_ids, floors(q_ids, q), k)
            search(q, cover_tree(q), data, ids, tree, best)
            found = [(qid, rid, -s) for qid, f in zip(q_ids.tolist(), best.found, strict=True) for s, rid in f]
            columns = list(zip(*found, strict=True)) or [()] * 3
            return arrow({n: (list(c), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            roles, b_ids, column = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4)
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or roles[i] != roles[i - 1]] + [len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if keys[lo] != now:
                    if waiting:
                        yield answers()
                    now, kept, tree, waiting = keys[lo], [], None, []
                part = (b_ids[lo:hi], matrix(column.slice(lo, hi - lo)))
                if roles[lo] == 0:
                    kept.append(part)
                    continue
                if tree is None and kept:
                    ids, data = np.concatenate([p[0] for p in kept]), np.concatenate([p[1] for p in kept])
                    tree = cover_tree(data)
                if tree is not None:
                    waiting.append(part)
                    if sum(len(w[0]) for w in waiting) >= GROUP:
                        yield answers()
                        waiting = []
        if waiting:
            yield answers()

    blocked = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("role"), "id", "v")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("role"), "id", "v")
    met = blocked.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "role", "id")
    found = map_batches(met, task, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
