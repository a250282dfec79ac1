"""N-gram Jaccard join by T-occurrence search.

Two documents of a given similarity differ in few shingles, so if the space of shingles is cut into a few more parts than that, some part of both is equal: the
hash of each part is a block's key, and only documents of one block are compared.  A block's documents are searched as T-occurrence queries over inverted
lists: short lists are merged by a heap, long ones are probed by bisection for what the merge leaves (DivideSkip), and documents that reach the required
overlap link.  Blocks are first compared with one center each, which settles groups of copies without their pairs; what that leaves open is compared whole.
Before a search, sketches (16-bit hashes of four times as many parts) rule out documents that differ in more parts than linked ones can.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, map_batches, more_components, stage, stage_counted

WORDS, SIMILAR, OF = 3, 90, 100
TILE, CENTERS, FINE, MU = 256, 4, 4, 0.05

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's runs of three words; with fewer words the whole sequence is one; without words there are none."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers = np.cumprod(np.full(n, ODD, np.uint64), dtype=np.uint64)
            self.inverses = np.cumprod(np.full(n, INVERSE, np.uint64), dtype=np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text.lower(), np.uint8)
        edges = np.flatnonzero(np.diff(SPACE[b], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        self.grow(len(b) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[b] * self.powers[: len(b)], dtype=np.uint64)])
        word = mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        n = min(self.words, len(word))
        count = len(word) - n + 1
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(ODD) + word[k : k + count])
        return np.unique(h)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_classes(upto: int, similar: int, of: int) -> list[int]:
    """Lower bounds of size classes: sizes that can link lie in one class or in two neighbouring ones."""
    bounds = [1, 2]
    while bounds[-1] <= upto:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * of // similar + 1))
    return bounds


def most_different(bounds: list[int], c: int, similar: int, of: int) -> int:
    """The most shingles in which linked sets of class ``c`` (and the one below) differ."""
    return 2 * (bounds[c + 1] - 1) * (of - similar) // (of + similar)


def part_hashes(s: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of ``n`` equal parts of the shingles' space, and whether the part has any."""
    cuts = np.searchsorted(s, (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + np.uint64(1)), dtype=np.uint64)])
    begins, ends = np.concatenate([[0], cuts]), np.append(cuts, len(s))
    return mixed(sums[ends] - sums[begins] + mixed(np.arange(n, dtype=np.uint64) + np.uint64(salt << 32))), ends > begins


def own_class(n: int, bounds: list[int]) -> int:
    return bisect_left(bounds, n + 1) - 1


def block_keys(s: np.ndarray, similar: int, of: int, bounds: list[int]) -> list[int]:
    """Keys of a set for its own size class and the next: one per part of the shingles' space.

    With d the most shingles in which linked sets of the class differ there are d + 2 parts, so two parts at least are equal.  A set with one empty
    part needs no key for it, as another equal part is not empty.
    """
    own, keys = own_class(len(s), bounds), []
    for c in (own, own + 1):
        if differ := most_different(bounds, c, similar, of):  # else only equal sets link, and those are folded
            part, full = part_hashes(s, differ + 2, c)
            keys += (part[full] if np.count_nonzero(~full) == 1 else part).view(np.int64).tolist()
    return keys


def sketches(s: np.ndarray, similar: int, of: int, bounds: list[int]) -> list[bytes]:
    """Short hashes of finer parts for the own class and the next."""
    own = own_class(len(s), bounds)
    return [part_hashes(s, FINE * (most_different(bounds, c, similar, of) + 2), c)[0].astype(np.uint16).tobytes() for c in (own, own + 1)]


def may_link(unequal, sizes, similar: int, of: int):
    """Every unequal part holds a shingle that one of the two lacks."""
    return unequal * (of + similar) <= sizes * (of - similar)


def t_occurrence(query: np.ndarray, lists: dict[int, list[int]], sizes: list[int], similar: int, of: int) -> Iterator[tuple[int, int]]:
    """``(document, overlap)`` of all documents that link with the query.

    ``lists``: ascending documents of each shingle.  A linked document shares at least T shingles; the L longest lists are set aside, the others are
    merged by a heap, and only documents met T - L times are probed for in the long ones.
    """
    need = -(-len(query) * similar // of)
    own = sorted((lists[h] for h in query.tolist() if h in lists), key=len, reverse=True)
    if len(own) < need:
        return
    aside = min(need - 1, int(need / (MU * math.log2(len(own[0]) + 1) + 1)))
    long, short = own[:aside], own[aside:]
    run, seen = None, 0
    for doc in [*heapq.merge(*short), None]:
        if doc == run:
            seen += 1
            continue
        if run is not None and seen >= need - aside:
            overlap, left = seen, len(long)
            for docs in long:
                at = bisect_left(docs, run)
                overlap += at < len(docs) and docs[at] == run
                left -= 1
                if overlap + left < need:
                    break
            if of * overlap >= similar * (len(query) + sizes[run] - overlap):
                yield run, overlap
        run, seen = doc, 1


def inverted(sets: Iterable[np.ndarray], wanted: set[int] | None = None) -> dict[int, list[int]]:
    lists: dict[int, list[int]] = {}
    for doc, s in enumerate(sets):
        for h in s.tolist():
            if wanted is None or h in wanted:
                lists.setdefault(h, []).append(doc)
    return lists


def pairs_batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 2
    return arrow({n: (list(c), pa.int64()) for n, c in zip(("a", "b"), columns, strict=True)})


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with equal leading columns, of a partition sorted by them."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield now, rows


def jaccard_components(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; documents link when ``of * intersection >= similar * union``.

    Null, empty and blank texts have no shingles and link with nothing: their component is their own ``doc_id``.  Equal sets are folded, so copies are never
    compared.  The component is the smallest ``doc_id`` reachable by links.  Repeated rows are copies.  Sets are told apart by 64-bit hashes.
    Rows without id link like any others and are passed over as smallest: a component of such rows alone has a null ``component_id``.
    """
    shingles, bounds = Shingles(words), size_classes(1 << 34, similar, of)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles.of(text or b"")
                sizes.append(len(s))
                node = int(mixed(np.cumsum(mixed(s))[-1:] + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None
                nodes.append(node)
                keys.append(block_keys(s, similar, of, bounds) if len(s) and node not in seen else [])
                seen.add(node)
            columns = {"n_shingles": (sizes, pa.int64()), "node": (nodes, pa.int64()), "keys": (keys, pa.list_(pa.int64()))}
            made = arrow(columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns, batch.column(2)], names=["doc_id", *columns, "told"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("told"))
    sets = stage(map_batches(texts, described, "doc_id long, n_shingles long, node long, keys array<long>, told long"), "sets")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of key and node, streamed: each further node of a key next to the key's first."""
        key, center = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate([[key is None or keys[0] != key], keys[1:] != keys[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
            centers = np.where(at >= 0, nodes[at], 0 if center is None else center)
            key, center = keys[-1], centers[-1]
            more = nodes != centers
            yield arrow({"key": (keys[more], pa.int64()), "center": (centers[more], pa.int64()), "node": (nodes[more], pa.int64())})

    entries = sets.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    open_ = stage(map_batches(entries, stars, "key long, center long, node long").distinct(), "stars")

    # The sets of all nodes that share a block, made anew from one text each; a text goes by its id, which may be null, and its hash.
    met = open_.select(F.col("center").alias("node")).unionAll(open_.select("node")).distinct()
    wanted = sets.join(met, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "told")).alias("w"))
    wanted = wanted.select("node", F.col("w.doc_id").alias("id"), F.col("w.told").alias("of"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingles.of(text or b"")
                if len(s) and int(mixed(np.cumsum(mixed(s))[-1:] + np.uint64(len(s))).view(np.int64)[0]) == node:
                    rows.append((node, s.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 2
            yield arrow({"node": (list(columns[0]), pa.int64()), "shingles": (list(columns[1]), pa.binary())})

    known = stage(map_batches(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("told") == F.col("of"))).select("node", "text"), made, "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_ = [np.frombuffer(b, np.uint64) for b in batch.column(1).to_pylist()]
            both = [sketches(s, similar, of, bounds) for s in sets_]
            columns = {
                "size": ([len(s) for s in sets_], pa.int64()),
                "class": ([own_class(len(s), bounds) for s in sets_], pa.int32()),
                "own": ([b[0] for b in both], pa.binary()),
                "next": ([b[1] for b in both], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrow(columns).columns], names=["node", *columns])

    short = stage(map_batches(known, sketched, "node long, size long, class int, own binary, next binary"), "sketches")

    comps, tested = None, None
    for turn in range(CENTERS + 1):
        if turn < CENTERS:
            pairs = open_.select(F.col("center").alias("a"), F.col("node").alias("b"))
        else:
            pairs = block_pairs(open_, short, similar, of)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        tested = pairs if tested is None else tested.unionAll(pairs)
        new = stage(center_links(possible(pairs, short, similar, of) if turn < CENTERS else pairs, known, similar, of), "links")
        comps = more_components(comps, new)
        if turn == CENTERS:
            break
        # Left open: blocks whose other nodes are in several components.
        rest = open_.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        centers = rest.groupBy("key").agg(F.min("node").alias("center"), F.min("component").alias("low"), F.max("component").alias("high"))
        left = rest.join(centers.where("low <> high").select("key", "center"), "key")
        # The last turn compares blocks whole, so the center chosen for it stays among their nodes.
        open_, n_open = stage_counted(left if turn + 1 == CENTERS else left.where("node <> center"), "open")
        if not n_open:
            break

    reps = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    named = reps.join(comps, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    found = sets.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def center_links(pairs: DataFrame, known: DataFrame, similar: int, of: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link.  A center's partners lie in tiles; each tile is searched with the center as the query."""
    tiled = pairs.withColumn("tile", F.floor(F.row_number().over(_by("a", "b")) / TILE))
    members = tiled.join(known.withColumnRenamed("node", "b"), "b").select("a", "tile", F.lit(1).alias("role"), F.col("b").alias("node"), "shingles")
    asks = tiled.select("a", "tile").distinct().join(known.withColumnRenamed("node", "a"), "a")
    asks = asks.select("a", "tile", F.lit(0).alias("role"), F.col("a").alias("node"), "shingles")
    met = members.unionAll(asks).repartition("a", "tile").sortWithinPartitions("a", "tile", "role")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (a, _), rows in grouped(batches, 2):
            query, sets = np.frombuffer(rows[0][2], np.uint64), [np.frombuffer(r[2], np.uint64) for r in rows[1:]]
            lists = inverted(sets, set(query.tolist()))
            out += [(a, rows[1 + doc][1]) for doc, _ in t_occurrence(query, lists, [len(s) for s in sets], similar, of)]
            if len(out) > 4096:
                yield pairs_batch(out)
                out.clear()
        yield pairs_batch(out)

    return map_batches(met, searched, "a long, b long")


def possible(pairs: DataFrame, short: DataFrame, similar: int, of: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that their sketches don't rule out."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, n, m, c, d, *s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, y = s[0] if c >= d else s[1], s[2] if d >= c else s[3]
                if abs(c - d) < 2 and may_link(np.count_nonzero(np.frombuffer(x, np.uint16) != np.frombuffer(y, np.uint16)), n + m, similar, of):
                    out.append((a, b))
            yield pairs_batch(out)

    named = lambda k, i: short.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}{i}") for c in ("size", "class", "own", "next")))
    met = pairs.join(named("a", 1), "a").join(named("b", 2), "b")
    return map_batches(met.select("a", "b", "size1", "size2", "class1", "class2", "own1", "next1", "own2", "next2"), checked, "a long, b long")


def block_pairs(rows: DataFrame, short: DataFrame, similar: int, of: int) -> DataFrame:
    """Pairs of different components inside blocks ``(key, node, component, center)`` that sketches don't rule out; equal blocks are taken once, large
    ones by pairs of tiles."""
    whole = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s")
    )
    whole = whole.groupBy("n", "x", "s").agg(F.min("key").alias("key")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = rows.join(whole.select("key", "n"), "key").select("key", "node", "component", tiles.alias("tiles"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(2)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    cells = placed.select("key", "node", "component", "tile", other)
    cells = cells.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "component")
    met = cells.join(short, "node").select("key", "i", "j", "tile", "node", "component", "size", "class", "own", "next")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in grouped(batches, 3):
            tile, node, component, size = (np.array([r[k] for r in group]) for k in range(4))
            top = max(r[4] for r in group)
            sketch = np.stack([np.frombuffer(r[5] if r[4] == top else r[6], np.uint16) for r in group])
            right, out = np.flatnonzero(tile == j), []
            for x in np.flatnonzero(tile == i):
                others = right[(component[right] != component[x]) & ((right > x) if i == j else True)]
                if len(others):
                    unequal = np.count_nonzero(sketch[others] != sketch[x], axis=1)
                    hits = others[may_link(unequal, size[others] + size[x], similar, of)]
                    out += [(min(int(node[x]), int(node[y])), max(int(node[x]), int(node[y]))) for y in hits]
            yield pairs_batch(out)

    return map_batches(met, compared, "a long, b long")


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)
