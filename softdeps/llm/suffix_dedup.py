"""Suffix-array dedup of long repeated byte strings.

Only strings that can repeat reach a suffix array.  Every window of 400 bytes names an anchor, the least hash among its 64-byte grams, so equal windows name
equal anchors; windows whose anchor occurs once are unique.  The others are cut out as contexts, the stretches of windows that name one anchor, equal
contexts are folded, and the contexts of an anchor meet in a shard of bounded size.  A shard's suffix array is built in two stages: suffixes smaller
than their successors are sorted directly, the rest is induced by scanning buckets; common prefixes of neighbours tell which windows repeat.  An
anchor with more contexts than a shard holds is split by content: a context is cut in two parts, of windows that hold some bytes more behind the anchor and of
windows that hold some more before it, and those bytes join the key; again while a group is too large.  Equal windows always stay in one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, map_batches, parts, stage
from softdeps.session import slots

LENGTH, GRAM_STEPS, SHARD_BYTES = 400, 6, 1 << 19
GRAM = 1 << GRAM_STEPS
TASKS_A_SLOT = 32
KEY = ("anchor", "context")
HALVES = (
    "anchor long, context binary, n long, offset int, half_anchor long, half_context binary, bytes binary, windows int, at int, width int"
)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 64-byte gram, by doubling."""
    rng = np.random.default_rng(11)
    h = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[b]
    for k in range(GRAM_STEPS):
        h = h[: -(1 << k)] * np.uint64(int(rng.integers(1 << 40, 1 << 62)) * 2 + 1) + h[1 << k :]
        h ^= h >> np.uint64(31)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``: running minima of blocks from both ends."""
    n = len(h)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, and of each run of windows with one anchor: the anchor, its first window and the end."""
    h = gram_hashes(np.frombuffer(text, np.uint8))
    least = window_minima(h, length - GRAM + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return h, least[starts].view(np.int64), starts, np.append(starts[1:], len(least))


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` bytes, in two stages.

    A suffix is small if it precedes its successor.  Small suffixes are sorted directly.  A bucket holds the suffixes of one first byte, the others before the
    small ones; scanning buckets upwards, the predecessor of every suffix met that is not small is the next of its own bucket.
    """
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    rise = np.zeros(n, bool)
    if n > 1:  # equal neighbours take the type of the first unequal pair after them
        step = b[:-1] != b[1:]
        at = np.where(step, np.arange(n - 1), n - 1)
        following = np.minimum.accumulate(at[::-1])[::-1]
        inside = following < n - 1
        rise[:-1][inside] = (b[:-1] < b[1:])[following[inside]]
    small = np.array(sorted(np.flatnonzero(rise).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    firsts = b[small]
    bounds = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[b[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        levels = []
        while len(level):  # a run of this byte is induced inside its own bucket
            levels.append(level)
            before = level[level > 0] - 1
            level = before[(b[before] == c) & ~rise[before]]
        bucket = np.concatenate([*levels, small[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(b[before] > c) & ~rise[before]]
        if not len(before):
            continue
        order = np.argsort(b[before], kind="stable")
        before = before[order]
        values, begins = np.unique(b[before], return_index=True)
        for v, lo, hi in zip(values, begins, np.append(begins[1:], len(before)), strict=True):
            waiting[v].append(before[lo:hi])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(data: bytes, a: np.ndarray, b: np.ndarray, limit: int, step: int = 40) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs, up to ``limit`` (which both suffixes must reach)."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(step), np.uint8), step)
    found, open_ = np.full(len(a), limit), np.arange(len(a))
    for at in range(0, limit, step):
        differ = view[a[open_] + at] != view[b[open_] + at]
        some = differ.any(1)
        found[open_[some]] = np.minimum(at + differ[some].argmax(1), limit)
        open_ = open_[~some]
        if not len(open_):
            break
    return found


def repeated_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and offset of every whole window, in the order of the suffix array, and the number of its class of equal windows."""
    data = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = suffix_array(data, length)
    owner = np.searchsorted(begins, order, side="right") - 1
    offset = order - begins[owner]
    whole = offset + length <= sizes[owner]
    order, owner, offset = order[whole], owner[whole], offset[whole]
    same = common_prefixes(data, order[:-1], order[1:], length) >= length
    return owner, offset, np.concatenate([[0], np.cumsum(~same)]).astype(np.int64)[: len(order)]


def regions(context: bytes, anchor: int, at: int | None, windows: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of windows with the place of the region that all of a range hold: at first their leftmost anchor, so that equal windows hold it at one place."""
    if at is not None:
        yield 0, windows, at
        return
    lo = 0
    for at in np.flatnonzero(gram_hashes(np.frombuffer(context, np.uint8)).view(np.int64) == anchor).tolist():
        if lo < windows:
            yield lo, min(at + 1, windows), at
        lo = at + 1


def halves_of(context: bytes, anchor: int, at: int | None, width: int, windows: int, length: int) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """``(key, bytes, at, width, first window, windows)`` of a context's parts.

    A window has ``length - width`` bytes beside its region.  With at most half of them before it, it holds the region and ``right`` bytes behind it, else
    the region and ``left`` bytes before it; a part's key is a hash of the old one, the side and these bytes, so equal windows get equal keys.
    """
    spare = length - width
    right, left = -(-spare // 2), spare // 2 + 1
    for lo, hi, at_ in regions(context, anchor, at, windows):
        middle = min(max(lo, at_ - spare // 2), hi)
        for side, s, e, begin, grown in ((b">", middle, hi, at_, right), (b"<", lo, middle, at_ - left, left)):
            if s < e:
                more = context[at_ + width : at_ + width + right] if side == b">" else context[begin:at_]
                key = hashlib.blake2b(anchor.to_bytes(8, "little", signed=True) + side + more, digest_size=8).digest()
                yield int.from_bytes(key, "little", signed=True), context[s : e + length - 1], begin - s, width + grown, s, e - s


def cut_in_two(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The parts of contexts; the bytes of equal ones once a batch."""
    names = ("anchor", "context", "n", "offset", "half_anchor", "half_context", "bytes", "windows", "at", "width")
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
    for batch in batches:
        out, seen = [], set()
        for anchor, name, n, context, windows, at, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for key, data, begin, grown, first, count in halves_of(context, anchor, at, width, windows, length):
                half = hashlib.md5(begin.to_bytes(4, "little") + data).digest()
                out.append((anchor, name, n, first, key, half, None if (key, half) in seen else data, count, begin, grown))
                seen.add((key, half))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield arrow({c: (list(v), t) for c, v, t in zip(names, columns, types, strict=True)})


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, with_kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row, and ``kept`` (binary: a cut may fall inside a character) if asked for.

    Every byte covered by a string of ``length`` (more than 64) bytes that also starts elsewhere, in this or another row, is removed; all occurrences go.
    Null text: empty.  Repeated rows are copies of each other.  Texts shorter than ``length`` stay whole.  An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, owners = [], [], []
            for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, runs, lo, hi = anchor_runs(text, length)
                h = h.view(np.int64)
                keys += runs.tolist()
                counts += [int(np.count_nonzero(h[s : e + length - GRAM] == v)) for v, s, e in zip(runs, lo, hi, strict=True)]
                owners += [digest] * len(runs)
            yield arrow({"anchor": (keys, pa.int64()), "n": (counts, pa.int32()), "digest": (owners, pa.binary())})

    long = texts.where(F.octet_length("text") >= length)
    found = stage(map_batches(long.select("text", "digest"), anchors, "anchor long, n int, digest binary"), "anchors")
    repeated = found.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    flagged = found.join(repeated, "anchor", "left_semi").groupBy("digest").agg(F.collect_set("anchor").alias("anchors"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text, digest, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, runs, lo, hi = anchor_runs(text, length)
                first = digest not in seen
                seen.add(digest)
                for k in np.flatnonzero(np.isin(runs, np.array(keep))):
                    for s in range(lo[k], hi[k], length - GRAM + 1):  # ties can make a run longer than one anchor's reach
                        e = min(hi[k], s + length - GRAM + 1)
                        context = text[s : e + length - 1]
                        out.append((int(runs[k]), hashlib.md5(context).digest(), digest, int(s), int(e - s), context if first else None))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            names = ("anchor", "context", "digest", "start", "windows", "bytes")
            yield arrow({n: (list(c), t) for n, c, t in zip(names, columns, types, strict=True)})

    schema = "anchor long, context binary, digest binary, start int, windows int, bytes binary"
    cut = stage(map_batches(long.join(flagged, "digest").select("text", "digest", "anchors"), cut_out, schema), "contexts")
    folded = cut.groupBy("anchor", "context").agg(F.sum(F.lit(1)).alias("n"), F.first("bytes", True).alias("bytes"), F.first("windows").alias("windows"))
    level = stage(folded.select(*KEY, "n", "bytes", "windows", F.lit(None).cast("int").alias("at"), F.lit(GRAM).alias("width")), "folded")
    levels, links, few, total = [level], [], [], 0
    while True:
        least = F.max("n") > 0 if len(levels) == 1 else F.sum("n") > 1  # a part of a context holds no window twice
        size = F.sum(F.col("windows") + (length - 1))
        groups = level.groupBy("anchor").agg(F.min("n").alias("least"), least.alias("meets"), size.alias("size"), F.max("width").alias("width"))
        large = (F.col("size") > shard_bytes) & (F.col("width") < length)
        groups = stage(groups.where("least = 1 and meets").select("anchor", "size", large.alias("large")), "groups")
        small, many = groups.agg(F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))), F.count_if("large")).first()
        total += small or 0
        told = groups.where("not large").select("anchor")
        few.append(level.join(told, "anchor").select(F.lit(len(levels) - 1).alias("level"), *KEY, "n", "bytes"))
        if not many:
            break
        # a large group holds more than a shard, so there are few: contexts need no shuffle to find out whether theirs is one
        halves = level.join(F.broadcast(groups.where("large").select("anchor")), "anchor")
        halves = stage(map_batches(halves.select(*KEY, "n", "bytes", "windows", "at", "width"), partial(cut_in_two, length=length), HALVES), "halves")
        links.append(halves.where("n = 1").select(*KEY, "offset", "half_anchor", "half_context"))
        level = halves.groupBy(F.col("half_anchor").alias("anchor"), F.col("half_context").alias("context")).agg(
            F.sum("n").alias("n"), F.first("bytes", True).alias("bytes"), *[F.first(c).alias(c) for c in ("windows", "at", "width")]
        )
        level = stage(level, "level")
        levels.append(level)

    shards = parts(total, shard_bytes)
    sharded = reduce(DataFrame.unionByName, few).withColumn("shard", F.pmod(F.xxhash64("level", "anchor"), F.lit(shards)))
    sharded = sharded.repartition(min(shards, TASKS_A_SLOT * slots(docs.sparkSession)), "shard")

    def marked(table: pa.Table) -> pa.Table:
        owner, offset, cls = repeated_windows(table.column("bytes").to_pylist(), length)
        hit = (np.bincount(cls)[cls] > 1) & (table.column("n").to_numpy()[owner] == 1)
        owner, offset = owner[hit], offset[hit]
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(offset) != 1)])[: len(owner)])
        ends = np.append(begins[1:], len(owner))[: len(begins)] - 1
        rows = table.select(["level", *KEY]).take(pa.array(owner[begins]))
        return rows.append_column("lo", pa.array(offset[begins], pa.int32())).append_column("hi", pa.array(offset[ends], pa.int32()))

    found_in = stage(sharded.groupBy("shard").applyInArrow(marked, "level int, anchor long, context binary, lo int, hi int"), "marks")
    marks = None
    for k in reversed(range(len(levels))):
        own = found_in.where(F.col("level") == k).select(*KEY, "lo", "hi")
        own = own.unionByName(levels[k].where("n > 1").select(*KEY, F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi")))
        if marks is not None:
            above = marks.toDF("half_anchor", "half_context", "lo", "hi").join(links[k], ["half_anchor", "half_context"])
            own = own.unionByName(above.select(*KEY, (F.col("offset") + F.col("lo")).alias("lo"), (F.col("offset") + F.col("hi")).alias("hi")))
        marks = own
    places = cut.select("digest", "anchor", "context", "start").distinct()
    spans = places.join(marks, ["anchor", "context"]).groupBy("digest")
    spans = spans.agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, last, n = [], 0, 0
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in found or []):
                    if lo > last or not n:
                        kept.append(text[last:lo])
                        n += 1
                    last = max(last, hi)
                kept = b"".join([*kept, text[last:]])
                out.append((len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            m = 6 if with_kept else 5
            yield pa.RecordBatch.from_arrays(arrays[:m], names=["doc_id", *names][:m])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    return map_batches(texts.join(spans, "digest", "left").select("doc_id", "text", "spans"), removed, schema)
