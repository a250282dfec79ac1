"""Packing along a space-filling curve.

A document's hashed vector of byte pairs is projected to three dimensions; the Hilbert key of that point orders the documents, so neighbours on the
curve are alike.  Rows are range-partitioned by the key; each task tokenizes its stretch of the curve and lays the documents end to end, cutting every
1024 tokens.  What is left at the end of a stretch is cut into powers of two, so nothing is padded at all.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from softdeps.llm.common import arrow, map_batches

LENGTH = 1024
FEATURES, DIMS, BITS = 256, 3, 16


def projection(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each byte pair, and the projection of features to the curve's dimensions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, FEATURES, 65536).astype(np.int16), rng.standard_normal((FEATURES, DIMS)) / math.sqrt(DIMS)


def curve_points(texts: list[bytes], pair_feature: np.ndarray, project: np.ndarray) -> np.ndarray:
    """Points on the integer grid, one row per text; texts of under two bytes lie in the middle."""
    vectors = np.zeros((len(texts), FEATURES))
    for row, text in enumerate(texts):
        if len(text) > 1:
            b = np.frombuffer(text, np.uint8)
            counts = np.bincount(pair_feature[b[:-1].astype(np.uint16) * 256 + b[1:]], minlength=FEATURES)
            vectors[row] = counts / math.sqrt(float(counts @ counts))
    flat = np.tanh(vectors @ project)
    return np.clip(((flat + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of grid points (n x d): axes are rotated and exchanged from the highest bit down, then Gray-decoded and interleaved."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> b) & 1)
    return key


# Fixed values of byte-level vocabularies: how a text is cut into units, and which bytes stand for themselves in the vocabulary's strings.
UNITS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class TextIds:
    """Ids of whole texts by a byte-level tokenizers file.

    Texts without two white-space characters in a row are encoded from the same vocabulary's merge ranks, which is five times as fast and gives the
    same ids; all others, those that may hold a special token, and vocabularies whose ids aren't in merge order go through the tokenizer itself.
    """

    def __init__(self, path: str, encode_special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs = re.compile(r"\s\s")
        model = json.loads(self.tokenizer.to_str())["model"]
        hidden = [b for b in range(256) if b not in PRINTABLE]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged):
            import tiktoken

            units = {u: i for u, i in model["vocab"].items() if u not in self.special}
            ranks = {bytes(byte_of[c] for c in u): i for u, i in units.items()}
            self.fast = tiktoken.Encoding("units", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.runs.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def pack_by_curve(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = True, encode_special: bool = False
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all documents, and ``ids`` (little-endian unsigned 32 bit) if asked for.

    ``tokenizer_path``: a tokenizers file, readable on every executor.  Null text: empty, so the document is its ``end_id`` alone.  Repeated rows are
    packed as often as they occur; equal keys are ordered by ``doc_id``.  An empty table gives no rows; further columns are not looked at.
    """
    pair_feature, project = projection()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = hilbert_keys(curve_points(texts, pair_feature, project))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["doc_id", "text", "key"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, last_ids = TextIds(tokenizer_path, encode_special), None, None
        first, at, held = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last_ids is None or text != last:  # copies lie side by side on the curve
                    last, last_ids = text, np.append(encode(text or ""), end_id).astype("<u4")
                ids = last_ids
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, length - at % length)
                    held.append((doc_id, start, ids[start : start + take], len(ids), first + at // length, at % length))
                    start, at = start + take, at + take
                    if at % length == 0:
                        out, held = out + held, []
            if out:
                yield rows(out)
        if held:
            yield rows(list(powers(held)))

    def powers(last: list[tuple]) -> Iterator[tuple]:
        """The last, unfinished sequence anew, as sequences whose lengths are powers of two."""
        total, sequence = sum(len(p[2]) for p in last), last[0][4]
        ends = [0]
        for b in range(length.bit_length(), -1, -1):
            if total >> b & 1:
                ends.append(ends[-1] + (1 << b))
        for doc_id, start, ids, n, _, offset in last:
            for k in range(1, len(ends)):
                lo, hi = max(offset, ends[k - 1]), min(offset + len(ids), ends[k])
                if lo < hi:
                    yield doc_id, start + lo - offset, ids[lo - offset : hi - offset], n, sequence + k - 1, lo - ends[k - 1]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        ids = [p[2].tobytes() for p in pieces]
        columns = {
            "doc_id": ([p[0] for p in pieces], pa.int64()),
            "start": ([p[1] for p in pieces], pa.int64()),
            "length": ([len(p[2]) for p in pieces], pa.int64()),
            "ids_crc32": ([zlib.crc32(b) for b in ids], pa.int64()),
            "doc_tokens": ([p[3] for p in pieces], pa.int64()),
            "sequence_id": ([p[4] for p in pieces], pa.int64()),
            "offset": ([p[5] for p in pieces], pa.int64()),
        }
        return arrow(columns | ({"ids": (ids, pa.binary())} if with_ids else {}))

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    ordered = map_batches(texts, keyed, "doc_id long, text string, key long").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return map_batches(ordered, packed, schema)
