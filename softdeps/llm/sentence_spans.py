"""Substring dedup by sliding spans of sentences.

Runs of at least two sentences and twenty words are hashed; runs of equal words are joined over all documents, and each sentence that a non-first
occurrence covers is removed.  A run depends on its own words alone, so a passage gives the same runs wherever it stands.  Not every run is needed: what a
longer one covers, the shortest run from each sentence and those that end before the next sentence's shortest run does cover as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import WORD, arrow, map_batches

SENTENCES, WORDS = 2, 20

# A sentence ends after closing punctuation before white space, or at a line's end.  One of more than LONGEST words is cut after the word of least hash of
# every WINDOW words in a row (the last of equal ones), so the cuts follow from the words around them and no piece is longer than the window.  A passage of
# 42 words has a run of its own then, whatever stands before and after it.
BREAK = re.compile(rb"[.!?]+[\"')\]]*[\x20\x09-\x0D]+|\n+")
LONGEST, WINDOW = 24, 8
BYTES_WORD = re.compile(WORD.encode())


def cuts(words: list[bytes]) -> list[int]:
    """Ascending places before which a long sentence is cut; the last is its end."""
    h, out, at = [*map(xxhash.xxh3_64_intdigest, words)], [], -1
    for i in range(len(h) - WINDOW + 1):
        if at < i:
            at = min(range(i, i + WINDOW), key=lambda k: (h[k], -k))
        elif h[i + WINDOW - 1] <= h[at]:
            at = i + WINDOW - 1
        else:
            continue
        out.append(at + 1)
    return [*out, len(words)] if out[-1:] != [len(words)] else out


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """``(start, end, words)`` of each sentence; together they cover the text.  One without words belongs to the sentence before."""
    out: list[tuple[int, int, list[bytes]]] = []
    start = 0
    for end in [*(m.end() for m in BREAK.finditer(text)), len(text)]:
        if end == start:
            continue
        words = text[start:end].split()
        if not words and out:
            out[-1] = (out[-1][0], end, out[-1][2])
        elif len(words) <= LONGEST:
            out.append((start, end, words))
        else:
            ends, at, first = [m.end() for m in BYTES_WORD.finditer(text, start, end)], start, 0
            for last in cuts(words):
                upto = end if last == len(words) else ends[last - 1]
                out.append((at, upto, words[first:last]))
                at, first = upto, last
        start = end
    return out


def runs(text: bytes, least: int, words: int) -> Iterator[tuple[int, int, bytes]]:
    """``(first, last, digest)`` of the shortest run from each sentence that is long enough, and of those that end before the next sentence's does.

    Any longer run is made up of such runs inside it, which repeat wherever it does, so together they cover what all runs would.
    """
    cut = sentences(text)
    last, n, ends = -1, 0, []
    for first in range(len(cut)):
        while last + 1 < len(cut) and (last - first + 1 < least or n < words):
            last += 1
            n += len(cut[last][2])
        if last - first + 1 < least or n < words:
            break
        ends.append(last)
        n -= len(cut[first][2])
    said = [b" ".join(words) for *_, words in cut]
    for first, last in enumerate(ends):
        upto = ends[first + 1] if first + 1 < len(ends) else len(cut)
        key = xxhash.xxh3_128(b" ".join(said[first if said[first] else first + 1 : last + 1]))
        yield first, last, key.digest()
        for further in range(last + 1, upto):
            key.update(b" " + said[further])
            yield first, further, key.digest()


def drop_repeated_sentences(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated sentences, and ``n_bytes, n_sentences, n_removed`` (bytes), ``n_spans`` (maximal removed stretches),
    ``n_removed_sentences, kept_sha256``.

    The first occurrence is that of the smallest ``doc_id`` (nulls last), then of the smallest hash of the text, then of the smallest place.  Rows that
    share a ``doc_id`` and a text are one document and get the same result; rows that share only a ``doc_id``, null or not, are documents of their own.  Null text: stays null, counts as empty.  Further columns pass through; columns of the new names are replaced.
    """
    new = ("n_bytes", "n_sentences", "n_removed", "n_spans", "n_removed_sentences", "kept_sha256")
    docs = docs.drop(*new)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, keys = [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for first, last, key in runs(text or b"", least, words):
                    rows.append(row)
                    places.append(first << 32 | last)
                    keys.append(key)
            high, low = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            of = pa.array(rows, pa.int32())
            columns = [pa.array(high), pa.array(low), batch.column(0).take(of), batch.column(1).take(of), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of key, document and place, streamed: those that are not at their key's first place."""
        origin = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy() for c in batch.columns])
            x[4] >>= 32
            before = x[:, :1] - 1 if origin is None else origin
            opens = (x[:2] != np.concatenate([before[:2], x[:2, :-1]], 1)).any(0)
            at = np.maximum.accumulate(np.where(opens, np.arange(x.shape[1]), -1))
            origins = np.where(at >= 0, x[:, at], before)
            origin = origins[:, -1:]
            yield batch.filter(pa.array((x[2:] != origins[2:]).any(0))).select(names[2:])

    names = ["high", "low", "#id", "#digest", "place"]
    document = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("#id"), F.xxhash64("text").alias("#digest")
    schema = ", ".join(f"`{n}` long" for n in names)
    found = map_batches(docs.select(*document, "text"), spans, schema).repartition("high", "low").sortWithinPartitions(*names)
    covered = map_batches(found, later, ", ".join(f"`{n}` long" for n in names[2:])).groupBy("#id", "#digest").agg(F.collect_set("place").alias("#covered"))
    joined = docs.select("*", *document).join(covered, ["#id", "#digest"], "left").select(*docs.columns, "#covered")
    passed, at = list(docs.columns), docs.columns.index("text")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [], []
            for text, marks in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column("#covered").to_pylist(), strict=True):
                cut = sentences(text or b"")
                gone = bytearray(len(cut))
                for m in marks or []:
                    first, last = m >> 32, m & 0xFFFFFFFF
                    gone[first : last + 1] = b"\1" * (last + 1 - first)
                kept = b"".join(text[s:e] for (s, e, _), g in zip(cut, gone, strict=True) if not g) if text else b""
                texts.append(None if text is None else kept.decode())
                stretches = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
                n = len(text or b"")
                out.append((n, len(cut), n - len(kept), stretches, sum(gone), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 6
            arrays = [batch.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(passed))]
            arrays += [pa.array(c, pa.string() if k == "kept_sha256" else pa.int64()) for k, c in zip(new, columns, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*passed, *new])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), *(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in new)])
    return map_batches(joined, removed, schema)
