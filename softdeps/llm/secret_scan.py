"""Secret scan with recursive decoding.

Each text is a worklist of layers: the text, what its percent and Unicode escapes say, and what its base64 tokens and compressed blobs hold.  Every layer
is scanned with the same patterns and searched for further layers; a layer that stands below itself (by its content) is not entered again, so cycles
end.  Spans found in a layer are mapped back to code points of the original text, at every place where the layer stands.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from softdeps.llm.common import map_batches

# The kinds in order, their patterns and the shortest match that counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % HEX_LEAST)
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})(?:\\u([0-9A-Fa-f]{4}))?|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABET = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)+={0,2}")
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
# What a layer among other bytes must hold to be looked at: a beginning of any pattern or of a further layer.
TELLING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-]{4}\r?\n[\x20\t]*[A-Za-z0-9+/_-]{4}")
UNPACK = ((b"\x1f\x8b", lambda: zlib.decompressobj(31)), (b"x", zlib.decompressobj), (b"BZh", bz2.BZ2Decompressor), (b"\xfd7zXZ", lzma.LZMADecompressor))

# A layer's decompressed size is bounded so that a bomb can't exhaust a task; a cut is reported in ``n_cut``, and what was unpacked is scanned.
LAYER_BYTES = 32 << 20

Span = tuple[int, int]
Map = Callable[[int, int], Span]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(text)]  # a run of 32 or more is what HEX finds whole
    return sorted(found)


def percent_bytes(match: re.Match) -> list[tuple[str, int, int]]:
    """The characters of a run of percent escapes with the place of each in the run; what isn't UTF-8 reads as Latin-1."""
    raw, out, i = bytes.fromhex(match.group().replace("%", "")), [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[i : i + n].decode(), 3 * i, 3 * (i + n)))
                break
            except UnicodeDecodeError:
                pass
        else:
            n = 1
            out.append((chr(raw[i]), 3 * i, 3 * i + 3))
        i += n
    return out


def unicode_chars(match: re.Match) -> list[tuple[str, int, int]]:
    braced, first, second, wide, byte = match.groups()
    whole = len(match.group())
    if first and second:
        a, b = int(first, 16), int(second, 16)
        if 0xD800 <= a < 0xDC00 <= b < 0xE000:
            return [(chr(0x10000 + ((a - 0xD800) << 10) + b - 0xDC00), 0, whole)]
        return [(chr(a), 0, 6), (chr(b), 6, 12)]
    code = int(braced or first or wide or byte, 16)
    return [(chr(code), 0, whole)] if code < 0x110000 else [(c, i, i + 1) for i, c in enumerate(match.group())]


def rewritten(text: str, pattern: re.Pattern, decode: Callable) -> tuple[str, Map, Callable[[int, int], bool]] | None:
    """The text with every match replaced, the map of its spans to the old text, and whether a span touches a replaced place."""
    pieces, starts, old, size, last = [], [], [], 0, 0
    for m in pattern.finditer(text):
        pieces.append(text[last : m.start()])
        starts.append(size)
        old.append((last, m.start(), True))
        size += m.start() - last
        for char, lo, hi in decode(m):
            pieces.append(char)
            starts.append(size)
            old.append((m.start() + lo, m.start() + hi, False))
            size += len(char)
        last = m.end()
    if not last:
        return None
    pieces.append(text[last:])
    starts.append(size)
    old.append((last, len(text), True))

    def place(at: int, end: bool) -> int:
        k = bisect_right(starts, at - end) - 1
        lo, hi, same = old[k]
        return lo + at - starts[k] if same else (hi if end else lo)

    def touched(start: int, end: int) -> bool:
        return any(not old[k][2] for k in range(bisect_right(starts, start) - 1, bisect_right(starts, end - 1)))

    return "".join(pieces), lambda s, e: (place(s, False), place(e, True)), touched


def unpacked(raw: bytes) -> tuple[bytes, bool, int] | None:
    """Decompressed bytes of all members in a row, whether they were cut, and the bytes read; None if it is no compressed data."""
    out, room, cut, rest = [], LAYER_BYTES, False, raw
    while found := next((x for x in UNPACK if rest.startswith(x[0])), None):
        if not room:
            cut = True
            break
        engine = found[1]()
        try:
            out.append(engine.decompress(rest, room))
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            cut = bool(out) and found[0] != b"x"  # an x may be any text behind the data
            break
        room -= len(out[-1])
        if not engine.eof:
            cut, rest = True, b""
            break
        rest = engine.unused_data.lstrip(b"\0")
    return (whole, cut, len(raw) - len(rest)) if (whole := b"".join(out)) else None


def unpacked_whole(raw: bytes) -> tuple[str, bool, int] | None:
    """The text of what is compressed, also more than once."""
    if not (packed := unpacked(raw)):
        return None
    out, cut, used = packed
    while (inner := unpacked(out)) and inner[0] != out:
        out, cut = inner[0], cut or inner[1]
    return out.decode("utf-8", "replace"), cut, used


class Token:
    """A base64 token, which may be wrapped over lines, and the places of its characters in the layer."""

    def __init__(self, match: re.Match):
        self.lo, self.hi = match.span()
        self.starts, self.places, pieces, n = [], [], [], 0
        for m in ALPHABET.finditer(match.group()):
            self.starts.append(n)
            self.places.append(self.lo + m.start())
            pieces.append(m.group())
            n += len(pieces[-1])
        self.text = "".join(pieces).replace("-", "+").replace("_", "/")

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]

    def end(self, i: int) -> int:
        last = min(i, len(self.text))
        return min(self.hi, self.place(last - 1) + 1 + i - last)

    def span(self, s: int, e: int, skip: int = 0) -> Span:
        """Of bytes: four characters for three."""
        return self.place(skip + s // 3 * 4), self.end(skip + (e + 2) // 3 * 4)

    def whole(self) -> tuple[str, Map, bool] | None:
        """The layer if all of the token is its base64."""
        try:
            raw = base64.b64decode(self.text + "=" * (-len(self.text) % 4), validate=True)
        except (binascii.Error, ValueError):
            return None
        everywhere = lambda s, e: (self.lo, self.hi)
        if packed := unpacked_whole(raw):
            return packed[0], everywhere, packed[1]
        try:
            layer = raw.decode()
        except UnicodeDecodeError:
            return None
        return layer, self.span if len(layer) == len(raw) else everywhere, False

    def glued(self, first: int) -> Iterator[tuple[str, Map, bool]]:
        """Layers that begin or end inside the token, from each of the four alignments on: only those that may say something."""
        for skip in range(first, 4):
            n = len(self.text) - skip
            n -= n % 4 == 1
            raw = base64.b64decode(self.text[skip : skip + n] + "=" * (-n % 4))
            if TELLING.search(raw):
                yield raw.decode("latin-1"), (lambda s, e, skip=skip: self.span(s, e, skip)), False
            done = 0
            for m in PACKED.finditer(raw):
                i = m.start()
                if i < done or not i + skip or (raw[i] == 0x78 and i % 3):
                    continue
                if packed := unpacked_whole(raw[i:]):
                    layer, cut, used = packed
                    if raw[i] == 0x78 and cut and not TELLING.search(layer.encode()):
                        continue  # two bytes that look like a header
                    done = i + used
                    yield layer, (lambda s, e, at=skip + i // 3 * 4: (self.place(at), self.hi)), cut


def blob_layers(text: str) -> Iterator[tuple[str, Map, bool]]:
    """Layers inside base64 tokens, wrapped over lines or glued to other characters too: their text, or that of the compressed data in them."""
    wrapped: list[tuple[int, int, bool]] = []
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            token = Token(m)
            if len(token.text) >= 16:
                if found := token.whole():
                    yield found
                wrapped.append((*m.span(), bool(found)))
                yield from token.glued(1 if found else 0)
    k = 0
    for m in BASE64.finditer(text):
        while k < len(wrapped) and wrapped[k][1] <= m.start():
            k += 1
        inside = k < len(wrapped) and wrapped[k][0] <= m.start()
        if inside and wrapped[k][2]:
            continue
        token = Token(m)
        if found := token.whole():
            yield found
        if not inside:
            yield from token.glued(1 if found else 0)


def sublayers(layer: str) -> Iterator[tuple[str, Map, Callable | None, bool]]:
    """``(content, map of its spans to the layer, whether a span counts, whether it was cut)`` of each layer that the layer itself holds."""
    if "%" in layer and (new := rewritten(layer, PERCENT, percent_bytes)):
        yield (*new, False)
    if "\\" in layer and (new := rewritten(layer, UNICODE, unicode_chars)):
        yield (*new, False)
    for inner, place, was_cut in blob_layers(layer):
        yield inner, place, None, was_cut


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Plain spans, all spans (start, kind, end), number of different layers below the text, number of layers cut.

    Depth first.  A content's own and inner spans are found once, in its own places, and mapped to every place where it stands; only a content met again
    below itself isn't entered.
    """
    base, cut = base_spans(text), 0
    seen, chain = {text}, {text: 0}
    done: dict[str, tuple[list, set]] = {}
    # content, its plain spans, spans of its inner layers, layers to come, how the layer above holds it, least depth of the chain met again below
    stack: list[list] = [[text, base, set(), sublayers(text), None, None, 0]]

    def told(above: list, plain: list, inner: set, place: Map, touched: Callable | None) -> None:
        for s, k, e in [x for x in plain if touched is None or touched(x[0], x[2])] + list(inner):
            a, b = place(s, e)
            above[2].add((a, k, b))

    while True:
        now = stack[-1]
        if (new := next(now[3], None)) is None:
            stack.pop()
            del chain[now[0]]
            if now[6] >= len(stack):  # nothing of it was left to a layer above
                done[now[0]] = now[1], now[2]
            if not stack:
                return base, sorted({*base, *now[2]}), len(seen) - 1, cut
            stack[-1][6] = min(stack[-1][6], now[6])
            told(stack[-1], *now[1:3], *now[4:6])
            continue
        inner, place, touched, was_cut = new
        cut += was_cut
        seen.add(inner)
        if inner in chain:
            now[6] = min(now[6], chain[inner])
            told(now, stack[chain[inner]][1], set(), place, touched)
        elif inner in done:
            told(now, *done[inner], place, touched)
        else:
            chain[inner] = len(stack)
            stack.append([inner, base_spans(inner), set(), sublayers(inner), place, touched, len(stack)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, last = [], 0
    for start, _, end in spans:
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, n_cut`` for every row.

    Null text: empty, so no spans and the digest of the empty string.  Repeated rows give repeated results; an empty table gives none; further columns
    are not looked at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans, layers, cut = scan(text or "")
                count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, cut))
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_cut"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_cut long"
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), task, schema)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (of any layer) in ``text`` replaced by ``mark``; all rows and columns stay, null texts stay null."""
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and redacted(t, scan(t)[1], mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, task, docs.schema)
