"""Secrets in texts and in what is wrapped inside them.

A worklist starts with the text itself. Each layer is scanned; then URL escapes, Unicode escapes, base64 runs and
compressed payloads in it are unwrapped into new layers, until nothing new appears. Layers already seen (a payload that
unwraps to itself) are left out by digest. Every layer carries a map of its bytes to spans of the original text.

A layer is kept as bytes, whatever they are. All patterns are ASCII, so one byte for each character (Latin-1, "?" for
the others) is enough for the text itself, and UTF-8 and Latin-1 payloads need no decoding.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
URL_RUN = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(rb"\\[uUx]([0-9A-Fa-f]+)")
#: Both alphabets, with the line breaks of wrapped base64. The second form finds runs whose first line is short.
BASE64_RUN = re.compile(rb"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\t\x20]*[A-Za-z0-9+/_-]++)*+={0,2}")
WRAPPED_RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,15}+(?:\r?\n[\t\x20]*[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(rb"\r?\n[\t\x20]*")
#: String escapes of JSON, C and Python, as compressed bytes are written with them.
ANY_ESCAPE = re.compile(rb"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|[abefnrtv/\\\\\"'])")
SHORT = dict(zip(b"abefnrtv", b"\a\b\x1b\f\n\r\t\v", strict=True))
#: ASCII in UTF-16 or UTF-32 of either byte order.
WIDE = re.compile(rb"[\x01-\x7f](?:\x00{1,3}[\x01-\x7f]){3,}")
STANDARD = bytes.maketrans(b"-_", b"+/")
#: What base64 decodes to at a wrong phase has no such stretch; no secret and nothing that can be unwrapped is shorter.
STRETCH = re.compile(rb"[\x00\t\n\r\x20-\x7e]{8,}")
#: Second bytes of a zlib head by its first one.
_ZLIB = b"|".join(re.escape(bytes((c,))) + b"[" + b"".join(b"\\x%02x" % f for f in range(256) if not f & 0x20 and (c * 256 + f) % 31 == 0) + b"]" for c in range(0x08, 0x79, 0x10))
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\x28\xb5\x2f\xfd|" + _ZLIB, re.DOTALL)
#: Compressed bytes are read in pieces of this size. Layers above the second size are kept in a temporary file.
PIECE, IN_MEMORY = 1024, 64 << 20


def scan(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of one layer, leftmost and non-overlapping within a kind."""
    found = []
    if text.find(b":") >= 0 or text.find(b"=") >= 0:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if text.find(b"AKIA") >= 0:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """Bytes with pieces (start in the bytes, original start, original end, whether its bytes map one to one)."""

    def __init__(self, text: bytes | mmap.mmap, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.pieces, self.starts = text, pieces, [p[0] for p in pieces]

    def origin(self, start: int, end: int) -> tuple[int, int]:
        a = self.pieces[bisect_right(self.starts, start) - 1]
        b = self.pieces[bisect_right(self.starts, end - 1) - 1]
        return a[1] + (start - a[0]) * a[3], b[1] + end - b[0] if b[3] else b[2]

    def rewritten(self, runs: list[tuple[int, int, bytes]]) -> Layer:
        """The layer with runs (start, end, replacement) put in; a replaced run maps as a whole."""
        parts, pieces, size, at = [], [], 0, 0

        def keep(upto: int) -> None:
            nonlocal size
            k = at
            while k < upto:
                i = bisect_right(self.starts, k) - 1
                stop = min(upto, self.starts[i + 1] if i + 1 < len(self.starts) else upto)
                p = self.pieces[i]
                pieces.append((size, p[1] + (k - p[0]) * p[3], p[2], p[3]))
                parts.append(self.text[k:stop])
                size += stop - k
                k = stop

        for start, end, new in runs:
            keep(start)
            if new:
                pieces.append((size, *self.origin(start, end), False))
                parts.append(new)
                size += len(new)
            at = end
        keep(len(self.text))
        return Layer(b"".join(parts), pieces)


def _opened(raw: bytes | memoryview, at: int):
    if raw[at : at + 2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[at : at + 3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[at : at + 4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    return zlib.decompressobj(15)


class _Joined:
    """Bytes put together piece by piece, in a temporary file once they are many."""

    def __init__(self):
        self.parts, self.size, self.file = [], 0, None

    def add(self, part: bytes) -> None:
        self.size += len(part)
        if self.file is None and self.size > IN_MEMORY:
            self.file = tempfile.TemporaryFile()
            self.file.writelines(self.parts)
            self.parts = []
        if self.file is None:
            self.parts.append(part)
        else:
            self.file.write(part)

    def value(self) -> bytes | mmap.mmap:
        if self.file is None:
            return b"".join(self.parts)
        self.file.flush()
        with self.file:
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _unpacked(raw: bytes | mmap.mmap, at: int) -> tuple[int, bytes | mmap.mmap]:
    """Where the compressed streams that start at a place end, and what is in them, members and frames that follow each
    other joined; of a broken stream, what comes before the break."""
    out, end = _Joined(), at
    while True:
        d, start = _opened(raw, end), end
        try:
            while end < len(raw) and not d.eof:
                piece = raw[end : end + PIECE]
                out.add(d.decompress(piece))
                end += len(piece) - len(d.unused_data)
        except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
            return (start if start > at else at + 1), out.value()
        if end >= len(raw) or end == start or PACKED.match(raw, end) is None:
            return end, out.value()


def _packed(layer: Layer) -> Iterator[Layer]:
    """What the compressed streams of a layer hold, wherever they start."""
    at = 0
    while (m := PACKED.search(layer.text, at)) is not None:
        at, inner = _unpacked(layer.text, m.start())
        at = max(at, m.start() + 1)
        if inner:
            yield Layer(inner, [(0, *layer.origin(m.start(), at), False)])


def _decoded(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """The base64 run of a layer, read in each of the four phases: a payload behind other characters of the alphabet
    is in one of them. What is no clean text maps stretch by stretch."""
    run = bytes(layer.text[start:end]).rstrip(b"=")
    breaks = [(m.start(), m.end()) for m in BREAK.finditer(run)]
    body = BREAK.sub(b"", run).translate(STANDARD)
    lost, starts, shifts = 0, [0], [start]
    for a, b in breaks:
        starts.append(a - lost)
        lost += b - a
        shifts.append(start + lost)

    def place(k: int) -> int:
        return k + shifts[bisect_right(starts, k) - 1]

    for phase in range(4):
        whole = body[phase:]
        if len(whole) % 4 == 1:
            whole = whole[:-1]
        raw = binascii.a2b_base64(whole + b"=" * (-len(whole) % 4))
        if STRETCH.search(raw) is None and PACKED.search(raw) is None:
            continue

        def span(a: int, b: int, phase: int = phase, n: int = len(raw)) -> tuple[int, int]:
            return layer.origin(place(phase + a * 4 // 3), end if b == n else place(phase + -(-b * 4 // 3) - 1) + 1)

        if _readable(raw):
            yield Layer(raw, [(0, *span(0, len(raw)), False)])
            continue
        # Between stretches, and in compressed bytes, each block of three bytes maps to its four characters.
        pieces, at = [], 0
        for m in [*STRETCH.finditer(raw), None]:
            upto = m.start() if m else len(raw)
            pieces += [(k, *span(k, min(k + 3, upto)), False) for k in range(at, upto, 3)]
            if m:
                pieces.append((upto, *span(upto, m.end()), False))
                at = m.end()
        yield Layer(raw, pieces)


def _readable(raw: bytes) -> bool:
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return sum(not (c.isprintable() or c in "\t\r\n") for c in text) * 20 <= len(text)


def _characters(run: bytes) -> bytes:
    """One byte for each escaped character; bytes that Python escaped as U+DC80 to U+DCFF are those bytes."""
    codes = [int(x, 16) for x in ESCAPE.findall(run)]
    return bytes(c if c < 0x100 else c - 0xDC00 if 0xDC80 <= c < 0xDD00 else 63 for c in codes)


def _any_characters(run: bytes) -> bytes:
    body = run[1:]
    if body[0] in b"uUx":
        return _characters(run)
    return bytes((int(body, 8) & 255 if body[0] in b"01234567" else SHORT.get(body[0], body[0]),))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    yield from _packed(layer)
    if text.find(b"%") >= 0 and (runs := [(m.start(), m.end(), bytes.fromhex(m[0].replace(b"%", b"").decode())) for m in URL_RUN.finditer(text)]):
        yield layer.rewritten(runs)
        if text.find(b"+") >= 0:
            # Forms write a space as "+"; for compressed bytes both readings are tried.
            runs += [(k, k + 1, b" ") for k in (m.start() for m in re.finditer(rb"\+", text))]
            yield from _packed(layer.rewritten(sorted(runs)))
    if text.find(b"\\") >= 0:
        if runs := [(m.start(), m.end(), _characters(m[0])) for m in UNICODE_RUN.finditer(text)]:
            yield layer.rewritten(runs)
        if runs := [(m.start(), m.end(), _any_characters(m[0])) for m in ANY_ESCAPE.finditer(text)]:
            yield from _packed(layer.rewritten(runs))
    if text.find(b"\0") >= 0 and (runs := [(m.start(), m.end(), m[0].replace(b"\0", b"")) for m in WIDE.finditer(text)]):
        yield layer.rewritten(runs)
    for m in BASE64_RUN.finditer(text):
        yield from _decoded(layer, m.start(), m.end())
    if text.find(b"\n") >= 0:
        for m in WRAPPED_RUN.finditer(text):
            if m.end() - m.start() >= 16:
                yield from _decoded(layer, m.start(), m.end())


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted (start, kind, end) in code points of the text."""
    raw = (text or "").encode("latin-1", "replace")
    base = sorted(scan(raw))
    spans, seen, work = set(base), set(), [Layer(raw, [(0, 0, len(raw), True)])]
    while work:
        for inner in unwrapped(work.pop()):
            if not inner.text:
                continue
            digest = hashlib.sha256(inner.text)
            digest.update(repr((inner.pieces[0], inner.pieces[-1], len(inner.pieces))).encode())
            if digest.digest() in seen:
                continue
            seen.add(digest.digest())
            for start, kind, end in scan(inner.text):
                a, b = inner.origin(start, end)
                spans.add((a, kind, b))
            work.append(inner)
    return base, sorted(spans)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t in batch:
            base, spans = find(t)
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null is the empty text: no spans. Rows are judged one by one; repeated rows and null ids pass through.
    """
    judged = F.pandas_udf(_report, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select("doc_id", judged(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([mask(t) for t in batch], dtype=object)


def mask(text: str | None, put: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones merged, replaced. Null stays null."""
    if not text:
        return text
    parts, at, upto = [], 0, -1
    for start, _, end in find(text)[1]:
        if start > upto:
            parts.append(text[at:start] if upto < 0 else text[upto:start])
            parts.append(put)
        upto = max(upto, end)
    return text if upto < 0 else "".join(parts) + text[upto:]


def redacted(text: Column) -> Column:
    return F.pandas_udf(_masked, "string")(text)
