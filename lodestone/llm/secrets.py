"""Secret scans with a worklist of decoded layers.

A text is scanned as it is; then encoded parts are unwrapped into further
layers, which are scanned and unwrapped in turn until nothing new appears.  A
layer seen before at the same place isn't unwrapped again.  Each character of a
layer knows the span of the original text it comes from, so a secret found deep
down is reported where its encoding lies, and as often as it is encoded.  Layers
of bytes are text too: what isn't UTF-8 in them are lone surrogates
(``surrogateescape``), from which gzip and zlib streams are read back.

A stream is inflated piece by piece, however far it expands: beyond ``WINDOW``
bytes it makes several layers, each overlapping the one before by ``OVERLAP``.
One layer at a time is held for each depth of nesting.  A secret or an encoding
that is longer than the overlap and lies across two windows is seen in parts.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._tokens import lean, trimmed

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_REPR = re.compile(_ESCAPE.pattern + r"""|\\[nrt\\'"]""")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Starts of gzip and zlib streams, whose bytes are characters below 256 or escaped as lone surrogates.
_MAGIC = re.compile(r"\x1f[\x8b\udc8b]\x08|x[\x01\x5e\x9c\udc9c\xda\udcda]")
_STREAM = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")
#: Base64 broken into lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[ \t]*+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]+={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
#: UTF-16 or UTF-32 text read as bytes.
_WIDE = re.compile(r"(?:[^\x00]\x00){6,}|(?:[^\x00]\x00{3}){6,}")
#: Bytes of an inflated layer at most, what the next one repeats of it, and what is inflated or fed at a time.
WINDOW, OVERLAP, _PIECE, _FEED = 4 << 20, 64 << 10, 1 << 20, 64 << 10


class Layer(NamedTuple):
    """A decoded text; character i comes from start[i]:end[i] of the original (None: from i:i+1)."""

    text: str
    start: np.ndarray | None
    end: np.ndarray | None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[a:b].max()))

    def at(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.text)
        return (np.arange(n), np.arange(1, n + 1)) if self.start is None else (self.start, self.end)

    def one_place(self) -> bool:
        """Whether all characters come from the same span."""
        return self.start is not None and self.start.strides == (0,)

    def key(self) -> bytes:
        """Of text and place: equal texts from other places are other layers."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for part in self.at():
            digest.update(part[:1].tobytes() + b"*" if self.one_place() else part.tobytes())
        return digest.digest()


def _from_one_place(text: str, start: int, end: int) -> Layer:
    return Layer(text, np.broadcast_to(np.int64(start), len(text)), np.broadcast_to(np.int64(end), len(text)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns: leftmost, not overlapping within a kind, too short ones dropped."""
    low = text.lower()
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if any(w in low for w in _WORDS) else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _spliced(layer: Layer, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with [a, b) replaced by a decoded string each, whose characters come from the spans low:high of the layer."""
    text, at = [], 0
    for a, b, new, *_ in parts:
        text += [layer.text[at:a], new]
        at = b
    whole = "".join([*text, layer.text[at:]])
    if layer.one_place():
        return _from_one_place(whole, int(layer.start[0]), int(layer.end[0]))
    start, end = layer.at()
    starts, ends, at = [], [], 0
    for a, b, _, low, high in parts:
        starts += [start[at:a], start[low]]
        ends += [end[at:a], end[np.asarray(high) - 1]]
        at = b
    return Layer(whole, np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]))


def _edges(text: str) -> np.ndarray:
    """Where the UTF-8 bytes of each character begin, and the end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    escaped = (code >= 0xDC80) & (code < 0xDD00)
    return np.cumsum(np.r_[0, np.where(escaped, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def _url(layer: Layer) -> Iterator[Layer]:
    parts = []
    for m in _PERCENT.finditer(layer.text) if "%" in layer.text else ():
        new = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        edges = m.start() + 3 * _edges(new)
        parts.append((m.start(), m.end(), new, edges[:-1], edges[1:]))
    if parts:
        yield _spliced(layer, parts)


def _unicode(layer: Layer) -> Iterator[Layer]:
    """Escaped characters; where bytes are escaped, also with the short escapes that stand among them."""
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    for pattern in (_ESCAPE, _REPR) if "\\x" in layer.text else (_ESCAPE,):
        yield from _unescaped(layer, pattern)


def _unescaped(layer: Layer, pattern: re.Pattern[str]) -> Iterator[Layer]:
    parts = []
    for m in pattern.finditer(layer.text):
        s = m[0]
        if s.startswith("\\u"):
            units = [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)]
            new, low, high, i = [], [], [], 0
            while i < len(units):
                pair = i + 1 < len(units) and 0xD800 <= units[i] < 0xDC00 <= units[i + 1] < 0xE000
                code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
                new.append("�" if 0xD800 <= code < 0xE000 else chr(code))
                low.append(m.start() + 6 * i), high.append(m.start() + 6 * (i + 1 + pair))
                i += 1 + pair
            parts.append((m.start(), m.end(), "".join(new), low, high))
        elif len(s) == 2:
            parts.append((m.start(), m.end(), {"n": "\n", "r": "\r", "t": "\t"}.get(s[1], s[1]), [m.start()], [m.end()]))
        else:
            code = int(s[3:-1], 16) if s[:3] in ("&#x", "&#X") else int(s[2:-1]) if s[0] == "&" else int(s[2:], 16)
            if code < 0x110000 and not 0xD800 <= code < 0xE000:
                parts.append((m.start(), m.end(), chr(code), [m.start()], [m.end()]))
    if parts:
        yield _spliced(layer, parts)


def _inflate(raw: memoryview) -> Generator[bytes, None, tuple[int, bool] | None]:
    """What the gzip or zlib stream at the start of ``raw`` holds over all its members, in pieces.

    Returns its length and whether it ends; None if it is none.
    """
    begin = 0
    while True:
        stream, at = zlib.decompressobj(47), begin
        try:
            while at < len(raw) and not stream.eof:
                data = raw[at : at + _FEED]
                at += len(data)
                while True:
                    yield (piece := stream.decompress(data, _PIECE))
                    data = stream.unconsumed_tail
                    if stream.eof or (not data and len(piece) < _PIECE):
                        break
        except zlib.error:
            return (begin, True) if begin else None
        if not stream.eof:
            return len(raw), False
        begin = at - len(stream.unused_data)
        if not _STREAM.match(raw, begin):
            return begin, True


def _extent(raw: memoryview) -> tuple[int, bool] | None:
    pieces = _inflate(raw)
    while True:
        try:
            next(pieces)
        except StopIteration as end:
            return end.value


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= WINDOW:
            whole = b"".join(held)
            yield whole
            held, size = [whole[-OVERLAP:]], OVERLAP
    yield b"".join(held)


def _compressed(layer: Layer) -> Iterator[Layer]:
    """Each gzip or zlib stream in the layer, whose bytes are its characters or their UTF-8."""
    if ("\x1f" not in layer.text and "x" not in layer.text) or not _MAGIC.search(layer.text):
        return
    code = np.frombuffer(layer.text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((code >= 0xDC80) & (code < 0xDD00), code - 0xDC00, code)
    views = {np.where(code < 256, code, 63).astype(np.uint8).tobytes(): None}
    views.setdefault(layer.text.encode("utf-8", "surrogateescape"), _edges(layer.text))
    for raw, edges in views.items():
        view = memoryview(raw)
        at = 0
        while m := _STREAM.search(raw, at):
            at = m.start() + 1
            if (got := _extent(view[m.start() :])) is None:
                continue
            end = m.start() + got[0]
            if got[1]:
                at = end
            a, b = (m.start(), end) if edges is None else (int(np.searchsorted(edges, m.start(), "right")) - 1, int(np.searchsorted(edges, end)))
            span, met = layer.span(a, b), set()
            for window in _windows(_inflate(view[m.start() :])):
                if (key := hashlib.blake2b(window, digest_size=16).digest()) in met:
                    continue
                met.add(key)
                if _leads(new := window.decode("utf-8", "surrogateescape")):
                    yield _from_one_place(new, *span)


def _wide(layer: Layer) -> Iterator[Layer]:
    """UTF-16 and UTF-32 without the zero bytes."""
    parts = []
    for m in _WIDE.finditer(layer.text) if "\x00" in layer.text else ():
        low = m.start() + np.flatnonzero(np.frombuffer(m[0].encode("utf-32-le", "surrogatepass"), np.uint32))
        parts.append((m.start(), m.end(), m[0].replace("\x00", ""), low, np.r_[low[1:], m.end()]))
    if parts:
        yield _spliced(layer, parts)


def _lines(layer: Layer) -> Iterator[Layer]:
    """Base64 without its line breaks."""
    parts = [(m.start() + b.start(), m.start() + b.end(), "", np.zeros(0, np.int64), np.zeros(0, np.int64)) for m in _WRAPPED.finditer(layer.text) for b in _BREAK.finditer(m[0])]
    if parts:
        yield _spliced(layer, parts)


#: A character that each kind of encoding needs, which is found much faster.
_SIGNS = (("%", _PERCENT), ("\\", _ESCAPE), ("&", _ESCAPE), ("\x1f", _MAGIC), ("x", _MAGIC), ("\x00", _WIDE))


def _leads(text: str) -> bool:
    """Whether a text has a secret or anything to unwrap."""
    return any(sign in text and p.search(text) for sign, p in _SIGNS) or bool(_BASE64.search(text)) or bool(base_spans(text))


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs decoded from each of the 4 alignments, as a path or a word can be glued to their front."""
    for m in _BASE64.finditer(layer.text):
        run = m[0].rstrip("=").translate({45: 43, 95: 47})
        for skip in range(4):
            body = run[skip:]
            if len(body) % 4 == 1:
                body = body[:-1]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            new = raw.decode("utf-8", "surrogateescape")
            if not _leads(new):
                continue
            at, edges = m.start() + skip, _edges(new)
            low, high = at + edges[:-1] * 4 // 3, np.minimum(at - (-edges[1:] * 4 // 3), at + len(body))
            high[-1] = m.end()  # with the padding
            if layer.one_place():
                yield _from_one_place(new, int(layer.start[0]), int(layer.end[0]))
            else:
                start, end = layer.at()
                yield Layer(new, start[low], end[high - 1])


def _below(layer: Layer) -> Iterator[Layer]:
    for unwrap in (_url, _unicode, _lines, _base64, _compressed, _wide):
        yield from unwrap(layer)


def all_spans(text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns in the text and in every layer below it, in order."""
    found = set(base_spans(text) if base is None else base)
    seen: set[bytes] = set()
    work = [_below(Layer(text, None, None))]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            found.update((kind, *layer.span(a, b)) for kind, a, b in base_spans(layer.text))
            work.append(_below(layer))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with the union of the spans replaced by a mark each."""
    out, at = [], 0
    for a, b in _union(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, by start, then kind as in KINDS.

    A null text is empty and has no spans.  One row per input row; other
    columns are not read.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()

        def rows(spans):
            return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

        for batch in batches:
            base, every = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                own = sorted(base_spans(text), key=lambda s: (s[1], KINDS.index(s[0])))
                base.append(rows(own))
                every.append(rows(all_spans(text, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, base {kind}, spans {kind}")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that :func:`scan_secrets` reports replaced by ``mark`` in the text; null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        lean()
        out = pa.array((None if (t := x.as_py()) is None else redacted(t, all_spans(t), mark) for x in texts), pa.string())
        trimmed()
        return out

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
