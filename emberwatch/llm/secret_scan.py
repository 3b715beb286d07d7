"""Secret scan over a text and every layer wrapped in it.

A worklist starts with the text. Each layer is scanned, then unwrapped: percent escapes, Unicode
and entity escapes (the layer as a whole, so that a name and its value stay side by side), base64
runs, and inside what those give gzip, zlib, bzip2 and xz streams. Each result is a new layer
whose every character knows the span of the original text that it came from, so whatever is found
in it maps back. A layer that was seen already, with the same content from the same place, is not
opened again; the list is done when no layer gives a new one.

Kinds and rules are those of ``PATTERNS``; a match that fails its length is dropped and not tried
again. Spans count code points, with the end exclusive.

A base64 run is decoded at all four alignments, as text may be glued to its front. Runs that only line
breaks separate are decoded each and joined, since lines may be one blob or several; a secret over
a line's end can so be listed whole and in part.

Compressed streams are found anywhere in decoded bytes and opened member by member, a damaged one
up to the damage. Bytes need not be clean: those that are no UTF-8 stand as U+FFFD, and UTF-16 is
read too. A stream's content is scanned whole, in pieces of ``MAX_BYTES`` that overlap by a quarter,
which is what bounds a task's memory; ``n_cut`` counts the streams that took more than one piece.
In those, a match or wrapped blob longer than the overlap (16 MB) may be seen in parts only.

Nulls and edges: a null text counts as empty. Other columns pass through untouched.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

#: Kind, pattern, the group whose length is tested, and that length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

MAX_BYTES = 64 << 20

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};|&(?:quot|apos|amp|lt|gt|equals|colon|lowbar);")
_ONE_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Runs that only line breaks separate.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+[\r\n][\x20\t\r\n]*+[A-Za-z0-9+/_-]++)++")
_BREAKS = re.compile(r"[\x20\t\r\n]+")
_HEADS = re.compile(rb"(?P<gzip>\x1f\x8b\x08[\x00-\x1f])|(?P<zlib>\x78[\x01\x5e\x9c\xda])|(?P<bzip2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<xz>\xfd7zXZ\x00)")
_OPENERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}

#: Characters of the shortest match, ``token=`` and six; bytes without so many of ASCII in a row hold none, in no layer.
LEAST = 12
_PLAIN = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")
_WIDE = re.compile(rb"((?:[\t\r\n\x20-\x7e]\x00){12,})|(?:\x00[\t\r\n\x20-\x7e]){12,}")
#: Bytes that are read and unpacked at a time.
CHUNK, STEP = 16 << 10, 1 << 20


@dataclass
class Layer:
    """A text and, by character, where in the original it came from (None: it is the original)."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None
    via: str

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The original span of characters ``start`` to ``end``."""
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def spots(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            return np.arange(start, end), np.arange(start + 1, end + 1)
        return self.starts[start:end], self.ends[start:end]


def _layer(text: str, spots: list[tuple[int, int]], via: str) -> Layer:
    starts, ends = np.array(spots, np.int64).reshape(-1, 2).T
    return Layer(text, starts, ends, via)


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of what the patterns find in one text."""
    low = text.lower()
    for kind, pattern, group, least in PATTERNS:
        if kind == "assign" and not any(name in low for name in _NAMES):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _same(spot: int, n: int) -> np.ndarray:
    """``n`` times one origin, without the memory."""
    return np.broadcast_to(np.int64(spot), n)


def _utf8(data: bytes, starts: np.ndarray, ends: np.ndarray, via: str) -> Layer:
    """Bytes, each with its origin, as UTF-8; a byte that is none becomes one U+FFFD."""
    codes = np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")
    bad = (codes >= 0xD800) & (codes < 0xE000)
    size = np.where(bad, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    text = np.where(bad, 0xFFFD, codes).astype("<u4").tobytes().decode("utf-32-le")
    if starts.strides == (0,):
        return Layer(text, _same(starts[0], len(text)), _same(ends[0], len(text)), via)
    last = np.cumsum(size)
    return Layer(text, starts[last - size], ends[last - 1], via)


def _utf16(data: bytes, starts: np.ndarray, ends: np.ndarray, order: str, at: int, via: str) -> Layer:
    """The same as UTF-16 from byte ``at`` on, a character a unit."""
    units = np.frombuffer(data, f"{order}u2", (len(data) - at) // 2, at).astype("<u4")
    text = np.where((units >= 0xD800) & (units < 0xE000), 0xFFFD, units).astype("<u4").tobytes().decode("utf-32-le")
    end = at + 2 * len(units)
    return Layer(text, starts[at:end:2], ends[at + 1 : end : 2], via)


def _wide(data: bytes, starts: np.ndarray, ends: np.ndarray, via: str) -> Iterator[tuple[Layer, int]]:
    """The UTF-16 texts in bytes."""
    if b"\0" in data:
        for order, at in sorted({("<" if m.group(1) else ">", m.start() % 2) for m in _WIDE.finditer(data)}):
            yield _utf16(data, starts, ends, order, at, via), 0


def _texts(data: bytes, starts: np.ndarray, ends: np.ndarray, via: str) -> Iterator[tuple[Layer, int]]:
    """The texts that bytes may be, where they are long enough to hold a match."""
    if _PLAIN.search(data):
        yield _utf8(data, starts, ends, via), 0
    yield from _wide(data, starts, ends, via)


def _head(data: bytes) -> str | None:
    """The name of the compressed stream that begins like this."""
    m = _HEADS.match(data)
    return m and m.lastgroup


def _sliced(data: bytes, start: int) -> Iterator[bytes]:
    return (data[i : i + CHUNK] for i in range(start, len(data), CHUNK))


def _members(source: Iterator[bytes], ends: list[int]) -> Iterator[bytes]:
    """What the members of a compressed stream hold, in steps, up to the first byte that belongs to none or is damaged.

    ``ends`` gets how many bytes of the source whole members take, and how many were read of all.
    """
    data, read = b"", 0
    while True:
        while len(data := data.lstrip(b"\0")) < 10 and (more := next(source, b"")):
            data, read = data + more, read + len(more)
        name = _head(data)
        if not name:
            ends[1] = ends[0]
            return
        stream = _OPENERS[name]()
        try:
            while not stream.eof:
                found = stream.decompress(data, STEP)
                data = stream.unused_data if stream.eof else getattr(stream, "unconsumed_tail", b"")
                if found:
                    yield found
                elif not stream.eof and not data:
                    data = next(source, b"")
                    read += len(data)
                    if not data:
                        ends[1] = read
                        return
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
            ends[1] = read
            return
        ends[0] = read - len(data)


def _pieces(steps: Iterator[bytes]) -> Iterator[bytes]:
    """Steps in pieces of about MAX_BYTES that overlap by a quarter, from a line's start where there is one."""
    piece, overlap, size = [], MAX_BYTES // 4, 0
    for step in steps:
        piece.append(step)
        size += len(step)
        while size > MAX_BYTES:
            whole = b"".join(piece)
            data, at = whole[:MAX_BYTES], MAX_BYTES - overlap
            yield data
            at = data.rfind(b"\n", at - overlap, at) + 1 or at
            piece, size = [whole[at:]], size - at
    if size:
        yield b"".join(piece)


def _streams(data: bytes, start: int) -> Iterator[tuple[str, bytes, bool]]:
    """What the stream at ``start`` holds, and the streams in it: their names, a piece, and whether it is a second one."""
    opened, known, names, head = lambda: _sliced(data, start), set(), "", data[start : start + 10]
    while name := _head(head):
        names = f"{names}>{name}"
        opened = lambda inner=opened: _members(inner(), [0, 0])
        n, first = 0, b""
        for n, piece in enumerate(_pieces(opened()), 1):
            first = first or piece
            yield names, piece, n == 2
        mark = hashlib.blake2b(first).digest()
        if mark in known:
            return
        known.add(mark)
        if n == 1:
            opened = lambda whole=first: _sliced(whole, 0)
        head = first[:10]


def _from_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray, via: str) -> Iterator[tuple[Layer | None, int]]:
    """Layers of the compressed streams that begin anywhere in bytes, each with 1 where a stream proves longer than a piece.

    What a compressed stream gives comes from the stream as a whole.
    """
    at = 0
    while m := _HEADS.search(data, at):
        at, size = m.start(), [0, 0]
        if any([bool(step) for step in _members(_sliced(data, at), size)]):
            begin, end = int(starts[at : at + size[1]].min()), int(ends[at : at + size[1]].max())
            for names, piece, cut in _streams(data, at):
                yield None, int(cut)
                yield from _texts(piece, _same(begin, len(piece)), _same(end, len(piece)), via + names)
        at += max(size[0], 1)


def _replaced(layer: Layer, runs: list[tuple[int, int, Layer]], via: str) -> Layer:
    """The layer with some runs replaced by what they stand for."""
    text, starts, ends, at = [], [], [], 0
    for start, end, inner in runs:
        before = layer.spots(at, start)
        text += [layer.text[at:start], inner.text]
        starts += [before[0], inner.starts]
        ends += [before[1], inner.ends]
        at = end
    rest = layer.spots(at, len(layer.text))
    starts, ends = np.concatenate([*starts, rest[0]]), np.concatenate([*ends, rest[1]])
    return Layer("".join([*text, layer.text[at:]]), starts, ends, f"{layer.via}>{via}")


def _percent(layer: Layer) -> Iterator[tuple[Layer | None, int]]:
    if "%" not in layer.text:
        return
    runs = []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m.group().replace("%", ""))
        starts, ends = layer.spots(m.start(), m.end())
        starts, ends, via = starts.reshape(-1, 3).min(axis=1), ends.reshape(-1, 3).max(axis=1), f"{layer.via}>url"
        inner = _utf8(data, starts, ends, via)
        if _head(data):
            # a name beside the run and the value in its stream stay side by side
            opened = next((new for new, _ in _from_bytes(data, starts, ends, via) if new), inner)
            inner = opened if len(opened.text) < MAX_BYTES else inner
        if len(data) >= LEAST:
            yield from _from_bytes(data, starts, ends, via)
            yield from _wide(data, starts, ends, via)
        runs.append((m.start(), m.end(), inner))
    if runs:
        yield _replaced(layer, runs, "url"), 0


def _escapes(layer: Layer) -> Iterator[tuple[Layer | None, int]]:
    if "\\" not in layer.text and "&" not in layer.text:
        return
    runs = []
    for m in _ESCAPE.finditer(layer.text):
        if m.group()[0] == "&":
            units = [(html.unescape(m.group()), m.start(), m.end())]
        else:
            units = []
            for one in _ONE_ESCAPE.finditer(m.group()):
                code, start, end = int(one.group(1), 16), m.start() + one.start(), m.start() + one.end()
                if units and 0xDC00 <= code < 0xE000 and len(units[-1][0]) == 1 and 0xD800 <= ord(units[-1][0]) < 0xDC00:
                    code = 0x10000 + ((ord(units[-1][0]) - 0xD800) << 10) + (code - 0xDC00)
                    start = units.pop()[1]
                units.append((chr(code) if code < 0x110000 else "�", start, end))
        text = "".join(c for c, _, _ in units)
        if len(text) != len(units) or any(0xD800 <= ord(c) < 0xE000 for c in text):
            continue
        runs.append((m.start(), m.end(), _layer(text, [layer.source(start, end) for _, start, end in units], layer.via)))
    if runs:
        yield _replaced(layer, runs, "unicode"), 0


def _decoded(run: str, starts: np.ndarray, ends: np.ndarray, via: str) -> Iterator[tuple[Layer | None, int]]:
    """Layers of a run of base64 that may begin at any of its first four characters."""
    run = run.translate({45: 43, 95: 47})
    for skip in range(4):
        n = len(run) - skip
        n -= n % 4 == 1
        data = base64.b64decode(run[skip : skip + n] + "=" * (-n % 4))
        if not (_PLAIN.search(data) or _HEADS.search(data) or _WIDE.search(data)):
            continue
        if starts.strides == (0,):
            first, last = _same(starts[0], len(data)), _same(ends[0], len(data))
        else:
            # byte i comes from the characters that hold its first and its last bit
            bits = np.arange(len(data)) * 8
            first, last = starts[skip + bits // 6], ends[skip + (bits + 7) // 6]
        yield from _from_bytes(data, first, last, via)
        yield from _texts(data, first, last, via)


def _base64(layer: Layer) -> Iterator[tuple[Layer | None, int]]:
    via = f"{layer.via}>base64"
    for m in _BASE64.finditer(layer.text):
        yield from _decoded(m.group(), *layer.spots(*m.span()), via)
    if "\n" not in layer.text and "\r" not in layer.text:
        return
    for m in _LINES.finditer(layer.text):
        run = _BREAKS.sub("", m.group())
        if len(run) < 16:
            continue
        starts, ends = layer.spots(*m.span())
        if starts.strides != (0,):
            own = np.frombuffer(m.group().encode(), np.uint8) > 0x20
            starts, ends = starts[own], ends[own]
        yield from _decoded(run, starts, ends, via)


def _inner(layer: Layer) -> Iterator[tuple[Layer | None, int]]:
    """What is wrapped in a layer, one after another, and 1 for a stream that is longer than a piece."""
    for unwrap in (_percent, _escapes, _base64):
        yield from unwrap(layer)


def scan(text: str) -> tuple[list[tuple[int, int, int, str]], int]:
    """(start, place of the kind in KINDS, end, via) of all spans in order, and how many streams were cut.

    ``via`` names the layers that a span was found through; it is empty for the text itself.
    """
    found: dict[tuple[int, int, int], str] = {}
    work, known, cut = [(Layer(text, None, None, ""), None)], set(), 0
    while work:
        layer, news = work.pop()
        if layer:
            for kind, start, end in matches(layer.text):
                start, end = layer.source(start, end)
                found.setdefault((start, KINDS.index(kind), end), layer.via.lstrip(">"))
            news = _inner(layer)
            del layer
        for new, more in news:
            cut += more
            if new is None:
                continue
            mark = (hashlib.blake2b(new.text.encode()).digest(), int(new.starts[0]), int(new.ends[-1]))
            if mark not in known:
                known.add(mark)
                # the rest comes after what is in this one, so that one piece a level is held
                work += [(None, news), (new, None)]
                break
    return sorted((*span, via) for span, via in found.items()), cut


_FOUND = "struct<spans:array<struct<start:bigint,kind:int,end:bigint,via:string>>,n_cut:bigint>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("via", pa.string())])


def secrets(text: Column) -> Column:
    """``spans`` (start, kind as a place in KINDS, end, via) in order, and ``n_cut``, of a text."""

    @F.arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        spans, cuts = [], []
        for t in texts:
            own, cut = scan(t.as_py() or "")
            spans.append([dict(zip(("start", "kind", "end", "via"), s, strict=True)) for s in own])
            cuts.append(cut)
        return pa.StructArray.from_arrays([pa.array(spans, pa.list_(_SPAN)), pa.array(cuts, pa.int64())], ["spans", "n_cut"])

    return found(text)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans, sorted by start, replaced; overlapping ones by one mark."""
    first = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        new = F.when(span["start"] < state["at"], state["done"]).otherwise(F.concat(state["done"], gap, F.lit(mark)))
        return F.struct(new.alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    rest = lambda state: F.concat(state["done"], F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text)))
    return F.aggregate(spans, first, step, rest)


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, ``spans`` and ``n_cut`` of each row of ``docs`` (doc_id, text)."""
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), secrets(F.col("text").cast("string")).alias("found"))
    return scanned.select("doc_id", "found.spans", "found.n_cut")


def summary(docs: DataFrame) -> DataFrame:
    """Counts and digests of ``found_in``; the base spans are those of the text itself."""
    kinds = F.array(*map(F.lit, KINDS))

    def listed(spans: Column) -> Column:
        name = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])
        return F.concat_ws(",", F.transform(spans, name))

    base = F.filter("spans", lambda s: s["via"] == "")
    of_kind = lambda n: F.size(F.filter(base, lambda s: s["kind"] == n)).cast("long")
    counts = [of_kind(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found_in(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_cut")
