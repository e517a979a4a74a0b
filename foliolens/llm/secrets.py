"""Secret scans over whole texts and everything encoded inside them.

Three kinds are sought: assignments, access keys and long hexadecimal runs. The text is the first entry of a
worklist. Each entry is scanned, then unwrapped: percent escapes, Unicode escapes and character references
make a new text each; each base64 run, wrapped at line ends or not, makes one of what it holds, unpacked if that is
compressed; a run that is no clean text makes one for each of the four places where a blob may begin. Bytes that are
no text are kept and scanned along with the rest. New entries are scanned
in turn, until nothing is left to unwrap. A digest of content and place keeps an entry from being worked twice,
and a content that occurs among its own wrappers ends that branch. Every character knows the span of the
original text that it came from, so a finding in any layer is reported as a span of the document.

Compressed layers are read to their end, all members of them, in windows of WINDOW bytes which overlap; a window
ends before an encoded run that goes on, unless that fills half a window. Such a run is never held whole: a window is cut inside it, and the
run is decoded as a stream, by each alignment and from each place where compressed data may begin, for which its
layer is unpacked anew from the start; what comes out is read in windows again. So a worker's memory doesn't grow with a layer, only
with the text itself. Bytes after the last member, or from where a member is damaged, are
scanned as they are. `n_cut` counts layers that are not read to their end: it is zero. Raw deflate, xz and other formats
are not unpacked.

Defined cases: a null text is an empty one; an empty text has no span; repeated rows get a row each; other
columns are ignored (`redact` passes them on); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliolens.llm.common import documents, id_text, per_batch, rows_to_batch, small_batches, texts_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_NAMES = re.compile(r"(?i:passw|secret|token|api)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Runs, and runs wrapped at line ends.
_BASE64 = (re.compile(r"[A-Za-z0-9+/]{16,}"), re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}+(?:\r?\n[A-Za-z0-9+/]++)+"))
_URLSAFE = (re.compile(r"[A-Za-z0-9_-]{16,}"), re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?:\r?\n[A-Za-z0-9_-]++)+"))
#: Where compressed data may begin in a run: gzip and bzip2 anywhere, zlib after a separator.
_HEADS = re.compile(r"H4sI|Qlpo|(?<![A-Za-z0-9])e[A-Za-z0-9]")
_BINARY = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: Bytes of a window, of the overlap of two, and taken in and given out by a decompressor at once.
WINDOW, OVERLAP, STEP = 4 << 20, 64 << 10, 64 << 10
#: Characters of which runs of encoded text consist.
_ENCODED = (string.ascii_letters + string.digits + "+/_=%\\&#;{}\r\n-").encode()

Span = tuple[int, int, int]  # start, kind's number, end: sorts as the contract lists


def scan(text: str) -> list[Span]:
    """The secrets of one layer. A match of an assignment that is too short still uses up its characters."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text, and for each of its characters the span of the original it came from (None: the original itself)."""

    __slots__ = ("begun", "high", "low", "more", "text", "within")

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None, within: frozenset = frozenset(), more: tuple | None = None, begun: bool = False):
        self.text, self.low, self.high, self.within = text, low, high, within
        #: For a window cut inside a run: what makes its layer's bytes anew, and where the window is in them; whether it begins inside one.
        self.more, self.begun = more, begun

    def of_one_place(self) -> bool:
        """Whether all characters came from the same span."""
        return self.low is not None and self.low.strides == (0,)

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start:end].min()), int(self.high[start:end].max()))

    def bounds(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            return np.arange(start, end), np.arange(start + 1, end + 1)
        return self.low[start:end], self.high[start:end]

    def key(self) -> bytes:
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        return digest.digest()

    def place(self) -> tuple[int, int]:
        return (0, -1) if self.low is None or not len(self.low) else (int(self.low[0]), int(self.high[-1]))


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """layer with each match replaced by its decoded text, or None if nothing decodes."""
    parts, low, high, at, changed = [], [], [], 0, False
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        changed = True
        for a, b in [layer.bounds(at, m.start())]:
            low.append(a)
            high.append(b)
        parts += [layer.text[at : m.start()], new]
        lo, hi = layer.origin(m.start(), m.end())
        low.append(np.full(len(new), lo))
        high.append(np.full(len(new), hi))
        at = m.end()
    if not changed:
        return None
    a, b = layer.bounds(at, len(layer.text))
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*low, a]), np.concatenate([*high, b]), layer.within)


def _percent(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8", "surrogateescape")


def _escape(s: str) -> str | None:
    try:
        if s[:2] == "&#":
            return chr(int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1]))
        if s[:3] == "\\u{":
            return chr(int(s[3:-1], 16))
        if s[:2] == "\\x":
            return chr(int(s[2:], 16))
        return bytes.fromhex(s.replace("\\u", "")).decode("utf-16-be", "surrogatepass")
    except (ValueError, OverflowError):
        return None


def _text(data: bytes) -> str | None:
    """data as clean UTF-8, or None."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or _BINARY.search(text) else text


def _read_text(data: bytes) -> str:
    """The text that _read gives."""
    even = len(data) & ~1
    for code, zeros in (("utf-16-le", data[1:even:2]), ("utf-16-be", data[0:even:2])):
        if 4 * zeros.count(0) > len(zeros):
            try:
                return data[:even].decode(code, "surrogatepass")
            except UnicodeDecodeError:
                continue
    return data.decode("utf-8", "surrogateescape")


def _read(data: bytes) -> tuple[str, np.ndarray]:
    """data as text, whatever it holds, and the bytes of each character: UTF-16 where zeros alternate, else UTF-8 with odd bytes kept."""
    even = len(data) & ~1
    for code, zeros in (("utf-16-le", data[1:even:2]), ("utf-16-be", data[0:even:2])):
        if 4 * zeros.count(0) > len(zeros):
            try:
                text = data[:even].decode(code, "surrogatepass")
            except UnicodeDecodeError:
                continue
            return text, np.fromiter((4 if c > "\uffff" else 2 for c in text), dtype=np.int64, count=len(text))
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text, np.ones(len(text), dtype=np.int64)
    return text, np.fromiter((len(c.encode("utf-8", "surrogateescape")) for c in text), dtype=np.int64, count=len(text))


def _stream(data: bytes):
    """A decompressor for what data begins with, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] == 0x78 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if data[:3] == b"BZh" else None


def _steps(stream, data: bytes, step: int, rest: list[bytes]) -> Iterator[bytes]:
    """What one member gives, at most step bytes at once; rest gets the bytes after it."""
    at, tail = 0, b""
    while not stream.eof:
        feed = tail
        if not tail and getattr(stream, "needs_input", True):
            feed = data[at : at + STEP]
            at += len(feed)
        new = stream.decompress(feed, step)
        tail = getattr(stream, "unconsumed_tail", b"")
        if new:
            yield new
        elif not feed and not stream.eof:
            break
    rest.append(stream.unused_data + data[at:] if stream.eof else b"")


def _members(data: bytes) -> Iterator[bytes]:
    """What the members of data give, and the bytes that are in none."""
    while (stream := _stream(data)) is not None:
        size, rest = 0, []
        try:
            for new in _steps(stream, data, STEP, rest):
                size += len(new)
                yield new
        except (zlib.error, OSError, EOFError):
            # A damaged member: the step that failed is done again byte by byte, for what comes out before the damage.
            try:
                done = 0
                for new in _again(data, size):
                    done += len(new)
                    yield new
            except (zlib.error, OSError, EOFError):
                pass
            if not size + done:
                break
            yield b"\n"
            break
        data = rest[0]
    if data:
        yield data


def _again(data: bytes, size: int) -> Iterator[bytes]:
    """What a member gives after its first size bytes, byte by byte."""
    stream, at, tail = _stream(data), 0, b""
    while not stream.eof:
        feed = tail
        if not tail and getattr(stream, "needs_input", True):
            feed = data[at : at + 1]
            at += 1
        new = stream.decompress(feed, min(size, STEP) or 1)
        tail = getattr(stream, "unconsumed_tail", b"")
        if size:
            size -= len(new)
        elif new:
            yield new
        if not new and not feed and at > len(data):
            break


def _members_in(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """As _members, of data that come in chunks."""
    data = b""
    while True:
        while len(data) < 3 and (chunk := next(chunks, None)) is not None:
            data += chunk
        if (stream := _stream(data)) is None:
            break
        size, tail = 0, b""
        try:
            while not stream.eof:
                feed = tail
                if not tail and getattr(stream, "needs_input", True):
                    data = data or next(chunks, b"")
                    feed, data = data[: STEP // 16], data[STEP // 16 :]
                new = stream.decompress(feed, STEP)
                tail = getattr(stream, "unconsumed_tail", b"")
                if new:
                    size += len(new)
                    yield new
                elif not feed and not stream.eof:
                    return
        except (zlib.error, OSError, EOFError):
            if size:
                yield b"\n"
                return
            break
        data = stream.unused_data + data
    if data:
        yield data
    yield from chunks


def _run_bytes(make, offset: int, urlsafe: bool, wrapped: bool) -> Iterator[bytes]:
    """What the base64 run holds that begins at an offset of a layer, whose bytes `make` gives anew."""
    letters = re.compile(rb"[A-Za-z0-9%s%s]*" % (b"_-" if urlsafe else b"+/", b"\r\n" if wrapped else b""))
    decode = base64.urlsafe_b64decode if urlsafe else base64.b64decode
    held = b""
    for part in make():
        if offset >= len(part):
            offset -= len(part)
            continue
        part, offset = part[offset:], 0
        end = letters.match(part).end()
        held += part[:end].translate(None, b"\r\n")
        cut = len(held) & ~3
        if cut:
            yield decode(held[:cut])
            held = held[cut:]
        if end < len(part):
            break
    if len(held) > 1:
        yield decode(held + b"=" * (-len(held) % 4))


def _inflated(data: bytes):
    """What makes the bytes that data holds compressed; None if it isn't compressed."""
    if _stream(data) is None:
        return None
    first = next(_members(data), None)
    return None if first is None or first is data else lambda: _members(data)


def _windows(make) -> Iterator[tuple[int, bytes, bool, bool]]:
    """Windows of a layer's bytes: where each begins, and whether it begins or ends inside a run. Each begins OVERLAP before the
    end of the last, and ends before a run that goes on, unless that fills half the window."""
    held, offset, begun = bytearray(), 0, False
    for part in make():
        held += part
        while len(held) >= WINDOW:
            cut = not held[WINDOW // 2 : WINDOW].translate(None, _ENCODED)
            end = WINDOW if cut else len(held[:WINDOW].rstrip(_ENCODED))
            yield offset, bytes(held[:end]), begun, cut
            step = max(1, end - OVERLAP)
            del held[:step]
            offset, begun = offset + step, cut
    yield offset, bytes(held), begun, False


def _layers(make, low: int, high: int, within: frozenset) -> Iterator[Layer]:
    """The windows of a layer's bytes as layers that came from one span."""
    known = set()
    for offset, data, begun, cut in _windows(make):
        if not cut or not any(h in data for h in (b"H4sI", b"Qlpo", b"e")):  # then equal windows hold equal things
            digest = hashlib.blake2b(data, digest_size=16, salt=bytes([begun, cut])).digest()
            if digest in known:
                continue
            known.add(digest)
        text = _read_text(data)
        yield Layer(text, np.broadcast_to(low, len(text)), np.broadcast_to(high, len(text)), within, (make, offset) if cut else None, begun)


def _streamed(layer: Layer, m: re.Match, urlsafe: bool, wrapped: bool) -> Iterator[Layer]:
    """What a run holds that goes on behind its window, or began before it, by streams."""
    make, offset = layer.more if layer.more else (None, 0)
    low, high = layer.origin(m.start(), m.end())
    if make is None:
        return
    at = offset + len(layer.text[: m.start()].encode("utf-8", "surrogateescape"))
    decode = base64.urlsafe_b64decode if urlsafe else base64.b64decode
    for h in _HEADS.finditer(m[0]):
        if _stream(decode(m[0][h.start() : h.start() + 4].translate({13: None, 10: None}).ljust(4, "A"))) is not None:
            yield from _layers(lambda k=h.start(): _members_in(_run_bytes(make, at + k, urlsafe, wrapped)), low, high, layer.within)
    if not (layer.begun and not m.start()):  # else the window in which the run began has read it
        for k in range(4):
            yield from _layers(lambda k=k: _run_bytes(make, at + k, urlsafe, wrapped), low, high, layer.within)


def _decoded(layer: Layer, run: str, at: np.ndarray, plus: bool) -> Iterator[Layer]:
    """What a base64 run holds, whose characters are at these places of layer. What comes before the blob may have
    joined the run: unless it decodes to clean text, all four alignments are read, and what may begin compressed data."""
    decode = base64.urlsafe_b64decode if plus else base64.b64decode

    def data_from(k: int) -> bytes:
        part = run[k:]
        part = part[:-1] if len(part) % 4 == 1 else part
        return decode(part + "=" * (-len(part) % 4))

    def laid(data: bytes, k: int) -> Layer:
        if layer.of_one_place():
            text = _read_text(data)
            return Layer(text, np.broadcast_to(layer.low[0], len(text)), np.broadcast_to(layer.high[0], len(text)), layer.within)
        text, size = _read(data)
        ends = np.cumsum(size)
        first, last = at[k + (ends - size) * 4 // 3], at[np.minimum(k - (-ends * 4 // 3), len(run)) - 1]
        if layer.low is None:
            return Layer(text, first, last + 1, layer.within)
        return Layer(text, layer.low[first], layer.high[last], layer.within)

    whole = data_from(0)
    if _text(whole):
        yield laid(whole, 0)
        return
    for k in sorted({0, *(m.start() for m in _HEADS.finditer(run))}):
        if _stream(decode(run[k : k + 4])) is not None and (make := _inflated(data_from(k))) is not None:
            yield from _layers(make, *layer.origin(int(at[k]), int(at[-1]) + 1), layer.within)
            if not k:
                return
    for k in range(4):
        yield laid(data_from(k) if k else whole, k)


def _unpacked(layer: Layer) -> Iterator[Layer]:
    """What the base64 runs of layer hold, each line of a wrapped one by itself too."""
    for patterns, plus in ((_BASE64, False), (_URLSAFE, True)):
        for pattern in patterns:
            for m in pattern.finditer(layer.text):
                run = m[0]
                if plus and "_" not in run and "-" not in run:
                    continue
                if layer.more and m.end() >= len(layer.text) - 2:
                    yield from _streamed(layer, m, plus, pattern is patterns[1])
                    continue
                at = np.arange(m.start(), m.end())
                if pattern is patterns[1]:
                    at = at[[c not in "\r\n" for c in run]]
                    run = run.replace("\r", "").replace("\n", "")
                yield from _decoded(layer, run, at, plus)


def _inner(layer: Layer) -> Iterator[Layer]:
    """What layer unwraps to, one at a time, so that a long layer is not held whole."""
    if "%" in layer.text and (x := _substituted(layer, _PERCENT, _percent)):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _substituted(layer, _UNICODE, _escape)):
        yield x
    yield from _unpacked(layer)


def find(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, layers read, layers cut (none)."""
    base = scan(text)
    spans, read, seen = set(base), 0, set()
    first = Layer(text)
    work = [(first.key(), first.within, _inner(first))]
    while work:
        own, within, inner = work[-1]
        layer = next(inner, None)
        if layer is None:
            work.pop()
            continue
        key = layer.key()
        if key == own or key in within or (key, layer.place()) in seen:
            continue
        seen.add((key, layer.place()))
        layer.within = within | {own}
        read += 1
        spans.update((a, k, b) for s, k, e in scan(layer.text) for a, b in [layer.origin(s, e)])
        work.append((key, layer.within, _inner(layer)))
    return base, sorted(spans), read, 0


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("n_cut", pa.int64())])


def _report(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for text in texts_of(batch.column("text")):
        base, spans, layers, cut = find(text)
        counts = [sum(k == n for _, k, _ in base) for n in range(3)]
        rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), layers, cut))
    return rows_to_batch(_REPORT, [batch.column("doc_id"), *zip(*rows, strict=True)])


def scan_documents(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return id_text(docs).mapInArrow(per_batch(_report), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_cut long")


def redacted(text: str, mark: str = "[secret]") -> str:
    """text with each stretch of overlapping spans replaced by a mark."""
    out, at, open_at, end = [], 0, None, 0
    for s, _, e in [*find(text)[1], (len(text) + 1, 0, 0)]:
        if open_at is not None and s >= end:
            out += [text[at:open_at], mark]
            at, open_at = end, None
        if open_at is None:
            open_at, end = s, e
        else:
            end = max(end, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets of each text replaced, and n_chars of changed texts set anew; other texts stay as they are."""
    small_batches(docs.sparkSession)
    where = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(where).to_pylist()
        new = [x if x is None else redacted(x) for x in old]
        columns = list(batch.columns)
        columns[where] = pa.array(new, type=pa.string())
        if count is not None:
            n = [c if a == b else len(b) for a, b, c in zip(old, new, batch.column(count).to_pylist(), strict=True)]
            columns[count] = pa.array(n, type=batch.column(count).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(per_batch(run), docs.schema)


def op4_recursive_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))
