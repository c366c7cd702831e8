"""Secret scans through nested encodings.

A text is scanned for three kinds of secrets. Then a worklist unwraps what is encoded in it: lines with URL
escapes or Unicode escapes and character references, base64 runs (also wrapped over lines), and compressed data in
either. Every layer is scanned again and unwrapped again until nothing new appears; a layer that was seen at the
same place is not taken up twice, so cycles end. Finds are mapped to places in the original text.
"""

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a compressed layer is held whole up to; a larger one is counted, and unwrapped and scanned piece by piece.
MOST_UNWRAPPED = 1 << 24
#: Bytes that are inflated at a time.
CHUNK = 1 << 16

# The patterns of secrets and the least length of what must be long enough.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE = 6

_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
# Tokens in which bytes may be escaped, and what stands for one byte in them.
_URL_TOKEN = re.compile(r"[!-~]+")
_URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.")
_HEX_TOKEN = re.compile(r"[ -~]+")
_HEX_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|.")
_HEX = re.compile(r"\\x[0-9A-Fa-f]{2}")
_SPACES = re.compile(r" *")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_SHORT = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
_MAGIC_INSIDE = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]1AY|\xfd7zXZ\x00")
_MAGIC = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of secrets that stand in the text itself; kind is an index of KINDS."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- layers -----------------------------------------------------------------------------------

def _readable(data: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 without control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\r\n" for c in text) else None


def _text(data: bytes) -> str:
    """The bytes as text: UTF-8, else one character a byte, which leaves what the patterns look for as it is."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _plain(data: bytes) -> bool:
    """Whether bytes are text by far the most part. They are scanned in any case; this tells if other readings are tried too."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("ascii", "replace").replace("\ufffd", "\0")
    return sum(c.isprintable() or c.isspace() for c in text) >= 0.85 * len(text)


class _Source:
    """Bytes to read from chunks; `taken` counts them."""

    def __init__(self, chunks):
        self.chunks, self.head, self.taken = iter(chunks), b"", 0

    def read(self, n: int = CHUNK) -> bytes:
        self.head = self.head or next(self.chunks, b"")
        out, self.head = self.head[:n], self.head[n:]
        self.taken += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.head = data + self.head
        self.taken -= len(data)

    def compressed(self) -> bool:
        while len(self.head) < 6 and (more := next(self.chunks, b"")):
            self.head += more
        return self.head.startswith(_MAGIC)


def _pieces(source: _Source):
    """Chunks of what compressed data holds, up to where it ends or breaks."""
    while source.compressed():  # members of a file follow each other
        head = source.head
        if head.startswith(b"\x28\xb5\x2f\xfd"):
            import zstandard
            reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
            try:
                while piece := reader.read(CHUNK):
                    yield piece
            except zstandard.ZstdError:
                pass
            return
        d = bz2.BZ2Decompressor() if head.startswith(b"BZh") else lzma.LZMADecompressor() if head.startswith(b"\xfd") else zlib.decompressobj(47)
        tail, full = b"", False
        try:
            while not d.eof:
                hungry = d.needs_input if hasattr(d, "needs_input") else not tail and not full
                data = source.read() if hungry else tail
                if hungry and not data:
                    return
                piece = d.decompress(data, CHUNK)
                tail, full = getattr(d, "unconsumed_tail", b""), len(piece) == CHUNK
                if piece:
                    yield piece
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            return
        source.back(d.unused_data)


def _opened(data: bytes, depth: int) -> _Source:
    """What is left when `depth` compressions are taken off."""
    source = _Source(data[i:i + CHUNK] for i in range(0, len(data), CHUNK))
    for _ in range(depth):
        source = _Source(_pieces(source))
    return source


def _cut(text: str) -> int:
    """The place behind the last line that no secret and no encoded run goes beyond, 0 if there is none."""
    at = len(text)
    while (at := text.rfind("\n", 0, at)) >= 0:
        if _NOT_BASE64.search(text[max(0, at - 41):at].rstrip("\r")[-40:]):
            return at + 1
    return 0


def _parts(data: bytes, start: int, end: int):
    """Layers of whole lines of what compressed data holds, which are never held together."""
    depth, heads = 1, set()
    while (source := _opened(data, depth)).compressed() and source.head not in heads and _opened(data, depth + 1).read():
        heads.add(source.head)
        depth += 1
    source, decoder, kept = _opened(data, depth), codecs.getincrementaldecoder("utf-8")("replace"), []
    while piece := source.read():
        text = decoder.decode(piece)
        at = _cut(text)
        kept.append(text[:at] if at else text)
        if at:
            yield "".join(kept), _Same(start), _Same(end)
            kept = [text[at:]]
    yield "".join(kept) + decoder.decode(b"", True), _Same(start), _Same(end)


class _Same:
    """The one place of all characters of a layer."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, _) -> int:
        return self.place


class _Layers:
    """The worklist of one text: layers, and generators of layers."""

    def __init__(self, text: str):
        self.work: list = [(text, None, None)]
        self.seen: set[bytes] = set()
        self.large = 0

    def next(self):
        """The next layer, None at the end of a generator."""
        layer = self.work.pop()
        if isinstance(layer, tuple):
            return layer
        found = next(layer, None)
        if found is not None:
            self.work.append(layer)
        return found

    def add(self, text: str, starts, ends) -> None:
        key = hashlib.sha1(f"{starts[0]}:{ends[-1]}:{text}".encode("utf-8", "surrogatepass")).digest()
        if key not in self.seen:
            self.seen.add(key)
            self.work.append((text, starts, ends))

    def add_whole(self, data: bytes, start: int, end) -> int:
        """Compressed data that stands for one place as a whole, up to `end` of its size: how many bytes it has, 0 if none."""
        size, known = 0, set()
        while data.startswith(_MAGIC) and (key := hashlib.sha1(data).digest()) not in known:
            known.add(key)
            source, out, total = _opened(data, 0), [], 0
            for piece in _pieces(source):
                total += len(piece)
                if total <= MOST_UNWRAPPED:
                    out.append(piece)
                else:
                    out.clear()
            if not total:
                break
            size = size or source.taken
            if total > MOST_UNWRAPPED:
                key = hashlib.sha1(b"%d:%d:%s" % (start, end(size), key)).digest()
                if key not in self.seen:
                    self.seen.add(key)
                    self.large += 1
                    self.work.append(_parts(data, start, end(size)))
                return size
            data = b"".join(out)
        if size and data:
            self.add(_text(data), _Same(start), _Same(end(size)))
        return size


def _utf16(units: list[int]) -> str:
    return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace")


def _unescaped(piece: str) -> str:
    """What a run of Unicode escapes, or one character reference, stands for."""
    if piece.startswith("&#"):
        code = int(piece[3:-1], 16) if piece[2] in "xX" else int(piece[2:-1])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if piece.startswith("\\u{") or piece.startswith("\\U"):
        code = int(piece.strip("\\uU{}"), 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    if piece.startswith("\\u"):
        return _utf16([int(piece[i + 2:i + 6], 16) for i in range(0, len(piece), 6)])
    data = bytes(int(piece[i + 2:i + 4], 16) for i in range(0, len(piece), 4))
    return data.decode("latin-1") if _readable(data) is None else data.decode("utf-8")


def _lines_with(text: str, pattern: re.Pattern):
    """(start, line) of lines in which the pattern is found."""
    at = 0
    while m := pattern.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield start, text[start:end]
        at = end


def _ahead(text: str, at: int, stop: int) -> tuple[int, int]:
    """The end of the word at a place, and of the second word after it."""
    ends = []
    for _ in range(3):
        found = text.find(" ", at, stop)
        ends.append(stop if found < 0 else found)
        if found < 0:
            break
        at = _SPACES.match(text, found).end()
    return ends[0], ends[-1]


def _back(text: str, at: int, stop: int) -> int:
    """The start of the second word before the word at a place."""
    for left in (2, 1, 0):
        at = text.rfind(" ", stop, at) + 1 or stop
        while left and at > stop and text[at - 1] == " ":
            at -= 1
    return at


def _stretches(text: str, pattern: re.Pattern):
    """(start, piece) of what surrounds the pattern within a line, as far as a secret can reach: two words and spaces either way."""
    before, line_end = 0, -1
    m = pattern.search(text)
    while m:
        start = _back(text, m.start(), max(text.rfind("\n", before, m.start()) + 1, before))
        if line_end < m.end():
            line_end = text.find("\n", m.end())
            line_end = len(text) if line_end < 0 else line_end
        word, end = _ahead(text, m.end(), line_end)
        before = m.end()
        while (m := pattern.search(text, before)) and m.start() < end:
            before = m.end()
            if before > word:
                word, end = _ahead(text, before, line_end)
        yield start, text[start:end]


def _replaced(layers: _Layers, line: str, base: int, starts, ends, pattern: re.Pattern, decode) -> None:
    """A layer of the line with every match decoded; `decode` gives (text, width of each character in the match)."""
    if isinstance(starts, _Same):
        layers.add(pattern.sub(lambda m: decode(m.group())[0], line), starts, ends)
        return
    out, s, e, at = [], array("q"), array("q"), 0
    first = (lambda i: base + i) if starts is None else (lambda i: starts[base + i])
    last = (lambda i: base + i + 1) if ends is None else (lambda i: ends[base + i])
    for m in pattern.finditer(line):
        for i in range(at, m.start()):
            s.append(first(i))
            e.append(last(i))
        out.append(line[at:m.start()])
        text, places = decode(m.group())
        out.append(text)
        for a, b in places:
            s.append(first(m.start() + a))
            e.append(last(m.start() + b - 1))
        at = m.end()
    out.append(line[at:])
    for i in range(at, len(line)):
        s.append(first(i))
        e.append(last(i))
    if s:
        layers.add("".join(out), s, e)


def _percent(piece: str) -> tuple[str, list[tuple[int, int]]]:
    data = bytes.fromhex(piece.replace("%", ""))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1"), [(3 * i, 3 * i + 3) for i in range(len(data))]
    places, at = [], 0
    for c in text:
        width = 3 * len(c.encode("utf-8"))
        places.append((at, at + width))
        at += width
    return text, places


def _byte(piece: str) -> int:
    """The byte that a character or an escape stands for."""
    if len(piece) == 1:
        return ord(piece)
    return int(piece[-2:], 16) if piece[1:2] == "x" or piece[0] == "%" else _SHORT[piece[1]]


def _rebuilt(layers: "_Layers", line: str, base: int, starts, ends, tokens: re.Pattern, piece: re.Pattern) -> None:
    """Compressed data in bytes that are partly escaped and partly stand as they are."""
    sign = "%" if tokens is _URL_TOKEN else "\\x"
    for token in tokens.finditer(line):
        if sign not in token.group():
            continue
        places = [m.start() for m in piece.finditer(line, token.start(), token.end())] + [token.end()]
        plain = bytes(_byte(line[a:b]) for a, b in zip(places, places[1:]))
        spaced = bytes(32 if line[a] == "+" else c for a, c in zip(places, plain)) if sign == "%" else plain
        for data in {plain, spaced}:  # a form writes a space as +
            at = 0
            while m := _MAGIC_INSIDE.search(data, at):
                first = base + places[m.start()]
                last = lambda size: base + places[m.start() + size] - 1  # noqa: B023, E731
                size = layers.add_whole(data[m.start():], first if starts is None else starts[first],
                                        lambda n: last(n) + 1 if ends is None else ends[last(n)])  # noqa: B023
                at = m.start() + max(size, 1)


def _references(piece: str) -> tuple[str, list[tuple[int, int]]]:
    text = _unescaped(piece)
    width = len(piece) // len(text) if text and len(piece) % len(text) == 0 else 0
    if width and len(text) > 1:
        return text, [(width * i, width * (i + 1)) for i in range(len(text))]
    return text, [(0, len(piece))] * len(text)


def _decoded64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _unwrap64(layers: _Layers, run: str, places: list[int], starts, ends) -> bool:
    """A layer of a base64 run whose characters stand at `places` of the layer; whether it is text or compressed data by all signs."""
    data = _decoded64(run)
    if data is None:
        return False
    first = (lambda i: places[i]) if starts is None else (lambda i: starts[places[i]])
    last = (lambda i: places[i] + 1) if ends is None else (lambda i: ends[places[i]])
    if size := layers.add_whole(data, first(0), lambda _: last(len(run) - 1)):
        if size < len(data):
            layers.add(_text(data[size:]), _Same(first(0)), _Same(last(len(run) - 1)))
        return True
    text = _text(data)
    if text and isinstance(starts, _Same):
        layers.add(text, starts, ends)
        return _plain(data)
    wide = len(text) < len(data)
    s, e, at = array("q"), array("q"), 0
    body = len(run.rstrip("="))
    for c in text:
        width = len(c.encode("utf-8")) if wide else 1
        s.append(first(at * 4 // 3))
        e.append(last(min(body - 1, (at + width) * 4 // 3 if (at + width) % 3 else (at + width) * 4 // 3 - 1)))
        at += width
    if text:
        layers.add(text, s, e)
    return _plain(data)


def scan(text: str) -> tuple[list[tuple], list[tuple], int]:
    """Base spans, all spans as (start, kind, end), and the number of layers that were too large to be held whole."""
    base = base_spans(text)
    spans, layers, top = set(base), _Layers(text), True
    while layers.work:
        found = layers.next()
        if found is None:
            continue
        layer, starts, ends = found
        if not top:
            spans.update((starts[s], k, ends[e - 1]) for s, k, e in base_spans(layer))
        top = False
        if "%" in layer:
            for at, piece in _stretches(layer, _ESCAPED):
                _replaced(layers, piece, at, starts, ends, _ESCAPED, _percent)
                _rebuilt(layers, piece, at, starts, ends, _URL_TOKEN, _URL_BYTE)
        if "\\" in layer or "&#" in layer:
            for at, piece in _stretches(layer, _UNICODE):
                _replaced(layers, piece, at, starts, ends, _UNICODE, _references)
        if "\\x" in layer:
            for at, line in _lines_with(layer, _HEX):
                _rebuilt(layers, line, at, starts, ends, _HEX_TOKEN, _HEX_BYTE)
        wrapped = []
        for m in _WRAPPED.finditer(layer) if "\n" in layer else ():
            places = [i for i in range(m.start(), m.end()) if not layer[i].isspace()]
            if _unwrap64(layers, "".join(layer[i] for i in places), places, starts, ends):
                wrapped.append((m.start(), m.end()))
        for m in _BASE64.finditer(layer):
            run = m.group()
            if any(a <= m.start() < b for a, b in wrapped):
                continue
            if not _unwrap64(layers, run, range(m.start(), m.end()), starts, ends):
                for part in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", run) if re.search(r"[/_+-]", run) else ():
                    at = m.start() + part.start()
                    _unwrap64(layers, part.group(), range(at, at + len(part.group())), starts, ends)
    return base, sorted(spans), layers.large


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def _scanned(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("n_skipped", pa.int64())])
    for batch in batches:
        spans, skipped = [], []
        for text in batch.column(1):
            base, found, n = scan(text.as_py() or "")
            own = set(base)
            spans.append([{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in own} for s, k, e in found])
            skipped.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), pa.array(skipped, pa.int64())], schema=schema)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, n_skipped) per row: finds by start, then kind, with their place in the text in code points.

    `base` marks finds in the text itself; the others come from a layer and cover what encodes them. A null text is
    empty. `n_skipped` counts layers beyond MOST_UNWRAPPED characters.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scanned, f"doc_id long, spans {SPANS}, n_skipped long")
