"""Secret scans with a worklist of decoded layers.

The whole text is the first layer. From each layer come new ones, until none is new: the layer with its URL or Unicode
escapes replaced, and what each base64 or hexadecimal run (over line breaks, from each alignment) holds, decompressed if it is a compressed stream. Every layer
is scanned with the same patterns, whatever else it holds (bytes that are no UTF-8 or UTF-16 are replaced), and a find is mapped back to the characters of the original text it came from. A
layer is worked on once (cycle detection by its text and place); layers without a find or a further encoding end there.

Kinds: `assign`, `access` and `hex` are finds in the text itself. Finds in decoded layers are named by the way to them,
such as `url/assign` or `base64/gzip/access`, and counted in n_decoded, not with the base kinds.

Compressed streams are read to the end, all members and all compressed layers in them. More than `most_bytes` of content
are scanned in pieces that overlap, so that a stream cannot exhaust the memory of a task; n_cut counts such streams. A
run of base64 or hexadecimal digits goes on in the next piece, up to four pieces long. Layers of any depth are unpacked one
after the other, without recursion; behind 20,000 compressed layers within each other, or 50 that are each longer than a
piece, what is left is scanned as it is and counts in n_cut too. Ties: of two ways to a find the shorter names it, then the
smaller by name. A null id is passed through; an empty table has no rows.
Null or empty text: no spans. Repeated rows each get their row. Other columns are ignored (`redact` hands them on).
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqdrift.llm.base import frugal

# The base patterns and the least lengths of what they find
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so short ones need no look

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
# a run goes on after a line break, as long as its lines are long enough for a run
BREAK = r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK}[A-Za-z0-9+/_-]{{16,}}+)*+(?:{BREAK}[A-Za-z0-9+/_-]++)?={{0,2}}")
HEX_BYTES = re.compile(rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{24,}}+(?:{BREAK}[0-9a-fA-F]{{24,}}+)*+(?:{BREAK}[0-9a-fA-F]++)?")
BROKEN = re.compile(BREAK)
# how compressed streams begin that stand behind something else
WITHIN = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\0|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
MOST_BYTES = 1 << 24
STEP = 1 << 18  # bytes of a stream at a time
OVERLAP = 1 << 12  # bytes that two pieces of a stream share at least
LAYERS = 20_000  # compressed layers within each other
STREAMS = 50  # of these, more than a piece long
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\\r\n"


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Layer(NamedTuple):
    text: str
    way: tuple[str, ...]
    starts: np.ndarray | int  # of each character, where it came from in the original; one number: the whole layer did
    ends: np.ndarray | int

    def place(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[a]), int(self.ends[b - 1])


def base_spans(text: str) -> list[Span]:
    found = [Span(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [Span(*m.span(), "hex") for m in HEX.finditer(text)]


def texts_of(raw: bytes) -> list[str]:
    """What bytes say as UTF-8, and as UTF-16 if there are zeros or a mark; bytes that say nothing are replaced."""
    out = [raw.decode("utf-8", "replace")]
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or b"\0" in raw:
        out += [raw.decode(kind, "replace") for kind in ("utf-16-le", "utf-16-be")]
    return out


def zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


PACKED = {
    "gzip": (b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    "zlib": (b"\x78", zlib.decompressobj),
    "bzip2": (b"BZh", bz2.BZ2Decompressor),
    "xz": (b"\xfd7zXZ", lzma.LZMADecompressor),
    "zstd": (b"\x28\xb5\x2f\xfd", zstd),
}


BROKEN_STREAM = b"\0broken"  # in place of what follows a fault


def packing(head: bytes) -> str | None:
    return next((name for name, (magic, _) in PACKED.items() if head.startswith(magic)), None)


class Feed:
    """Chunks of a stream, at most STEP bytes at a time, with a place for what was read too far."""

    def __init__(self, source: Iterator[bytes]) -> None:
        self.source, self.back, self.taken = source, b"", 0

    @classmethod
    def of(cls, raw: bytes, begin: int = 0) -> Feed:
        return cls(raw[i : i + STEP] for i in range(begin, len(raw), STEP))

    def __iter__(self) -> Feed:
        return self

    def __next__(self) -> bytes:
        chunk, self.back = self.back, b""
        chunk = chunk or next(self.source)
        self.taken += len(chunk)
        return chunk

    def push(self, *chunks: bytes) -> None:
        """What was taken comes again."""
        again = b"".join(chunks)
        self.back = again + self.back
        self.taken -= len(again)

    def head(self) -> bytes:
        """The first bytes, which stay in the stream."""
        parts = []
        while sum(map(len, parts)) < 8 and (chunk := next(self, None)) is not None:
            parts.append(chunk)
        self.push(*parts)
        return self.back[:8]


def member(name: str, source: Feed, rest: list[bytes], most: int) -> Iterator[bytes]:
    """Content of the first member of a stream, in chunks; `rest` gets what was read beyond it, or all if nothing came out."""
    work, eaten, some = PACKED[name][1](), [], False
    for chunk in source:
        if not some:
            eaten.append(chunk)
        at = 0
        while at < len(chunk) and not work.eof:
            piece = chunk[at : at + (64 if name == "zstd" else STEP)]  # a few bytes of zstd can hold much, and it has no other limit
            at += len(piece)
            while True:
                try:
                    out = work.decompress(piece) if name == "zstd" else work.decompress(piece, min(most, STEP))
                except Exception as e:
                    if isinstance(e, MemoryError):
                        raise
                    rest += [BROKEN_STREAM] if some else eaten
                    return
                if out:
                    some = True
                    yield out
                piece = work.unconsumed_tail if name in ("gzip", "zlib") else b""
                if work.eof or not (piece or name in ("bzip2", "xz") and not work.needs_input):
                    break
        if work.eof:
            rest += [work.unused_data, chunk[at:]]
            return
    if not some and not work.eof:
        rest += eaten


def following(source: Feed, rest: list[bytes], most: int) -> Iterator[bytes]:
    """Content of the members that follow the first one, and of what follows them. `rest`: as `member` left it."""
    if BROKEN_STREAM in rest:
        return
    source.push(b"".join(rest).lstrip(b"\0"))
    while name := packing(source.head()):
        before, own = source.taken, []
        yield from member(name, source, own, most)
        if BROKEN_STREAM in own:
            rest.append(BROKEN_STREAM)
            return
        source.push(b"".join(own).lstrip(b"\0"))
        if source.taken == before:  # not compressed after all
            break
    yield from source


def contents(raw: bytes, most: int, within: int = 0) -> Iterator[tuple[tuple[str, ...], bytes, bool]]:
    """The way to what is in `raw` through all compressed layers, its pieces, and whether a second piece begins.

    A layer of at most `most` bytes is read whole before the next one is opened, so that any number of layers take the memory
    of two. Larger ones are open together; behind STREAMS of these, or LAYERS of any size, a layer is content as it is, and
    counts as cut. A faulty stream is also content itself. From a place within `raw` on, only compressed streams count."""
    way, faults, deep, streams = [], [], False, 0
    source = Feed.of(raw, within)
    seen = set() if within else {hashlib.sha256(raw).digest()}
    while name := packing(source.head()):
        if deep := streams == STREAMS or len(way) == LAYERS:
            break
        before, rest = source.taken, []
        inside = member(name, source, rest, most)
        if (first := next(inside, None)) is None:
            source.push(b"".join(rest).lstrip(b"\0"))
            if source.taken == before:  # not compressed after all
                break
            continue  # an empty member
        way.append(name)
        faults.append(rest)
        held, size = [first], len(first)
        for chunk in (more := itertools.chain(inside, following(source, rest, most))):
            held.append(chunk)
            size += len(chunk)
            if size > most:
                break
        if size > most:
            streams += 1
            source = Feed(itertools.chain(held, more))
            continue
        layer = b"".join(held)
        source = Feed.of(layer)
        if (mark := hashlib.sha256(layer).digest()) in seen:  # holds itself
            break
        seen.add(mark)
    if within and not way:
        return
    ways = tuple(way)
    parts, size, kept, n = [], 0, 0, 0
    for chunk in source:
        parts.append(chunk)
        size += len(chunk)
        if size - kept >= most:
            piece = b"".join(parts)
            n += 1
            yield ways, piece, n == 2
            parts = [tail(piece, most)]
            size = kept = len(parts[0])
    if size > kept:
        yield ways, b"".join(parts), n == 1 or deep and n == 0
    if way and not within and any(BROKEN_STREAM in rest for rest in faults):
        yield (), raw, False


def tail(piece: bytes, most: int) -> bytes:
    """What the next piece of a stream begins with: an overlap, or the run that reaches its end; a run of four pieces is cut."""
    begin = max(0, len(piece) - OVERLAP)
    run = len(piece) - len(piece.rstrip(RUN))
    if len(piece) - begin < run + OVERLAP <= 4 * most:
        begin = max(0, len(piece) - run - OVERLAP)
    return piece[begin - begin % 2 :]


def replaced(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match decoded in place; None if nothing changes."""
    parts, starts, ends, at = [], [], [], 0
    whole = isinstance(layer.starts, int)

    def keep(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if not whole:
            starts.append(layer.starts[a:b])
            ends.append(layer.ends[a:b])

    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        keep(at, m.start())
        parts.append(new)
        if not whole:
            a, b = layer.place(*m.span())
            starts.append(np.full(len(new), a))
            ends.append(np.full(len(new), b))
        at = m.end()
    if not at:
        return None
    keep(at, len(layer.text))
    way = (*layer.way, name)
    return Layer("".join(parts), way, layer.starts, layer.ends) if whole else Layer("".join(parts), way, np.concatenate(starts), np.concatenate(ends))


def from_url(run: str) -> str:
    return unquote_to_bytes(run).decode("utf-8", "replace")


def from_unicode(run: str) -> str:
    raw = "".join(chr(min(int(a or b or c, 16), 0x10FFFF)) for a, b, c in ESCAPE.findall(run))
    return raw.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def inner(layer: Layer, most: int) -> Iterator[tuple[Layer, bool]]:
    """The layers directly below, and whether one was cut."""
    text = layer.text
    if "%" in text and (new := replaced(layer, "url", URL, from_url)):
        yield new, False
    if "\\" in text and (new := replaced(layer, "unicode", UNICODE, from_unicode)):
        yield new, False
    runs = [("base64", m) for m in BASE64.finditer(text)] + [("hex", m) for m in HEX_BYTES.finditer(text)]
    for name, a, b in ((name, a, b) for name, m in runs for a, b in whole_and_lines(m)):
        place, opened = layer.place(a, b), False
        for raw, within in decoded(name, BROKEN.sub("", text[a:b])):
            if within and opened:  # part of the stream that the run is
                continue
            for way, piece, cut in contents(raw, most, within):
                opened = opened if within else bool(way)
                for i, content in enumerate(texts_of(piece)):
                    yield Layer(content, (*layer.way, name, *way), *place), cut and i == 0


def whole_and_lines(m: re.Match) -> list[tuple[int, int]]:
    """Where a run lies, and where each of its lines does: they can be runs of their own."""
    breaks = [b.span() for b in BROKEN.finditer(m.string, *m.span())]
    lines = zip([m.start(), *[b for _, b in breaks]], [*[a for a, _ in breaks], m.end()], strict=True)
    return [m.span(), *[(a, b) for a, b in lines if breaks and b - a >= 16]]


def decoded(name: str, run: str) -> Iterator[tuple[bytes, int]]:
    """The bytes of a run from each alignment, 0 or where a compressed stream may begin in them."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/") if name == "base64" else run
    for begin in range(4 if name == "base64" else 2):
        if name == "base64":
            own = body[begin:]
            own = own[: len(own) - (len(own) % 4 == 1)]
            raw = base64.b64decode(own + "=" * (-len(own) % 4))
        else:
            raw = bytes.fromhex(body[begin : len(body) - (len(body) - begin) % 2])
        yield raw, 0
        for m in WITHIN.finditer(raw, 1):
            yield raw, m.start()


def scan(text: str, most: int = MOST_BYTES) -> tuple[list[Span], list[Span], int]:
    """Base spans, spans from decoded layers, and how many streams were cut."""
    base = sorted(base_spans(text), key=lambda s: (s.start, KINDS.index(s.kind)))
    n = len(text)
    first = Layer(text, (), np.arange(n), np.arange(1, n + 1))
    seen, more, n_cut = set(), set(), 0
    known = {(s.start, s.end, s.kind) for s in base}
    work = [inner(first, most)]  # layers are made when their turn comes, so few are in memory
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        below, cut = new
        n_cut += cut
        if not below.text:
            continue
        mark = (hashlib.sha256(below.text.encode("utf-8", "surrogatepass")).digest(), below.place(0, len(below.text)))
        if mark in seen:
            continue
        seen.add(mark)
        work.append(inner(below, most))
        for s in base_spans(below.text):
            a, b = below.place(s.start, s.end)
            # a find that no decoding touched was found in the text itself
            if (a, b, s.kind) not in known:
                more.add(Span(a, b, "/".join((*below.way, s.kind))))
    unique: dict[tuple[int, int, str], Span] = {}
    for s in sorted(more, key=lambda s: (s.kind.count("/"), s.kind)):  # the shortest way names a find
        unique.setdefault((s.start, s.end, s.kind.rpartition("/")[2]), s)
    return base, sorted(unique.values()), n_cut


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted([*base, *more], key=lambda s: (s.start, rank.get(s.kind, len(KINDS)), s.kind, s.end))


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded", "n_cut"]


def _scan(most: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                base, more, n_cut = scan(value.as_py() or "", most)
                each = [sum(s.kind == k for s in base) for k in KINDS]
                rows.append((*each, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(base, more)), len(more), n_cut))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], NAMES)

    return run


def find_secrets(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points), n_decoded, n_cut."""
    docs = docs.select("doc_id", "text")
    types = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_cut long"
    return docs.mapInArrow(_scan(most_bytes), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}")


def redacted(text: str, mask: str, most: int = MOST_BYTES) -> str:
    """The text with each stretch that spans cover replaced by the mask."""
    base, more, _ = scan(text, most)
    out, at = [], 0
    for s in all_spans(base, more):
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _redact(mask: str, most: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else redacted(v, mask, most) for v in batch.column("text").to_pylist()]
            i = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, batch.schema.types[i]) if j == i else c for j, c in enumerate(batch.columns)], batch.schema.names
            )

    return run


def redact(docs: DataFrame, mask: str = "[secret]", most_bytes: int = MOST_BYTES) -> DataFrame:
    """`docs` with all columns; spans in the text are replaced by the mask, other texts and null stay as they are."""
    return docs.mapInArrow(_redact(mask, most_bytes), docs.schema)
