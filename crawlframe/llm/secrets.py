"""Secret scans through nested encodings.

Every text is a layer on a worklist. A layer is scanned, then its encoded parts
(URL escapes, Unicode escapes, base64, compressed bytes) are decoded into new
layers, until nothing new comes up. A layer that was seen before at the same
place ends the chain, so encodings that reproduce each other stop. Every
character of a layer knows the span of the original text that it came from, so
findings at any depth are reported as spans of the original.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
# Patterns of the base scan; the lengths are checked after matching.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ that are long enough
ASSIGN_WORDS = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)

URL_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ESCAPES = re.compile(
    r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Lines that are full of it, as MIME and PEM write them, and a last one.
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,}+(?=[\x20\t]*\r?\n|=|$))*+"
    r"[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++={0,2}"
    r"|[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,}+(?=[\x20\t]*\r?\n|=|$))++={0,2})"
)
STANDARD = str.maketrans("-_", "+/")
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")
_GOOD = rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xf4][\x80-\xbf]{1,3}+)"
READABLE = re.compile(_GOOD + rb"{6,}+(?:[\x00-\xff]{1,2}?" + _GOOD + rb"{4,}+)*+")
URL_BYTES = re.compile(r"(?=%1[fF]%8[bB]%08|(?:x|%78)(?:%01|%5[eE]|%9[cC]|%[dD][aA])|(?:\(|%28)%[bB]5(?:/|%2[fF])%[fF][dD])(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
HEX_BYTES = re.compile(
    r"(?=\\x1[fF]\\x8[bB]\\(?:x08|b)|(?:x|\\x78)(?:\\x01|\^|\\x5[eE]|\\x9[cC]|\\x[dD][aA])|(?:\(|\\x28)\\x[bB]5(?:/|\\x2[fF])\\x[fF][dD])"
    r"(?:\\x[0-9A-Fa-f]{2}|\\[^x]|[\x20-\x5B\x5D-\x7E])+"
)
HEX_BYTE = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[\x00-\x7F]|.", re.DOTALL)
PLAIN_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
INFLATE = 1 << 20  # bytes at a time
OVERLAP = 1 << 16  # of the pieces of a large part


@dataclass(frozen=True)
class Limits:
    """``layer_bytes`` bounds what is held of one inflated part, so that a compression bomb cannot take the task.

    A part that inflates to more is scanned in overlapping pieces and counted in ``n_too_large``.
    """

    layer_bytes: int = 64 << 20


class Layer:
    """Decoded text with, for each character, the span of the original it stands for.

    ``start`` and ``end`` are None for the original text itself, and numbers where all characters share one span.
    """

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: list[int] | int | None = None, end: list[int] | int | None = None) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, first: int, last: int) -> tuple[int, int]:
        if self.start is None:
            return first, last
        if isinstance(self.start, int):
            return self.start, self.end
        return min(self.start[first:last]), max(self.end[first:last])


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain scan, leftmost and non-overlapping per kind."""
    found = []
    if ASSIGN_WORDS.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _stretches(raw: bytes) -> Iterator[tuple[int, str]]:
    """(first byte, text) of what reads as text, with some bytes in between that do not."""
    for m in READABLE.finditer(raw):
        yield m.start(), m.group().decode("utf-8", "surrogateescape")


def _inflated(raw: memoryview, limits: Limits) -> Iterator[bytes]:
    """The content of gzip, zlib or zstandard bytes at the start of ``raw``, all members, in overlapping pieces.

    What follows the last member does not matter. Damaged bytes give what comes before the damage.
    """
    piece, overlap = limits.layer_bytes, min(OVERLAP, limits.layer_bytes // 2)

    def blocks() -> Iterator[bytes]:
        rest = raw
        try:
            if rest[:4] == ZSTD:
                with zstandard.ZstdDecompressor().stream_reader(rest, read_across_frames=True) as reader:
                    while block := reader.read(INFLATE):
                        yield block
                return
            wbits = 31 if rest[:2] == GZIP else 15
            while len(rest) > 2:
                opened = zlib.decompressobj(wbits=wbits)
                given = rest
                while not opened.eof:
                    block = opened.decompress(given, INFLATE)
                    given = opened.unconsumed_tail
                    if block:
                        yield block
                    elif not given:
                        break
                rest = memoryview(opened.unused_data)
                if rest[:2] != GZIP or wbits != 31:
                    return
        except (zlib.error, zstandard.ZstdError):
            return

    held = bytearray()
    fresh = False
    for block in blocks():
        held += block
        fresh = True
        while len(held) > piece:
            yield bytes(held[:piece])
            del held[: piece - overlap]
    if fresh:
        yield bytes(held)


def _opened(raw: bytes, limits: Limits, large: list[int], seen: frozenset[bytes] = frozenset()) -> Iterator[tuple[int, str]]:
    """(first byte, text) of compressed bytes anywhere in ``raw``, through any number of compressions."""
    view, done = memoryview(raw), 0
    for m in PACKED.finditer(raw):
        if m.start() < done:
            continue
        for k, inner in enumerate(_inflated(view[m.start() :], limits)):
            if k == 1:
                large.append(m.start())
            mark = hashlib.blake2b(inner, digest_size=16).digest()
            if mark in seen:
                continue
            for _, text in _stretches(inner):
                yield m.start(), text
            for _, text in _opened(inner, limits, large, seen | {mark}):
                yield m.start(), text


def _unescaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The whole layer with the matches decoded; text between stays, so secrets may reach across."""
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    at, changed = 0, False

    def copy(until: int) -> None:
        for k in range(at, until):
            lo, hi = layer.span(k, k + 1)
            out.append(layer.text[k])
            start.append(lo)
            end.append(hi)

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        copy(m.start())
        lo, hi = layer.span(*m.span())
        out.append(got)
        start += [lo] * len(got)
        end += [hi] * len(got)
        at, changed = m.end(), True
    if not changed:
        return None
    copy(len(layer.text))
    return Layer("".join(out), start, end)


def _url(escapes: str) -> str:
    return bytes.fromhex(escapes.replace("%", "")).decode("utf-8", "surrogateescape")


def _unicode(escape: str) -> str | None:
    body = escape.strip("&#;{}\\").lstrip("uUxX{")
    code = int(body, 10 if escape.startswith("&#") and escape[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _runs(text: str) -> Iterator[tuple[str, list[int] | range, int]]:
    """(base64 characters, their places, end with padding) of runs in one line, and of runs over several."""
    for m in BASE64.finditer(text):
        yield m.group().rstrip("="), range(m.start(), m.end()), m.end()
    for m in WRAPPED.finditer(text):
        places = [k for k in range(*m.span()) if text[k] not in " \t\r\n="]
        yield "".join(text[k] for k in places), places, m.end()


def _parts(layer: Layer, limits: Limits, large: list[int]) -> Iterator[Layer]:
    """Layers inside base64 runs, unpacked if compressed.

    Every one of the four alignments of a run is decoded, since a run may start
    with characters that are not part of the code, as in a path.
    """
    for run, places, stop in _runs(layer.text):
        body = run.translate(STANDARD)
        for skip in range(4):
            size = (len(body) - skip) // 4 * 4 + ((len(body) - skip) % 4 if (len(body) - skip) % 4 != 1 else 0)
            if size < 8:
                continue
            raw = base64.b64decode(body[skip : skip + size] + "=" * (-size % 4))
            for at, text in _stretches(raw):  # three bytes stand in four characters
                starts, ends = [], []
                for c in text:
                    n = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode())
                    first, final = skip + at * 4 // 3, skip - (-(at + n) * 4 // 3) - 1
                    lo, hi = layer.span(places[first], places[final] + 1)
                    starts.append(lo)
                    ends.append(hi)
                    at += n
                yield Layer(text, starts, ends)
            for at, text in _opened(raw, limits, large):
                yield Layer(text, *layer.span(places[skip + at * 4 // 3], stop))


def _spelled(layer: Layer, limits: Limits, large: list[int]) -> Iterator[Layer]:
    """Layers inside compressed bytes that are written with URL or \\x escapes."""
    for pattern, token in ((URL_BYTES, URL_BYTE), (HEX_BYTES, HEX_BYTE)):
        if ("%" if pattern is URL_BYTES else "\\x") not in layer.text:
            continue
        for m in pattern.finditer(layer.text):
            raw, places, stop = bytearray(), [], m.end()
            before = layer.text[m.start() - 1 : m.start()]
            for one in token.finditer(layer.text, *m.span()):
                got = one.group()
                if got == before and got in ("'", '"'):  # a literal ends
                    stop = one.start()
                    break
                if len(got) > 2:
                    raw.append(int(got[-2:], 16))
                elif len(got) == 2:
                    raw.append(ord(PLAIN_ESCAPES.get(got[1], got[1])))
                else:
                    raw.append(ord(got))
                places.append(one.start())
            for at, text in _opened(bytes(raw), limits, large):
                yield Layer(text, *layer.span(places[at], stop))


def _inner(layer: Layer, limits: Limits, large: list[int]) -> Iterator[Layer]:
    if "%" in layer.text and (new := _unescaped(layer, URL_ESCAPES, _url)):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _unescaped(layer, UNICODE_ESCAPES, _unicode)):
        yield new
    yield from _spelled(layer, limits, large)
    yield from _parts(layer, limits, large)


def scan(text: str | None, limits: Limits = Limits()) -> tuple[list, list, int, int]:
    """Base findings, all findings, layers opened, parts that were scanned in pieces."""
    text = text or ""
    base = base_findings(text)
    found = set(base)
    # Depth first, so that one piece of a large part is held at a time.
    work, seen, layers, large = [iter([Layer(text)])], {hash((text, 0))}, 0, []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layers:
            mark = hash((layer.text, layer.span(0, 1)[0]))
            if mark in seen:
                continue
            seen.add(mark)
            found.update((kind, *layer.span(lo, hi)) for kind, lo, hi in base_findings(layer.text))
        layers += 1
        work.append(_inner(layer, limits, large))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return base, sorted(found, key=lambda f: (f[1], order[f[0]], f[2])), layers - 1, len(large)


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {kind: k for k, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda f: (f[1], order[f[0]], f[2])))


FOUND = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_too_large bigint"
)
FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per document: counts of the base findings, their digest, and all spans.

    A null text counts as empty. Repeated rows are scanned one by one. A finding
    at the same original span and of the same kind is listed once, whatever the
    number of layers that show it.
    """

    @F.arrow_udf(f"struct<{FOUND.replace(', ', ',').replace(' ', ':')}>")
    def scanned(texts: pa.Array) -> pa.Array:
        rows = []
        for one in texts.to_pylist():
            base, found, layers, too_large = scan(one, limits)
            counts = [sum(f[0] == kind for f in base) for kind in KINDS]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*counts, digest, joined(found), layers, too_large))
        columns = list(zip(*rows)) or [()] * len(FOUND_NAMES)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FOUND_NAMES)

    return docs.select(docs[key], scanned(docs[text]).alias("_s")).select(key, "_s.*")
