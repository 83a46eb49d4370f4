"""Secret scans of texts and of every layer that can be decoded from them."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#x([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: An escaped escape sign, escaped again and again: one layer takes the whole chain.
URL_CHAIN = re.compile(r"%25(?:25)+")
ESCAPE_CHAIN = re.compile(r"\\u005[cC](?:u005[cC])+|\\x5[cC](?:x5[cC])+|&#38;(?:#38;)+")
#: Compressed bodies are read by pieces, with so much of the piece before.
PIECE, BEFORE = 1 << 20, 1 << 12
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
KEYWORDS = ("passw", "secret", "token", "api")

Span = tuple[str, int, int]
ToParent = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> list[Span]:
    """Code point spans in one layer, leftmost and non-overlapping in each kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _readable(text: str) -> bool:
    return all(c.isprintable() or c in "\t\n\r" for c in text)


def _lenient(raw: bytes) -> str:
    """UTF-8; a byte that is none becomes a character of its own, so that every place is kept."""
    return raw.decode("utf-8", "surrogateescape")


def _pieces(raw: bytes, magic: bytes) -> Iterator[bytes]:
    """A compressed body, a bounded piece at a time, each with the end of the one before."""
    zipped = magic[:1] not in (b"B", b"\xfd")
    if zipped:
        opener = zlib.decompressobj(31 if magic[:1] == b"\x1f" else 15)
    else:
        opener = bz2.BZ2Decompressor() if magic[:1] == b"B" else lzma.LZMADecompressor()
    last, more = b"", raw
    try:
        while not opener.eof:
            piece = opener.decompress(more, PIECE)
            if not piece:
                return
            yield last + piece
            last = piece[-BEFORE:]
            more = opener.unconsumed_tail if zipped else b""
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return


def _inflated(raw: bytes, first: int | None = None, seen: set | None = None) -> Iterator[tuple[int, bytes]]:
    """What the gzip, zlib, bzip2 or xz bodies in some bytes hold, bodies in these included, and
    where the outermost body starts. No more than a piece of each is held."""
    seen = set() if seen is None else seen
    for m in MAGIC.finditer(raw):
        start = m.start() if first is None else first
        for inner in _pieces(memoryview(raw)[m.start() :], m[0]):
            one = start, _digest(inner)
            if one in seen:
                continue
            seen.add(one)
            yield start, inner
            yield from _inflated(inner, start, seen)


def _digest(x: bytes | str) -> bytes:
    raw = x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=16).digest()


def _mapped(pieces: list[tuple[str, int, int]]) -> tuple[str, ToParent]:
    """A text put together from (characters, start, end in the parent); a piece as long as what it
    stands for maps one to one, another one maps to all of it."""
    text = "".join(p[0] for p in pieces)
    ends, at = [], 0
    for p in pieces:
        at += len(p[0])
        ends.append(at)

    def place(i: int) -> tuple[int, int]:
        from bisect import bisect_right

        k = min(bisect_right(ends, i), len(ends) - 1)
        piece, a, b = pieces[k]
        if len(piece) == b - a:
            a += i - (ends[k] - len(piece))
            b = a + 1
        return a, b

    return text, lambda s, e: (place(s)[0], place(e - 1)[1])


def _url_layer(text: str) -> tuple[str, ToParent] | None:
    if "%" not in text:
        return None
    pieces, last = [], 0
    for m in re.finditer(r"%25(?:25)+|(?:%[0-9A-Fa-f]{2})+", text):
        if URL_CHAIN.fullmatch(m[0]):
            pieces += [(text[last : m.start()], last, m.start()), ("%", *m.span())]
            last = m.end()
            continue
        raw = bytes.fromhex(m[0].replace("%", ""))
        pieces.append((text[last : m.start()], last, m.start()))
        at = m.start()
        for c in raw.decode("utf-8", "replace"):
            width = 3 * (1 if c == "\ufffd" else len(c.encode("utf-8")))
            pieces.append((c, at, min(at + width, m.end())))
            at += width
        last = m.end()
    if not pieces:
        return None
    pieces.append((text[last:], last, len(text)))
    return _mapped([p for p in pieces if p[0]])


def _escape_layer(text: str) -> tuple[str, ToParent] | None:
    if "\\" not in text and "&#" not in text:
        return None
    pieces, last = [], 0
    for m in re.finditer(f"{ESCAPE_CHAIN.pattern}|{ESCAPE.pattern}", text):
        if ESCAPE_CHAIN.fullmatch(m[0]):
            pieces += [(text[last : m.start()], last, m.start()), ("&" if m[0][0] == "&" else "\\", *m.span())]
            last = m.end()
            continue
        braced, four, eight, two, dec, hexa = m.groups()
        code = int(dec) if dec else int(braced or four or eight or two or hexa, 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        pieces += [(text[last : m.start()], last, m.start()), (chr(code), *m.span())]
        last = m.end()
    if not pieces:
        return None
    pieces.append((text[last:], last, len(text)))
    return _mapped([p for p in pieces if p[0]])


def _runs(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Places of the characters of each base64 run, and of runs that go on over line ends; and
    where the run ends with its padding."""
    for m in BASE64.finditer(text):
        yield np.arange(m.start(), m.start() + len(m[0].rstrip("="))), m.end()
    yield from _wrapped(text)


def _wrapped(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Runs that go on over line ends: 16 characters or more at the end of a line, then lines of
    nothing else, the last one with padding at most. Each line is looked at once."""
    if "\n" not in text:
        return
    places: list[np.ndarray] = []
    at = end = 0
    while at <= len(text):
        stop = text.find("\n", at)
        line = text[at : stop if stop >= 0 else len(text)]
        content = (line[:-1] if stop >= 0 and line.endswith("\r") else line).rstrip(" \t")
        core = content.rstrip("=")
        run = len(core) - len(core.rstrip(LETTERS))
        lead = len(content) - len(content.lstrip(" \t"))
        padding = len(content) - len(core)
        if places and run and run == len(core) - lead and padding <= 2:
            places.append(np.arange(at + lead, at + len(core)))
            end = at + len(content)
            goes_on = not padding
        else:
            if len(places) > 1:
                yield np.concatenate(places), end
            places = []
            goes_on = run >= 16 and not padding
            if goes_on:
                places = [np.arange(at + len(core) - run, at + len(core))]
        if not goes_on or stop < 0:
            if len(places) > 1:
                yield np.concatenate(places), end
            places = []
        if stop < 0:
            return
        at = stop + 1


def _may_hold(text: str) -> bool:
    return bool(base_spans(text) or BASE64.search(text) or URL.search(text) or ESCAPE.search(text))


def _from_bytes(text: str, at: np.ndarray) -> ToParent:
    """Places of a text decoded from the base64 characters at ``at``."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    escaped = (code >= 0xD800) & (code < 0xE000)
    width = np.where(escaped, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
    upto = np.append(0, np.cumsum(width))
    return lambda s, e: (int(at[upto[s] * 4 // 3]), int(at[min(-(-upto[e] * 4 // 3), len(at)) - 1]) + 1)


def _base64_layers(text: str) -> Iterator[tuple[str, ToParent, bool]]:
    """Each run from each of its first four characters on (a start further on, as after a slash, is
    in step with one of these), and the compressed bodies in it."""
    for every, end in _runs(text):
        run = "".join(text[i] for i in every) if every[-1] - every[0] >= len(every) else text[every[0] : every[-1] + 1]
        run = run.replace("-", "+").replace("_", "/")
        for start in range(4):
            body = run[start : len(run) - ((len(run) - start) % 4 == 1)]
            at = every[start : start + len(body)]
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
            plain = _lenient(raw)
            plainly = _readable(plain)
            if plainly or _may_hold(plain):
                yield plain, _from_bytes(plain, at), plainly
            for first, inner in _inflated(raw):
                yield _lenient(inner), lambda s, e, a=int(at[first * 4 // 3]), b=end: (a, b), True


def _layers(text: str) -> Iterator[tuple[str, ToParent, bool]]:
    inner = ((*x, True) for x in (f(text) for f in (_url_layer, _escape_layer)) if x)
    return (x for x in chain(inner, _base64_layers(text)) if x[0] and x[0] != text)


def layered_spans(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and how many different layers were opened: whole readable texts, those
    under URL or Unicode escapes or a compression, and any other that holds a secret.

    Each layer is scanned, and so is what its URL, Unicode, base64 and compressed parts decode to;
    a chain of escaped escape signs is one layer. The spans of a layer are kept by the digest of its
    text, so that only the layers being opened are held, and every place where that text is decoded again gets
    them; only a layer inside itself is not opened.
    """
    base = base_spans(text)
    done: dict[bytes, set[Span]] = {}
    counted: set[bytes] = set()
    top = _digest(text)
    path = {top}
    work = [(top, _layers(text), set(base))]
    while work:
        layer, rest, found = work[-1]
        for decoded, to_layer, counts in rest:
            name = _digest(decoded)
            if counts:
                counted.add(name)
            if name in done:
                found.update((k, *to_layer(s, e)) for k, s, e in done[name])
            elif name not in path:
                path.add(name)
                work[-1] = (layer, chain([(decoded, to_layer, counts)], rest), found)
                work.append((name, _layers(decoded), set(base_spans(decoded))))
                break
        else:
            work.pop()
            path.discard(layer)
            done[layer] = found
    every = done.pop(top)
    counted.update(x for x, spans in done.items() if spans)
    return base, list(every), len(counted - {top})


def joined(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    ordered = sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    for b in batches:
        rows = []
        for text in b.column(1):
            base, every, layers = layered_spans(text.as_py() or "")
            n = [sum(k == x[0] for x in base) for k in KINDS]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*n, digest, joined(every), layers))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int32()]
        arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=[b.schema.names[0], *names])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of secrets in each whole text, nested layers included.

    Kinds: ``assign`` (a keyword, a sign and a value of 6 characters or more; the span is the
    whole match), ``access`` (``AKIA`` and upper case letters or digits, 20 or more), ``hex``
    (24 or more). Spans count code points, end exclusive; a secret found in a decoded layer has
    the span of the characters that it was decoded from (all of a compressed run), at every place
    where they stand, and counts once if a base span says the same. Base64 runs are decoded line by
    line and over line ends, so a secret over a line end has both its part's span and its own. Null is the empty text: no spans. Repeated rows are rows of
    their own, no rows give none, other columns are not read. No shuffle.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col], F.col(text_col).cast("string")).mapInArrow(
        _scan, f"`{id_col}` {kind}, {FIELDS}"
    )
