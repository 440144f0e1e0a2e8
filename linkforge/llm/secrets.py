"""Secret scans through nested encodings."""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import itertools
import lzma
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines: the rest of a line, then whole lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=={0,2}[\x20\t]*(?:\r?\n|\Z)))+={0,2}")
_GLUE = re.compile(r"[/_-]")
#: No secret, plain or encoded, is without this many ASCII characters in a row.
_PLAIN = re.compile(r"[\x20-\x7e]{12}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: How bzip2, xz and Zstandard streams begin, and what reads them.
_READERS = {b"BZh": bz2.BZ2File, b"\xfd7zXZ\x00": lzma.LZMAFile, b"\x28\xb5\x2f\xfd": lambda f: zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)}
_READ = re.compile(b"|".join(map(re.escape, _READERS)))
#: Bytes that a compressed layer unfolds to at a time, and how many of them the next piece repeats.
MOST_UNFOLDED, OVERLAP = 64_000_000, 1_000_000
#: Bytes of a possible raw layer that are tried first.
PROBE = 4096
#: Where each character of a layer stands in the text: first places, and places after the last.
Places = tuple[np.ndarray, np.ndarray]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in the text itself."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _text(data: bytes) -> tuple[str, bool]:
    """data as text, and whether it is UTF-8; a byte that is not stays as a lone surrogate.

    UTF-16 is told by its mark, or where a third of the even or of the odd bytes are zero.
    """
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace"), False
    if b"\0" in data:
        for at, code in ((1, "utf-16-le"), (0, "utf-16-be")):
            if 3 * data[at::2].count(0) > len(data[at::2]) and data[1 - at :: 2].count(0) * 9 < len(data):
                return data.decode(code, "replace"), False
    return data.decode("utf-8", "surrogateescape"), True


def _headed(data) -> bool:
    """Whether data begins as gzip or zlib do."""
    return len(data) > 2 and (bytes(data[:2]) == b"\x1f\x8b" or data[0] & 15 == 8 and data[0] < 128 and (data[0] * 256 + data[1]) % 31 == 0)


def _pieces(data, wbits: int):
    """What a compressed layer and the members after it unfold to, as far as it goes, in overlapping pieces.

    A raw layer (wbits < 0) has no header that tells it, so nothing comes of one that doesn't reach its end.
    """
    run, out, new = zlib.decompressobj(wbits), bytearray(), False
    while len(data):
        try:
            part = run.decompress(data, MOST_UNFOLDED - len(out))
        except zlib.error:
            if wbits < 0:
                return
            break
        out += part
        new = new or bool(part)
        if run.eof:
            data = run.unused_data
            if not _headed(data):
                break
            run, wbits = zlib.decompressobj(47), 47
        else:
            data = run.unconsumed_tail
            if wbits < 0 and not data:
                return
        if len(out) >= MOST_UNFOLDED:
            yield bytes(out)
            out, new = out[-OVERLAP:], False
    if new:
        yield bytes(out)


def _streamed(data: bytes, reader):
    """What a stream unfolds to, as far as it goes, in overlapping pieces."""
    out, new = bytearray(), False
    try:
        source = reader(io.BytesIO(data))
        while part := source.read(65_536):
            out += part
            new = True
            if len(out) >= MOST_UNFOLDED:
                yield bytes(out)
                out, new = out[-OVERLAP:], False
    except (OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        pass  # the rest is no stream, or is cut off
    if new:
        yield bytes(out)


def _raw(data) -> bool:
    """Whether data may be raw deflate, by its first bytes."""
    try:
        return len(zlib.decompressobj(-15).decompress(data[:PROBE], 2 * PROBE)) > 8
    except zlib.error:
        return False


def _unfolded(data: bytes, starts=(0,)):
    """What the compressed layers in data unfold to: at the starts, and wherever the usual headers stand."""
    view = memoryview(data)
    heads = {m.start() for m in _MAGIC.finditer(data)}
    for at in sorted(heads.union(starts)):
        if _headed(view[at:]):
            yield from _pieces(view[at:], 47)
        if at in starts and _raw(view[at:]):
            yield from _pieces(view[at:], -15)
    for m in _READ.finditer(data):
        yield from _streamed(data[m.start() :], _READERS[m[0]])


def _opened(data: bytes, starts=(0,)):
    """Texts under the compressed layers in decoded bytes, however many."""
    seen, work = set(), [_unfolded(data, starts)]
    while work:
        piece = next(work[-1], None)
        if piece is None:
            work.pop()
        elif (key := hashlib.blake2b(piece, digest_size=16).digest()) not in seen:
            seen.add(key)
            yield _text(piece)[0]
            work.append(_unfolded(piece))


def _character_layer(text: str, pattern: re.Pattern, decode) -> tuple[str, Places] | None:
    """The text with all matches decoded, and the places in ``text`` of each of its characters; None if nothing changes."""
    parts, first, last, at = [], array("q"), array("q"), 0

    def same(a: int, b: int) -> None:
        parts.append(text[a:b])
        first.extend(range(a, b))
        last.extend(range(a + 1, b + 1))

    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        same(at, m.start())
        parts.append(new[0])
        first.extend(m.start() + x for x in new[1][:-1])
        last.extend(m.start() + x for x in new[1][1:])
        at = m.end()
    if not at:
        return None
    same(at, len(text))
    return "".join(parts), (np.frombuffer(first, np.int64), np.frombuffer(last, np.int64))


def _percent(run: str):
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return text, np.append(0, np.cumsum(3 * _sizes(text))).tolist()


def _escape(one: str):
    code = int(one[2:].strip("{}"), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [0, len(one)]


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8; 1 of a lone surrogate, which stands for a byte."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    size[(code >= 0xD800) & (code < 0xE000)] = 1
    return size


def _placed(text: str, at: np.ndarray) -> Places:
    """For text decoded from the base64 characters at these places: the places of each character."""
    ends = np.cumsum(_sizes(text))
    return at[8 * np.append(0, ends[:-1]) // 6], at[(8 * ends - 1) // 6] + 1


def _whole(m: re.Match, inner: str) -> Places:
    """The place of the whole match for each character."""
    return np.broadcast_to(np.int64(m.start()), len(inner)), np.broadcast_to(np.int64(m.end()), len(inner))


def _base64_parts(text: str):
    """(places, decoded text) of the base64 in a text, compressed or not.

    A run is read at all four alignments, for it may be glued to a path or a word before it; lines of
    base64 are read one by one and as one run. Only what can hold a secret comes out. A run read from
    its start, and what a compressed layer holds, has the place of the whole run.
    """
    for m in itertools.chain(_BASE64.finditer(text), _WRAPPED.finditer(text)):
        body = m[0].rstrip("=")
        code = np.frombuffer(body.encode(), np.uint8)
        at = m.start() + np.flatnonzero((code != 32) & ((code < 9) | (code > 13)))
        body = "".join(body.split()).replace("-", "+").replace("_", "/")
        wrapped = len(body) < m.end() - m.start() - m[0].count("=")
        glued = [x.end() for x in _GLUE.finditer("".join(m[0].rstrip("=").split()))]
        for o in range(4):
            part = body[o : len(body) - ((len(body) - o) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            inner, by_byte = _text(data)
            if _PLAIN.search(inner):
                yield _placed(inner, at[o:]) if by_byte and (o or wrapped) else _whole(m, inner), inner
            for inner in _opened(data, {0}.union(i // 4 * 3 for i in glued if i % 4 == o)):
                if _PLAIN.search(inner):
                    yield _whole(m, inner), inner


def layers(text: str):
    """(layer text, places) of every layer under a text; places give each character's place in the text, None: itself.

    A worklist: each layer is searched for percent-encoded, Unicode-escaped and base64 parts, compressed
    ones included; what they decode to is a new layer, until nothing new turns up. A layer that was
    seen at the same place is not opened again, so cycles end.
    """
    work: list[tuple[str, Places | None]] = [(text, None)]
    seen = set()
    while work:
        layer, place = work.pop()
        if not layer:
            continue
        key = (hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest(), None if place is None else (int(place[0][0]), int(place[1][-1])))
        if key in seen:
            continue
        seen.add(key)
        yield layer, place

        def mapped(spans: Places, place=place) -> Places:
            return spans if place is None else (place[0][spans[0]], place[1][spans[1] - 1])

        for sign, pattern, decode in (("%", _PERCENT, _percent), ("\\", _UNICODE, _escape)):
            if sign in layer and (new := _character_layer(layer, pattern, decode)):
                work.append((new[0], mapped(new[1])))
        for spans, inner in _base64_parts(layer):
            work.append((inner, mapped(spans)))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those found in decoded layers, in the text's code points."""
    text = text or ""
    base = base_spans(text)
    every = set(base)
    for layer, place in layers(text):
        if place is not None:
            every |= {(kind, int(place[0][a]), int(place[1][b - 1])) for kind, a, b in base_spans(layer)}
    return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scans(batches):
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
        digest = [hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([spelled(x) for _, x in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans stand in the text itself: assignments to a password-like name, access keys, hex strings;
    the counts and the digest are of them. ``spans`` also has those found below URL, Unicode, base64
    and compressed (gzip, zlib, raw deflate, bzip2, xz, Zstandard) layers, nested in any order, at the place of the encoded
    characters that gave them. Null text counts as empty. A compressed layer that unfolds to more than
    64 MB is read in pieces of that size, each with the last 1 MB of the one before. Other columns are
    ignored; empty: empty; rows that repeat, repeat.
    """
    return docs.select("doc_id", "text").mapInArrow(_scans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
