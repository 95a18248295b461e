"""Secrets in texts, also behind layers of encodings.

A text is scanned with three patterns. Then a worklist is unwrapped: the text with its percent escapes resolved, with its Unicode escapes
(``\\uXXXX``, ``\\u{X}``, ``\\xXX``, ``&#N;``, ``&#xX;``) resolved, and each run of base64 in it decoded and, where the bytes are gzip, zlib, bzip2 or xz,
decompressed. Every layer is scanned with the same patterns and put back on the list, until nothing new comes up. A layer whose content was
already met over the same stretch of the original text is not unwrapped again, so content that decodes to itself ends.

Each character of a layer knows the stretch of the original text that it came from; a finding in a layer is reported as the stretch from its
first to its last character. Findings of the plain text always stay.

Whole texts are scanned, row by row in Arrow batches of bounded bytes, without a shuffle. A row of the result is small, whatever the text.

Defined results: a null text is empty and has no spans; ids are passed through, so repeated rows give repeated results; other columns are ignored; an empty
table gives no rows. A compressed layer of over ``MOST_UNPACKED`` bytes is not read, the protection against archives made to explode;
bytes that are not UTF-8 text are not a layer.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import re
import zlib
from base64 import b64decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds of secrets in order, their patterns, and the least length of what is judged (group 2, or all).
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}")
_LEAST_ASSIGN, _LEAST_ACCESS = 12, 18

#: Bytes that a compressed layer may have.
MOST_UNPACKED = 1 << 26

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_MAGIC = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"\x78\x01": zlib.decompressobj, b"\x78\x5e": zlib.decompressobj, b"\x78\x9c": zlib.decompressobj, b"\x78\xda": zlib.decompressobj,
          b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ": lzma.LZMADecompressor}

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def scan(text: str) -> list[Span]:
    """Findings of the patterns themselves: leftmost, not overlapping within a kind, those that are too short left out."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# Layers ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """A text, and for pieces of it (by their first character, ascending) the stretch of the original: ``step`` characters of the original for each character of
    the piece if it was copied (step 1), else all of ``[start, end)`` for every character (step 0)."""

    text: str
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    step: np.ndarray

    def origin(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and ends of the stretches that characters i came from."""
        k = np.searchsorted(self.at, i, "right") - 1
        moved = self.start[k] + (i - self.at[k]) * self.step[k]
        return moved, np.where(self.step[k] == 1, moved + 1, self.end[k])

    def stretch(self, a: int, z: int) -> tuple[int, int]:
        """Where characters a to z (exclusive) came from."""
        start, end = self.origin(np.array([a, z - 1]))
        return int(start[0]), int(end[1])


def _pieces(text: str, pieces: list[tuple[int, int, int, int]]) -> Layer:
    return Layer(text, *np.array(pieces, np.int64).reshape(-1, 4).T)


def plain(text: str) -> Layer:
    return _pieces(text, [(0, 0, len(text), 1)])


def _rewritten(layer: Layer, changes: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with stretches replaced: (from, to, [(character, its own from, to)]); what lies between is copied with its pieces."""
    out, pieces, at, n = [], [], 0, 0

    def copy(a: int, z: int) -> None:
        nonlocal n
        k = int(np.searchsorted(layer.at, a, "right")) - 1
        while a < z:
            stop = min(z, int(layer.at[k + 1]) if k + 1 < len(layer.at) else z)
            pieces.append((n, *((layer.start[k] + a - layer.at[k], layer.end[k], 1) if layer.step[k] else (layer.start[k], layer.end[k], 0))))
            out.append(layer.text[a:stop])
            n += stop - a
            a, k = stop, k + 1

    for a, z, characters in changes:
        copy(at, a)
        for c, b, e in characters:
            pieces.append((n, *layer.stretch(b, e), 0))
            out.append(c)
            n += 1
        at = z
    copy(at, len(layer.text))
    return _pieces("".join(out), pieces)


def _decoded(raw: bytes) -> tuple[str, np.ndarray] | None:
    """UTF-8 text and the places in bytes at which its characters begin, with the end; None if it is no text."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text, np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def percent_decoded(layer: Layer) -> Layer | None:
    """The layer with its percent escapes resolved; bytes that are not UTF-8 stay escaped."""
    changes = []
    for m in _PERCENT.finditer(layer.text):
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            escaped = "\udc80" <= c <= "\udcff"
            n = 3 if escaped or c < "\x80" else 3 * len(c.encode())
            if not escaped:
                changes.append((at, at + n, [(c, at, at + n)]))
            at += n
    return _rewritten(layer, changes) if changes else None


def unicode_decoded(layer: Layer) -> Layer | None:
    """The layer with its Unicode escapes resolved; surrogates of a pair are put together, single ones and numbers beyond Unicode stay."""
    changes: list = []
    for m in _UNICODE.finditer(layer.text):
        number = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
        if 0xDC00 <= number < 0xE000 and changes and changes[-1][1] == m.start() and 0xD800 <= changes[-1][2] < 0xDC00:
            a, _, high = changes.pop()
            changes.append((a, m.end(), 0x10000 + ((high - 0xD800) << 10) + number - 0xDC00))
        elif number < 0x110000:
            changes.append((m.start(), m.end(), number))
    kept = [(a, z, [(chr(number), a, z)]) for a, z, number in changes if not 0xD800 <= number < 0xE000]
    return _rewritten(layer, kept) if kept else None


def _unpacked(raw: bytes) -> bytes | None:
    make = next((f for magic, f in _MAGIC.items() if raw.startswith(magic)), None)
    if make is None:
        return None
    try:
        unpacker = make()
        found = unpacker.decompress(raw, MOST_UNPACKED)
        return found if unpacker.eof else None
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return None


def base64_decoded(layer: Layer) -> Iterator[Layer]:
    """A layer for each run of base64 (either alphabet) whose bytes, decompressed as often as they are archives, are text. A character of it comes from the
    run's characters that hold its bits, or from the whole run behind a decompression."""
    for m in _BASE64.finditer(layer.text):
        body = m[0].rstrip("=")
        if len(body) % 4 == 1:
            body = body[:-1]
        raw = b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
        packed, met = False, set()
        while (more := _unpacked(raw)) is not None and (digest := hashlib.sha256(raw).digest()) not in met:
            met.add(digest)
            raw, packed = more, True
        if not raw or not (found := _decoded(raw)):
            continue
        (text, where), a = found, m.start()
        if packed:
            yield _pieces(text, [(0, *layer.stretch(a, m.end()), 0)])
        else:
            last = np.minimum(a + len(body), a - -where[1:] * 8 // 6) - 1
            yield Layer(text, np.arange(len(text)), layer.origin(a + where[:-1] * 8 // 6)[0], layer.origin(last)[1], np.zeros(len(text), np.int64))


def layers(text: str) -> Iterator[Layer]:
    """Every layer behind the text, once for each stretch of the original that it covers."""
    work, met = [plain(text)], set()
    while work:
        layer = work.pop()
        behind = list(base64_decoded(layer))
        behind += [x for x in ("%" in layer.text and percent_decoded(layer), ("\\" in layer.text or "&#" in layer.text) and unicode_decoded(layer)) if x]
        for found in behind:
            where = found.stretch(0, len(found.text)) if found.text else (0, 0)
            name = (*where, hashlib.sha256(found.text.encode("utf-8", "surrogatepass")).digest())
            if name not in met:
                met.add(name)
                work.append(found)
                yield found


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(findings of the text itself, those and the findings of all layers), each sorted by start, kind, end."""
    base = scan(text)
    every = set(base)
    for layer in layers(text):
        for a, kind, z in scan(layer.text):
            start, end = layer.stretch(a, z)
            every.add((start, kind, end))
    return base, sorted(every)


# Tables ------------------------------------------------------------------------------------------------------------


def shown(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        each = [spans(t or "") for t in b["text"].to_pylist()]
        counts = [[sum(kind == k for _, kind, _ in base) for base, _ in each] for k in range(len(KINDS))]
        base, every = pa.array([shown(x) for x, _ in each], pa.string()), pa.array([shown(y) for _, y in each], pa.string())
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in counts), base, every], names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): counts and spans ``kind:start:end`` of the plain text's findings, and of all findings."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redacted(docs: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` with every finding's characters masked, a text's length kept; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b["text"].to_pylist():
                if t is not None:
                    for start, _, end in spans(t)[1]:
                        t = t[:start] + mask * (end - start) + t[end:]
                texts.append(t)
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    return find_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
