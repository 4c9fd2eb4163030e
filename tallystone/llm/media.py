"""Operator 3: media columns, sniffed by signature.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a value. Each hit goes to the
format's validator, which walks the structure (chunks, segments, blocks, pages) and returns the exact length, or
nothing where the structure is broken. A medium that starts at byte 0 corrects the declared type; media found
further in are carved out, except those inside a medium already carved.

Nulls and empty values have no type, no length and nothing embedded. A value of any length is scanned whole. Repeated
rows get equal results, an empty table none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialize, small_batches

UNIT = 192


def _riff(kind: bytes) -> Callable[[bytes, int], int]:
    def length(b: bytes, i: int) -> int:
        if len(b) < i + 12 or b[i + 8 : i + 12] != kind:
            return 0
        size = struct.unpack_from("<I", b, i + 4)[0] + 8
        at, end = i + 12, i + size
        if end > len(b):
            return 0
        while at + 8 <= end:
            n = struct.unpack_from("<I", b, at + 4)[0]
            at += 8 + n + (n & 1)
        return size if at == end else 0

    return length


def _png(b: bytes, i: int) -> int:
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or first and kind != b"IHDR" or struct.unpack_from(">I", b, at + 8 + n)[0] != zlib.crc32(b[at + 4 : at + 8 + n]):
            return 0
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at - i
    return 0


def _jpeg(b: bytes, i: int) -> int:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2 - i
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return 0
        at += 2 + n
        if kind == 0xDA:  # entropy-coded data: up to the next marker that is no stuffing and no restart
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    return 0
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                else:
                    break
    return at + 2 - i if b[at : at + 2] == b"\xff\xd9" else 0


def _gif(b: bytes, i: int) -> int:
    if len(b) < i + 13:
        return 0
    at = i + 13 + (3 << (b[i + 10] & 7) + 1 if b[i + 10] & 0x80 else 0)
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 - i
        if kind == 0x2C:
            if at + 10 > len(b):
                return 0
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 0x80 else 0)
        elif kind == 0x21:
            at += 2
        else:
            return 0
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return 0


def _bmp(b: bytes, i: int) -> int:
    if len(b) < i + 54:
        return 0
    size, zero, offset, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, i + 2)
    if zero or head not in (40, 52, 56, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or width <= 0:
        return 0
    return size if offset >= 14 + head and i + size <= len(b) and size >= offset + (width * depth + 31) // 32 * 4 * abs(height) else 0


def _gzip(b: bytes, i: int) -> int:
    d = zlib.decompressobj(31)
    try:
        for at in range(i, len(b), 1 << 16):
            d.decompress(b[at : at + (1 << 16)])
            if d.eof:
                return min(at + (1 << 16), len(b)) - len(d.unused_data) - i
    except zlib.error:
        pass
    return 0


class Finder:
    """bytes.find for searches from ascending places: text between a place and the next match is read once."""

    def __init__(self, b: bytes):
        self.b, self.last, self._archives = b, {}, None

    def __call__(self, what: bytes, start: int) -> int:
        a, at = self.last.get(what, (0, 0))
        if not (a <= start and (at < 0 or start <= at)) or what not in self.last:
            at = self.b.find(what, start)
            self.last[what] = start, at
        return at

    def archives(self) -> dict[int, int]:
        """Where zip archives would begin, by their end records, and the first end of each."""
        if self._archives is not None:
            return self._archives
        found, b = {}, self.b
        at = b.find(b"PK\x05\x06")
        while at >= 0 and at + 22 <= len(b):
            n, size, offset, note = struct.unpack_from("<HIIH", b, at + 10)
            first = at - size
            if n and first >= 0 and b[first : first + 4] == b"PK\x01\x02" and at + 22 + note <= len(b):
                found.setdefault(first - offset, at + 22 + note)
            at = b.find(b"PK\x05\x06", at + 4)
        self._archives = found
        return found


def _zip(b: bytes, i: int, find: Finder) -> int:
    return max(find.archives().get(i, i) - i, 0)


def _ogg(b: bytes, i: int) -> int:
    at = i
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b):
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b) or b[at + 4]:
            return 0
        last, at = b[at + 5] & 4, end
        if last:
            return at - i
    return 0


def _pdf(b: bytes, i: int, find: Finder) -> int:
    end, start = find(b"%%EOF", i), find(b"startxref", i)
    return end + 5 - i if 0 <= start < end else 0


#: Fixed values: (type, magic bytes, validator).
FORMATS: list[tuple[str, bytes, Callable[[bytes, int], int]]] = [
    ("audio/wav", b"RIFF", _riff(b"WAVE")),
    ("image/webp", b"RIFF", _riff(b"WEBP")),
    ("video/avi", b"RIFF", _riff(b"AVI ")),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/bmp", b"BM", _bmp),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/zip", b"PK\x03\x04", _zip),
    ("audio/ogg", b"OggS", _ogg),
    ("application/pdf", b"%PDF-", _pdf),
]


def automaton() -> ahocorasick.Automaton:
    by_magic: dict[str, list] = {}
    for kind, magic, check in FORMATS:
        by_magic.setdefault(magic.decode("latin-1"), []).append((kind, check))
    a = ahocorasick.Automaton()
    for magic, checks in by_magic.items():
        a.add_word(magic, (len(magic), checks))
    a.make_automaton()
    return a


def sniff(b: bytes, a: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """The media in b that are not inside one another, as (offset, length, type)."""
    find = Finder(b)
    hits = sorted((end - n + 1, k, kind, check) for end, (n, checks) in a.iter(b.decode("latin-1")) for k, (kind, check) in enumerate(checks))
    found, free = [], 0
    for i, _, kind, check in hits:
        if i >= free and (n := check(b, i, find) if check in (_zip, _pdf) else check(b, i)):
            found.append((i, n, kind))
            free = i + n
    return found


def wav(payload: bytes) -> bytes:
    """8-bit mono samples at 8 kHz; the payload's bytes are the samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + (n & 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n & 1)


def wav_samples(b: bytes) -> bytes:
    """The samples of the data chunk."""
    at = 12
    while at + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        if kind == b"data":
            return b[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    return b""


def feature(samples: bytes) -> str:
    """Mean level, zero crossings about the mid level, energy and a 16-bin histogram of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return ""
    histogram = np.bincount(x, minlength=256)
    levels = np.arange(256)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return ":".join(map(str, [int(histogram @ levels), crossings, int(histogram @ (levels - 128) ** 2), *histogram.reshape(16, 16).sum(1)]))


def text_to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's UTF-8 bytes, padded by spaces to a positive multiple of unit, as WAV."""
    small_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("doc_id"), F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, media = [], []
            for x in batch.column(1):
                b = x.as_py()
                n.append(len(b))
                media.append(wav(b.ljust(max(1, -(-len(b) // unit)) * unit)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(["audio/wav"] * len(n), pa.string())], names=["doc_id", "n_bytes", "media", "declared"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, declared string")


MEDIA_SCHEMA = "type string, declared_ok boolean, length long, embedded array<struct<offset:long,length:long,type:string>>"


def inspect(media: DataFrame, keep: list[str], media_col: str = "media", declared_col: str = "declared", digests: bool = False) -> DataFrame:
    """The columns in keep, and each value's true type, whether the declared one was right, its length and what is embedded.

    digests adds the stored form's and the payload's figures for WAV values, read from the stored bytes.
    """
    small_batches(media.sparkSession)
    rows = media.select(*[col(k) for k in keep], col(media_col).alias("__media"), col(declared_col).alias("__declared"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), MEDIA_SCHEMA])
    if digests:
        schema += ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, names = automaton(), [x.split(" ")[0].strip("`") for x in schema.split(", ")]
        item = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
        for batch in batches:
            out: list[tuple] = []
            for value, declared in zip(batch.column(len(keep)), batch.column(len(keep) + 1).to_pylist(), strict=True):
                b = value.as_py() or b""
                found = sniff(b, a)
                whole = found[0] if found and found[0][0] == 0 else None
                inner = found[1:] if whole else found
                if whole and whole[2] == "audio/wav":  # what the container carries is looked at too
                    inner = [(44 + i, n, t) for i, n, t in sniff(b[44:], a)] + inner
                row = (whole and whole[2], None if whole is None else whole[2] == declared, whole and whole[1], [{"offset": i, "length": n, "type": t} for i, n, t in inner])
                if digests:
                    p = wav_samples(b) if whole and whole[2] == "audio/wav" else b
                    row += (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature(p))
                out.append(row)
            kinds = [pa.string(), pa.bool_(), pa.int64(), item, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([r[k] for r in out], kinds[k]) for k in range(10 if digests else 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=[*names[: len(keep)], "type", "declared_ok", "length", "embedded", *["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"][: 6 * digests]])

    return rows.mapInArrow(run, schema)


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text as a medium, read the stored bytes back, sniff and describe them."""
    stored = materialize(text_to_wav(docs), "media")
    out = inspect(stored, ["doc_id", "n_bytes"], digests=True)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("type").alias("media_type"), "declared_ok", F.size("embedded").cast("long").alias("n_embedded"))
