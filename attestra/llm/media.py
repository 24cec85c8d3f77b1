"""Media columns: signature sniffing, correction of declared types, carving, WAV storage.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a
binary value; for each hit a validator of the format walks its structure and gives its
length or turns the hit down. The item at offset 0 is the value's true type, which replaces
a wrong declared one; valid items at other offsets are embedded media and can be carved out.

Payloads are stored as 8-bit mono WAV samples without loss; they are read back through the
same sniffing, from the data chunk that the validator found.

Defined results: a null value has no type and no items; an unknown one has the type
application/octet-stream; a truncated item is not valid; a null text is an empty payload
(one block of padding); repeated rows stay; other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm import common

BLOCK, PAD, RATE = 576, b"\xff", 8000
UNKNOWN = "application/octet-stream"


def wav_chunks(data: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Place and size of each chunk of the WAV at ``at``, and of the whole at b''; None if it isn't valid."""
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    found, i = {}, at + 12
    while i + 8 <= end:
        size = struct.unpack_from("<I", data, i + 4)[0]
        if i + 8 + size > end:
            return None
        found.setdefault(data[i : i + 4], (i + 8, size))
        i += 8 + size + (size & 1)
    if b"fmt " not in found or b"data" not in found or found[b"fmt "][1] < 16:
        return None
    return found | {b"": (at, end - at)}


def _wav(data: bytes, at: int, marks: Marks) -> int:
    chunks = wav_chunks(data, at)
    return chunks[b""][1] if chunks else 0


class Marks:
    """Next place of a marker, found by one pass over the value: hits don't search to its end again and again."""

    def __init__(self, data: bytes):
        self.data, self.places = data, {}

    def next(self, marker: bytes, at: int) -> int:
        """-1 where there is none from ``at`` on."""
        if marker not in self.places:
            self.places[marker] = [m.start() for m in re.finditer(b"(?=" + re.escape(marker) + b")", self.data)]
        found = self.places[marker]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1


def _png(data: bytes, at: int, marks: Marks) -> int:
    i = at + 8
    while i + 12 <= len(data):
        size = struct.unpack_from(">I", data, i)[0]
        if i == at + 8 and data[i : i + 8] != b"\0\0\0\x0dIHDR":
            return 0
        if i + 12 + size > len(data) or zlib.crc32(data[i + 4 : i + 8 + size]) != struct.unpack_from(">I", data, i + 8 + size)[0]:
            return 0
        kind = data[i + 4 : i + 8]
        i += 12 + size
        if kind == b"IEND":
            return i - at
    return 0


def _gif(data: bytes, at: int, marks: Marks) -> int:
    if len(data) < at + 13:
        return 0
    i = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int:
        while i < len(data) and data[i]:
            i += data[i] + 1
        return i + 1

    while i < len(data):
        if data[i] == 0x3B:
            return i + 1 - at
        if data[i] == 0x21:
            i = blocks(i + 2)
        elif data[i] == 0x2C and i + 10 < len(data):
            i = blocks(i + 11 + (3 << ((data[i + 9] & 7) + 1) if data[i + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(data: bytes, at: int, marks: Marks) -> int:
    i = at + 2
    while i + 4 <= len(data) and data[i] == 0xFF:
        kind, size = data[i + 1], struct.unpack_from(">H", data, i + 2)[0]
        if size < 2:
            return 0
        i += 2 + size
        if kind == 0xDA:
            end = marks.next(b"\xff\xd9", i)
            return end + 2 - at if end >= 0 else 0
    return 0


def _pdf(data: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"%%EOF", at)
    return end + 5 - at if 0 <= marks.next(b"startxref", at) <= end - 9 else 0


def _gzip(data: bytes, at: int, marks: Marks) -> int:
    unpack, i = zlib.decompressobj(31), at
    try:
        while i < len(data) and not unpack.eof:
            unpack.decompress(data[i : i + 65536], 1 << 20)
            while unpack.unconsumed_tail and not unpack.eof:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return 0
    return min(i, len(data)) - len(unpack.unused_data) - at if unpack.eof else 0


def _zip(data: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return 0
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    whole = end + 22 + note
    return whole - at if start + size == end - at and whole <= len(data) else 0


#: Magic bytes, type and validator of each format.
FORMATS = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
]

_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for i, (magic, _, _) in enumerate(FORMATS):
            a.add_word(magic.decode("latin-1"), i)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """Type, start and length of each valid item, by start. A ZIP's inner headers are within it."""
    found, zip_end, marks = [], 0, Marks(data)
    for end, i in automaton().iter(data.decode("latin-1")):
        magic, kind, valid = FORMATS[i]
        at = end + 1 - len(magic)
        if kind == "application/zip" and at < zip_end:
            continue
        if size := valid(data, at, marks):
            found.append((kind, at, size))
            if kind == "application/zip":
                zip_end = at + size
    return found


ITEMS = "array<struct<type:string,start:long,length:long>>"


def sniff_media(df: DataFrame, column: str = "content", declared: str | None = None) -> DataFrame:
    """The columns of df plus media_type (as found), media_type_ok (the declared type is the true
    one) and media_items (valid items). Columns of these names in the input are replaced."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("media_type", "media_type_ok", "media_items")])
    kinds = T.StructType([*df.schema.fields, T.StructField("media_type", T.StringType()), T.StructField("media_type_ok", T.BooleanType()), *T._parse_datatype_string(f"media_items {ITEMS}").fields])
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column(declared).to_pylist() if declared else [None] * b.num_rows
            kind, right, items = [], [], []
            for data, word in zip(b.column(column).to_pylist(), said, strict=True):
                found = sniff(data) if data is not None else []
                true = None if data is None else next((k for k, at, _ in found if at == 0), UNKNOWN)
                kind.append(true)
                right.append(None if true is None or word is None else word == true)
                items.append([{"type": k, "start": at, "length": n} for k, at, n in found] if data is not None else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kind, pa.string()), pa.array(right, pa.bool_()), pa.array(items, pa.list_(item))], names=kinds.names)

    return df.mapInArrow(run, kinds)


def carve(data: bytes) -> list[tuple[str, bytes]]:
    """Embedded items: those that don't start the value."""
    return [(k, data[at : at + n]) for k, at, n in sniff(data) if at]


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + PAD * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def store_wav(samples: bytes) -> bytes:
    """8-bit mono PCM."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def read_wav(stored: bytes) -> bytes:
    """The samples of a stored value, at the place that sniffing found."""
    at = next(at for kind, at, _ in sniff(stored) if kind == "audio/wav")
    start, size = wav_chunks(stored, at)[b"data"]
    return stored[start : start + size]


def wav_feature(samples: bytes, items: list[tuple[str, int, int]]) -> str:
    """Type, embedded items, frames, level and change of the samples, and loudest of 16 bands of values."""
    x = np.frombuffer(samples, np.uint8)
    total, power = int(x.sum(dtype=np.int64)), int(np.dot(y := x.astype(np.float64), y))
    change = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    bands = np.bincount(x >> 4, minlength=16)
    return f"{items[0][0]};embedded={len(items) - 1};frames={len(x) // BLOCK};sum={total};power={power};change={change};top={int(bands.argmax())}"


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                n, raw = payload(text)
                stored = store_wav(raw)
                items = sniff(stored)
                start, size = wav_chunks(stored, items[0][1])[b"data"]
                back = stored[start : start + size]
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), wav_feature(back, items)))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
