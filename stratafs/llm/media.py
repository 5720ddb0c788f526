"""Media columns: signature sniffing.

An Aho-Corasick automaton finds magic bytes anywhere in a value; a validator for each
format then confirms structure and lengths. What a value begins with corrects its
declared type; valid media that begin further in are carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Magic bytes and the media types that they announce.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"BM", "image/bmp"),
    (b"RIFF", "riff"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"OggS", "audio/ogg"),
    (b"fLaC", "audio/flac"),
)
#: A PDF's version, its ends, and what a cross-reference begins with.
_PDF_VERSION, _PDF_END, _PDF_XREF = re.compile(rb"\d\.\d"), re.compile(rb"startxref\s+(\d{1,12})\s+%%EOF"), re.compile(rb"xref\b|\d{1,10}\s+\d{1,5}\s+obj\b")


# Each validator gets the value, an offset, and what others of the same value have noted;
# none searches the rest of a value again for every magic that it holds.


def _png(b: bytes, at: int, noted: dict) -> int:
    pos, chunks = at + 8, []
    while pos + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b[pos : pos + 8])
        end = pos + 12 + size
        if end > len(b) or not kind.isalpha() or (pos == at + 8 and (kind != b"IHDR" or size != 13)):
            return 0
        chunks.append((pos + 4, end - 4))
        if kind == b"IEND":  # lengths lead to an end, so the sums are worth computing
            return end - at if all(struct.unpack(">I", b[y : y + 4])[0] == zlib.crc32(b[x:y]) for x, y in chunks) else 0
        pos = end
    return 0


def _jpeg(b: bytes, at: int, noted: dict) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        marker, size = b[pos + 1], struct.unpack(">H", b[pos + 2 : pos + 4])[0]
        if size < 2 or not (0xC0 <= marker <= 0xFE):
            return 0
        pos += 2 + size
        if marker == 0xDA:
            end = -1 if pos >= noted.get("no jpeg end", len(b)) else b.find(b"\xff\xd9", pos)
            if end < 0:
                noted["no jpeg end"] = min(pos, noted.get("no jpeg end", pos))
            return end + 2 - at if end >= 0 else 0
    return 0


def _gif(b: bytes, at: int, noted: dict) -> int:
    if at + 13 > len(b):
        return 0
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            pos += 10 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0) + 1
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return 0


def _bmp(b: bytes, at: int, noted: dict) -> int:
    if at + 30 > len(b):
        return 0
    size, spare, data, header = struct.unpack("<IIII", b[at + 2 : at + 18])
    planes = struct.unpack("<H", b[at + 26 : at + 28])[0]
    fits = spare == 0 and header in (12, 40, 52, 56, 108, 124) and planes == 1 and 14 + header <= data <= size
    return size if fits and at + size <= len(b) else 0


def _wav(b: bytes, at: int, noted: dict) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, pos, kinds = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0], at + 12, []
    if end > len(b):
        return 0
    while pos + 8 <= end:
        kind, size = struct.unpack("<4sI", b[pos : pos + 8])
        if pos + 8 + size > end:
            return 0
        kinds.append(kind)
        pos += 8 + size + (size & 1)
    return end - at if b"fmt " in kinds and b"data" in kinds else 0


def _webp(b: bytes, at: int, noted: dict) -> int:
    if at + 20 > len(b) or b[at + 12 : at + 16] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return 0
    end, pos = at + 8 + struct.unpack("<I", b[at + 4 : at + 8])[0], at + 12
    if end > len(b):
        return 0
    while pos + 8 <= end:
        pos += 8 + (size := struct.unpack("<I", b[pos + 4 : pos + 8])[0]) + (size & 1)
    return end - at if pos == end else 0


def _pdf(b: bytes, at: int, noted: dict) -> int:
    """Up to the last end before the next header whose startxref leads to a real xref behind the end before it, as in files saved anew; else to the first end."""
    if not _PDF_VERSION.match(b, at + 5):
        return 0
    stop = b.find(b"%PDF-", at + 5)
    stop = len(b) if stop < 0 else stop
    end = 0
    for m in _PDF_END.finditer(b, at, stop):
        xref = at + int(m[1])
        if max(end, at) <= xref < m.start() and _PDF_XREF.match(b, xref):
            end = m.end()
    end = end or b.find(b"%%EOF", at, stop) + 5
    return max(0, end - at) if end >= 5 else 0


def _zip(b: bytes, at: int, noted: dict) -> int:
    ends = noted.get("zip")
    if ends is None:  # where each archive begins by its directory's end
        ends, pos = {}, b.find(b"PK\x05\x06")
        while pos >= 0 and pos + 22 <= len(b):
            size, start, note = struct.unpack("<IIH", b[pos + 12 : pos + 22])
            if pos + 22 + note <= len(b):
                ends.setdefault(pos - size - start, []).append(pos + 22 + note)
            pos = b.find(b"PK\x05\x06", pos + 4)
        noted["zip"] = ends
    return next((end - at for end in ends.get(at, ()) if end > at), 0)


def _ogg(b: bytes, at: int, noted: dict) -> int:
    """Up to the last whole page."""
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        table = b[pos + 27 : pos + 27 + b[pos + 26]]
        end = pos + 27 + len(table) + sum(table)
        if len(table) < b[pos + 26] or end > len(b):
            break
        pos = end
    return pos - at


def _flac(b: bytes, at: int, noted: dict) -> int:
    """The metadata of a stream that begins the value. Nothing tells where its frames end, so none is carved further in."""
    pos, last = 4, at != 0 or b[4:8] not in (b"\0\0\0\x22", b"\x80\0\0\x22")
    while not last and pos + 4 <= len(b):
        last, pos = bool(b[pos] & 0x80), pos + 4 + int.from_bytes(b[pos + 1 : pos + 4], "big")
        if last and pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xFE == 0xF8:
            return pos
    return 0


#: For each announced type: the type it is if valid, and the length of the valid value or 0.
VALIDATE: dict[str, tuple[str, Callable[[bytes, int, dict], int]]] = {
    "image/png": ("image/png", _png), "image/jpeg": ("image/jpeg", _jpeg), "image/gif": ("image/gif", _gif),
    "image/bmp": ("image/bmp", _bmp), "riff": ("audio/wav", _wav), "webp": ("image/webp", _webp), "application/pdf": ("application/pdf", _pdf),
    "application/zip": ("application/zip", _zip), "audio/ogg": ("audio/ogg", _ogg), "audio/flac": ("audio/flac", _flac),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, announced in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), announced))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in data, none inside another that precedes it."""
    found, free, noted = [], 0, {}
    for last, (size, announced) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - size
        if at < free:
            continue
        kind, valid = VALIDATE["webp" if announced == "riff" and data[at + 8 : at + 12] == b"WEBP" else announced]
        if length := valid(data, at, noted):
            found.append((kind, at, length))
            free = at + length
    return found


def sniff_media(df: DataFrame, data_col: str, declared_col: str, id_col: str) -> DataFrame:
    """(id, declared, actual, corrected, carved) of each value of a binary column.

    actual: the type of the valid medium at offset 0, else application/octet-stream;
    corrected: it isn't the declared one; carved: type, offset, length and bytes of the
    valid media further in, in order; of media that begin within another the first stands.
    Null and empty values have no media; very long ones are searched whole; a null
    declaration is corrected to what is found; equal rows each give a row; other columns
    are left aside; an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    carved = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))

    def run(batches):
        for batch in batches:
            actual, more = [], []
            for data in batch.column(1).to_pylist():
                media = sniff(data or b"")
                actual.append(media[0][0] if media and media[0][1] == 0 else "application/octet-stream")
                more.append([{"type": k, "offset": o, "length": n, "data": data[o : o + n]} for k, o, n in media if o])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(actual, pa.string()), pa.array(more, carved)], ["id", "declared", "actual", "carved"]
            )

    got = df.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"), F.col(declared_col).cast("string").alias("declared")).mapInArrow(
        run, f"id {kind}, declared string, actual string, carved array<struct<type:string,offset:long,length:long,data:binary>>"
    )
    return got.select(F.col("id").alias(id_col), "declared", "actual", (~F.col("declared").eqNullSafe(F.col("actual"))).alias("corrected"), "carved")


#: Bytes of a row of samples, and what fills the last one.
ROW, FILL = 576, 255
#: Samples a second of the stored form; it has no meaning for the payload.
RATE = 8000


def to_wav(payload: bytes) -> bytes:
    """payload as 8-bit mono samples; its length is even."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(stored: bytes) -> bytes:
    """The samples of the WAV medium that sniffing finds at the start of stored."""
    media = sniff(stored)
    if not media or media[0][:2] != ("audio/wav", 0):
        raise ValueError("no valid WAV medium")
    pos, end = 12, media[0][2]
    while pos + 8 <= end:
        kind, size = struct.unpack("<4sI", stored[pos : pos + 8])
        if kind == b"data":
            return stored[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no samples")


def features(samples: bytes) -> str:
    """Mean, deviation and zero crossings of 8-bit samples, and what is embedded in them."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    inside = ";".join(f"{k}@{o}+{n}" for k, o, n in sniff(samples))
    return f"wav8|n={len(x)}|mean={total / len(x):.4f}|rms={(squares / len(x)) ** 0.5:.4f}|crossings={crossings}|embedded={inside}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a WAV medium, read back through sniffing, as digests and features.

    A null text is an empty one, whose payload is one row of fill bytes; very long texts
    are stored whole (a WAV holds up to 4 GB, a row of Spark 2 GB); equal texts have equal values; equal rows each give a row; a null id stays null; other columns
    are left aside; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
              ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def one(text: str | None) -> tuple:
        raw = (text or "").encode()
        rows = max(1, -(-len(raw) // ROW))
        stored = to_wav(raw + bytes([FILL]) * (rows * ROW - len(raw)))
        back = wav_samples(stored)
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back))

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(one, batch.column(1).to_pylist()))) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], ["id", *(n for n, _ in fields)]
            )

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    return got.select(F.col("id").alias(id_col), *(n for n, _ in fields))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))
