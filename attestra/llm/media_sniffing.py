"""Operator 10: media columns by signature sniffing.

One Aho-Corasick automaton over all signatures finds every magic number in a column of
stored bytes in a single pass; a validator for each format then walks the structure and
its lengths. What stands valid at offset 0 is the value's true type, whatever was declared;
what stands valid further in, outside of the media already accepted, is carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import id_and_text, map_arrow, read_table, text_bytes

#: Samples in a row of an image, and the unit to which payloads are filled up.
ROW = 192
#: Formats that payloads are stored in.
STORED = ("wav", "bmp", "pgm", "png", "au")

Found = tuple[int, bytes | None]  # length of the whole medium, its 8-bit samples if it is of a kind that we store


def write_wav(samples: bytes) -> bytes:
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def write_bmp(samples: bytes) -> bytes:
    height = len(samples) // ROW
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + 1024 + len(samples), 0, 0, 54 + 1024, 40, ROW, height, 1, 8, 0, len(samples), 2835, 2835, 256, 256)
    return head + palette + _flipped(samples)


def write_pgm(samples: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(samples) // ROW) + samples


def write_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    raw = np.hstack((np.zeros((len(rows), 1), np.uint8), rows)).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def write_au(samples: bytes) -> bytes:
    return struct.pack(">4sIIIII", b".snd", 24, len(samples), 2, 8000, 1) + samples


def _flipped(samples: bytes) -> bytes:
    return np.frombuffer(samples, np.uint8).reshape(-1, ROW)[::-1].tobytes()


def check_wav(b: bytes, at: int) -> Found | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, plain, samples, data = at + 12, False, None, False
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            plain = struct.unpack_from("<HH", b, pos + 8) == (1, 1) and struct.unpack_from("<H", b, pos + 22)[0] == 8
        if kind == b"data":
            data, samples = True, b[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    return (end - at, samples if plain else None) if data else None


def check_bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, r1, r2, off, head, width, height, planes, bits, packed = struct.unpack_from("<IHHIIiiHHI", b, at + 2)
    if r1 or r2 or head != 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or packed > 3 or off < 54:
        return None
    line = (width * bits + 31) // 32 * 4
    if at + size > len(b) or (not packed and off + line * abs(height) > size):
        return None
    plain = bits == 8 and not packed and width == ROW and height > 0
    return size, _flipped(b[at + off : at + off + line * height]) if plain else None


def check_pgm(b: bytes, at: int) -> Found | None:
    fields, pos = [], at + 2
    while len(fields) < 3:
        start = pos
        while b[pos : pos + 1] in (b" ", b"\n", b"\t", b"\r") and pos < len(b):
            pos += 1
        digits = pos
        while pos < min(len(b), digits + 10) and 0x30 <= b[pos] <= 0x39:
            pos += 1
        if digits == start or pos == digits:
            return None
        fields.append(int(b[digits:pos]))
    width, height, top = fields
    if b[pos : pos + 1] not in (b" ", b"\n", b"\t", b"\r") or not (width and height and 0 < top < 65536):
        return None
    end = pos + 1 + width * height * (1 + (top > 255))
    return (end - at, b[pos + 1 : end] if top == 255 else None) if end <= len(b) else None


def check_png(b: bytes, at: int) -> Found | None:
    pos, shape, packed = at + 8, None, []
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        if kind == b"IHDR" and size == 13:
            shape = struct.unpack_from(">IIBBBBB", b, pos + 8)
        if kind == b"IDAT":
            packed.append(b[pos + 8 : pos + 8 + size])
        pos += 12 + size
        if kind == b"IEND":
            samples = None
            if shape and shape[2:] == (8, 0, 0, 0, 0):
                size = shape[1] * (shape[0] + 1)
                raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), size + 1), np.uint8).reshape(shape[1], shape[0] + 1)
                samples = raw[:, 1:].tobytes() if not raw[:, 0].any() else None
            return (pos - at, samples) if shape else None
    return None


def check_au(b: bytes, at: int) -> Found | None:
    if at + 24 > len(b):
        return None
    off, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if off < 24 or not 1 <= coding <= 27 or not rate or not 1 <= channels <= 64 or at + off + size > len(b):
        return None
    return off + size, b[at + off : at + off + size] if coding == 2 and channels == 1 else None


def check_gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at, None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


#: Magic bytes of the formats.
SIGNATURES: dict[bytes, tuple[str, Callable[[bytes, int], Found | None]]] = {
    b"RIFF": ("wav", check_wav),
    b"BM": ("bmp", check_bmp),
    b"P5": ("pgm", check_pgm),
    b"\x89PNG\r\n\x1a\n": ("png", check_png),
    b".snd": ("au", check_au),
    b"GIF87a": ("gif", check_gif),
    b"GIF89a": ("gif", check_gif),
}
WRITERS = {"wav": write_wav, "bmp": write_bmp, "pgm": write_pgm, "png": write_png, "au": write_au}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic in SIGNATURES:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def sniff(stored: bytes) -> list[tuple[str, int, int, bytes | None]]:
    """(type, offset, length, samples) of every valid medium that lies outside of those before it."""
    out, free = [], 0
    for last, magic in _automaton().iter(stored.decode("latin-1")):
        at = last - len(magic) + 1
        if at >= free:
            kind, check = SIGNATURES[magic]
            try:
                hit = check(stored, at)
            except (ValueError, zlib.error, struct.error):
                hit = None
            if hit:
                out.append((kind, at, *hit))
                free = at + hit[0]
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, declared, sizes = [], [], []
        for text in text_bytes(batch):
            payload = text + b" " * (-len(text) % ROW or (0 if text else ROW))
            pick = zlib.crc32(payload)
            media.append(WRITERS[STORED[pick % len(STORED)]](payload))
            declared.append(STORED[(pick >> 8) % len(STORED)])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """Every whole text as the samples of a WAV, BMP, PGM, PNG or AU medium.

    One row per input row: doc_id, n_bytes (of the text in UTF-8), declared (a type named
    without looking, so often wrong), media. The payload is the text, filled up with spaces to a
    positive multiple of 192; format and declared type follow from its CRC, so equal texts give equal
    values. Null texts count as empty; null ids stay null; other columns stay behind.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(id_and_text(docs), _store, f"doc_id {kind}, n_bytes long, declared string, media binary")


def _sniffed(batches: Iterator[pa.RecordBatch], digests: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist()):
            media = media or b""
            found = sniff(media)
            true = found[0] if found and found[0][1] == 0 else None
            carved = found[1:] if true else found
            if digests:
                if true is None or true[3] is None:
                    raise ValueError("stored media can't be read back")
                payload = true[3]
                mean = float(np.frombuffer(payload, np.uint8).mean())
                feature = f"type={true[0]};declared={declared};corrected={int(declared != true[0])};samples={len(payload)};carved={len(carved)};mean={mean:.4f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            else:
                rows.append((true[0] if true else None, declared, true[3] if true else None, [{"type": k, "offset": a, "length": n, "content": media[a : a + n]} for k, a, n, _ in carved]))
        if digests:
            names, types = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            keep = ["doc_id", "n_bytes"]
        else:
            names, keep = ["type", "declared", "samples", "carved"], ["doc_id"]
            types = [pa.string(), pa.string(), pa.binary(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(cols, types))], keep + names)


def sniff_media(stored: DataFrame) -> DataFrame:
    """True types, samples and carved media of a column `media` with types `declared`.

    One row per input row: doc_id, type (what is valid at offset 0, else null), declared,
    samples (of the 8-bit kinds) and carved, the valid media elsewhere in the bytes. Null and empty
    media have no type. Other columns stay behind.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_arrow(stored.select("doc_id", "declared", "media"), _sniffed, f"doc_id {kind}, type string, declared string, samples binary, carved array<struct<type:string,offset:long,length:long,content:binary>>", digests=False)


def op10_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(read_table(spark, sf_dir, "documents"))
    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_arrow(stored, _sniffed, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", digests=True)
