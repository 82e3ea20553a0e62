"""Media columns: signature sniffing, validation, type correction, carving; and a lossless payload store.

An Aho-Corasick automaton over the magic bytes of the known formats finds every place where a medium may begin. A
validator for the format then reads the structure at that place and either gives the medium's exact length or rejects
it: WAV and WebP, PNG, BMP, PGM, GIF, JPEG, MP4, OGG, MP3 and FLAC. (A FLAC stream doesn't say how long it is: its head is
validated, and it is taken to the end of the value.) A medium at offset 0 that spans the value decides the corrected
type; others are embedded and can be carved.

`sniffed` corrects the declared types of a column and lists the media in each value, `carved` cuts them out.
`store_payload` keeps bytes as 8-bit samples of a medium and `load_payload` reads them back through the sniffer alone:
the declared type is not trusted.

Defined cases: a null or empty value sniffs as type null with no media, whatever is declared; a null declared type counts as
wrong for a value with a type; null and empty texts both store the one padded unit of 192 spaces; equal texts give equal
stored bytes whatever their row, id or order; repeated and null ids pass through; other columns are ignored; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import map_chunks

UNIT = 192


class Medium(NamedTuple):
    mime: str
    start: int
    length: int
    data: tuple[tuple[int, int], ...]  # where its samples or compressed samples lie
    shape: tuple[int, ...]


def _wav(b: bytes, at: int) -> Medium | None:
    """RIFF/WAVE: the chunk list must fill the declared size; there is one fmt and one data chunk."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, form, data = at + 12, None, None
    if end > len(b):
        return None
    while pos + 8 <= end:
        name, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", b, pos + 8)
        elif name == b"data":
            data = (pos + 8, size)
        pos += 8 + size + size % 2
    if pos < end or form is None or data is None or not form[1] or not form[5]:
        return None
    return Medium("audio/wav", at, min(pos, len(b)) - at, (data,), (form[2], form[1], form[5]))


def _png(b: bytes, at: int) -> Medium | None:
    """PNG: IHDR first, IEND last, each chunk's CRC right."""
    pos, data, shape = at + 8, [], None
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        if (shape is None) != (name == b"IHDR"):
            return None
        if name == b"IHDR":
            shape = struct.unpack_from(">IIBBBBB", b, pos + 8)
        elif name == b"IDAT":
            data.append((pos + 8, size))
        elif name == b"IEND":
            return Medium("image/png", at, pos + 12 - at, tuple(data), shape) if data else None
        pos += 12 + size
    return None


def _bmp(b: bytes, at: int) -> Medium | None:
    """BMP with 8-bit samples: the declared size equals the header, palette and rows."""
    if len(b) < at + 54:
        return None
    size, _, off, head, w, h, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    row = (abs(w) * bits + 31) // 32 * 4
    if at + size > len(b) or head < 40 or planes != 1 or bits not in (1, 4, 8, 24, 32) or packed or w <= 0 or not h or off < 14 + head or size != off + row * abs(h):
        return None
    return Medium("image/bmp", at, size, ((at + off, row * abs(h)),), (w, h, bits))


def _pgm(b: bytes, at: int) -> Medium | None:
    """Binary PGM with a plain header, one byte a sample."""
    head = b[at : at + 40].split(b"\n", 3)
    if len(head) < 4 or head[0] != b"P5" or head[2] != b"255":
        return None
    dims = head[1].split(b" ")
    if len(dims) != 2 or not all(d.isdigit() and len(d) < 10 for d in dims):
        return None
    w, h = map(int, dims)
    skip = sum(map(len, head[:3])) + 3
    if not w * h or at + skip + w * h > len(b):
        return None
    return Medium("image/x-portable-graymap", at, skip + w * h, ((at + skip, w * h),), (w, h))


def _gif(b: bytes, at: int) -> Medium | None:
    """GIF: colour tables and sub-block chains up to the trailer."""
    if len(b) < at + 13 or b[at + 3 : at + 6] not in (b"87a", b"89a"):
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    pos, seen = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), False
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return Medium("image/gif", at, pos + 1 - at, (), (w, h)) if seen else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            seen = True
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _webp(b: bytes, at: int) -> Medium | None:
    """RIFF/WEBP: the first chunk is one of the three kinds, and the chunks fill the declared size."""
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, data = at + 12, []
    if end > len(b) or b[pos : pos + 4] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return None
    while pos + 8 <= end:
        size = struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + size > end:
            return None
        data.append((pos + 8, size))
        pos += 8 + size + size % 2
    return Medium("image/webp", at, end - at, tuple(data), ()) if pos == end else None


def _riff(b: bytes, at: int) -> Medium | None:
    kind = b[at + 8 : at + 12]
    return _wav(b, at) if kind == b"WAVE" else _webp(b, at) if kind == b"WEBP" else None


def _jpeg(b: bytes, at: int) -> Medium | None:
    """JPEG: segments up to the end mark, a frame header before the first scan; scans end at a mark that isn't a restart."""
    pos, shape, data = at + 2, None, []
    while pos + 4 <= len(b) + 2 and pos + 1 < len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xD9:
            return Medium("image/jpeg", at, pos + 2 - at, tuple(data), shape) if data else None
        if mark == 0xFF or mark == 1:
            pos += 1 if mark == 0xFF else 2
            continue
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8 or pos + 4 > len(b):
            return None
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(b):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if size < 8:
                return None
            shape = struct.unpack_from(">BHHB", b, pos + 4)
        pos += 2 + size
        if mark == 0xDA:
            if shape is None:
                return None
            first = pos
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            data.append((first, pos - first))
    return None


#: Boxes that stand at the top of an ISO media file. Fixed values.
_BOXES = (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"sidx", b"styp", b"uuid", b"meta", b"pdin", b"emsg", b"prft")


def _mp4(b: bytes, at: int) -> Medium | None:
    """MP4: boxes one after another from ftyp on; there is a moov or moof."""
    pos, seen, data = at, set(), []
    while pos + 8 <= len(b) and b[pos + 4 : pos + 8] in _BOXES:
        name, size, head = b[pos + 4 : pos + 8], struct.unpack_from(">I", b, pos)[0], 8
        if name == b"ftyp" and seen:
            break  # another file
        if size == 1 and pos + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, pos + 8)[0], 16
        elif size == 0:
            size = len(b) - pos
        if size < head or pos + size > len(b):
            break
        seen.add(name)
        if name == b"mdat":
            data.append((pos + head, size - head))
        pos += size
    if b"ftyp" not in seen or not seen & {b"moov", b"moof"}:
        return None
    return Medium("video/mp4", at, pos - at, tuple(data), ())


_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(page: bytes) -> int:
    """Polynomial 0x04c11db7, most significant bit first, from 0: zlib's CRC of mirrored bytes, mirrored."""
    plain = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{plain:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> Medium | None:
    """OGG: a first page, then pages up to a last one or what isn't a page, each page's CRC right."""
    pos, data, kind = at, [], "application/ogg"
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and not b[pos + 4]:
        flags, n = b[pos + 5], b[pos + 26]
        head = 27 + n
        size = head + sum(b[pos + 27 : pos + head])
        page = b[pos : pos + size]
        if len(page) < size or bool(flags & 2) != (pos == at) or ogg_crc(page[:22] + bytes(4) + page[26:]) != struct.unpack_from("<I", page, 22)[0]:
            break
        if pos == at:
            start = page[head : head + 8]
            kind = "audio/ogg" if start == b"OpusHead" or start.startswith(b"\x01vorbis") else "video/ogg" if start.startswith(b"\x80theora") else kind
        data.append((pos + head, size - head))
        pos += size
        if flags & 4:
            break
    return Medium(kind, at, pos - at, tuple(data), ()) if data else None


#: Bit rates (kbit/s) of layer III by index, and sample rates. Fixed values of the format.
_RATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
_RATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
_SAMPLES = (44100, 48000, 32000)


def _mp3_frame(b: bytes, at: int) -> int:
    """Bytes of the layer III frame here, 0 if there is none."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE6 != 0xE2 or b[at + 1] >> 3 & 3 == 1:
        return 0
    version, rate, hertz, pad = b[at + 1] >> 3 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3, b[at + 2] >> 1 & 1
    if rate in (0, 15) or hertz == 3:
        return 0
    full = version == 3
    samples = _SAMPLES[hertz] // (1 if full else 2 if version == 2 else 4)
    return (144 if full else 72) * 1000 * (_RATES_1 if full else _RATES_2)[rate] // samples + pad


def _mp3(b: bytes, at: int) -> Medium | None:
    """MP3: an ID3 tag or none, then at least three whole frames in a row."""
    pos = at
    if b[at : at + 3] == b"ID3":
        if len(b) < at + 10 or any(x & 128 for x in b[at + 6 : at + 10]):
            return None
        pos += 10 + sum(x << 7 * (3 - i) for i, x in enumerate(b[at + 6 : at + 10]))
    first, frames = pos, 0
    while (size := _mp3_frame(b, pos)) and pos + size <= len(b):
        pos, frames = pos + size, frames + 1
    return Medium("audio/mpeg", at, pos - at, ((first, pos - first),), (frames,)) if frames >= 3 else None


def _flac(b: bytes, at: int) -> Medium | None:
    """FLAC: STREAMINFO first, blocks up to the last one, then a frame's sync code."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if kind & 127 == 127 or first != (kind & 127 == 0) or (first and size != 34):
            return None
        first, pos = False, pos + 4 + size
        if kind & 128:
            return Medium("audio/flac", at, len(b) - at, ((pos, len(b) - pos),), ()) if b[pos : pos + 1] == b"\xff" and b[pos + 1 : pos + 2] in (b"\xf8", b"\xf9") else None
    return None


#: Magic bytes, how far they stand behind a medium's start, and the validator of each format. Fixed values of the formats.
FORMATS = {
    b"RIFF": (0, _riff),
    b"\x89PNG\r\n\x1a\n": (0, _png),
    b"BM": (0, _bmp),
    b"P5\n": (0, _pgm),
    b"GIF8": (0, _gif),
    b"\xff\xd8\xff": (0, _jpeg),
    b"ftyp": (4, _mp4),
    b"OggS": (0, _ogg),
    b"ID3": (0, _mp3),
    b"\xff\xfb": (0, _mp3),
    b"\xff\xfa": (0, _mp3),
    b"\xff\xf3": (0, _mp3),
    b"\xff\xf2": (0, _mp3),
    b"fLaC": (0, _flac),
}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for magic in FORMATS:
        auto.add_word(magic.decode("latin-1"), magic)
    auto.make_automaton()
    return auto


def sniff(value: bytes | None) -> list[Medium]:
    """All valid media in the value, outermost first from the left; a hit inside a medium already taken is part of it."""
    found, free = [], 0
    for last, magic in _automaton().iter((value or b"").decode("latin-1")):
        behind, valid = FORMATS[magic]
        at = last + 1 - len(magic) - behind
        if at >= free and (m := valid(value, at)):
            found.append(m)
            free = at + m.length
    return found


def correct_type(value: bytes | None) -> str | None:
    """The type of a value that is one medium as a whole; null if it is none."""
    media = sniff(value)
    return media[0].mime if media and media[0].start == 0 and media[0].length == len(value) else None


def carve(value: bytes | None) -> list[tuple[str, int, bytes]]:
    return [(m.mime, m.start, value[m.start : m.start + m.length]) for m in sniff(value)]


MEDIA = "array<struct<mime:string,offset:long,length:long>>"


def sniffed(df: DataFrame, *, id_col: str, value_col: str, type_col: str) -> DataFrame:
    """(id, declared, mime, wrong, media) for each row: the type by the bytes, null where the value isn't one medium as a
    whole; whether the declared type is another; and all media in the value with their places."""

    def look(batch: pa.RecordBatch) -> dict:
        values = batch["value"].to_pylist()
        media = [sniff(v) for v in values]
        mime = [m[0].mime if m and m[0].start == 0 and m[0].length == len(v) else None for m, v in zip(media, values, strict=True)]
        listed = [[{"mime": x.mime, "offset": x.start, "length": x.length} for x in m] for m in media]
        return {"id": batch["id"], "declared": batch["declared"], "mime": mime, "wrong": [a != b and a is not None for a, b in zip(mime, batch["declared"].to_pylist(), strict=True)], "media": listed}

    cut = df.select(F.col(id_col).alias("id"), F.col(type_col).cast("string").alias("declared"), F.col(value_col).cast("binary").alias("value"))
    schema = StructType([cut.schema["id"], cut.schema["declared"], *_parse_datatype_string(f"mime string, wrong boolean, media {MEDIA}")])
    return map_chunks(cut, look, schema, column="value").withColumnRenamed("id", id_col)


def carved(df: DataFrame, *, id_col: str, value_col: str) -> DataFrame:
    """(id, mime, offset, medium): a row for each medium in a value, cut out of it."""

    def cut_out(batch: pa.RecordBatch) -> dict:
        found = [(i, *x) for i, v in enumerate(batch["value"].to_pylist()) for x in carve(v)]
        return {"id": batch["id"].take(pa.array([x[0] for x in found], pa.int64())), "mime": [x[1] for x in found], "offset": [x[2] for x in found], "medium": [x[3] for x in found]}

    cut = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("binary").alias("value"))
    schema = StructType([cut.schema["id"], *_parse_datatype_string("mime string, offset long, medium binary")])
    return map_chunks(cut, cut_out, schema, column="value").withColumnRenamed("id", id_col)


def padded(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def store_payload(payload: bytes) -> bytes:
    """One of four media with 8-bit samples; which one depends on the payload's checksum only."""
    rows, kind = len(payload) // UNIT, zlib.crc32(payload) % 4
    if kind == 0:
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == 1:
        lines = np.zeros((rows, UNIT + 1), np.uint8)  # filter 0 before each row
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    if kind == 2:
        palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, UNIT, -rows, 1, 8, 0, len(payload), 0, 0, 256, 0) + palette + payload
    return b"P5\n%d %d\n255\n" % (UNIT, rows) + payload


def load_payload(stored: bytes) -> tuple[str, bytes]:
    """The sniffed type and the samples; raises if the value isn't one whole medium of a kind that is stored here."""
    m = next(iter(sniff(stored)), None)
    if m is None or m.start or m.length != len(stored):
        raise ValueError("not one whole medium")
    raw = b"".join(stored[a : a + n] for a, n in m.data)
    if m.mime == "image/png":
        w, h, depth, colour, *_ = m.shape
        lines = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, w + 1)
        if depth != 8 or colour or lines[:, 0].any():
            raise ValueError("only unfiltered grey rows are stored")
        raw = lines[:, 1:].tobytes()
    return m.mime, raw


def features(mime: str, payload: bytes) -> str:
    """Type, sample count, mean and deviation of the samples, distinct values, and share of neighbours that differ."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = counts @ values / len(x)
    spread = max(0.0, counts @ (values * values) / len(x) - mean * mean) ** 0.5
    return f"{mime};n={len(x)};mean={mean:.4f};sd={spread:.4f};distinct={np.count_nonzero(counts)};turns={np.count_nonzero(x[1:] != x[:-1])}"


#: What media_column declares, true for a part of its rows only.
DECLARED = "audio/wav"


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text stored as a medium, all declared as audio. One narrow pass."""

    def keep(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in batch["text"].to_pylist()]
        return {"id": batch["id"], "n_bytes": list(map(len, texts)), "declared": [DECLARED] * len(texts), "media": [store_payload(padded(t)) for t in texts]}

    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([cut.schema["id"], *_parse_datatype_string("n_bytes long, declared string, media binary")])
    return map_chunks(cut, keep, schema).withColumnRenamed("id", id_col)


def media_features(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Reads each stored medium back by its bytes alone and describes it; keeps id and n_bytes. mime is the type by the
    bytes, retyped whether another one was declared."""

    def read(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch["id"], "n_bytes": batch["n_bytes"]}
        stored = batch["media"].to_pylist()
        loaded = [load_payload(m) for m in stored]
        out["payload_bytes"] = [len(p) for _, p in loaded]
        out["payload_sha256"] = [hashlib.sha256(p).hexdigest() for _, p in loaded]
        out["tail_crc32"] = [zlib.crc32(p[-16:]) for _, p in loaded]
        out["media_bytes"] = [len(m) for m in stored]
        out["media_sha256"] = [hashlib.sha256(m).hexdigest() for m in stored]
        out["feature"] = [features(*x) for x in loaded]
        out["mime"] = [m for m, _ in loaded]
        out["retyped"] = [m != d for (m, _), d in zip(loaded, batch["declared"].to_pylist(), strict=True)]
        return out

    cut = media.withColumnRenamed(id_col, "id")
    schema = StructType([cut.schema["id"], *_parse_datatype_string("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, mime string, retyped boolean")])
    return map_chunks(cut, read, schema, column="media").withColumnRenamed("id", id_col)
