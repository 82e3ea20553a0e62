import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import media_columns as M


def test_media_tables(documents, odd, none):
    for df in (documents, odd, none):
        got = M.media_features(M.media_column(df)).collect()
        want, by = Counter(), {}
        for r in df.collect():
            b = (r.text or "").encode()
            p = b + b" " * (192 - len(b) % 192 if len(b) % 192 or not b else 0)
            want[(r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        for r in got:
            assert by.setdefault(r.payload_sha256, tuple(r)[2:]) == tuple(r)[2:]


@pytest.mark.parametrize("text", [b"", b"abc" * 500, bytes(range(256)) * 3, b"RIFF BM P5\n GIF89a" * 40, b"x"])
def test_store_load(text):
    p = M.padded(text)
    stored = M.store_payload(p)
    mime, back = M.load_payload(stored)
    assert back == p and M.correct_type(stored) == mime
    junk = b"BM RIFF junk" + stored + b"P5\n trailing"
    assert M.correct_type(junk) is None and (mime, 12, stored) in M.carve(junk)


def test_all_kinds_and_damage():
    kinds = {M.load_payload(s)[0]: s for i in range(40) if (s := M.store_payload(M.padded(b"%d" % i * 99)))}
    assert len(kinds) == 4
    for s in kinds.values():
        assert M.correct_type(s[:-1]) is None
    png = bytearray(kinds["image/png"])
    png[60] ^= 1
    assert M.sniff(bytes(png)) == []
    assert M.sniff(None) == [] and M.correct_type(b"") is None
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    assert M.correct_type(gif) == "image/gif"


def ogg_page(flags, body, serial=7):
    head = b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<II", serial, 0)
    rest = bytes([1, len(body)]) + body
    crc = 0
    for x in head + bytes(4) + rest:  # bit by bit, as the format defines it
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return head + struct.pack("<I", crc) + rest


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def riff(kind, *chunks):
    body = kind + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


FRAME = b"\xff\xfb\x90\x00" + bytes(413)  # 128 kbit/s at 44,100 Hz: 417 bytes
SMALL = {
    "image/jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0?\0\x12\xff\0\x34\xff\xd3\x56\xff\xd9",
    "image/webp": riff(b"WEBP", (b"VP8L", b"/\0\0\0\0")),
    "video/mp4": box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", bytes(20))) + box(b"mdat", b"media"),
    "audio/ogg": ogg_page(2, b"OpusHead head") + ogg_page(0, b"packet") + ogg_page(4, b"last"),
    "audio/mpeg": b"ID3\x04\0\0\0\0\0\x05hello" + FRAME * 3,
    "audio/flac": b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8frames",
}


@pytest.mark.parametrize("mime", SMALL)
def test_other_formats(mime):
    whole = SMALL[mime]
    assert M.correct_type(whole) == mime
    if mime != "audio/flac":  # it doesn't say where it ends
        inside = b"some text " + whole + b" and more"
        assert [(m, at, v) for m, at, v in M.carve(inside) if m == mime] == [(mime, 10, whole)]
        assert M.correct_type(whole + b"tail") is None
    for n in range(len(whole)):  # cut anywhere, no crash; and no whole medium of the full length
        assert all(m.start + m.length <= n for m in M.sniff(whole[:n]))
    noise = random.Random(len(whole))
    for _ in range(300):
        bent = bytearray(whole)
        for _ in range(noise.randrange(1, 4)):
            bent[noise.randrange(len(bent))] = noise.randrange(256)
        assert all(0 <= m.start and m.start + m.length <= len(bent) for m in M.sniff(bytes(bent)))


def test_types_and_carving_of_columns(spark):
    rows = [(i, "image/png" if i % 2 else mime, bytearray(v), 1, "x") for i, (mime, v) in enumerate(SMALL.items())]
    rows += [(20, "image/gif", None, 1, "x"), (21, None, bytearray(b""), 1, None), (22, None, bytearray(SMALL["image/webp"]), 1, "x"), (None, "text/plain", bytearray(b"BM no medium"), 1, "x")]
    rows += [(23, "text/plain", bytearray(b"a " + SMALL["image/jpeg"] + b" b " + SMALL["video/mp4"]), 1, "x")] * 2
    df = spark.createDataFrame(rows, "id long, declared string, body binary, offset int, media string")
    got = {r.id: r for r in M.sniffed(df, id_col="id", value_col="body", type_col="declared").collect()}
    for i, mime in enumerate(SMALL):
        assert (got[i].mime, got[i].wrong) == (mime, bool(i % 2))
    assert got[20].mime is None and not got[20].wrong and got[21].media == [] and got[22].wrong and got[None].mime is None
    assert [(m.mime, m.offset) for m in got[23].media] == [("image/jpeg", 2), ("video/mp4", 5 + len(SMALL["image/jpeg"]))] and got[23].mime is None
    cut = Counter((r.id, r.mime, r.offset, bytes(r.medium)) for r in M.carved(df, id_col="id", value_col="body").collect())
    assert cut[23, "image/jpeg", 2, SMALL["image/jpeg"]] == 2 and cut[22, "image/webp", 0, SMALL["image/webp"]] == 1
    assert M.sniffed(df.limit(0), id_col="id", value_col="body", type_col="declared").collect() == M.carved(df.limit(0), id_col="id", value_col="body").collect() == []


def test_features():
    for text in (b"abc", b"", bytes(range(200)) * 2, b"\xff" * 500):
        x = list(M.padded(text))
        mean = sum(x) / len(x)
        sd = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        got = dict(f.split("=") for f in M.features("t", bytes(x)).split(";")[1:])
        assert int(got["n"]) == len(x) and abs(float(got["mean"]) - mean) < 1e-3 and abs(float(got["sd"]) - sd) < 1e-3
        assert int(got["distinct"]) == len(set(x)) and int(got["turns"]) == sum(a != b for a, b in zip(x, x[1:]))
