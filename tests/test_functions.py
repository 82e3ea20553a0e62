import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import bytecode, text
from ledgerloom.functions import bytes as B


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").orderBy("_i").select(*columns).collect()]


def push(n, wide):
    return {1: b"\x4c" + bytes([n % 256]), 2: b"\x4d" + n.to_bytes(2, "little"), 4: b"\x4e" + n.to_bytes(4, "little")}[wide] + b"\x11" * n


def test_little_endian(spark):
    x = F.col("x")
    got = one(spark, [(0,), (255,), (256,), (65534,), (4294967295,), (-2,), (9223372036854775807,)], "x long", B.le_hex(x, 2), B.le_hex(x, 4), B.le_hex(x, 8))
    assert got == [tuple((v % 2 ** (8 * n)).to_bytes(n, "little").hex() for n in (2, 4, 8)) for v in (0, 255, 256, 65534, 4294967295, -2, 9223372036854775807)]
    assert one(spark, [(541065216,)], "x long", B.to_hex(B.uint32le(x))) == [("00004020",)]


def test_compact_and_reverse(spark):
    x = F.col("x")
    want = {0: "00", 252: "fc", 253: "fdfd00", 65535: "fdffff", 65536: "fe00000100", 4294967295: "feffffffff", 4294967296: "ff0000000001000000", 9223372036854775807: "ffffffffffffffff7f"}
    assert one(spark, [(v,) for v in want], "x long", B.compact_uint_hex(x)) == [(h,) for h in want.values()]
    assert one(spark, [(bytearray(b"\xff\x80\xc3\xa9\x01"),), (bytearray(),), (None,)], "x binary", B.to_hex(B.reverse_bytes(x))) == [("01a9c380ff",), ("",), (None,)]
    with pytest.raises(Exception, match="invalid hexadecimal"):
        one(spark, [("xy",)], "x string", B.from_hex(x))


PATTERNS = [
    ("76a914" + "00" * 20 + "88ac", "76a91488ac", "76a91488ac"),
    ("a914" + "00" * 20 + "87", "a91487", "a91487"),
    ("6a04000000005120" + "00" * 32 + "04000000000400000000", "6a0451200404", "6a0451200404"),
    ("6a026d0c09" + "00" * 9 + "4c5c" + "00" * 92, "6a02094c", "6a02094c5c"),
    ("6a" + push(256, 2).hex() + "515151", "6a4d515151", "6a4d0001515151"),
    ("515102", "515102", "515102"),
    ("51514c", "51514c", "51514c"),
    ("51514d11", "51514d", "51514d"),
    ("51514e112233", "51514e", "51514e"),
    ("4effffffff", "4e", "4e"),
    ("4c00", "4c", "4c00"),
    ("4d0000", "4d", "4d0000"),
    ("4e00000000", "4e", "4e00000000"),
    ("", "", ""),
]


def test_patterns(spark):
    s = F.col("s")
    rows = [(bytearray.fromhex(h),) for h, _, _ in PATTERNS] + [(None,)]
    got = one(spark, rows, "s binary", bytecode.pattern_hex(s), bytecode.pattern_hex(s, True))
    assert got == [(a, b) for _, a, b in PATTERNS] + [(None, None)]


def test_redeem(spark):
    want = {"0002000051": None, "0003019951": "0151", "00020000": "0000", "0003510151": "5101"}
    inner = b"\x00" + push(76, 1) + b"\x51\x52\x53"
    want["00020000" + push(len(inner), 1)[:2].hex() + inner.hex()] = "004c515253"
    want |= dict.fromkeys(("4c", "4d11", "4e112233", "4effffffff", "", "0251"), None)
    want |= {"4c00": "", "51": None}
    got = one(spark, [(bytearray.fromhex(h),) for h in want], "s binary", bytecode.redeem_pattern_hex(F.col("s")))
    assert got == [(v,) for v in want.values()]


def test_text(spark):
    x, ms = F.col("x"), F.col("ms")
    sizes = {0: "0 B", 7: "7 B", 999: "999 B", 1000: "1.00 KB", 73456: "73.46 KB", 999990: "999.99 KB", 999991: "1.00 MB", 999995: "1.00 MB", 8125000: "8.13 MB", 999990000: "999.99 MB", 999990001: "1.00 GB", 31415926535: "31.42 GB"}
    assert one(spark, [(v,) for v in sizes], "x long", text.format_bytes(x)) == [(v,) for v in sizes.values()]
    rates = {(0, 0): "- B/s", (9, 0): "- B/s", (1234, 100000): "12.34 B/s", (125, 10000): "12.5 B/s", (640, 80000): "8 B/s", (1, 300000): "0 B/s", (9996, 10000): "999.6 B/s", (99999, 100000): "999.99 B/s", (999992, 1000000): "1.00 KB/s", (77000, 3500): "22.00 KB/s", (6, 5): "1.20 KB/s", (999995, 1000): "1.00 MB/s"}
    assert one(spark, list(rates), "x long, ms long", text.format_rate(x, ms)) == [(v,) for v in rates.values()]
    when = one(spark, [("2031-05-17T08:30:00.250Z",), ("2031-05-17 08:30:00",), ("soon",)], "x string", text.iso_utc(text.parse_utc(x)))
    assert when == [("2031-05-17T08:30:00.250Z",), ("2031-05-17T08:30:00.000Z",), (None,)]
    rows = {(50, 200, 0, 0): 10, (200, 200, 0, 90): 40, (200, 200, 45, 90): 70, (200, 200, 90, 90): 100, (0, 0, 0, 0): 0}
    assert one(spark, list(rows), "a long, b long, c long, d long", text.index_progress(*map(F.col, "abcd"))) == [(v,) for v in rows.values()]
