"""Byte encoders over hex text: pure column expressions, inside whole-stage code generation where Spark allows it.

Functions that end in _hex take and give lower-case hex text; `to_hex` and `from_hex` convert at the edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(h: Column) -> Column:
    """Raises on text that isn't hex, where unhex would give null."""
    return F.when(h.isNull() | h.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(h)).otherwise(F.raise_error(F.concat(F.lit("invalid hexadecimal data: "), h)))


def reverse_bytes(b: Column) -> Column:
    """Byte order reversed. Spark's reverse() on binary reverses the characters of UTF-8; in ISO-8859-1 each byte is one."""
    return F.encode(F.reverse(F.decode(b, "ISO-8859-1")), "ISO-8859-1")


def reverse_hex(h: Column) -> Column:
    return F.lower(F.hex(reverse_bytes(F.unhex(h))))


def le_hex(x: Column, size: int) -> Column:
    """The low `size` bytes of a long, least significant first (two's complement)."""
    full = F.lpad(F.lower(F.hex(x.cast("long"))), 16, "0")
    return F.concat(*[F.substring(full, 15 - 2 * i, 2) for i in range(size)])


def uint16le(x: Column) -> Column:
    return F.unhex(le_hex(x, 2))


def uint32le(x: Column) -> Column:
    return F.unhex(le_hex(x, 4))


int32le = uint32le


def uint64le(x: Column) -> Column:
    return F.unhex(le_hex(x, 8))


def compact_uint_hex(x: Column) -> Column:
    return (
        F.when(x <= 252, le_hex(x, 1))
        .when(x <= 65535, F.concat(F.lit("fd"), le_hex(x, 2)))
        .when(x <= 4294967295, F.concat(F.lit("fe"), le_hex(x, 4)))
        .otherwise(F.concat(F.lit("ff"), le_hex(x, 8)))
    )


def compact_uint(x: Column) -> Column:
    return F.unhex(compact_uint_hex(x))


def compact_uint_length(x: Column) -> Column:
    return F.when(x <= 252, 1).when(x <= 65535, 3).when(x <= 4294967295, 5).otherwise(9)


def prefixed(b: Column) -> Column:
    """Bytes as the query layer shows them: \\x and hex."""
    return F.concat(F.lit("\\x"), to_hex(b))
