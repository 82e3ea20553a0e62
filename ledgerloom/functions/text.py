"""Byte counts and rates as text, in steps of 1000, rounded half up to hundredths; times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB")


def _scaled(x: Column) -> Column:
    """A value goes up a unit as soon as it's over 999.99 of the one below, before it is rounded. Bytes show decimals
    only where there are any; other units always show two."""
    x = x.cast("decimal(38,10)")
    out = F.concat(F.round(x / 10**9, 2).cast("decimal(38,2)").cast("string"), F.lit(" GB"))
    for k in (2, 1):
        value = F.round(x / 1000**k, 2).cast("decimal(38,2)")
        out = F.when(x * 100 <= 99999 * 1000**k, F.concat(value.cast("string"), F.lit(" " + UNITS[k]))).otherwise(out)
    few = F.regexp_replace(F.round(x, 2).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.when(x * 100 <= 99999, F.concat(few, F.lit(" B"))).otherwise(out)


def format_bytes(x: Column) -> Column:
    """999 B, 1.00 KB, 999.99 KB, 1.00 MB, ..."""
    return _scaled(x)


def format_rate(x: Column, ms: Column) -> Column:
    """12.34 B/s, 12.5 B/s, 1.00 KB/s, ...; - B/s over no time."""
    return F.when(ms == 0, F.lit("- B/s")).otherwise(F.concat(_scaled(x.cast("decimal(20,0)") * 1000 / ms.cast("decimal(20,0)")), F.lit("/s")))


def iso_utc(ts: Column) -> Column:
    """A timestamp without zone as ISO text in UTC, to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_utc(text: Column) -> Column:
    """ISO text with or without Z as a timestamp without zone; null where it isn't one."""
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def index_progress(blocks_done: Column, blocks_total: Column, tuples_done: Column, tuples_total: Column) -> Column:
    """Percent of an index build: scanning blocks is 40 of it, loading tuples 60."""

    def share(done: Column, total: Column) -> Column:
        return F.when(total > 0, done / total).otherwise(F.lit(0.0))

    return F.round(40 * share(blocks_done, blocks_total) + 60 * share(tuples_done, tuples_total)).cast("long")
