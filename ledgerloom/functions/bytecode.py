"""Script patterns: opcodes with pushed data left out, as a fold over the script's bytes in Catalyst.

The fold walks the positions of a script once; its state is the next position that holds an opcode, the hex of the
pattern, and where the last push lies. A push is 1-75 (that many bytes follow) or 76, 77, 78 (1, 2 or 4 length
bytes, then the data). A push operation without all its length bytes, or a 4-byte length with the top bit set, ends
the script after its opcode. A push may run past the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes import reverse_hex

_DONE = -1


def _byte(script: Column, at: Column) -> Column:
    """The byte at a 1-based position, as a long."""
    return F.conv(F.hex(script.substr(at.cast("int"), F.lit(1))), 16, 10).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once and named once in the plan."""
    return F.transform(F.array(value), f)[0]


def walked(script: Column) -> Column:
    """struct(next, pattern, wide, first, size) of one fold: the pattern, the pattern with the length bytes of 76, 77 and 78
    kept, and first and size of the last operation's data, null unless it's a full push. script must be a plain column
    or a name bound by _let."""
    n = F.octet_length(script).cast("long")
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(1).cast("long").alias("next"), F.lit("").alias("pattern"), F.lit("").alias("wide"), none.alias("first"), none.alias("size"))

    def pushed(at: Column, op: Column, wide: Column) -> Column:
        """Bytes that the operation pushes; null if it isn't a push, or is broken."""
        length = F.conv(reverse_hex(F.hex(script.substr((at + 1).cast("int"), wide.cast("int")))), 16, 10).cast("long")
        whole = F.when((wide > 0) & (at + wide <= n), length)
        return F.when(op.between(1, 75), op).when(whole < 1 << 31, whole)

    def moved(state: Column, at: Column, op: Column, wide: Column, size: Column) -> Column:
        first = at + 1 + wide
        broken = (wide > 0) & size.isNull()
        shown = F.when((wide > 0) & ~broken, wide + 1).otherwise(F.lit(1))
        fits = first + size - 1 <= n
        return F.struct(
            F.when(broken, F.lit(_DONE)).when(size.isNull(), at + 1).otherwise(first + size).cast("long").alias("next"),
            F.concat(state["pattern"], F.lower(F.hex(script.substr(at.cast("int"), F.lit(1))))).alias("pattern"),
            F.concat(state["wide"], F.lower(F.hex(script.substr(at.cast("int"), shown.cast("int"))))).alias("wide"),
            F.when(fits, first).cast("long").alias("first"),
            F.when(fits, size).cast("long").alias("size"),
        )

    def step(state: Column, k: Column) -> Column:
        at = k.cast("long")

        def with_op(op: Column) -> Column:
            wide = F.when(op == 76, 1).when(op == 77, 2).when(op == 78, 4).otherwise(0).cast("long")
            return _let(wide, lambda w: _let(pushed(at, op, w), lambda size: moved(state, at, op, w, size)))

        return F.when(state["next"] == at, _let(_byte(script, at), with_op)).otherwise(state)

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), start, step)


def pattern_hex(script: Column, lengths: bool = False) -> Column:
    """Hex of the pattern; with lengths, the length bytes of 76, 77 and 78 are kept. Null script, null pattern."""
    return F.when(script.isNotNull(), walked(script)["wide" if lengths else "pattern"])


def of_scripts(df: DataFrame, script: str, **columns: Callable[[Column], Column]) -> DataFrame:
    """df with columns that depend on a script alone, made once for each different script: scripts repeat, and a fold over
    their bytes costs more than meeting them again. They hang on the scripts' counts, so that a later filter on them isn't
    moved to where all rows still are."""
    kinds = df.select(F.col(script).alias("_s")).where("_s is not null").groupBy("_s").agg(F.count(F.lit(1)).alias("_times"))
    kinds = kinds.select("_s", *[F.when(F.col("_times") > 0, f(F.col("_s"))).alias(name) for name, f in columns.items()])
    return df.join(kinds, F.col(script) == F.col("_s"), "left").drop("_s")


def pattern_counts(df: DataFrame, script: str, count: str, redeem: bool = False) -> DataFrame:
    """How many rows have a pattern: (pattern, with_lengths), or with the redeemed script's pattern (pattern, redeem). Scripts
    are counted first, then each different one is walked once."""
    scripts = df.groupBy(F.col(script).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    scripts = scripts.withColumn("_w", F.when(F.col("_s").isNotNull(), walked(F.col("_s"))))
    both = [F.col("_w.pattern").alias("pattern"), redeem_pattern_hex(F.col("_s")).alias("redeem") if redeem else F.col("_w.wide").alias("with_lengths")]
    return scripts.select("_n", *both).groupBy("pattern", "redeem" if redeem else "with_lengths").agg(F.sum("_n").alias(count))


def redeem_pattern_hex(script: Column) -> Column:
    """Hex of the pattern of what the last operation pushes; null unless that is a complete push."""

    def of(last: Column) -> Column:
        data = F.when(last["size"].isNotNull(), script.substr(last["first"].cast("int"), last["size"].cast("int")))
        return _let(data, lambda d: F.when(d.isNotNull(), walked(d)["pattern"]))

    return F.when(script.isNotNull(), _let(walked(script), of))


def is_data_carrier(value: Column, script: Column) -> Column:
    return (value == 0) | ((F.octet_length(script) > 0) & (F.substring(script, 1, 1) == F.lit(b"\x6a")))


def is_p2sh(script: Column) -> Column:
    """As its pattern is a91487, read off the length and both ends."""
    return (F.octet_length(script) == 23) & script.startswith(F.lit(b"\xa9\x14")) & script.endswith(F.lit(b"\x87"))
