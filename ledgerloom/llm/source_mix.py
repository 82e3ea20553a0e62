"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Each source gets a target: its share of all words by weight, at most `most` times its own size, the
excess reshared by weight until no target is above (the level at which capped targets sum to all words). A document's
expected copies are in proportion to its own weight (rounded to eighth powers of two), at most `most`, and their words
sum to the target: a level is found among the weights of each source as among the sources. Whole copies are allocated
for certain; the fraction left is the document's inclusion probability. The rest of the target is filled by Pareto
order sampling: documents are ranked by the odds of a uniform draw divided by the odds of their inclusion
probability, and selected in the order of their ranks. The sample's size is fixed in words: a document that is
longer than the words still missing is passed over, so that one long document at the cut doesn't leave a gap of half its
size, and at last the shortest one passed over is taken if that comes nearer. Only ranks behind the first document that
doesn't fit are affected; before it the sample is the plain Pareto sample.

The ranks are never sorted as a whole. They are binned (2**16 bins of q / (1 + q)); a histogram by source and bin finds
the bin where the remainder runs out; all lower bins are selected, and only the keys (rank, hash, size) of the bins
that hold the next `tail` documents are ordered, for each source. While words are missing, the same is repeated over
the ranks behind, with the documents that the room left can hold, until none is left: each source is filled as if all
its ranks were read in order. What the keys decide is joined back by hash; no row with its text is ever grouped.

Draws are hashes of seed, id and text: reruns agree, and the plan's partitioning doesn't matter.

Defined cases: null or empty texts have size 0 and take 0 words; a null source is a source of its own, last in order;
repeated rows draw alike and are ordered arbitrarily among themselves, which doesn't change the multiset of results; null ids
are drawn by text; an empty table gives none; other columns don't matter, whatever their names, unless carried. Weights
that are null or not positive count as the least one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD_RE, importable, named, stored

BINS = 1 << 16
RANK = [("z", "ascending"), ("h", "ascending"), ("size", "ascending")]


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row a source, so its windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everywhere = Window.partitionBy(F.lit(1))
    s = s.withColumns({"total": F.sum("source_size").over(everywhere), "caps": F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "left": F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("full", F.col("w") * (F.col("total") - F.col("caps")) / F.col("left") > F.col("cap"))
    s = s.withColumns({"used": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everywhere), F.lit(0.0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(everywhere)})
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - F.col("used")) * F.col("w") / F.col("open")).alias("target"))


def _fill(room: int, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """In rank order, take what fits the room; and the room left."""
    take = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if 0 < size <= room:
            take[i], room = True, room - size
    return take, room


def levels(classes: DataFrame, most: float) -> DataFrame:
    """hope by (source, w): min(most, c * w), with c such that the words of a source's classes, hope times each, sum to
    its target. classes: (source, w, words, target); a source has at most a few hundred."""
    every = Window.partitionBy("source")
    heavier = every.orderBy(F.col("w").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = every.orderBy(F.col("w").desc()).rowsBetween(0, Window.unboundedFollowing)
    c = classes.withColumns({"before": F.coalesce(F.sum("words").over(heavier), F.lit(0)), "mass": F.sum(F.col("words") * F.col("w")).over(rest)})
    c = c.withColumn("c", F.when(F.col("mass") > 0, (F.col("target") - most * F.col("before")) / F.col("mass")))  # if all heavier classes are full
    full = F.col("c") * F.col("w") > most
    c = c.withColumn("full", F.coalesce(full, F.lit(False)))
    c = c.withColumn("level", F.max(F.when(~F.col("full"), F.struct(-F.col("before"), "c"))).over(every)["c"])  # the first class that isn't full
    return c.select("source", "w", F.when(F.col("full") | (F.col("words") == 0), F.when(F.col("words") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("w"))).alias("hope"))


def eighths(weight: Column) -> Column:
    """A weight rounded to an eighth power of two, between 2**-16 and 2**16."""
    return F.pow(F.lit(2.0), F.round(8 * F.log2(F.least(F.greatest(F.coalesce(F.when(weight > 0, weight), F.lit(0.0)), F.lit(2.0**-16)), F.lit(2.0**16)))) / 8)


def by_length(size: Column) -> Column:
    """Longer documents are likelier, by the logarithm of their words."""
    return F.log2(size + 2)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | Callable[[Column], Column] | None = None, seed: int = 17, tail: int = 256, carry: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row; with carry, all columns of docs under
    `row` (a struct) and copies. weight is a document's weight, as a column of docs or as a function of its size."""
    size = F.coalesce(F.regexp_count(named(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")
    small = {"id": named(id_col), "source": named(source_col), "size": size, "h": F.xxhash64(F.lit(seed), named(id_col), named(text_col)), "w": weight if isinstance(weight, Column) else F.lit(1.0)}

    def weighed(*carried: Column) -> DataFrame:
        """What counts of each row; words are counted once, whatever the weight makes of them."""
        rows = docs.select(*carried, *[c.alias(n) for n, c in small.items()])
        w = F.col("w") if weight is None or isinstance(weight, Column) else weight(F.col("size"))
        return rows.withColumn("w", F.lit(1.0) if weight is None else eighths(w.cast("double")))

    sized = stored(weighed(), "mix-sizes")
    classes = stored(sized.groupBy("source", "w").agg(F.sum("size").alias("words")), "mix-classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goal = goal.withColumnRenamed("source", "_k").join(classes, F.col("source").eqNullSafe(F.col("_k"))).drop("_k")
    hopes = levels(goal, most).withColumnsRenamed({"source": "_k", "w": "_kw"})
    goal = stored(goal.join(hopes, F.col("source").eqNullSafe(F.col("_k")) & (F.col("w") == F.col("_kw"))).select("source", "w", "source_size", "target", F.round("hope", 12).alias("hope")), "mix-targets")

    def with_goal(rows: DataFrame) -> DataFrame:
        t = goal.withColumnsRenamed({"source": "_k", "w": "_kw"})
        t = F.broadcast(t) if goal.count() <= 10_000 else t
        rows = rows.join(t, F.col("source").eqNullSafe(F.col("_k")) & (F.col("w") == F.col("_kw"))).drop("_k", "_kw")
        rows = rows.withColumn("whole", F.floor("hope"))
        lam = F.greatest(F.least(F.col("hope") - F.col("whole"), F.lit(1 - 1e-9)), F.lit(1e-9))
        u = (F.pmod("h", F.lit(1 << 52)) + 0.5) / float(1 << 52)
        q = (u / (1 - u)) / (lam / (1 - lam))
        at = F.col("q") / (1 + F.col("q"))
        more = F.col("whole") < most
        return rows.withColumn("q", q).withColumn("z", at).withColumn("bin", F.when(more, F.least(F.floor(at * BINS), F.lit(BINS - 1))))

    ranked = with_goal(sized)

    def beside(rows: DataFrame, t: DataFrame) -> DataFrame:
        """rows with the columns of t, which has one row a source."""
        t = t.withColumnRenamed("source", "_k")
        t = F.broadcast(t) if t.count() <= 10_000 else t
        return rows.join(t, F.col("source").eqNullSafe(F.col("_k"))).drop("_k")

    def left_in(t: pa.Table) -> pa.Table:
        t = t.sort_by(RANK)
        _, left = _fill(t["start"][0].as_py(), t["size"].to_numpy())
        return t.select(["source"]).slice(0, 1).append_column("left", pa.array([left], pa.int64()))

    up, all_of = Window.partitionBy("source").orderBy("bin"), Window.partitionBy("source")
    state = ranked.groupBy("source").agg(F.round(F.first("target") - F.sum(F.col("size") * F.col("whole"))).cast("long").alias("room"), F.lit(0).cast("long").alias("lo"))
    state, rounds = stored(state, "mix-rooms"), []
    while (going := state.where((F.col("room") > 0) & (F.col("lo") < BINS))).limit(1).count():
        fit = beside(ranked, going).where((F.col("size") > 0) & (F.col("size") <= F.col("room")) & (F.col("bin") >= F.col("lo")))
        bins = fit.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("room").alias("room"), F.first("lo").alias("lo"))
        bins = bins.withColumns({"cum": F.sum("words").over(up), "seen": F.sum("n").over(up)}).withColumn("low", F.col("cum") <= F.col("room"))
        bins = bins.withColumn("had", F.coalesce(F.max(F.when(F.col("low"), F.col("seen"))).over(all_of), F.lit(0)))
        zone = bins.groupBy("source").agg(F.first("room").alias("room"), F.first("lo").alias("lo"), F.min(F.when(~F.col("low"), F.col("bin"))).alias("cut"), (F.first("room") - F.coalesce(F.max(F.when(F.col("low"), F.col("cum"))), F.lit(0))).alias("start"), F.min(F.when(~F.col("low") & (F.col("seen") >= F.col("had") + tail), F.col("bin"))).alias("end"))
        zone = stored(zone.withColumns({"cut": F.coalesce("cut", F.lit(BINS)), "end": F.coalesce("end", F.lit(BINS))}), "mix-cuts")
        rounds.append(zone)
        near = beside(ranked, zone).where((F.col("size") > 0) & (F.col("size") <= F.col("start")) & (F.col("bin") >= F.col("cut")) & (F.col("bin") <= F.col("end")))
        filled = importable(near.select("source", "start", "size", "z", "h")).groupBy("source").applyInArrow(left_in, StructType([ranked.schema["source"], StructField("left", LongType())]))
        filled = zone.select(F.col("source").alias("_z"), "start", "end").join(filled.withColumnRenamed("source", "_f"), F.col("_z").eqNullSafe(F.col("_f")), "left")
        filled = filled.select("_z", F.coalesce("left", "start").alias("left"), (F.col("end") + 1).alias("next"))
        # a source without a row in zone has nothing left that fits
        state = stored(state.join(filled, F.col("source").eqNullSafe(F.col("_z")) & (F.col("lo") < BINS), "left").select("source", F.coalesce("left", "room").alias("room"), F.coalesce("next", F.lit(BINS + 1)).cast("long").alias("lo")), "mix-rooms")
    plan = state.select("source", F.col("room").alias("left"))
    if rounds:
        past = reduce(DataFrame.unionByName, rounds).groupBy(F.col("source").alias("_z")).agg(F.collect_list(F.struct("lo", "cut", "end", "room", "start")).alias("rounds"))
        plan = plan.join(past, F.col("source").eqNullSafe(F.col("_z")), "left").drop("_z")
    else:
        plan = plan.withColumn("rounds", F.expr("cast(null as array<struct<lo: long, cut: long, end: long, room: long, start: long>>)"))
    plan = stored(plan, "mix-plan")

    def planned(rows: DataFrame) -> DataFrame:
        """rows with `picked` (1 if selected by bin), `start` (the room at the cut, if they are near it) and `left`."""
        at = F.filter("rounds", lambda r: (F.col("bin") >= r["lo"]) & (F.col("bin") <= r["end"]))
        rows = beside(rows, plan).withColumn("at", F.try_element_at(at, F.lit(1))).drop("rounds")
        below = (F.col("bin") < F.col("at.cut")) & (F.col("size") <= F.col("at.room"))
        near = (F.col("bin") >= F.col("at.cut")) & (F.col("size") <= F.col("at.start"))
        some = F.col("size") > 0
        return rows.withColumn("picked", F.coalesce(some & below, F.lit(False)).cast("long")).withColumn("start", F.when(some & near, F.col("at.start"))).drop("at")

    # the shortest document that was skipped, if it comes nearer
    skipped = planned(ranked).where(F.col("bin").isNotNull() & (F.col("picked") == 0) & F.col("start").isNull() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left")))
    spare = skipped.groupBy("source").agg(F.min(F.struct("size", "z", "h")).alias("spare"))
    plan = stored(plan.join(spare.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")

    if carry:
        rows = with_goal(weighed(F.struct(*map(named, docs.columns)).alias("row")))
    else:
        rows = ranked

    def inside(rows: DataFrame) -> Column:
        last = F.col("bin").isNotNull() & (F.col("picked") == 0) & (F.struct("size", "z", "h") == F.col("spare"))
        return F.col("start").isNotNull() | F.coalesce(last, F.lit(False))

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by(RANK)
        sizes, start, left = t["size"].to_numpy(), t["start"].fill_null(0).to_numpy(), t["left"][0].as_py()
        take = np.zeros(len(sizes), bool)
        for room in np.unique(start).tolist():  # each cut has its own room; one that took nothing may share it with the next
            at = np.flatnonzero(start == room)
            take[at], _ = _fill(room, sizes[at])
        rest = np.flatnonzero(~take)
        if left > 0 and len(rest):
            small = rest[np.argmin(sizes[rest])]
            take[small] = sizes[small] < 2 * left
        return t.select(["source", "h"]).filter(pa.array(take))

    keys = planned(ranked)
    keys = importable(keys.where(inside(keys)).select("source", "size", "z", "h", "start", "left")).groupBy("source").applyInArrow(choose, StructType([ranked.schema["source"], ranked.schema["h"]]))
    chosen = stored(keys.groupBy(F.col("source").alias("_c"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_m")), "mix-chosen")

    rows = planned(rows)
    out = [*(["row"] if carry else []), "id", "source", "size", "source_size", "target"]
    sure = rows.where(~inside(rows)).select(*out, (F.col("whole") + F.col("picked")).alias("copies"))
    near = rows.where(inside(rows)).select(*out, "h", "whole").join(chosen.hint("merge"), (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_c")), "left")
    among = Window.partitionBy("source", "h").orderBy(F.lit(1))  # rows that are the same in all that counts
    near = near.withColumn("_n", F.row_number().over(among)).select(*out, (F.col("whole") + F.coalesce(F.col("_n") <= F.col("_m"), F.lit(False)).cast("long")).alias("copies"))
    both = sure.unionByName(near).withColumn("taken", F.col("copies") * F.col("size"))
    return both if carry else both.withColumnsRenamed({"id": id_col, "source": source_col})
