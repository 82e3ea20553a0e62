"""Pending transactions of each source: what replaces, confirms, invalidates or expires them.

Every transition reads the state before it and gives an Archive: the pending rows that remain, and the rows that go to
history, as (node_internal_id, transaction_internal_id, validated_at, replaced_at). replaced_at is null for confirmed
rows. Where several events archive one row, a confirmation wins, then the earliest time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..schema import ZERO_HASH
from ..sources.ledger import Ledger

KEY = ["node_internal_id", "transaction_internal_id"]


class Archive(NamedTuple):
    pending: DataFrame
    history: DataFrame


def _outpoints(ledger: Ledger, tx: str, of: DataFrame | None = None) -> DataFrame:
    """What each transaction spends, issuance left out; of: only these transactions (transaction_internal_id)."""
    i = ledger["input"].where(F.col("outpoint_transaction_hash") != F.unhex(F.lit(ZERO_HASH)))
    if of is not None:
        i = i.join(of.select("transaction_internal_id").distinct(), "transaction_internal_id", "left_semi")
    return i.select(F.col("transaction_internal_id").alias(tx), "outpoint_transaction_hash", "outpoint_index")


def conflicts(ledger: Ledger, a: str, b: str, of_a: DataFrame | None, of_b: DataFrame) -> DataFrame:
    """Distinct pairs of different transactions, one of of_a (None: any) and one of of_b, that spend a common output."""
    return _outpoints(ledger, a, of_a).join(_outpoints(ledger, b, of_b), ["outpoint_transaction_hash", "outpoint_index"]).where(F.col(a) != F.col(b)).select(a, b).distinct()


def _archive(pending: DataFrame, events: DataFrame) -> Archive:
    """events: KEY and replaced_at, any number for a row."""
    one = events.groupBy(*KEY).agg(F.when(F.bool_or(F.col("replaced_at").isNull()), F.lit(None).cast("timestamp_ntz")).otherwise(F.min("replaced_at")).alias("replaced_at"))
    return Archive(pending.join(one, KEY, "left_anti"), pending.join(one, KEY).select(*KEY, "validated_at", "replaced_at"))


def replace(ledger: Ledger, new: DataFrame) -> Archive:
    """new: pending rows just added. Other pending rows of the same source that spend an output of theirs go, at the
    time the new one was validated."""
    pending = ledger["node_transaction"]
    hits = new.select("node_internal_id", F.col("transaction_internal_id").alias("added"), F.col("validated_at").alias("replaced_at")).join(conflicts(ledger, "added", "transaction_internal_id", new, pending), "added")
    return _archive(pending, hits.select(*KEY, "replaced_at"))


def accept(ledger: Ledger, accepted: DataFrame) -> Archive:
    """accepted: node_block rows just added. Pending rows of the same source that a block holds are confirmed; those
    that conflict with one of its transactions go at the time of acceptance (null where that isn't known)."""
    pending = ledger["node_transaction"]
    # from the pending rows to the blocks: all that blocks hold, once for each source, would be many times more
    same = pending.select("transaction_internal_id", F.col("transaction_internal_id").alias("mined")).distinct()
    rivals = conflicts(ledger, "mined", "transaction_internal_id", None, pending).select("transaction_internal_id", "mined")
    held = same.unionAll(rivals).join(ledger["block_transaction"].select("block_internal_id", F.col("transaction_internal_id").alias("mined")), "mined")
    rows = pending.select(*KEY).join(held, "transaction_internal_id").join(accepted, ["node_internal_id", "block_internal_id"])
    return _archive(pending, rows.select(*KEY, F.when(F.col("mined") != F.col("transaction_internal_id"), F.col("accepted_at")).alias("replaced_at")))


def _children(ledger: Ledger, source: str, child: str) -> DataFrame:
    """Pending transactions and the stored ones that they spend from."""
    t = ledger["transaction"].select(F.col("internal_id").alias(source), F.col("hash").alias("outpoint_transaction_hash"))
    return _outpoints(ledger, child, ledger["node_transaction"]).join(t, "outpoint_transaction_hash").select(source, child).distinct()


def _spread(ledger: Ledger, events: DataFrame) -> Archive:
    """Archives the events' rows and all pending descendants of the same source, each at the earliest time of any path."""
    pending = ledger["node_transaction"]
    edges = stored(_children(ledger, "transaction_internal_id", "child"))
    live = stored(pending.select(*KEY))
    front = stored(events.join(live, KEY, "left_semi").groupBy(*KEY).agg(F.min("replaced_at").alias("replaced_at")))
    best = front
    while not front.isEmpty():
        reach = front.join(edges, "transaction_internal_id").select("node_internal_id", F.col("child").alias("transaction_internal_id"), "replaced_at").join(live, KEY, "left_semi")
        reach = reach.groupBy(*KEY).agg(F.min("replaced_at").alias("replaced_at"))
        old = best.withColumnRenamed("replaced_at", "old")
        front = stored(reach.join(old, KEY, "left").where(F.col("old").isNull() | (F.col("replaced_at") < F.col("old"))).drop("old"))
        best = stored(best.unionAll(front).groupBy(*KEY).agg(F.min("replaced_at").alias("replaced_at")))
    return _archive(pending, best)


def invalidate(ledger: Ledger, replaced: DataFrame) -> Archive:
    """replaced: history rows just added. The pending descendants of those with replaced_at go with them."""
    seeds = replaced.where("replaced_at is not null").select(*KEY, "replaced_at")
    kids = _children(ledger, "transaction_internal_id", "child")
    first = seeds.join(kids, "transaction_internal_id").select("node_internal_id", F.col("child").alias("transaction_internal_id"), "replaced_at")
    return _spread(ledger, first)


def backfill_orphans(ledger: Ledger) -> Archive:
    """As invalidate, from all of history: seeds spend a stored output of a replaced transaction. Running it again
    changes nothing."""
    gone = ledger["node_transaction_history"].where("replaced_at is not null").select("node_internal_id", F.col("transaction_internal_id").alias("source"), "replaced_at")
    t = ledger["transaction"].select(F.col("internal_id").alias("source"), F.col("hash").alias("outpoint_transaction_hash"))
    there = ledger["output"].select(F.col("transaction_hash").alias("outpoint_transaction_hash"), F.col("output_index").alias("outpoint_index"))
    spends = _outpoints(ledger, "transaction_internal_id", ledger["node_transaction"]).join(there, ["outpoint_transaction_hash", "outpoint_index"], "left_semi").join(t, "outpoint_transaction_hash").select("source", "transaction_internal_id").distinct()
    return _spread(ledger, gone.join(spends, "source").select(*KEY, "replaced_at"))


def repair_accepted(ledger: Ledger) -> Archive:
    """Pending rows that the source has accepted in a block, or that conflict with what it has accepted."""
    return accept(ledger, ledger["node_block"])


def expiring(ledger: Ledger, horizon: Column, ttl_ms: int) -> DataFrame:
    """Pending rows with expires_at = validated_at + ttl, up to the horizon, in order of expiry, source and hash."""
    out = ledger["node_transaction"].withColumn("expires_at", F.col("validated_at") + F.make_dt_interval(secs=F.lit(ttl_ms / 1000))).where(F.col("expires_at") <= horizon)
    n = ledger["node"].select(F.col("internal_id").alias("node_internal_id"), "name")
    t = ledger["transaction"].select(F.col("internal_id").alias("transaction_internal_id"), "hash")
    return out.join(F.broadcast(n), "node_internal_id").join(t, "transaction_internal_id").orderBy("expires_at", "name", "hash")


def expire(ledger: Ledger, horizon: Column, ttl_ms: int) -> Archive:
    """Expired rows and their pending descendants go, at the exact time of expiry."""
    due = expiring(ledger, horizon, ttl_ms).select(*KEY, F.col("expires_at").alias("replaced_at"))
    return _spread(ledger, due)


def announce(ledger: Ledger, heard: DataFrame) -> DataFrame:
    """node_transaction rows for heard (node_internal_id, hash, validated_at): unknown transactions and rows that are
    there already are ignored, the first time of a repeated announcement counts."""
    t = ledger["transaction"].select(F.col("internal_id").alias("transaction_internal_id"), "hash")
    rows = heard.join(t, "hash").groupBy(*KEY).agg(F.min("validated_at").alias("validated_at"))
    return rows.join(ledger["node_transaction"], KEY, "left_anti")
