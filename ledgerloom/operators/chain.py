"""Chains of blocks as sources see them: gaps, progress, locators, re-organizations and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import compact_uint_length
from ..schema import TWO_HOURS
from ..sources.ledger import Ledger


def accepted_heights(ledger: Ledger) -> DataFrame:
    """(node_internal_id, height, hash) of the blocks that each source accepts."""
    b = ledger["block"].select(F.col("internal_id").alias("block_internal_id"), "height", "hash")
    return ledger["node_block"].join(b, "block_internal_id").select("node_internal_id", "height", "hash")


def sync_states(ledger: Ledger) -> DataFrame:
    """(node_internal_id, synced_to, additional): the last height up to which none is missing (-1 if 0 is missing), and
    how many accepted heights lie beyond the first gap."""
    w = Window.partitionBy("node_internal_id").orderBy("height")
    h = accepted_heights(ledger).select("node_internal_id", "height").distinct().withColumn("dense", F.col("height") == F.row_number().over(w) - 1)
    s = h.groupBy("node_internal_id").agg(F.max(F.when(F.col("dense"), F.col("height"))).alias("top"), F.sum((~F.col("dense")).cast("long")).alias("extra"))
    every = ledger["node"].select(F.col("internal_id").alias("node_internal_id"))
    return every.join(s, "node_internal_id", "left").select("node_internal_id", F.coalesce("top", F.lit(-1).cast("long")).alias("synced_to"), F.coalesce("extra", F.lit(0).cast("long")).alias("additional"))


def gaps(ledger: Ledger) -> DataFrame:
    """(node_internal_id, first, last): runs of heights that a source misses below its highest."""
    w = Window.partitionBy("node_internal_id").orderBy("height")
    h = accepted_heights(ledger).select("node_internal_id", "height").distinct()
    p = h.withColumn("before", F.coalesce(F.lag("height").over(w), F.lit(-1)))
    return p.where("height > before + 1").select("node_internal_id", (F.col("before") + 1).cast("long").alias("first"), (F.col("height") - 1).alias("last"))


def sync_percentages(ledger: Ledger) -> DataFrame:
    """(node_internal_id, pending, best, percent): the next height a source needs against the highest known; least
    synced first."""
    best = ledger["block"].agg(F.max("height").alias("best"))
    s = sync_states(ledger).select("node_internal_id", (F.col("synced_to") + 1).alias("pending")).crossJoin(F.broadcast(best))
    return s.withColumn("percent", F.round(100 * F.col("pending") / F.greatest(F.col("best"), F.lit(1)), 6)).orderBy("percent", "node_internal_id")


def locator_heights(length: int) -> list[int]:
    """The last twelve positions of a chain, then steps that double, then the first."""
    out, at, step = [], length - 1, 1
    while at > 0:
        out.append(at)
        if len(out) >= 12:
            step *= 2
        at -= step
    return [*out, 0] if length > 0 else []


def locator(ledger: Ledger, node: int) -> DataFrame:
    """(position, height, hash) of a source's locator; heights that it misses are left out."""
    h = accepted_heights(ledger).where(F.col("node_internal_id") == node)
    top = h.agg(F.max("height")).first()[0]
    want = [] if top is None else locator_heights(top + 1)
    at = ledger.spark.createDataFrame(list(enumerate(want)), "position long, height long")
    return F.broadcast(at).join(h, "height").select("position", "height", "hash").orderBy("position")


def splice(chain: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new chain, stale rows) where headers (node_internal_id, height, hash) overwrite a chain's heights. Only heights
    that the headers hold are overwritten: a shorter replacement leaves the old tail."""
    key = ["node_internal_id", "height"]
    new = headers.select(*key, F.col("hash").alias("new"))
    stale = chain.join(new, key).where(F.col("hash") != F.col("new")).select(*key, "hash")
    return chain.join(headers, key, "left_anti").select(*key, "hash").unionAll(headers.select(*key, "hash")), stale


def follow(chain: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new chain, stale rows, ignored) for header messages (node_internal_id, position, hash, previous_block_hash), one a
    source: they go on from the last height of the first one's parent. Ignored are sources whose parent isn't in their
    chain (reason "unknown parent") or whose last header already is ("known headers")."""
    key = ["node_internal_id"]
    ends = headers.groupBy(*key).agg(F.min(F.struct("position", "previous_block_hash")).alias("first"), F.max(F.struct("position", "hash")).alias("last"))
    ends = ends.select(*key, F.col("first.position").alias("start"), F.col("first.previous_block_hash").alias("parent"), F.col("last.hash").alias("tip"))
    at = chain.select(*key, F.col("hash").alias("parent"), "height").join(ends.select(*key, "parent"), [*key, "parent"], "left_semi").groupBy(*key).agg(F.max("height").alias("below"))
    had = chain.join(ends.select(*key, F.col("tip").alias("hash")), [*key, "hash"], "left_semi").select(*key, F.lit("known headers").alias("had")).distinct()
    state = ends.join(at, key, "left").join(had, key, "left").withColumn("reason", F.when(F.col("below").isNull(), F.lit("unknown parent")).otherwise(F.col("had")))
    placed = headers.join(state.where("reason is null").select(*key, "start", "below"), key)
    placed = placed.select(*key, (F.col("below") + 1 + F.col("position") - F.col("start")).cast("long").alias("height"), "hash")
    new, stale = splice(chain, placed)
    return new, stale, state.where("reason is not null").select(*key, "reason")


def rewound(states: DataFrame, extra: DataFrame, reorgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, extra) after re-organizations (node_internal_id, height): progress (node_internal_id, synced_to) falls back
    to the height below, if it had come that far, and synced or pending heights (node_internal_id, height, ...) at and
    above it are dropped."""
    low = reorgs.groupBy("node_internal_id").agg(F.min("height").alias("_at"))
    s = states.join(low, "node_internal_id", "left").withColumn("synced_to", F.coalesce(F.least("synced_to", F.col("_at") - 1), F.col("synced_to"))).drop("_at")
    e = extra.join(low, "node_internal_id", "left").where(F.col("_at").isNull() | (F.col("height") < F.col("_at"))).drop("_at")
    return s, e


def next_heights(states: DataFrame, extra: DataFrame) -> DataFrame:
    """(node_internal_id, next): the first height above synced_to that a source neither has synced nor has pending."""
    h = extra.select("node_internal_id", "height").join(states.select("node_internal_id", "synced_to"), "node_internal_id").where("height > synced_to").distinct()
    w = Window.partitionBy("node_internal_id").orderBy("height")
    run = h.where("height is not null").withColumn("_n", F.row_number().over(w)).where(F.col("height") == F.col("synced_to") + F.col("_n")).groupBy("node_internal_id").agg(F.max("height").alias("_top"))
    return states.join(run, "node_internal_id", "left").select("node_internal_id", (F.coalesce("_top", "synced_to") + 1).cast("long").alias("next"))


def stale_blocks(ledger: Ledger, headers: DataFrame, removed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(node_block that remains, node_block_history rows) after a source's re-organization to the headers."""
    _, stale = splice(accepted_heights(ledger), headers)
    ids = stale.join(ledger["block"].select("hash", F.col("internal_id").alias("block_internal_id")), "hash").select("node_internal_id", "block_internal_id")
    key = ["node_internal_id", "block_internal_id"]
    left = ledger["node_block"].join(ids, key, "left_anti")
    return left, ledger["node_block"].join(ids, key, "left_semi").withColumn("removed_at", removed_at)


def nodes_with_block(ledger: Ledger) -> DataFrame:
    """(height, hash, nodes): the sorted names of the sources that accept a block."""
    n = ledger["node"].select(F.col("internal_id").alias("node_internal_id"), "name")
    named = accepted_heights(ledger).join(F.broadcast(n), "node_internal_id")
    return named.groupBy("height", "hash").agg(F.array_sort(F.collect_set("name")).alias("nodes"))


def catch_up(headers: DataFrame, known: DataFrame, pending: DataFrame) -> DataFrame:
    """headers (node_internal_id, height, hash) from a source's pending height (node_internal_id, pending) on, as far as
    all hashes are known (hash)."""
    h = headers.join(pending, "node_internal_id").where("height >= pending").drop("pending")
    miss = h.join(known, "hash", "left_anti").groupBy("node_internal_id").agg(F.min("height").alias("miss"))
    return h.join(miss, "node_internal_id", "left").where(F.col("miss").isNull() | (F.col("height") < F.col("miss"))).drop("miss")


def accepted_at(block_timestamp: Column, heard_at: Column, heard_seconds: Column) -> Column:
    """When a block counts as heard live: null for blocks more than two hours old at the time."""
    return F.when(block_timestamp >= heard_seconds - TWO_HOURS, heard_at)


def incomplete_blocks(ledger: Ledger, low: int, high: int, limit: int | None = None, known: list[str] = ()) -> DataFrame:
    """Accepted blocks of heights low <= h < high whose size differs from what is linked: header, count and the linked
    transactions' sizes. known: hashes to leave out."""
    b = ledger["block"].where((F.col("height") >= low) & (F.col("height") < high))
    if known:
        b = b.where(~F.col("hash").isin([F.lit(bytearray(bytes.fromhex(h))) for h in known]))
    b = b.join(ledger["node_block"].select(F.col("block_internal_id").alias("internal_id")), "internal_id", "left_semi")
    t = ledger["transaction"].select(F.col("internal_id").alias("transaction_internal_id"), F.col("size_bytes").alias("tx_bytes"))
    bridge = ledger["block_transaction"].join(b.select(F.col("internal_id").alias("block_internal_id")), "block_internal_id", "left_semi")
    linked = bridge.join(t, "transaction_internal_id", "left").groupBy(F.col("block_internal_id").alias("internal_id")).agg(F.count("transaction_internal_id").alias("linked"), F.coalesce(F.sum("tx_bytes"), F.lit(0)).alias("linked_bytes"))
    b = b.join(linked, "internal_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("linked", "linked_bytes")})
    b = b.withColumn("expected", F.col("linked_bytes") + 80 + compact_uint_length(F.col("linked")))
    out = b.where(F.col("expected") != F.col("size_bytes")).orderBy("height", "hash")
    return out if limit is None else out.limit(limit)


def audit_report(ledger: Ledger, low: int, high: int, limit: int | None = None) -> DataFrame:
    """One row: how many accepted blocks were scanned, and the incomplete ones as a JSON list in order, [] if none."""
    b = ledger["block"].where((F.col("height") >= low) & (F.col("height") < high)).join(ledger["node_block"].select(F.col("block_internal_id").alias("internal_id")), "internal_id", "left_semi")
    bad = incomplete_blocks(ledger, low, high, limit).select("height", F.lower(F.hex("hash")).alias("hash"), F.col("expected").alias("linkedSizeBytes"), F.col("size_bytes").alias("sizeBytes"), F.col("linked").alias("transactionCount"))
    listed = bad.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*bad.columns)))).alias("incomplete"))
    return b.agg(F.count(F.lit(1)).alias("scanned")).crossJoin(listed)  # one row each


def audit_range(best: int, following: int, batch: int) -> tuple[int, int]:
    """The heights low <= h < high to audit next: from the following height on, or from 0 again beyond the best one."""
    low = 0 if following > best else following
    return low, min(low + batch, best + 1)


def audit_progress(best: int, low: int, high: int, found: int, limit: int) -> tuple[int, bool]:
    """(height to go on from, whether all heights are audited): the same range again while it gives a full list."""
    if found == limit:
        return low, False
    return (0, True) if high == best + 1 else (high, False)
