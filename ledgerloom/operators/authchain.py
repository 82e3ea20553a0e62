"""Identity chains: from a transaction, follow whichever transaction spends output 0 until one isn't spent.

Both `chain_ends` and `chains`, which lists the members too, use pointer doubling: rounds grow with the logarithm of the
longest chain. A round joins hops (base, to, what lies between) with one another and with the chains that are known.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored
from ..sources.ledger import Ledger

MOST_STEPS = 100_000
#: What _edges has stored: a ledger's tables don't change.
_known: WeakKeyDictionary[Ledger, tuple[DataFrame, DataFrame]] = WeakKeyDictionary()


def _edges(ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """(parent, child) for inputs that spend an output 0; and the transactions with that output unspent or, for
    children, not stored."""
    if ledger not in _known:
        t = ledger["transaction"].select(F.col("internal_id").alias("parent"), F.col("hash").alias("outpoint_transaction_hash"))
        base = stored(ledger["output"].where("output_index = 0").select(F.col("transaction_hash").alias("outpoint_transaction_hash")).join(t, "outpoint_transaction_hash").select("parent", "outpoint_transaction_hash"))
        spends = ledger["input"].where("outpoint_index = 0").select("outpoint_transaction_hash", F.col("transaction_internal_id").alias("child"))
        _known[ledger] = stored(spends.join(base, "outpoint_transaction_hash").select("parent", "child").distinct()), base.select(F.col("parent").alias("tx"))
    return _known[ledger]


def _heads(edges: DataFrame, base: DataFrame) -> DataFrame:
    """(tx, own): what no edge leaves; own: it has an output 0, so that it is a chain by itself. A parent always has one."""
    every = base.select("tx", F.lit(True).alias("own")).unionAll(edges.select(F.col("child").alias("tx"), F.lit(False).alias("own")))
    return every.groupBy("tx").agg(F.max("own").alias("own")).join(edges.select(F.col("parent").alias("tx")), "tx", "left_anti")


def _doubled(edges: DataFrame, heads: DataFrame, first: Column, head: Column, join: Callable[[Column, Column], Column], merge: bool) -> DataFrame:
    """(base, head, way, paths) of all chains; paths: how many chains share the other three. first: the way of one hop;
    head: that of a head alone; join: of two in a row. merge: different chains may have one way.

    Hops of round r are 2^r edges long, and it finds the chains of 2^r to 2^(r+1) - 1 edges: no two rounds find one
    chain, so what a round has found is written once and left as it is."""
    one = F.lit(1).cast("long").alias("paths")
    ends = stored(heads.select(F.col("tx").alias("base"), F.col("tx").alias("head"), head.alias("way"), one, "own"))
    done, own = ends.drop("own"), ends.where("own").drop("own")
    hop = stored(edges.select(F.col("parent").alias("base"), F.col("child").alias("to"), first.alias("way"), one))

    def merged(df: DataFrame, end: str) -> DataFrame:
        return stored(df.groupBy("base", end, "way").agg(F.sum("paths").alias("paths")) if merge else df)

    rounds = 0
    while rounds <= MOST_STEPS.bit_length() and not hop.isEmpty():
        rounds += 1
        # hops that arrive where all ends are known are finished; the others double
        known = done.select(F.col("base").alias("to"), "head", F.col("way").alias("more"), F.col("paths").alias("times"))
        on = hop.select(F.col("base").alias("to"), F.col("to").alias("next"), F.col("way").alias("more"), F.col("paths").alias("times"))
        both = [join(F.col("way"), F.col("more")).alias("way"), (F.col("paths") * F.col("times")).alias("paths")]
        fresh = merged(hop.join(known, "to").select("base", "head", *both), "head")
        hop = merged(hop.join(on, "to").select("base", F.col("next").alias("to"), *both), "to")
        done, own = done.unionAll(fresh), own.unionAll(fresh)
    return own


def _ends(ledger: Ledger) -> DataFrame:
    edges, base = _edges(ledger)
    own = _doubled(edges, _heads(edges, base), F.lit(1).cast("long"), F.lit(0).cast("long"), lambda a, b: a + b, merge=True)
    return own.where(F.col("way") <= MOST_STEPS).select("base", "head", (F.col("way") + 1).alias("length"), "paths")


def chain_ends(ledger: Ledger) -> DataFrame:
    """(base, head, length): every transaction with an output 0, each unspent end it leads to, and the members between
    them, both included. Several ends where an output was spent twice."""
    return _ends(ledger).drop("paths")


def chains(ledger: Ledger) -> DataFrame:
    """(base, head, members): members are the transactions' ids from base to head."""
    edges, base = _edges(ledger)
    own = _doubled(edges, _heads(edges, base), F.array("parent"), F.array("tx"), F.concat, merge=False)
    return own.where(F.size("way") <= MOST_STEPS + 1).select("base", "head", F.col("way").alias("members"))


def authchain_view(ledger: Ledger) -> DataFrame:
    """(transaction_internal_id, authhead_transaction_hash, authchain_length, unspent_authhead), a row for each chain: only
    those that end in an unspent head are listed, so the last is always true."""
    t = ledger["transaction"].select(F.col("internal_id").alias("head"), F.col("hash").alias("authhead_transaction_hash"))
    each = _ends(ledger).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("paths").cast("int"))))
    return each.join(t, "head").select(F.col("base").alias("transaction_internal_id"), "authhead_transaction_hash", F.col("length").alias("authchain_length"), F.lit(True).alias("unspent_authhead"))


def migrations_view(ledger: Ledger) -> DataFrame:
    """(authbase_internal_id, migration_index, migration_transaction_internal_id)."""
    return migrations(chains(ledger)).select(F.col("base").alias("authbase_internal_id"), "migration_index", F.col("tx").alias("migration_transaction_internal_id"))


def migration_transactions(ledger: Ledger) -> DataFrame:
    """authbase_internal_id and migration_index with all columns of the migration's transaction."""
    t = ledger["transaction"]
    return migrations_view(ledger).join(t, F.col("migration_transaction_internal_id") == t["internal_id"]).drop("migration_transaction_internal_id")


def migrations(all_chains: DataFrame) -> DataFrame:
    """(base, migration_index, tx): a chain's members with their place, from 0."""
    return all_chains.select("base", F.posexplode("members").alias("i", "tx")).select("base", F.col("i").cast("long").alias("migration_index"), "tx")
