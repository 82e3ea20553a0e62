"""A ledger projected from a star schema of customers' orders, for tests and benchmarks.

An order is a transaction, its lines are the outputs; a customer's order spends outputs of the customer's previous
order (every twentieth also of the one before that, so some outputs are spent twice). A customer's first order is an
issuance. Days are blocks; regions are sources that each miss some blocks and hold late transactions as pending.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bytes import compact_uint_length
from ..schema import ZERO_HASH
from ..sources.ledger import Ledger

MAX_UINT32 = 4294967295


def sha(c: Column) -> Column:
    """Hex SHA-256 of a value's text."""
    return F.sha2(c.cast("string"), 256)


def seconds(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400


def epoch(ts: Column) -> Column:
    """Seconds of a timestamp without zone, whatever the session's zone."""
    return seconds(ts.cast("date")) + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def at(secs: Column) -> Column:
    """A timestamp without zone from seconds."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=secs)


class Projection:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.read = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def orders(self) -> DataFrame:
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        return self.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("owner"), F.lag("o_orderkey", 1).over(w).alias("prev1"), F.lag("o_orderkey", 2).over(w).alias("prev2"))

    def days(self) -> DataFrame:
        """One row a day: as many as the calendar holds, whatever the orders' number."""
        w = Window.orderBy("day")
        d = self.orders().select("day").distinct().withColumn("height", (F.row_number().over(w) - 1).cast("long"))
        return d.withColumn("previous", F.lag("day").over(w))

    def transaction(self) -> DataFrame:
        o = self.orders()
        return o.select(F.col("id").alias("internal_id"), F.unhex(sha(F.col("id"))).alias("hash"), (1 + F.col("id") % 2).alias("version"), F.col("owner").alias("locktime"), (100 + F.col("id") % 900).alias("size_bytes"), F.col("prev1").isNull().alias("is_coinbase"))

    def lines(self, key: Column) -> DataFrame:
        """Lines as they are, with `key` of their order, which they are dealt by, and their place in it. What is made of
        them is made where they have arrived: keys are narrower than the hashes and scripts that they stand for."""
        w = Window.partitionBy("key").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        raw = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
        return self.read("lineitem").select(key.alias("key"), *raw).withColumn("output_index", (F.row_number().over(w) - 1).cast("long"))

    def output(self) -> DataFrame:
        token = F.col("l_linestatus") == "F"
        part = sha(F.col("l_partkey"))
        script = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("a914"), F.substring(part, 1, 40), F.lit("87")))
        script = script.when(F.col("l_returnflag") == "A", F.concat(F.lit("6a04"), F.substring(part, 1, 8))).otherwise(F.concat(F.lit("76a914"), F.substring(part, 1, 40), F.lit("88ac")))
        value = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), 0).otherwise(F.round(F.col("l_extendedprice") * 100).cast("long"))
        nft = token & (F.col("l_linenumber") % 2 == 0)
        return self.lines(F.unhex(sha(F.col("l_orderkey")))).select(
            F.col("key").alias("transaction_hash"),
            "output_index",
            value.cast("long").alias("value_satoshis"),
            F.unhex(script).alias("locking_bytecode"),
            F.unhex(F.when(token, sha(F.col("l_suppkey")))).alias("token_category"),
            F.when(token, F.col("l_quantity").cast("long")).alias("fungible_token_amount"),
            F.when(nft, F.element_at(F.array(F.lit("none"), F.lit("mutable"), F.lit("minting")), F.col("l_linenumber") % 3 + 1)).alias("nonfungible_token_capability"),
            F.unhex(F.when(nft, F.substring(part, 1, 8))).alias("nonfungible_token_commitment"),
        )

    def input(self) -> DataFrame:
        """Inputs stay dealt by their transaction. An issuance is a source that no line has, so that it needs no union."""
        issued = F.col("prev1").isNull()
        two = F.filter(F.array("prev1", F.when(F.col("id") % 20 == 0, F.col("prev2"))), lambda x: x.isNotNull())
        spends = self.orders().select("id", issued.alias("issued"), F.explode(F.when(issued, F.array(-1 - F.col("id"))).otherwise(two)).alias("source"))
        lines = self.lines(F.col("l_orderkey")).where(F.col("output_index") % 3 != 2).select("key", "output_index", "l_partkey", "l_returnflag")
        i = spends.join(lines, (F.col("source") == F.col("key")) & ~F.col("issued"), "left").where(F.col("issued") | F.col("key").isNotNull())
        w = Window.partitionBy("id").orderBy("issued", "source", "output_index")
        i = i.select("id", "issued", "source", "output_index", "l_partkey", "l_returnflag").withColumn("place", (F.row_number().over(w) - 1).cast("long"))
        part = sha(F.col("l_partkey"))
        script = F.when(F.col("issued"), F.concat(F.lit("04"), F.substring(sha(F.col("id")), 1, 8)))
        script = script.when(F.col("l_returnflag") == "R", F.concat(F.lit("0017a914"), F.substring(part, 1, 40), F.lit("87"))).otherwise(F.concat(F.lit("41"), part, part, F.lit("012102"), part))
        most = F.lit(MAX_UINT32).cast("long")

        def unless_issued(value: Column, otherwise: Column) -> Column:
            return F.when(F.col("issued"), otherwise).otherwise(value)

        return i.select(
            F.col("id").alias("transaction_internal_id"),
            unless_issued(F.col("place"), F.lit(0).cast("long")).alias("input_index"),
            unless_issued(F.col("output_index"), most).alias("outpoint_index"),
            unless_issued(MAX_UINT32 - F.col("id") % 2, most).alias("sequence_number"),
            F.unhex(unless_issued(sha(F.col("source")), F.lit(ZERO_HASH))).alias("outpoint_transaction_hash"),
            F.unhex(script).alias("unlocking_bytecode"),
        )

    def _numbered(self) -> DataFrame:
        return self.orders().select("id", "day").join(self.days().select("day", "height"), "day")

    def block_transaction(self) -> DataFrame:
        w = Window.partitionBy("height").orderBy("id")
        return self._numbered().select(F.col("height").alias("block_internal_id"), F.col("id").alias("transaction_internal_id"), (F.row_number().over(w) - 1).cast("long").alias("transaction_index"))

    def block(self) -> DataFrame:
        size = self._numbered().groupBy("height").agg(F.count(F.lit(1)).alias("n"), F.sum(100 + F.col("id") % 900).alias("bytes"))
        h = F.col("height")
        off = F.when(h % 50 == 7, 1).otherwise(0)
        return self.days().join(size, "height").select(h.alias("internal_id"), h, (536870912 + h % 3).alias("version"), seconds(F.col("day")).alias("timestamp"), F.unhex(sha(F.col("day"))).alias("hash"), F.unhex(F.coalesce(sha(F.col("previous")), F.lit(ZERO_HASH))).alias("previous_block_hash"), F.unhex(sha(F.concat(F.lit("m"), F.col("day").cast("string")))).alias("merkle_root"), F.lit(486604799).cast("long").alias("bits"), (h * 7919 % 4294967296).alias("nonce"), (80 + compact_uint_length(F.col("n")) + F.col("bytes") + off).cast("long").alias("size_bytes"))

    def node(self) -> DataFrame:
        first = at(F.lit(1000000000).cast("long"))
        return self.read("region").select(F.lower("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("internal_id"), F.lit(70015).alias("protocol_version"), F.concat(F.lit("/agent:"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("user_agent"), first.alias("first_connected_at"), first.alias("latest_connection_began_at"))

    def node_block(self) -> DataFrame:
        n, b = self.node().select(F.col("internal_id").alias("n")), self.days()
        both = b.crossJoin(F.broadcast(n)).where((F.col("height") + F.col("n")) % 11 != 0)  # sources are a handful
        heard = at(seconds(F.col("day")) + 3600 + 60 * F.col("n"))
        return both.select(F.col("n").alias("node_internal_id"), F.col("height").alias("block_internal_id"), F.when(F.col("height") % 4 != 0, heard).alias("accepted_at"))

    def node_transaction(self) -> DataFrame:
        n, t = self.node().select(F.col("internal_id").alias("n")), self._numbered()
        last = self.days().agg((F.floor(F.max("height") * 9 / 10)).alias("least"))
        late = t.join(F.broadcast(last), F.col("height") >= F.col("least"))
        both = late.crossJoin(F.broadcast(n)).where((F.col("id") + F.col("n")) % 4 != 0)
        return both.select(F.col("n").alias("node_internal_id"), F.col("id").alias("transaction_internal_id"), at(seconds(F.col("day")) + F.col("n")).alias("validated_at"))

    def ledger(self) -> Ledger:
        names = ("block", "transaction", "block_transaction", "input", "output", "node", "node_block", "node_transaction")
        return Ledger(self.spark, {n: getattr(self, n) for n in names})
