"""Derived measures of inputs, transactions and blocks, and the views on outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytecode import is_data_carrier, is_p2sh, redeem_pattern_hex
from ..sources.ledger import Ledger


def with_spent(ledger: Ledger, inputs: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
    """inputs with these columns of the outputs that they spend (where they fit), null without. Outputs are looked up in a
    list of their transaction: joined by hash and index, both sides would be dealt anew by the two together."""
    shown = F.struct(*columns)
    o = F.struct("output_index", (shown if where is None else F.when(where, shown)).alias("x"))
    lists = ledger["output"].groupBy(F.col("transaction_hash").alias("_h")).agg(F.sort_array(F.collect_list(o)).alias("_o"))
    index = F.col("outpoint_index")
    there = F.get("_o", F.when((index >= 0) & (index < F.size("_o")), index).cast("int"))  # its place, where no index is missing
    found = F.when(there["output_index"] == index, there).otherwise(F.get(F.filter("_o", lambda x: x["output_index"] == index), F.lit(0)))
    names = inputs.columns
    rows = inputs.join(lists, F.col("outpoint_transaction_hash") == F.col("_h"), "left").select(*names, found["x"].alias("_x"))
    return rows.select(*names, *[F.col("_x")[c].alias(c) for c in columns])


def input_values(ledger: Ledger) -> DataFrame:
    """Every input and the value of the output it spends; null if that output isn't stored."""
    return with_spent(ledger, ledger["input"], "value_satoshis")


MEASURES = ("input_count", "output_count", "input_value_satoshis", "output_value_satoshis", "fee_satoshis")


def with_measures(ledger: Ledger, t: DataFrame) -> DataFrame:
    """Rows of transactions with input_count, output_count, input_value_satoshis (unknown outpoints count 0),
    output_value_satoshis (null without outputs) and fee_satoshis (0 for issuance; null without outputs)."""
    ins = input_values(ledger).groupBy(F.col("transaction_internal_id").alias("internal_id")).agg(F.count(F.lit(1)).alias("input_count"), F.sum("value_satoshis").alias("input_value_satoshis"))
    outs = ledger["output"].groupBy(F.col("transaction_hash").alias("hash")).agg(F.count(F.lit(1)).alias("output_count"), F.sum("value_satoshis").alias("output_value_satoshis"))
    t = t.join(ins, "internal_id", "left").join(outs, "hash", "left")
    t = t.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("input_count", "output_count", "input_value_satoshis")})
    return t.withColumn("fee_satoshis", F.when(F.col("is_coinbase"), F.lit(0).cast("long")).otherwise(F.col("input_value_satoshis") - F.col("output_value_satoshis")))


def transaction_measures(ledger: Ledger) -> DataFrame:
    """transaction columns and their measures."""
    return with_measures(ledger, ledger["transaction"])


def block_measures(ledger: Ledger) -> DataFrame:
    """block columns and transaction_count, input_count, output_count, input_value_satoshis, output_value_satoshis,
    fee_satoshis and generated_value_satoshis (output less input value): sums of the transactions' measures, 0 if none."""
    t = transaction_measures(ledger).withColumnRenamed("internal_id", "transaction_internal_id")
    sums = ("input_count", "output_count", "input_value_satoshis", "output_value_satoshis", "fee_satoshis")
    per = ledger["block_transaction"].join(t, "transaction_internal_id", "left").groupBy(F.col("block_internal_id").alias("internal_id")).agg(F.count(F.lit(1)).alias("transaction_count"), *[F.sum(c).alias(c) for c in sums])
    b = ledger["block"].join(per, "internal_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("transaction_count", *sums)})
    return b.withColumn("generated_value_satoshis", F.col("output_value_satoshis") - F.col("input_value_satoshis"))


def indexed_output(ledger: Ledger, index: int) -> DataFrame:
    """Every transaction with its output of this index, null without: 0 is the identity output, 1 the signing output."""
    o = ledger["output"].where(F.col("output_index") == index).drop("output_index")
    return ledger["transaction"].join(o.withColumnRenamed("transaction_hash", "hash"), "hash", "left")


def data_carrier_outputs(ledger: Ledger) -> DataFrame:
    return ledger["output"].where(is_data_carrier(F.col("value_satoshis"), F.col("locking_bytecode")))


def p2sh_outputs(ledger: Ledger) -> DataFrame:
    return ledger["output"].where(is_p2sh(F.col("locking_bytecode")))


def p2sh_inputs(ledger: Ledger) -> DataFrame:
    """Inputs that spend script-hash outputs, with the pattern of what they redeem and the output's value and script."""
    i = with_spent(ledger, ledger["input"], "value_satoshis", "locking_bytecode", where=is_p2sh(F.col("locking_bytecode"))).where("locking_bytecode is not null")
    return i.withColumn("redeem_pattern", redeem_pattern_hex(F.col("unlocking_bytecode")))


def unspent_outputs(ledger: Ledger) -> DataFrame:
    """Outputs that no known input spends, on any side of a split."""
    i = ledger["input"].select(F.col("outpoint_transaction_hash").alias("transaction_hash"), F.col("outpoint_index").alias("output_index"))
    return ledger["output"].join(i, ["transaction_hash", "output_index"], "left_anti")


def spenders(ledger: Ledger) -> DataFrame:
    """Outputs with the list of (transaction_internal_id, input_index) that spend them, empty if none."""
    i = ledger["input"].groupBy(F.col("outpoint_transaction_hash").alias("transaction_hash"), F.col("outpoint_index").alias("output_index")).agg(F.array_sort(F.collect_list(F.struct("transaction_internal_id", "input_index"))).alias("spent_by"))
    return ledger["output"].join(i, ["transaction_hash", "output_index"], "left").withColumn("spent_by", F.coalesce("spent_by", F.array().cast("array<struct<transaction_internal_id:long,input_index:long>>")))


def double_spends(ledger: Ledger) -> DataFrame:
    """Pairs of transactions that spend one output: (a, b, outpoint), a < b."""
    i = ledger["input"].where(~_is_zero(F.col("outpoint_transaction_hash"))).select(F.col("transaction_internal_id").alias("tx"), "outpoint_transaction_hash", "outpoint_index")
    key = ["outpoint_transaction_hash", "outpoint_index"]
    return i.withColumnRenamed("tx", "a").join(i.withColumnRenamed("tx", "b"), key).where("a < b")


def _is_zero(h: Column) -> Column:
    return h == F.unhex(F.lit("00" * 32))


def unconfirmed_counts(ledger: Ledger) -> DataFrame:
    """Pending transactions of each source, 0 if none."""
    n = ledger["node_transaction"].groupBy(F.col("node_internal_id").alias("internal_id")).agg(F.count(F.lit(1)).alias("unconfirmed_transaction_count"))
    return ledger["node"].join(n, "internal_id", "left").withColumn("unconfirmed_transaction_count", F.coalesce("unconfirmed_transaction_count", F.lit(0).cast("long")))
