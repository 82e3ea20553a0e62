"""A ledger: its tables as DataFrames, read from Parquet, decoded from nested block records, or projected."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.bytes import from_hex, to_hex
from ..plans.ids import with_ids


class Ledger:
    """Tables by name, each with the columns of schema.TABLES: DataFrames, or functions that make them when they are
    first used. A table that isn't given is empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(tables) - set(schema.TABLES)
        if unknown:
            raise ValueError(f"no such tables: {sorted(unknown)}")
        self.spark, self._tables = spark, dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], schema.struct(name))
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> Ledger:
        return Ledger(self.spark, self._tables | tables)

    def by_key(self, name: str, *values) -> DataFrame:
        """The row with this primary key, or none."""
        keys = schema.KEYS[name]
        if len(keys) != len(values):
            raise ValueError(f"{name} has the key {keys}")
        return self[name].where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in zip(keys, values, strict=True)])).limit(1)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        for name in self._tables:
            self[name].write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, names: tuple[str, ...] = schema.TABLES) -> Ledger:
        return cls(spark, {n: spark.read.schema(schema.struct(n)).parquet(f"{path}/{n}") for n in names})


_OUTPUT = "struct<valueSatoshis:long,lockingBytecode:string,fungibleTokenAmount:long,tokenCategory:string,nonfungibleTokenCapability:string,nonfungibleTokenCommitment:string>"
_INPUT = "struct<outpointIndex:long,outpointTransactionHash:string,sequenceNumber:long,unlockingBytecode:string>"
#: A transaction and a block as peers send them, decoded; hashes and scripts are hex text.
TRANSACTION_RECORD = f"struct<hash:string,isCoinbase:boolean,sizeBytes:long,version:long,locktime:long,inputs:array<{_INPUT}>,outputs:array<{_OUTPUT}>>"
BLOCK_RECORD = f"hash string, height long, version long, timestamp long, previousBlockHash string, merkleRoot string, bits long, nonce long, sizeBytes long, transactions array<{TRANSACTION_RECORD}>"


class Records(NamedTuple):
    """Decoded blocks, keyed by hash: a ledger gives them ids when they are saved."""

    block: DataFrame  # without internal_id
    transaction: DataFrame  # without internal_id
    link: DataFrame  # block_hash, transaction_hash, transaction_index
    input: DataFrame  # transaction_hash in place of transaction_internal_id
    output: DataFrame


def _once(df: DataFrame, key: str) -> DataFrame:
    """df without repeated keys. Keys are read first: rows, which may hold a whole block, are dealt by them only if some
    repeat."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return df if repeated.isEmpty() else df.dropDuplicates([key])


def transaction_records(txs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transaction, input, output) of decoded transactions, each hash once."""
    return _split(txs.dropDuplicates(["hash"]))


def _split(once: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    transaction = once.select(from_hex(F.col("hash")).alias("hash"), "version", "locktime", F.col("sizeBytes").alias("size_bytes"), F.col("isCoinbase").alias("is_coinbase"))
    ins = once.select("hash", F.posexplode("inputs").alias("i", "x"))
    inputs = ins.select(from_hex(F.col("hash")).alias("transaction_hash"), F.col("i").cast("long").alias("input_index"), F.col("x.outpointIndex").alias("outpoint_index"), F.col("x.sequenceNumber").alias("sequence_number"), from_hex(F.col("x.outpointTransactionHash")).alias("outpoint_transaction_hash"), from_hex(F.col("x.unlockingBytecode")).alias("unlocking_bytecode"))
    outs = once.select("hash", F.posexplode("outputs").alias("i", "x"))
    outputs = outs.select(from_hex(F.col("hash")).alias("transaction_hash"), F.col("i").cast("long").alias("output_index"), F.col("x.valueSatoshis").alias("value_satoshis"), from_hex(F.col("x.lockingBytecode")).alias("locking_bytecode"), from_hex(F.col("x.tokenCategory")).alias("token_category"), F.col("x.fungibleTokenAmount").alias("fungible_token_amount"), F.col("x.nonfungibleTokenCapability").alias("nonfungible_token_capability"), from_hex(F.col("x.nonfungibleTokenCommitment")).alias("nonfungible_token_commitment"))
    return transaction, inputs, outputs


def decode_blocks(blocks: DataFrame) -> Records:
    """Splits nested block records, which are read several times; blocks and transactions are kept once."""
    blocks = _once(blocks, "hash")
    block = blocks.select("height", "version", "timestamp", from_hex(F.col("hash")).alias("hash"), from_hex(F.col("previousBlockHash")).alias("previous_block_hash"), from_hex(F.col("merkleRoot")).alias("merkle_root"), "bits", "nonce", F.col("sizeBytes").alias("size_bytes"))
    tx = blocks.select(F.col("hash").alias("block"), F.posexplode("transactions").alias("i", "t"))
    link = tx.select(from_hex(F.col("block")).alias("block_hash"), from_hex(F.col("t.hash")).alias("transaction_hash"), F.col("i").cast("long").alias("transaction_index"))
    transaction, inputs, outputs = _split(_once(tx.select("t.*"), "hash"))
    return Records(block, transaction, link, inputs, outputs)


def from_blocks(blocks: DataFrame) -> Ledger:
    """A new ledger of these block records. Ids are given in the order of the hashes: by place, not by what a hash begins
    with, as all block hashes begin with zeros."""
    r = decode_blocks(blocks)
    none = Ledger(blocks.sparkSession, {})
    block, transaction = with_ids(none["block"], r.block, ["hash"]), with_ids(none["transaction"], r.transaction, ["hash"])
    return Ledger(blocks.sparkSession, {"block": block, "transaction": transaction, "output": r.output, **numbered(r, block, transaction)})


def numbered(r: Records, block: DataFrame, transaction: DataFrame) -> dict[str, DataFrame]:
    """The links and inputs of r with the ids of these blocks and transactions; what isn't among them is left out."""
    b = block.select(F.col("hash").alias("block_hash"), F.col("internal_id").alias("block_internal_id"))
    t = transaction.select(F.col("hash").alias("transaction_hash"), F.col("internal_id").alias("transaction_internal_id"))
    links = r.link.join(b, "block_hash").join(t, "transaction_hash").select(*schema.struct("block_transaction").names)
    return {"block_transaction": links, "input": r.input.join(t, "transaction_hash").select(*schema.struct("input").names)}


def _lists(ledger: Ledger) -> tuple[DataFrame, DataFrame]:
    """(transaction_internal_id, inputs) and (transaction_hash, outputs): lists in order, their bytes not yet as text."""

    def listed(df: DataFrame, key: str, index: str, name: str, **fields: str) -> DataFrame:
        x = F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("x")
        return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, x))), lambda s: s["x"]).alias(name))

    ins = listed(ledger["input"], "transaction_internal_id", "input_index", "inputs", outpointIndex="outpoint_index", outpointTransactionHash="outpoint_transaction_hash", sequenceNumber="sequence_number", unlockingBytecode="unlocking_bytecode")
    outs = listed(ledger["output"], "transaction_hash", "output_index", "outputs", valueSatoshis="value_satoshis", lockingBytecode="locking_bytecode", fungibleTokenAmount="fungible_token_amount", tokenCategory="token_category", nonfungibleTokenCapability="nonfungible_token_capability", nonfungibleTokenCommitment="nonfungible_token_commitment")
    return ins, outs


def _texts(rows: Column, df: DataFrame, name: str) -> Column:
    """A list of _lists with hex text for bytes, empty for null."""
    fields = df.schema[name].dataType.elementType
    shown = F.transform(rows, lambda x: F.struct(*[(to_hex(x[f.name]) if f.dataType.typeName() == "binary" else x[f.name]).alias(f.name) for f in fields]))
    return F.coalesce(shown, F.array().cast(f"array<{_INPUT if name == 'inputs' else _OUTPUT}>"))


def transaction_rows(ledger: Ledger) -> DataFrame:
    """A ledger's transactions as records (transaction_internal_id and the fields of TRANSACTION_RECORD)."""
    ins, outs = _lists(ledger)
    t = ledger["transaction"].withColumnsRenamed({"internal_id": "transaction_internal_id", "hash": "transaction_hash"})
    t = t.join(ins, "transaction_internal_id", "left").join(outs, "transaction_hash", "left")
    return t.select("transaction_internal_id", to_hex(F.col("transaction_hash")).alias("hash"), F.col("is_coinbase").alias("isCoinbase"), F.col("size_bytes").alias("sizeBytes"), "version", "locktime", _texts(F.col("inputs"), ins, "inputs").alias("inputs"), _texts(F.col("outputs"), outs, "outputs").alias("outputs"))


def block_rows(ledger: Ledger, parts: int | None = None) -> DataFrame:
    """A ledger's blocks as records, with all transactions in order. The header, each transaction with its inputs, and each
    list of outputs meet in their block: everything is moved there once, and is text only then. parts: how many
    partitions the blocks are dealt to."""
    ins, outs = _lists(ledger)
    key, place = F.col("block_internal_id"), ["transaction_index", "transaction_internal_id"]
    t = ledger["transaction"].withColumnsRenamed({"internal_id": "transaction_internal_id", "hash": "transaction_hash"}).join(ledger["block_transaction"], "transaction_internal_id")
    heads = t.join(ins, "transaction_internal_id", "left").select(key, F.struct(*place, "transaction_hash", "is_coinbase", "size_bytes", "version", "locktime", "inputs").alias("a"))
    tails = t.join(outs, "transaction_hash", "left").select(key, F.struct(*place, "outputs").alias("b"))
    fields = [c for c in ledger["block"].columns if c != "internal_id"]
    header = ledger["block"].select(F.col("internal_id").alias("block_internal_id"), F.struct(*fields).alias("h"))
    pieces = heads.unionByName(tails, allowMissingColumns=True).unionByName(header, allowMissingColumns=True)
    if parts is not None:
        pieces = pieces.repartition(parts, "block_internal_id")

    def both(a: Column, b: Column) -> Column:
        return F.struct(to_hex(a["transaction_hash"]).alias("hash"), a["is_coinbase"].alias("isCoinbase"), a["size_bytes"].alias("sizeBytes"), a["version"].alias("version"), a["locktime"].alias("locktime"), _texts(a["inputs"], ins, "inputs").alias("inputs"), _texts(b["outputs"], outs, "outputs").alias("outputs"))

    b = pieces.groupBy("block_internal_id").agg(F.max_by("h", F.col("h").isNotNull()).alias("h"), F.array_sort(F.collect_list("a")).alias("a"), F.array_sort(F.collect_list("b")).alias("b")).where("h is not null and size(a) > 0")
    return b.select(to_hex(F.col("h.hash")).alias("hash"), "h.height", "h.version", "h.timestamp", to_hex(F.col("h.previous_block_hash")).alias("previousBlockHash"), to_hex(F.col("h.merkle_root")).alias("merkleRoot"), "h.bits", "h.nonce", F.col("h.size_bytes").alias("sizeBytes"), F.zip_with("a", "b", both).alias("transactions"))
