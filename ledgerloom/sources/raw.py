"""Raw blocks and transactions in wire form, decoded to the records that a ledger saves. Each value is decoded alone, out
of Arrow batches; a value that isn't exactly one block or transaction gives null and the reason."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from ..schema import CAPABILITIES, ZERO_HASH
from .ledger import BLOCK_RECORD, TRANSACTION_RECORD

_TOKEN = 0xEF


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError(f"ends at byte {len(self.raw)}, {n} more are needed at {self.at}")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def compact(self) -> int:
        first = self.number(1)
        return first if first < 253 else self.number(1 << (first - 252))

    def hash(self) -> str:
        return self.take(32)[::-1].hex()

    def sized(self) -> bytes:
        return self.take(self.compact())


def _identity(raw: bytes) -> str:
    return hashlib.sha256(hashlib.sha256(raw).digest()).digest()[::-1].hex()


def _output(r: _Reader) -> dict:
    out: dict = {"valueSatoshis": r.number(8), "fungibleTokenAmount": None, "tokenCategory": None, "nonfungibleTokenCapability": None, "nonfungibleTokenCommitment": None}
    script = _Reader(r.sized())
    if script.raw[:1] == bytes([_TOKEN]):
        script.take(1)
        out["tokenCategory"], flags = script.hash(), script.number(1)
        if flags & 0x20:
            if flags & 15 >= len(CAPABILITIES):
                raise ValueError(f"no token capability {flags & 15}")
            out["nonfungibleTokenCapability"] = CAPABILITIES[flags & 15]
            out["nonfungibleTokenCommitment"] = script.sized().hex() if flags & 0x40 else ""
        out["fungibleTokenAmount"] = script.compact() if flags & 0x10 else 0
    out["lockingBytecode"] = script.raw[script.at :].hex()
    return out


def _transaction(r: _Reader) -> dict:
    start = r.at
    version = r.number(4)
    inputs = []
    for _ in range(r.compact()):
        spent = r.hash()
        inputs.append({"outpointTransactionHash": spent, "outpointIndex": r.number(4), "unlockingBytecode": r.sized().hex(), "sequenceNumber": r.number(4)})
    outputs = [_output(r) for _ in range(r.compact())]
    locktime = r.number(4)
    raw = r.raw[start : r.at]
    issued = len(inputs) == 1 and inputs[0]["outpointTransactionHash"] == ZERO_HASH
    return {"hash": _identity(raw), "isCoinbase": issued, "sizeBytes": len(raw), "version": version, "locktime": locktime, "inputs": inputs, "outputs": outputs}


def _block(r: _Reader, height: int) -> dict:
    head = _Reader(r.take(80))
    out = {"hash": _identity(head.raw), "height": height, "version": head.number(4), "previousBlockHash": head.hash(), "merkleRoot": head.hash(), "timestamp": head.number(4), "bits": head.number(4), "nonce": head.number(4), "sizeBytes": len(r.raw)}
    return out | {"transactions": [_transaction(r) for _ in range(r.compact())]}


def _whole(read: Callable, raw: bytes | None, *more) -> tuple[dict | None, str | None]:
    if raw is None:
        return None, "no bytes"
    r = _Reader(raw)
    try:
        out = read(r, *more)
        if r.at != len(raw):
            raise ValueError(f"{len(raw) - r.at} bytes too many")
    except ValueError as e:
        return None, str(e)
    return out, None


def _decoded(df: DataFrame, record: StructType, read: Callable, *columns: str) -> DataFrame:
    schema = StructType([StructField("record", record), StructField("error", StringType())])
    kinds = to_arrow_schema(schema)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block may be large: one at a time
                row = _whole(read, *(batch[c][k].as_py() for c in batch.schema.names))
                yield pa.RecordBatch.from_arrays([pa.array([row[i]], kinds.field(i).type) for i in range(2)], names=["record", "error"])

    return df.select(*columns).mapInArrow(work, schema)


def raw_transactions(df: DataFrame, column: str) -> DataFrame:
    """(record, error) of binary transactions: what a client sends, decoded, checked and hashed."""
    return _decoded(df, _parse_datatype_string(TRANSACTION_RECORD), _transaction, column)


def raw_blocks(df: DataFrame, column: str, height: str) -> DataFrame:
    """(record, error) of binary blocks with their heights."""
    return _decoded(df, _parse_datatype_string(BLOCK_RECORD), _block, column, height)
