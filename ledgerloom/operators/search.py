"""Searches for outputs by script or token. Only the first 25 bytes of a script take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger

SEARCHED = 25


def _bytes(text: str) -> bytes:
    return bytes.fromhex(text.removeprefix("\\x"))


def search_output(ledger: Ledger, scripts: list[str]) -> DataFrame:
    """Outputs whose script's first 25 bytes are one of these, in the scripts' order. A longer query never matches."""
    wanted = [F.lit(bytearray(b)) for b in {_bytes(s) for s in scripts}]
    start = F.substring("locking_bytecode", 1, SEARCHED)
    found = ledger["output"].where(start.isin(wanted)) if wanted else ledger["output"].where("false")
    return found.orderBy("locking_bytecode")


def search_output_prefix(ledger: Ledger, prefix: str) -> DataFrame:
    start = F.substring("locking_bytecode", 1, SEARCHED)
    return ledger["output"].where(start.startswith(F.lit(bytearray(_bytes(prefix))))).orderBy("locking_bytecode")


def search_token(ledger: Ledger, category: str) -> DataFrame:
    return ledger["output"].where(F.col("token_category") == F.lit(bytearray(_bytes(category))))
