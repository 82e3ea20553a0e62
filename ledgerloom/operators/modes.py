"""Catching up and live: until its sources are synced, a ledger takes no pending transactions, and accepting a block
clears none; from then on both happen with every save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from . import mempool
from .chain import sync_states


@dataclass(frozen=True)
class Mode:
    live: bool

    def heard(self, announced: DataFrame) -> DataFrame:
        """Announced transactions that are let in: none before live."""
        return announced if self.live else announced.limit(0)

    def accepted(self, ledger: Ledger, blocks: DataFrame) -> mempool.Archive:
        """After node_block rows were added: pending rows that they confirm or conflict with go, once live."""
        none = ledger["node_transaction"].limit(0).withColumn("replaced_at", F.lit(None).cast("timestamp_ntz"))
        return mempool.accept(ledger, blocks) if self.live else mempool.Archive(ledger["node_transaction"], none)

    def replaced(self, ledger: Ledger, history: DataFrame) -> mempool.Archive:
        """After history rows were added: their pending descendants go, once live."""
        none = ledger["node_transaction"].limit(0).withColumn("replaced_at", F.lit(None).cast("timestamp_ntz"))
        return mempool.invalidate(ledger, history) if self.live else mempool.Archive(ledger["node_transaction"], none)


def current(ledger: Ledger) -> Mode:
    """Live as soon as every source has all heights up to the best one that it has accepted."""
    behind = sync_states(ledger).where("additional > 0 or synced_to < 0").limit(1).count()
    return Mode(not behind)
