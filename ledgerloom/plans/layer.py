"""The query layer over a ledger: its tables, views and computed fields, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytecode import of_scripts, pattern_hex, redeem_pattern_hex
from ..operators import authchain, values, wire
from ..sources.ledger import Ledger
from .query import Compiler

#: Views by name, made when a query asks for them.
VIEWS: dict[str, Callable[[Ledger], DataFrame]] = {
    "authchain_view": authchain.authchain_view,
    "authchain_migrations_view": authchain.migrations_view,
    "data_carrier_output": values.data_carrier_outputs,
    "identity_output": lambda ledger: ledger["output"].where("output_index = 0"),
    "signing_output": lambda ledger: ledger["output"].where("output_index = 1"),
    "unspent_output": values.unspent_outputs,
    "p2sh_output": values.p2sh_outputs,
    "p2sh_input": values.p2sh_inputs,
}


def _joined(more: Callable[[Ledger], DataFrame], key: str, ledger: Ledger, df: DataFrame) -> DataFrame:
    """df with the columns of more(ledger) that it lacks."""
    add = more(ledger)
    new = [c for c in add.columns if c not in df.columns]
    return df.join(add.select(F.col(key).alias("_k"), *new), F.col(key) == F.col("_k"), "left").drop("_k")


def _pattern(script: str, name: str, f: Callable[[Column], Column], df: DataFrame) -> DataFrame:
    return of_scripts(df, script, **{name: f})


def computed(ledger: Ledger) -> dict[str, dict[str, Callable[[DataFrame], DataFrame]]]:
    tx, block = partial(values.with_measures, ledger), partial(_joined, values.block_measures, "internal_id", ledger)
    tx_names = values.MEASURES
    output = {"locking_bytecode_pattern": partial(_pattern, "locking_bytecode", "locking_bytecode_pattern", pattern_hex)}
    return {
        "transaction": dict.fromkeys(tx_names, tx) | {"encoded_hex": partial(wire.with_encoded, ledger)},
        "block": dict.fromkeys((*tx_names, "transaction_count", "generated_value_satoshis"), block) | {"encoded_hex": partial(_joined, wire.encoded_blocks, "internal_id", ledger)},
        "input": {"value_satoshis": lambda df: values.with_spent(ledger, df, "value_satoshis"), "unlocking_bytecode_pattern": partial(_pattern, "unlocking_bytecode", "unlocking_bytecode_pattern", pattern_hex), "redeem_bytecode_pattern": partial(_pattern, "unlocking_bytecode", "redeem_bytecode_pattern", redeem_pattern_hex)},
        **dict.fromkeys(("output", "data_carrier_output", "identity_output", "signing_output", "unspent_output", "p2sh_output"), output),
        "node": {"unconfirmed_transaction_count": partial(_joined, values.unconfirmed_counts, "internal_id", ledger)},
    }


def compiler(ledger: Ledger, capped: bool = False) -> Compiler:
    made: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in VIEWS:
            return ledger[name]
        if name not in made:
            made[name] = VIEWS[name](ledger)
        return made[name]

    return Compiler(table, capped=capped, computed=computed(ledger))
