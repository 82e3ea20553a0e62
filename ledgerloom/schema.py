"""Tables of the ledger: column names and types, and constants."""

from __future__ import annotations

from pyspark.sql import types as T

ZERO_HASH = "00" * 32
DATA_CARRIER = 0x6A
TWO_HOURS = 7200
CAPABILITIES = ("none", "mutable", "minting")  # in order


def _table(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


_DDL = {
    "block": "internal_id long, height long, version long, timestamp long, hash binary, previous_block_hash binary, merkle_root binary, bits long, nonce long, size_bytes long",
    "transaction": "internal_id long, hash binary, version long, locktime long, size_bytes long, is_coinbase boolean",
    "block_transaction": "block_internal_id long, transaction_internal_id long, transaction_index long",
    "input": "transaction_internal_id long, input_index long, outpoint_index long, sequence_number long, outpoint_transaction_hash binary, unlocking_bytecode binary",
    "output": "transaction_hash binary, output_index long, value_satoshis long, locking_bytecode binary, token_category binary, fungible_token_amount long, nonfungible_token_capability string, nonfungible_token_commitment binary",
    "node": "name string, internal_id int, protocol_version int, user_agent string, first_connected_at timestamp_ntz, latest_connection_began_at timestamp_ntz",
    "node_block": "node_internal_id int, block_internal_id long, accepted_at timestamp_ntz",
    "node_block_history": "internal_id long, node_internal_id int, block_internal_id long, accepted_at timestamp_ntz, removed_at timestamp_ntz",
    "node_transaction": "node_internal_id int, transaction_internal_id long, validated_at timestamp_ntz",
    "node_transaction_history": "internal_id long, node_internal_id int, transaction_internal_id long, validated_at timestamp_ntz, replaced_at timestamp_ntz",
}
TABLES = tuple(_DDL)

#: Primary keys, for lookups and upserts.
KEYS = {
    "block": ("internal_id",),
    "transaction": ("internal_id",),
    "block_transaction": ("block_internal_id", "transaction_internal_id"),
    "input": ("transaction_internal_id", "input_index"),
    "output": ("transaction_hash", "output_index"),
    "node": ("internal_id",),
    "node_block": ("node_internal_id", "block_internal_id"),
    "node_block_history": ("internal_id",),
    "node_transaction": ("node_internal_id", "transaction_internal_id"),
    "node_transaction_history": ("internal_id",),
}

#: Rows a public reader gets at most from a table, at the root and in each nested list.
ROW_CAPS = {
    "authchain_migrations_view": 1000,
    "authchain_view": 100,
    "block_transaction": 5000,
    "input": 1000,
    "node": 1000,
    "node_block_history": 1000,
    "node_transaction": 5000,
    "node_transaction_history": 1000,
    "output": 5000,
    "transaction": 10000,
}


def struct(name: str) -> T.StructType:
    return _table(_DDL[name])
