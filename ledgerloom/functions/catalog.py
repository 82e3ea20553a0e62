"""Functions by name for Spark SQL. Tables and views of a ledger become temporary views, byte and script functions become SQL
functions, and searches and chains table functions: all of them are Catalyst plans, none runs Python."""

from __future__ import annotations

from ..plans.layer import VIEWS
from ..schema import TABLES
from ..sources.ledger import Ledger

#: name: (parameters, result, body).
SCALARS = {
    "reverse_bytes": ("b BINARY", "BINARY", "encode(reverse(decode(b, 'ISO-8859-1')), 'ISO-8859-1')"),
    "uint16le": ("x BIGINT", "BINARY", "unhex(substr(hex(reverse_bytes(unhex(lpad(hex(x), 16, '0')))), 1, 4))"),
    "uint32le": ("x BIGINT", "BINARY", "unhex(substr(hex(reverse_bytes(unhex(lpad(hex(x), 16, '0')))), 1, 8))"),
    "uint64le": ("x BIGINT", "BINARY", "reverse_bytes(unhex(lpad(hex(x), 16, '0')))"),
    "compact_uint": ("x BIGINT", "BINARY", "CASE WHEN x <= 252 THEN unhex(lpad(hex(x), 2, '0')) WHEN x <= 65535 THEN concat(X'FD', uint16le(x)) WHEN x <= 4294967295 THEN concat(X'FE', uint32le(x)) ELSE concat(X'FF', uint64le(x)) END"),
    "is_script_hash": ("script BINARY", "BOOLEAN", "octet_length(script) = 23 AND startswith(script, X'A914') AND endswith(script, X'87')"),
}
_OUTPUT = "transaction_hash BINARY, output_index BIGINT, value_satoshis BIGINT, locking_bytecode BINARY"
_SHOWN = "SELECT o.transaction_hash, o.output_index, o.value_satoshis, o.locking_bytecode FROM {p}output o"
#: name: (parameters, columns, body); {p} is the views' prefix.
TABLES_OF = {
    "search_outputs": ("script_hex STRING", _OUTPUT, f"{_SHOWN} WHERE substr(o.locking_bytecode, 1, 25) = unhex(script_hex)"),
    "search_outputs_prefix": ("prefix_hex STRING", _OUTPUT, f"{_SHOWN} WHERE startswith(substr(o.locking_bytecode, 1, 25), unhex(prefix_hex))"),
    "data_carriers_of": ("tx_hash BINARY", _OUTPUT, f"{_SHOWN} WHERE o.transaction_hash = tx_hash AND (o.value_satoshis = 0 OR startswith(o.locking_bytecode, X'6A'))"),
    "authchains_of": ("tx BIGINT", "authhead_transaction_hash BINARY, authchain_length BIGINT", "SELECT a.authhead_transaction_hash, a.authchain_length FROM {p}authchain_view a WHERE a.transaction_internal_id = tx"),
}


def register(ledger: Ledger, prefix: str = "ledger_", views: tuple[str, ...] = ("authchain_view",)) -> None:
    """Registers the ledger's tables, some views and all functions with the ledger's session."""
    spark = ledger.spark
    for name in TABLES:
        ledger[name].createOrReplaceTempView(f"{prefix}{name}")
    for name in views:
        VIEWS[name](ledger).createOrReplaceTempView(f"{prefix}{name}")
    for name, (args, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    for name, (args, columns, body) in TABLES_OF.items():
        if "authchain_view" in views or "authchain" not in name:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body.format(p=prefix)}")
