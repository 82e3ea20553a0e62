"""The ledger queries by name, over the projected ledger of a folder's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bytes as B
from .functions import catalog, text
from .functions.bytecode import pattern_counts
from .operators import authchain, chain, mempool, modes, search, sinks, throughput, values, wire
from .plans import layer
from .plans.projection import Projection, at, epoch
from .plans.query import Compiler, Query, json_rows, stream_page
from .plans.storage import shared_dir, stored
from .sources.ledger import Ledger, block_rows, decode_blocks, transaction_rows
from .sources.raw import raw_blocks
from .streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Projection, Ledger], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(p := Projection(spark, sf_dir), p.ledger())
    return f


def hx(name: str, alias: str | None = None) -> Column:
    return B.to_hex(F.col(name)).alias(alias or name)


def tx_keys(ledger: Ledger) -> DataFrame:
    return ledger["transaction"].select(F.col("internal_id").alias("tx"), F.col("hash").alias("transaction_hash"))


@query
def block_fee_summary(p, ledger):
    return values.block_measures(ledger).select("height", "transaction_count", "input_count", "fee_satoshis")


@query
def tx_value_aggregates(p, ledger):
    return values.transaction_measures(ledger).select("internal_id", "input_value_satoshis", "output_value_satoshis", "fee_satoshis")


@query
def block_value_aggregates(p, ledger):
    return values.block_measures(ledger).select("height", "output_count", "input_value_satoshis", "output_value_satoshis", "generated_value_satoshis")


@query
def tx_counts(p, ledger):
    return values.transaction_measures(ledger).select("internal_id", "input_count", "output_count", "is_coinbase")


@query
def input_value_lookup(p, ledger):
    return values.input_values(ledger).select("transaction_internal_id", "input_index", hx("outpoint_transaction_hash"), "outpoint_index", "value_satoshis")


@query
def unspent_outputs(p, ledger):
    return values.unspent_outputs(ledger).select(hx("transaction_hash"), "output_index", "value_satoshis")


@query
def output_spenders(p, ledger):
    return values.spenders(ledger).select(hx("transaction_hash"), "output_index", F.size("spent_by").cast("long").alias("spenders"), F.array_min(F.transform("spent_by", lambda x: x["transaction_internal_id"])).alias("first_spender"))


@query
def p2sh_outputs(p, ledger):
    return values.p2sh_outputs(ledger).select(hx("transaction_hash"), "output_index", hx("locking_bytecode"))


@query
def p2sh_inputs_redeem(p, ledger):
    return values.p2sh_inputs(ledger).select("transaction_internal_id", "input_index", "redeem_pattern", "value_satoshis")


@query
def data_carrier_outputs(p, ledger):
    return values.data_carrier_outputs(ledger).select(hx("transaction_hash"), "output_index", "value_satoshis")


@query
def identity_signing_outputs(p, ledger):
    one = values.indexed_output(ledger, 0).select("internal_id", F.col("value_satoshis").alias("identity_value"))
    two = values.indexed_output(ledger, 1).select("internal_id", F.col("value_satoshis").alias("signing_value"))
    return one.join(two, "internal_id")


@query
def search_output(p, ledger):
    wanted = ["76a914" + _sha(str(k))[:40] + "88ac" for k in (1, 2, 3)] + ["6a04" + _sha("7")[:8], "76a914" + _sha("1")[:40] + "88ac", "76a914" + _sha("4")[:40] + "88acff"]
    return search.search_output(ledger, wanted).select(hx("transaction_hash"), "output_index", hx("locking_bytecode"))


@query
def search_output_prefix(p, ledger):
    return search.search_output_prefix(ledger, "a91425").select(hx("transaction_hash"), "output_index", hx("locking_bytecode"))


@query
def token_search(p, ledger):
    return search.search_token(ledger, _sha("3")).select(hx("transaction_hash"), "output_index", "fungible_token_amount", "nonfungible_token_capability", hx("nonfungible_token_commitment"))


def _sha(s: str) -> str:
    import hashlib

    return hashlib.sha256(s.encode()).hexdigest()


@query
def bytecode_patterns(p, ledger):
    return pattern_counts(ledger["output"], "locking_bytecode", "outputs")


@query
def unlocking_patterns(p, ledger):
    return pattern_counts(ledger["input"], "unlocking_bytecode", "inputs", redeem=True)


@query
def encode_ints(p, ledger):
    v = F.col("value_satoshis")
    return ledger["output"].select(v, B.le_hex(v, 2).alias("u16"), B.le_hex(v, 4).alias("u32"), B.le_hex(-v, 4).alias("i32"), B.le_hex(v * 1000003, 8).alias("u64")).distinct()


@query
def encode_compact_uint(p, ledger):
    v = F.col("value_satoshis")
    return ledger["output"].select(v, B.compact_uint_hex(v).alias("value"), B.compact_uint_hex(v % 300).alias("small"), B.compact_uint_hex(v * 1000003).alias("large")).distinct()


@query
def reverse_hashes(p, ledger):
    return ledger["transaction"].select("internal_id", B.to_hex(B.reverse_bytes(F.col("hash"))).alias("reversed"))


@query
def encode_block_header(p, ledger):
    return ledger["block"].select("height", wire.header_hex().alias("header"), wire.hash_of(wire.header_hex()).alias("header_hash"))


@query
def encode_transaction(p, ledger):
    return wire.encoded_transactions(ledger).select("internal_id", "encoded_hex")


@query
def encode_block(p, ledger):
    e = wire.encoded_blocks(ledger)
    return e.select("height", (F.length("encoded_hex") / 2).cast("long").alias("bytes"), F.sha2("encoded_hex", 256).alias("digest"))


@query
def authchains(p, ledger):
    return authchain.chain_ends(ledger)


@query
def authchain_view(p, ledger):
    c = authchain.chains(ledger)
    return c.select("base", "head", F.size("members").cast("long").alias("length"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query
def authchain_migrations(p, ledger):
    return authchain.migrations(authchain.chains(ledger))


@query
def double_spend_conflicts(p, ledger):
    return values.double_spends(ledger).select("a", "b", hx("outpoint_transaction_hash"), "outpoint_index")


def shown(history: DataFrame) -> DataFrame:
    return history.select(F.col("node_internal_id").cast("long"), "transaction_internal_id", epoch(F.col("validated_at")).alias("validated"), epoch(F.col("replaced_at")).alias("replaced"))


@query
def mempool_replacement(p, ledger):
    return shown(mempool.replace(ledger, ledger["node_transaction"].where("transaction_internal_id % 20 = 0")).history)


@query
def mempool_confirmation(p, ledger):
    newest = ledger["block"].agg(F.floor(F.max("height") * 19 / 20).alias("least"))
    new = ledger["node_block"].join(F.broadcast(newest), F.col("block_internal_id") >= F.col("least")).drop("least")
    return shown(mempool.accept(ledger, new).history)


@query
def accepted_mempool_repair(p, ledger):
    return shown(mempool.repair_accepted(ledger).history)


def _replaced(ledger: Ledger) -> DataFrame:
    gone = ledger["node_transaction"].where("transaction_internal_id % 50 = 0")
    return gone.withColumn("replaced_at", F.col("validated_at") + F.make_dt_interval(secs=F.lit(600)))


@query
def mempool_cascade(p, ledger):
    gone = _replaced(ledger)
    left = ledger["node_transaction"].join(gone, mempool.KEY, "left_anti")
    return shown(mempool.invalidate(ledger.with_tables(node_transaction=left), gone).history)


@query
def mempool_orphan_backfill(p, ledger):
    gone = _replaced(ledger)
    left = ledger["node_transaction"].join(gone, mempool.KEY, "left_anti")
    history = gone.select(F.lit(0).cast("long").alias("internal_id"), "*")
    return shown(mempool.backfill_orphans(ledger.with_tables(node_transaction=left, node_transaction_history=history)).history)


def _horizon(ledger: Ledger) -> Column:
    last = ledger["node_transaction"].agg(F.max("validated_at")).first()[0]
    return F.lit(last).cast("timestamp_ntz")


@query
def mempool_expiry_scan(p, ledger):
    due = mempool.expiring(ledger, _horizon(ledger), 14 * 86400 * 1000)
    return due.select("name", hx("hash"), epoch(F.col("expires_at")).alias("expires"))


@query
def mempool_expiry(p, ledger):
    return shown(mempool.expire(ledger, _horizon(ledger), 14 * 86400 * 1000).history)


@query
def node_unconfirmed_count(p, ledger):
    return values.unconfirmed_counts(ledger).select("name", "unconfirmed_transaction_count")


@query
def incomplete_block_audit(p, ledger):
    return chain.incomplete_blocks(ledger, 0, _best(ledger) + 1).select("height", hx("hash"), "linked", "linked_bytes", "size_bytes")


def _best(ledger: Ledger) -> int:
    return ledger["block"].agg(F.max("height")).first()[0] or 0


@query
def audit_report(p, ledger):
    return chain.audit_report(ledger, 0, _best(ledger) + 1)


@query
def chain_gap_restore(p, ledger):
    return chain.sync_states(ledger).select(F.col("node_internal_id").cast("long"), "synced_to", "additional")


@query
def chain_gaps(p, ledger):
    return chain.gaps(ledger).select(F.col("node_internal_id").cast("long"), "first", "last")


@query
def sync_percentages(p, ledger):
    return chain.sync_percentages(ledger).select(F.col("node_internal_id").cast("long"), "pending", "best", "percent")


@query
def header_locator(p, ledger):
    return chain.locator(ledger, 2).select("position", "height", hx("hash"))


def _fork(ledger: Ledger) -> DataFrame:
    """Source 1's new headers: other hashes for its heights that leave 3 on division by 5, in the last tenth."""
    least = ledger["block"].agg(F.floor(F.max("height") * 9 / 10).alias("least"))
    h = chain.accepted_heights(ledger).join(F.broadcast(least), F.col("height") >= F.col("least")).where("node_internal_id = 1 and height % 5 = 3")
    return h.select("node_internal_id", "height", F.unhex(F.sha2("hash", 256)).alias("hash"))


@query
def reorg_stale_blocks(p, ledger):
    _, history = chain.stale_blocks(ledger, _fork(ledger), at(F.lit(10**9).cast("long")))
    return history.select(F.col("node_internal_id").cast("long"), "block_internal_id", epoch(F.col("accepted_at")).alias("accepted"), epoch(F.col("removed_at")).alias("removed"))


@query
def reorg_spliced_chain(p, ledger):
    new, _ = chain.splice(chain.accepted_heights(ledger), _fork(ledger))
    return new.groupBy(F.col("node_internal_id").cast("long")).agg(F.count(F.lit(1)).alias("blocks"), F.min(B.to_hex(F.col("hash"))).alias("least"), F.max(B.to_hex(F.col("hash"))).alias("most"))


@query
def nodes_with_block(p, ledger):
    return chain.nodes_with_block(ledger).select("height", F.array_join("nodes", ",").alias("nodes"))


@query
def catch_up_prefix(p, ledger):
    headers = chain.accepted_heights(ledger)
    known = ledger["block"].where("height % 97 <> 96").select("hash")
    pending = chain.sync_states(ledger).select("node_internal_id", (F.col("synced_to") + 1).alias("pending"))
    return chain.catch_up(headers, known, pending).select(F.col("node_internal_id").cast("long"), "height")


@query
def accept_headers(p, ledger):
    late = F.col("block_internal_id") % 3 == 0
    headers = ledger["node_block"].join(ledger["block"].select(F.col("internal_id").alias("block_internal_id"), "hash", "timestamp"), "block_internal_id")
    heard = F.col("timestamp") + F.when(late, 7201).otherwise(7200)
    headers = headers.select("node_internal_id", "hash", at(heard).alias("heard_at"), heard.alias("heard_seconds"))
    kept = ledger["node_block"].where("block_internal_id % 4 = 1")
    new = sinks.accept_headers(ledger.with_tables(node_block=kept), headers)
    return new.select(F.col("node_internal_id").cast("long"), "block_internal_id", epoch(F.col("accepted_at")).alias("accepted"))


def intervals(p: Projection) -> DataFrame:
    ts = F.col("ts")
    ms = epoch(ts) * 1000 + F.floor(F.expr("extract(second from ts)") % 1 * 1000).cast("long")
    return p.read("events").select(ms.alias("start_ms"), (F.col("event_id") % 5000).alias("duration_ms"), (1 + F.col("user_id") % 50).alias("units"))


@query
def throughput_timeline(p, ledger):
    t = throughput.timeline(intervals(p), ["units"])
    return t.select("time_ms", "concurrency", F.round(F.col("units") + 1e-9, 3).alias("rate"), "next_ms")


@query
def throughput_summary(p, ledger):
    s = throughput.summary(intervals(p), ["units"])
    return s.select("intervals", "active_ms", F.round("average_concurrency", 6).alias("average_concurrency"), F.round("average_duration_ms", 6).alias("average_duration_ms"), F.col("total_units"), F.round("units_per_active_second", 4).alias("units_per_active_second"))


@query
def format_bytes(p, ledger):
    v = F.col("value_satoshis")
    low = v % 100000
    return ledger["output"].select(v, text.format_bytes(v).alias("size"), text.format_bytes(v * 1000).alias("large"), text.format_rate(v, F.lit(1500)).alias("rate"), text.format_rate(low, F.lit(100000)).alias("slow"), text.format_rate(low, F.lit(7000000)).alias("slower"), text.format_rate(v, F.lit(0)).alias("none")).distinct()


@query
def index_progress(p, ledger):
    b = ledger["block"]
    h = F.col("height")
    return b.select(h, text.index_progress(h % 100, F.lit(100), F.when(h % 2 == 0, h % 100).otherwise(0), F.when(h % 3 == 0, 0).otherwise(100)).alias("percent"))


@query
def daily_statistics(p, ledger):
    b = values.block_measures(ledger)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / 86400).cast("int"))
    return b.groupBy(F.year(day).cast("long").alias("year")).agg(F.sum("transaction_count").alias("transactions"), F.round(F.avg("size_bytes"), 6).alias("average_size"), F.sum("size_bytes").alias("bytes"))


# the declarative query layer


def compiler(ledger: Ledger, **kw) -> Compiler:
    return layer.compiler(ledger, **kw)


@query
def gql_where_tree(p, ledger):
    tree = {"_or": [{"fee_satoshis": {"_gt": 1000000, "_lte": 90000000}}, {"_and": [{"is_coinbase": {"_eq": True}}, {"output_count": {"_in": [1, 2, 3]}}]}], "_not": {"internal_id": {"_lt": 100}}, "locktime": {"_nin": [7, 8]}}
    return compiler(ledger).compile(Query("transaction", ("internal_id", "fee_satoshis"), tree))


@query
def gql_relation_filter(p, ledger):
    tree = {"outputs": {"value_satoshis": {"_gt": 9000000}, "token_category": {"_is_null": True}}, "_not": {"inputs": {"outpoint": {"value_satoshis": {"_lt": 1000000}}}}}
    return compiler(ledger).compile(Query("transaction", ("internal_id",), tree))


@query
def gql_relation_or(p, ledger):
    tree = {"_or": [{"inputs": {"outpoint": {"value_satoshis": {"_eq": 0}}}}, {"fee_satoshis": {"_lt": -20000000}}]}
    return compiler(ledger).compile(Query("transaction", ("internal_id",), tree))


@query
def gql_order_nulls(p, ledger):
    """All outputs in the order of their nested lists: null amounts first, as the order descends."""
    q = Query("output", ("fungible_token_amount", "value_satoshis", "output_index")).order_by({"fungible_token_amount": "desc"}, {"value_satoshis": "asc"}, {"output_index": "asc"})
    df = compiler(ledger).compile(Query("transaction", ("internal_id",)).with_nested(outputs=q))
    shown = F.transform("outputs", lambda x: F.concat_ws(":", F.coalesce(x["fungible_token_amount"].cast("string"), F.lit("-")), x["value_satoshis"].cast("string"), x["output_index"].cast("string")))
    return df.select("internal_id", F.array_join(shown, ",").alias("outputs"))


@query
def gql_distinct_on(p, ledger):
    q = Query("output", ("output_index", "value_satoshis")).distinct_on("output_index").order_by({"output_index": "asc"}, {"value_satoshis": "desc"})
    return compiler(ledger).compile(q)


@query
def gql_limit_offset(p, ledger):
    q = Query("transaction", ("internal_id", "fee_satoshis")).order_by({"fee_satoshis": "desc_nulls_last"}, {"internal_id": "asc"})
    return compiler(ledger).compile(q.offset(20).limit(30))


@query
def gql_topk_per_parent(p, ledger):
    inner = Query("output", ("output_index", "value_satoshis")).order_by({"value_satoshis": "desc"}, {"output_index": "asc"}).limit(2).where({"value_satoshis": {"_gt": 0}})
    df = compiler(ledger).compile(Query("transaction", ("internal_id",)).with_nested(outputs=inner))
    return df.select("internal_id", F.array_join(F.transform("outputs", lambda x: F.concat_ws(":", x["output_index"].cast("string"), x["value_satoshis"].cast("string"))), ",").alias("top"))


@query
def gql_nested_objects(p, ledger):
    q = Query("input", ("transaction_internal_id", "input_index")).with_nested(outpoint=Query("output", ("value_satoshis",)), transaction=Query("transaction", ("locktime",)))
    return compiler(ledger).compile(q).select("transaction_internal_id", "input_index", F.col("outpoint.value_satoshis").alias("value"), F.col("transaction.locktime").alias("locktime"))


AGGREGATES = ("avg", "max", "min", "stddev", "stddev_pop", "stddev_samp", "sum", "var_pop", "var_samp", "variance")


@query
def gql_aggregate_order_by(p, ledger):
    """For each aggregate, every owner's transaction that comes first by it."""
    by = {"count": {"count": "desc"}, **{f: {f: {"value_satoshis": "desc"}} for f in AGGREGATES}}
    q = Query("transaction", ("locktime", "internal_id")).distinct_on("locktime")
    return compiler(ledger).compile_firsts(q, {f: ({"locktime": "asc"}, {"outputs_aggregate": how}, {"internal_id": "asc"}) for f, how in by.items()}, "by")


@query
def gql_by_pk(p, ledger):
    """A row of each table, looked up by its key."""
    found = ledger.by_key("transaction", 1).select("internal_id", hx("hash"), "locktime")
    first = found.select(F.lit("transaction").alias("root"), F.concat_ws(":", "internal_id", "hash", "locktime").alias("row"))
    keys = {"block": (7,), "block_transaction": (7, _first_of(ledger, 7)), "node": (2,), "node_block": (2, 7), "input": (1, 0), "output": (bytearray(bytes.fromhex(_sha("1"))), 0), "node_transaction": _pending(ledger)}
    shown = {"block": ("height", "timestamp"), "block_transaction": ("block_internal_id", "transaction_index"), "node": ("name",), "node_block": ("node_internal_id", "block_internal_id"), "input": ("transaction_internal_id", "outpoint_index"), "output": ("output_index", "value_satoshis"), "node_transaction": KEY_OF_PENDING}
    parts = [ledger.by_key(n, *k).select(F.lit(n).alias("root"), F.concat_ws(":", *shown[n]).alias("row")) for n, k in keys.items()]
    return reduce(DataFrame.unionAll, parts, first)


KEY_OF_PENDING = ("node_internal_id", "transaction_internal_id")


def _first_of(ledger: Ledger, block: int) -> int:
    return ledger["block_transaction"].where(F.col("block_internal_id") == block).agg(F.min("transaction_internal_id")).first()[0]


def _pending(ledger: Ledger) -> tuple[int, int]:
    return tuple(ledger["node_transaction"].agg(F.min(F.struct(*KEY_OF_PENDING)).alias("k")).first()["k"])


@query
def gql_first_outputs(p, ledger):
    """The relation that joins an input with the transaction it spends from gives that transaction's first output."""
    q = Query("input", ("transaction_internal_id", "input_index")).with_nested(outpoint_transaction=Query("output", ("output_index", "value_satoshis")))
    return compiler(ledger).compile(q).select("transaction_internal_id", "input_index", F.col("outpoint_transaction.output_index").alias("first"), F.col("outpoint_transaction.value_satoshis").alias("value"))


@query
def gql_block_relations(p, ledger):
    q = Query("block", ("height",)).with_nested(previous_block=Query("block", ("height",)), accepted_by=Query("node_block", ("node_internal_id",)).order_by({"node_internal_id": "asc"}), transactions=Query("block_transaction", ("transaction_index",)))
    df = compiler(ledger).compile(q)
    return df.select("height", F.col("previous_block.height").alias("previous"), F.array_join(F.transform("accepted_by", lambda x: x["node_internal_id"].cast("string")), ",").alias("nodes"), F.size("transactions").cast("long").alias("transactions"))


@query
def gql_node_relations(p, ledger):
    q = Query("node", ("name", "unconfirmed_transaction_count")).with_nested(accepted_blocks=Query("node_block", ("block_internal_id",)).where({"block": {"height": {"_lt": 100}}}), unconfirmed_transactions=Query("node_transaction", ("transaction_internal_id",)).with_nested(transaction=Query("transaction", ("locktime",))))
    df = compiler(ledger).compile(q)
    owners = F.aggregate("unconfirmed_transactions", F.lit(0).cast("long"), lambda a, x: a + x["transaction"]["locktime"])
    return df.select("name", "unconfirmed_transaction_count", F.size("accepted_blocks").cast("long").alias("early_blocks"), owners.alias("owners"))


@query
def gql_history_relations(p, ledger):
    """Both history tables with their source, block and transaction."""
    _, stale = chain.stale_blocks(ledger, _fork(ledger), at(F.lit(10**9).cast("long")))
    gone = _replaced(ledger)
    number = F.lit(0).cast("long").alias("internal_id")
    past = ledger.with_tables(node_block_history=stale.select(number, "*"), node_transaction_history=gone.select(number, "*"))
    blocks = compiler(past).compile(Query("node_block_history", ("block_internal_id",)).with_nested(node=Query("node", ("name",)), block=Query("block", ("height",))))
    txs = compiler(past).compile(Query("node_transaction_history", ("transaction_internal_id",)).with_nested(node=Query("node", ("name",)), transaction=Query("transaction", ("locktime",))))
    shown = [blocks.select(F.lit("block").alias("kind"), F.col("block_internal_id").alias("id"), "node.name", F.col("block.height").alias("value")), txs.select(F.lit("transaction").alias("kind"), F.col("transaction_internal_id").alias("id"), "node.name", F.col("transaction.locktime").alias("value"))]
    return reduce(DataFrame.unionAll, shown)


@query
def gql_validations(p, ledger):
    gone = _replaced(ledger)
    past = ledger.with_tables(node_transaction_history=gone.select(F.lit(0).cast("long").alias("internal_id"), "*"))
    q = Query("transaction", ("internal_id",)).with_nested(node_validations=Query("node_transaction", ("node_internal_id",)), node_validation_timeline=Query("node_transaction_history", ("node_internal_id",)), input_outpoint_transactions=Query("input", ("transaction_internal_id",)))
    df = compiler(past).compile(q.where({"node_validations": {}}))
    return df.select("internal_id", *[F.size(c).cast("long").alias(n) for c, n in (("node_validations", "validations"), ("node_validation_timeline", "replacements"), ("input_outpoint_transactions", "spends"))])


@query
def gql_authchains(p, ledger):
    chains = Query("authchain_view", ("authchain_length",)).with_nested(authhead=Query("transaction", ("internal_id",)), migrations=Query("authchain_migrations_view", ("migration_index",)).with_nested(transaction=Query("transaction", ("internal_id",))).order_by({"migration_index": "asc"}))
    df = compiler(ledger).compile(Query("transaction", ("internal_id",)).with_nested(authchains=chains).where({"authchains": {"authchain_length": {"_gt": 1}}}))
    one = df.select("internal_id", F.explode("authchains").alias("c"))
    ids = F.transform("c.migrations", lambda m: m["transaction"]["internal_id"])
    return one.select("internal_id", F.col("c.authhead.internal_id").alias("head"), F.col("c.authchain_length").alias("length"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"))


@query
def authchain_migration_transactions(p, ledger):
    return authchain.migration_transactions(ledger).select("authbase_internal_id", "migration_index", hx("hash"), "locktime", "size_bytes")


@query
def gql_computed_fields(p, ledger):
    """Fields that are made only where they are asked for."""
    q = Query("transaction", ("internal_id", "fee_satoshis", "encoded_hex")).with_nested(identity_output=Query("output", ("value_satoshis", "locking_bytecode_pattern")), signing_output=Query("output", ("value_satoshis",)), data_carrier_outputs=Query("output", ("output_index",)))
    df = compiler(ledger).compile(q)
    return df.select("internal_id", "fee_satoshis", F.sha2("encoded_hex", 256).alias("digest"), F.col("identity_output.value_satoshis").alias("identity_value"), F.col("identity_output.locking_bytecode_pattern").alias("identity_pattern"), F.col("signing_output.value_satoshis").alias("signing_value"), F.size("data_carrier_outputs").cast("long").alias("carriers"))


@query
def gql_computed_inputs(p, ledger):
    q = Query("input", ("transaction_internal_id", "input_index", "value_satoshis", "redeem_bytecode_pattern")).where({"redeem_bytecode_pattern": {"_eq": "a91487"}})
    return compiler(ledger).compile(q)


@query
def gql_like_regex_similar(p, ledger):
    agents = [{"name": {"_like": "a%"}}, {"name": {"_ilike": "%EAST"}}, {"name": {"_regex": "r.p"}}, {"name": {"_similar": "(afr|as)i(a|ca)"}}, {"name": {"_iregex": "^MIDDLE"}}, {"name": {"_nlike": "%a%"}}, {"name": {"_nilike": "%A%"}}, {"name": {"_nregex": "^a"}}, {"name": {"_niregex": "^(A|E)"}}, {"name": {"_nsimilar": "(a|e)%"}}]
    c = compiler(ledger)
    parts = [c.compile(Query("node", ("name",), t)).withColumn("test", F.lit(i).cast("long")) for i, t in enumerate(agents)]
    return reduce(DataFrame.unionAll, parts)


@query
def gql_row_caps(p, ledger):
    q = Query("input", ("transaction_internal_id", "input_index")).order_by({"transaction_internal_id": "asc"}, {"input_index": "asc"}).limit(5000)
    return compiler(ledger, capped=True).compile(q)


@query
def gql_stream_cursor(p, ledger):
    return stream_page(ledger["output"].select("value_satoshis", "output_index", hx("transaction_hash")), {"value_satoshis": (5000000, "asc"), "output_index": (2, "asc"), "transaction_hash": ("8", "asc")}, 50)


@query
def gql_nested_caps(p, ledger):
    """A public reader's cap holds in each nested list."""
    df = compiler(ledger, capped=True).compile(Query("node", ("name",)).with_nested(unconfirmed_transactions=Query("node_transaction", ("transaction_internal_id",)).order_by({"transaction_internal_id": "asc"})))
    return df.select("name", F.size("unconfirmed_transactions").cast("long").alias("shown"), F.element_at("unconfirmed_transactions", -1)["transaction_internal_id"].alias("last"))


@query
def gql_page_of_parents(p, ledger):
    """Parents are cut before their lists are made."""
    inner = Query("output", ("value_satoshis",)).order_by({"value_satoshis": "desc"}, {"output_index": "asc"}).limit(3)
    df = compiler(ledger).compile(Query("transaction", ("internal_id",)).order_by({"internal_id": "desc"}).offset(5).limit(40).with_nested(outputs=inner, identity_output=Query("output", ("output_index",))))
    return df.select("internal_id", F.array_join(F.transform("outputs", lambda x: x["value_satoshis"].cast("string")), ",").alias("top"), F.col("identity_output.output_index").alias("identity"))


@query
def gql_json(p, ledger):
    q = Query("block", ("height", "hash")).order_by({"height": "asc"})
    return json_rows(compiler(ledger).compile(q))


@query
def node_upsert(p, ledger):
    n = ledger["node"]
    later = at(F.lit(1500000000).cast("long"))
    seen = n.where("internal_id <> 3").select("name", F.lit(70016).alias("protocol_version"), F.concat(F.lit("new-"), "name").alias("user_agent"), later.alias("first_connected_at"), later.alias("latest_connection_began_at"))
    out = sinks.upsert_nodes(n, seen)
    return out.select("name", F.col("internal_id").cast("long"), F.col("protocol_version").cast("long"), "user_agent", epoch(F.col("first_connected_at")).alias("first"), epoch(F.col("latest_connection_began_at")).alias("latest"))


@query
def insert_if_absent(p, ledger):
    t = ledger["transaction"]
    there = t.where("internal_id % 3 = 0")
    new = sinks.insert_if_absent(there, t.unionAll(t.where("internal_id % 4 = 0")), ["hash"])
    outs = sinks.children_of_inserted(ledger["output"], new.select(F.col("hash").alias("transaction_hash")), ["transaction_hash"])
    n = outs.groupBy("transaction_hash").agg(F.count(F.lit(1)).alias("outputs"))
    return new.join(n, new["hash"] == n["transaction_hash"], "left").select("internal_id", F.coalesce("outputs", F.lit(0).cast("long")).alias("outputs"))


@query
def assigned_ids(p, ledger):
    t = ledger["transaction"]
    new = sinks.with_ids(t.where("internal_id % 2 = 0"), t.where("internal_id % 2 = 1").select("hash"), ["hash"])
    return new.select(hx("hash"), "internal_id")


@query
def announced_transactions(p, ledger):
    t = ledger["node_transaction"].join(tx_keys(ledger).withColumnRenamed("tx", "transaction_internal_id"), "transaction_internal_id")
    heard = t.select("node_internal_id", F.col("transaction_hash").alias("hash"), "validated_at")
    again = heard.withColumn("validated_at", F.col("validated_at") - F.make_dt_interval(secs=F.lit(5)))
    odd = ledger["node_transaction"].where("transaction_internal_id % 3 = 0")
    new = mempool.announce(ledger.with_tables(node_transaction=odd), heard.unionAll(again))
    return new.select(F.col("node_internal_id").cast("long"), "transaction_internal_id", epoch(F.col("validated_at")).alias("validated"))


# writes


def _half(ledger: Ledger) -> Ledger:
    """The blocks of even height with their transactions, inputs and outputs."""
    b = ledger["block"].where("height % 2 = 0")
    links = ledger["block_transaction"].join(b.select(F.col("internal_id").alias("block_internal_id")), "block_internal_id", "left_semi")
    t = ledger["transaction"].join(links.select(F.col("transaction_internal_id").alias("internal_id")), "internal_id", "left_semi")
    ids = t.select(F.col("internal_id").alias("transaction_internal_id"), F.col("hash").alias("transaction_hash"))
    return ledger.with_tables(block=b, block_transaction=links, transaction=t, input=ledger["input"].join(ids, "transaction_internal_id", "left_semi"), output=ledger["output"].join(ids, "transaction_hash", "left_semi"), node_block=ledger["node_block"].limit(0))


def _totals(saved: Ledger) -> DataFrame:
    """What each saved block leads to by its own ids."""
    t = saved["transaction"].select(F.col("internal_id").alias("transaction_internal_id"), F.col("hash").alias("transaction_hash"), "size_bytes")
    ins = saved["input"].groupBy("transaction_internal_id").agg(F.count(F.lit(1)).alias("inputs"))
    outs = saved["output"].groupBy("transaction_hash").agg(F.sum("value_satoshis").alias("value"))
    t = t.join(ins, "transaction_internal_id", "left").join(outs, "transaction_hash", "left")
    b = saved["block"].select(F.col("internal_id").alias("block_internal_id"), "height")
    nodes = saved["node_block"].groupBy("block_internal_id").agg(F.count(F.lit(1)).alias("nodes"))
    per = saved["block_transaction"].join(t, "transaction_internal_id").groupBy("block_internal_id").agg(F.count(F.lit(1)).alias("transactions"), F.sum("size_bytes").alias("bytes"), F.sum("inputs").alias("inputs"), F.sum("value").alias("value"))
    zero = F.lit(0).cast("long")
    return b.join(per, "block_internal_id", "left").join(nodes, "block_internal_id", "left").select("height", *[F.coalesce(c, zero).alias(c) for c in ("transactions", "bytes", "inputs", "value", "nodes")])


def _heard(ledger: Ledger) -> DataFrame:
    b = ledger["block"].select(F.col("internal_id").alias("block_internal_id"), "hash")
    return ledger["node_block"].join(b, "block_internal_id").select("node_internal_id", "hash", "accepted_at")


@query
def save_blocks(p, ledger):
    """All blocks are sent to a ledger that has every second one: what is there afterwards."""
    there = _half(ledger)
    batch = decode_blocks(stored(block_rows(ledger)))
    new = sinks.save_blocks(there, batch, _heard(ledger))
    sinks.check_saved(there, batch, new)
    return _totals(there.with_tables(**{n: there[n].unionByName(df) for n, df in new.items()}))


@query
def save_transactions(p, ledger):
    """Pending transactions are sent with their validations to a ledger that has those of even height."""
    there = _half(ledger).with_tables(node_transaction=ledger["node_transaction"].limit(0))
    pending = ledger["node_transaction"].join(tx_keys(ledger).withColumnRenamed("tx", "transaction_internal_id"), "transaction_internal_id")
    sent = transaction_rows(ledger).join(pending.select("transaction_internal_id").distinct(), "transaction_internal_id", "left_semi").drop("transaction_internal_id")
    new = sinks.save_transactions(there, sent, pending.select("node_internal_id", F.col("transaction_hash").alias("hash"), "validated_at"))
    t = there["transaction"].unionByName(new["transaction"]).select(F.col("internal_id").alias("transaction_internal_id"), hx("hash"))
    return new["node_transaction"].join(t, "transaction_internal_id").select(F.col("node_internal_id").cast("long"), "hash", epoch(F.col("validated_at")).alias("validated"))


@query
def stream_ingest_blocks(p, ledger):
    """All blocks pass through a stream of files, in several micro-batches, into stored tables."""
    spark, root = ledger.spark, f"{shared_dir(ledger.spark)}/ingest-{uuid.uuid4().hex}"
    block_rows(ledger, 96).write.option("compression", "gzip").json(f"{root}/in")
    q = feeds.ingest_blocks(feeds.block_stream(spark, f"{root}/in", 32), f"{root}/out", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return _totals(feeds.read_batches(spark, f"{root}/out")).drop("nodes")


@query
def raw_round_trip(p, ledger):
    """Encoded blocks are decoded again: their sizes, counts, and whether the header's hash is that of the bytes."""
    e = wire.raw_encoded_blocks(ledger)
    r = raw_blocks(e, "raw", "height").select("record.*", "error")
    outs = F.aggregate("transactions", F.lit(0).cast("long"), lambda a, t: a + F.aggregate(t["outputs"], F.lit(0).cast("long"), lambda b, o: b + o["valueSatoshis"]))
    ins = F.aggregate("transactions", F.lit(0).cast("long"), lambda a, t: a + F.size(t["inputs"]))
    return r.select("height", F.col("previousBlockHash").alias("previous"), F.col("hash").alias("header_hash"), F.size("transactions").cast("long").alias("transactions"), ins.alias("inputs"), outs.alias("value"), F.col("error").isNull().alias("whole"))


@query
def follow_headers(p, ledger):
    """Header messages go on from their parent's height: a fork of source 1, known headers of 2, no known parent for 3."""
    h = chain.accepted_heights(ledger)
    top = h.groupBy("node_internal_id").agg((F.max("height") - 5).alias("cut"))
    tail = h.join(F.broadcast(top), "node_internal_id").where("height >= cut")
    first = tail.groupBy("node_internal_id").agg(F.min("height").alias("least"))
    tail = tail.join(F.broadcast(first), "node_internal_id")
    parent = tail.where("height = least").select("node_internal_id", F.when(F.col("node_internal_id") == 3, F.unhex(F.lit("ab" * 32))).otherwise(F.col("hash")).alias("previous_block_hash"))
    sent = tail.where("height > least").join(F.broadcast(parent), "node_internal_id").where("node_internal_id in (1, 2, 3)")
    sent = sent.select("node_internal_id", (F.col("height") - F.col("least") - 1).alias("position"), F.when(F.col("node_internal_id") == 1, F.unhex(F.sha2("hash", 256))).otherwise(F.col("hash")).alias("hash"), "previous_block_hash")
    _, stale, ignored = chain.follow(h, sent)
    gone = stale.select(F.col("node_internal_id").cast("long"), "height", F.lit("stale").alias("what"))
    return gone.unionAll(ignored.select(F.col("node_internal_id").cast("long"), F.lit(None).cast("long"), F.col("reason")))


@query
def sync_after_rewind(p, ledger):
    """Progress after every source was re-organized at height 6 * its number, and the height each needs next."""
    states, extra = chain.sync_states(ledger).select("node_internal_id", "synced_to"), chain.accepted_heights(ledger).select("node_internal_id", "height")
    back = ledger["node"].select(F.col("internal_id").alias("node_internal_id"), (6 * F.col("internal_id")).cast("long").alias("height"))
    states, extra = chain.rewound(states, extra, back)
    return states.join(chain.next_heights(states, extra), "node_internal_id").select(F.col("node_internal_id").cast("long"), "synced_to", "next")


@query
def mode_gates(p, ledger):
    """What a catching-up and a live ledger let in and clear."""
    return reduce(DataFrame.unionAll, [modes.Mode(live).accepted(ledger, ledger["node_block"]).history.agg(F.count(F.lit(1)).alias("cleared")).crossJoin(modes.Mode(live).heard(ledger["node_transaction"]).agg(F.count(F.lit(1)).alias("heard"))).select(F.lit(live).alias("live"), "cleared", "heard") for live in (False, True)])


@query
def sql_functions(p, ledger):
    """Searches and encoders by name in SQL."""
    catalog.register(ledger, views=())
    return ledger.spark.sql(f"""SELECT lower(hex(transaction_hash)) AS transaction_hash, output_index, lower(hex(compact_uint(value_satoshis))) AS value, lower(hex(uint32le(output_index))) AS idx, is_script_hash(locking_bytecode) AS script_hash
        FROM (SELECT * FROM search_outputs_prefix('a91425') UNION ALL SELECT * FROM search_outputs('76a914{_sha("1")[:40]}88ac'))""")
