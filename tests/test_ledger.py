import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom import schema
from ledgerloom.functions import catalog
from ledgerloom.operators import authchain, chain, mempool, modes, sinks, throughput, values, wire
from ledgerloom.sources.ledger import BLOCK_RECORD, Ledger, decode_blocks, from_blocks
from ledgerloom.sources.raw import raw_blocks, raw_transactions

START = dt.datetime(2031, 5, 17, 8, 30)
LATER = START + dt.timedelta(hours=3)
SOON = START + dt.timedelta(seconds=40)


def ledger(spark, **rows):
    return Ledger(spark, {n: spark.createDataFrame(r, schema.struct(n)) for n, r in rows.items()})


def h(number):
    return bytearray(hashlib.sha256(str(number).encode()).digest())


def tree(spark, pending, history=(), **more):
    """10 is spent by 11 and 12, 11 by 13, 13 by 14; 15 spends what 12 spends. Sources 5, 6 and 7."""
    spends = {11: (10, 0), 12: (10, 1), 13: (11, 0), 14: (13, 0), 15: (10, 1)}
    tx = [(i, h(i), 2, i, 60 + i, False) for i in range(10, 16)]
    outs = [(h(i), k, 700 + k, bytearray(b"\x52\x93"), None, None, None, None) for i in range(10, 16) for k in (0, 1)]
    ins = [(i, 0, k, 9, h(parent), bytearray(b"\x53")) for i, (parent, k) in spends.items()]
    nodes = [(name, i, 70015, "x", START, START) for i, name in ((5, "east"), (6, "north"), (7, "west"))]
    return ledger(spark, transaction=tx, output=outs, input=ins, node=nodes, node_transaction=pending, node_transaction_history=list(history), **more)


def got(df):
    return sorted(tuple(r) for r in df.collect())


GONE = "node_internal_id int, transaction_internal_id long, validated_at timestamp_ntz, replaced_at timestamp_ntz"


def test_cascade_stays_with_its_source(spark):
    lg = tree(spark, [(5, 13, START), (5, 14, SOON), (5, 12, START), (7, 13, START), (7, 14, START)])
    a = mempool.invalidate(lg, spark.createDataFrame([(5, 11, START, LATER), (7, 12, START, LATER)], GONE))
    assert got(a.history) == [(5, 13, START, LATER), (5, 14, SOON, LATER)]
    assert got(a.pending) == [(5, 12, START), (7, 13, START), (7, 14, START)]
    assert got(mempool.invalidate(lg, spark.createDataFrame([(5, 11, START, None)], GONE)).history) == []  # confirmed rows take none with them


def test_cascade_takes_the_earliest_time(spark):
    lg = tree(spark, [(6, 14, START)])
    a = mempool.invalidate(lg, spark.createDataFrame([(6, 13, START, LATER), (6, 13, START, SOON)], GONE))
    assert got(a.history) == [(6, 14, START, SOON)]


def test_expiry_takes_descendants_at_exact_time(spark):
    week = dt.timedelta(days=7)
    lg = tree(spark, [(6, 11, START), (6, 13, START + 2 * week), (6, 14, START + 2 * week), (6, 12, START + week), (5, 13, START + week)])
    a = mempool.expire(lg, F.lit(START + week).cast("timestamp_ntz"), 7 * 86400 * 1000)
    assert got(a.history) == [(6, t, at, START + week) for t, at in ((11, START), (13, START + 2 * week), (14, START + 2 * week))]
    assert got(a.pending) == [(5, 13, START + week), (6, 12, START + week)]
    assert mempool.expiring(lg, F.lit(START).cast("timestamp_ntz"), 1).collect() == []


def test_backfill_is_idempotent(spark):
    lg = tree(spark, [(7, 13, START), (7, 14, START), (7, 12, START)], [(1, 7, 11, START, SOON), (2, 7, 10, START, None)])
    a = mempool.backfill_orphans(lg)
    assert got(a.history) == [(7, 13, START, SOON), (7, 14, START, SOON)] and got(a.pending) == [(7, 12, START)]
    again = lg.with_tables(node_transaction=a.pending, node_transaction_history=lg["node_transaction_history"].unionByName(a.history.withColumn("internal_id", F.lit(3).cast("long"))))
    assert got(mempool.backfill_orphans(again).history) == []


def test_accepted_repair_and_replacement(spark):
    block = [(80, 912, 1, 0, h("b"), h("p"), h("m"), 0, 0, 0)]
    lg = tree(spark, [(5, 11, START), (5, 15, START), (6, 15, SOON), (6, 11, START)], block=block, block_transaction=[(80, 11, 0), (80, 12, 1)], node_block=[(5, 80, LATER)])
    a = mempool.repair_accepted(lg)
    assert got(a.history) == [(5, 11, START, None), (5, 15, START, LATER)] and got(a.pending) == [(6, 11, START), (6, 15, SOON)]
    assert got(values.double_spends(lg).select("a", "b")) == [(12, 15)]
    rival = lg.with_tables(node_transaction=spark.createDataFrame([(6, 12, START), (6, 15, SOON), (7, 12, START)], schema.struct("node_transaction")))
    r = mempool.replace(rival, rival["node_transaction"].where("transaction_internal_id = 15"))
    assert got(r.history) == [(6, 12, START, SOON)] and got(r.pending) == [(6, 15, SOON), (7, 12, START)]


def test_modes(spark):
    lg = tree(spark, [(5, 11, START), (5, 13, START)], block=[(80, 0, 1, 0, h("b"), h("p"), h("m"), 0, 0, 0)], block_transaction=[(80, 11, 0)], node_block=[(5, 80, LATER)])
    off, on = modes.Mode(False), modes.Mode(True)
    assert got(off.accepted(lg, lg["node_block"]).history) == [] and got(off.accepted(lg, lg["node_block"]).pending) == [(5, 11, START), (5, 13, START)]
    assert got(on.accepted(lg, lg["node_block"]).history) == [(5, 11, START, None)]
    assert off.heard(lg["node_transaction"]).count() == 0 and on.heard(lg["node_transaction"]).count() == 2
    gone = spark.createDataFrame([(5, 11, START, LATER)], GONE)
    assert got(off.replaced(lg, gone).history) == [] and got(on.replaced(lg, gone).history) == [(5, 13, START, LATER)]
    assert not modes.current(lg).live  # sources 6 and 7 have nothing yet
    every = lg.with_tables(node_block=spark.createDataFrame([(i, 80, None) for i in (5, 6, 7)], schema.struct("node_block")))
    assert modes.current(every).live


GENESIS = "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a29ab5f49ffff001d1dac2b7c"
ROOT = "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"


def genesis(spark):
    note = b"\x04\xff\xff\x00\x1d\x01\x04\x45The Times 03/Jan/2009 Chancellor on brink of second bailout for banks"
    key = "04678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5f"
    tx = (ROOT, True, 204, 1, 0, [(4294967295, "00" * 32, 4294967295, note.hex())], [(5000000000, "41" + key + "ac", None, None, None, None)])
    first = hashlib.sha256(hashlib.sha256(bytes.fromhex(GENESIS)).digest()).digest()[::-1].hex()
    row = (first, 0, 1, 1231006505, "00" * 32, ROOT, 486604799, 2083236893, 285, [tx])
    return spark.createDataFrame([row, row], BLOCK_RECORD)


def test_genesis(spark):
    lg = from_blocks(genesis(spark))
    assert lg["block"].select(wire.header_hex()).first()[0] == GENESIS
    encoded = wire.encoded_transactions(lg)
    assert encoded.select(wire.hash_of(F.col("encoded_hex"))).first()[0] == ROOT
    assert len(wire.encoded_blocks(lg).first().encoded_hex) == 2 * 285
    m = values.block_measures(lg).first()
    assert (m.fee_satoshis, m.generated_value_satoshis, m.input_value_satoshis, m.output_value_satoshis) == (0, 5000000000, 0, 5000000000)
    assert values.data_carrier_outputs(lg.with_tables(output=spark.createDataFrame([(h(1), 0, 1, bytearray(), None, None, None, None)], schema.struct("output")))).collect() == []


def record(n, txs, zeros=16):
    """A block record whose hash leads with zeros, as those of real blocks do."""
    name = "0" * zeros + hashlib.sha256(b"block %d" % n).hexdigest()[zeros:]
    made = [(hashlib.sha256(b"tx %d" % t).hexdigest(), False, 100, 1, 0, [(0, "11" * 32, 0, "51")], [(t, "51", None, None, None, None)]) for t in txs]
    return (name, n, 1, 0, "00" * 32, ROOT, 0, 0, 0, made)


def test_ids_of_zero_led_hashes(spark):
    blocks = spark.createDataFrame([record(n, [10 * n, 10 * n + 1, 5]) for n in range(1, 7)], BLOCK_RECORD)
    lg = from_blocks(blocks)
    assert sorted(r[0] for r in lg["block"].select("internal_id").collect()) == list(range(1, 7))
    assert lg["transaction"].count() == 13 and lg["block_transaction"].count() == 18
    links = lg["block_transaction"].groupBy("block_internal_id").count().collect()
    assert len(links) == 6 and {r["count"] for r in links} == {3}
    sums = lg["block"].join(lg["block_transaction"], F.col("internal_id") == F.col("block_internal_id")).select("height", "transaction_internal_id").join(lg["transaction"].select(F.col("internal_id").alias("transaction_internal_id"), F.col("hash").alias("transaction_hash")), "transaction_internal_id").join(lg["output"], "transaction_hash").groupBy("height").agg(F.sum("value_satoshis"))
    assert got(sums) == [(n, 20 * n + 6) for n in range(1, 7)]


def test_saves_once_and_repairs(spark):
    batch = decode_blocks(genesis(spark))
    none = ledger(spark, node=[("east", 5, 1, "x", START, START)])
    heard = batch.block.select("hash").withColumns({"node_internal_id": F.lit(5), "accepted_at": F.lit(START).cast("timestamp_ntz")})
    added = sinks.save_blocks(none, batch, heard)
    assert {n: df.count() for n, df in added.items()} == {"block": 1, "transaction": 1, "block_transaction": 1, "input": 1, "output": 1, "node_block": 1}
    sinks.check_saved(none, batch, added)
    there = none.with_tables(**added)
    assert {df.count() for df in sinks.save_blocks(there, batch, heard).values()} == {0}
    broken = added | {"block_transaction": added["block_transaction"].limit(0)}
    with pytest.raises(ValueError, match="1 transactions, 0 of them linked"):
        sinks.check_saved(none, batch, broken)
    again = sinks.save_blocks(none.with_tables(**broken), batch, heard)  # the block is there, its link isn't
    assert {n: df.count() for n, df in again.items() if df.count()} == {"block_transaction": 1}
    twice = decode_blocks(spark.createDataFrame([record(3, [4, 4, 8])], BLOCK_RECORD))
    with pytest.raises(ValueError, match="3 transactions, 2 of them linked"):
        sinks.check_saved(none, twice, sinks.save_blocks(none, twice))
    seeded = sinks.seed_genesis(none, genesis(spark))
    assert got(seeded["node_block"].select("node_internal_id", "accepted_at")) == [(5, None)] and seeded["block"].count() == 1


def test_save_transactions(spark):
    none = Ledger(spark, {})
    txs = genesis(spark).select(F.explode("transactions").alias("t")).select("t.*")
    one = F.unhex(F.lit(ROOT))
    heard = spark.createDataFrame([(5, LATER), (5, START), (6, SOON)], "node_internal_id int, validated_at timestamp_ntz").withColumn("hash", one)
    added = sinks.save_transactions(none, txs, heard)
    assert {n: df.count() for n, df in added.items()} == {"transaction": 1, "input": 1, "output": 1, "node_transaction": 2}
    assert got(added["node_transaction"].select("node_internal_id", "validated_at")) == [(5, START), (6, SOON)]
    with pytest.raises(ValueError, match="no transaction to validate"):
        sinks.save_transactions(none, txs.limit(0), heard)


def test_ids_are_dense_whatever_the_partitions(spark):
    """Wide rows, and partitions that are coalesced while the plan runs."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in conf if k != "spark.sql.adaptive.coalescePartitions.parallelismFirst"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.repeat(F.lit("payload "), 20).alias("wide")).repartition(13)
        there = spark.createDataFrame([(41,)], "internal_id long")
        out = sinks.with_ids(there, rows, ["hash"])
        assert out.agg(F.count(F.lit(1)), F.countDistinct("internal_id"), F.min("internal_id"), F.max("internal_id")).first() == (200_000, 200_000, 42, 200_041)
        first = out.orderBy("internal_id").limit(1000).select("hash").collect()
        assert [r.hash for r in first] == sorted(r.hash for r in first)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_raw(spark):
    raw = bytes.fromhex(wire.encoded_blocks(from_blocks(genesis(spark))).first().encoded_hex)
    rows = [(raw, 0), (raw[:-1], 0), (raw + b"\0", 0), (None, 0), (b"", 0)]
    out = raw_blocks(spark.createDataFrame([(None if x is None else bytearray(x), n) for x, n in rows], "raw binary, at long").coalesce(1), "raw", "at").collect()
    assert [r.record is not None for r in out] == [True, False, False, False, False] and "bytes too many" in out[2].error
    want = genesis(spark).first()
    assert out[0].record.asDict(True) == want.asDict(True)
    tx = raw[81:]
    got_tx = raw_transactions(spark.createDataFrame([(bytearray(tx),), (bytearray(tx[:40]),)], "raw binary").coalesce(1), "raw").collect()
    assert got_tx[0].record.hash == ROOT and got_tx[1].record is None


def test_follow_and_rewind(spark):
    k = "node_internal_id int, height long, hash string"
    old = spark.createDataFrame([(n, i, f"{n}-{i}") for n in (1, 2, 3) for i in range(8)], k)
    sent = [(1, 0, "x5", "1-4"), (1, 1, "x6", "x5"), (2, 0, "2-7", "2-6"), (3, 0, "y", "unheard"), (4, 0, "z", "2-6")]
    new, stale, ignored = chain.follow(old, spark.createDataFrame(sent, "node_internal_id int, position long, hash string, previous_block_hash string"))
    assert got(stale) == [(1, 5, "1-5"), (1, 6, "1-6")]
    assert [x for x in got(new) if x[0] == 1 and x[1] > 3] == [(1, 4, "1-4"), (1, 5, "x5"), (1, 6, "x6"), (1, 7, "1-7")]
    assert got(ignored) == [(2, "known headers"), (3, "unknown parent"), (4, "unknown parent")]
    states = spark.createDataFrame([(1, 9), (2, 3), (3, -1)], "node_internal_id int, synced_to long")
    extra = spark.createDataFrame([(1, 12), (2, 4), (2, 5), (2, 8), (3, 1)], "node_internal_id int, height long")
    assert got(chain.next_heights(states, extra)) == [(1, 10), (2, 6), (3, 0)]
    s, e = chain.rewound(states, extra, spark.createDataFrame([(1, 7), (2, 5)], "node_internal_id int, height long"))
    assert got(s) == [(1, 6), (2, 3), (3, -1)] and got(e) == [(2, 4), (3, 1)]
    assert chain.audit_range(90, 40, 25) == (40, 65) and chain.audit_range(90, 80, 25) == (80, 91) and chain.audit_range(90, 91, 25) == (0, 25)
    assert chain.audit_progress(90, 40, 65, 10, 10) == (40, False) and chain.audit_progress(90, 40, 65, 2, 10) == (65, False) and chain.audit_progress(90, 80, 91, 0, 10) == (0, True)


@pytest.mark.parametrize(("length", "want"), [(1, [0]), (10, list(range(9, -1, -1))), (100, [99, 98, 97, 96, 95, 94, 93, 92, 91, 90, 89, 88, 86, 82, 74, 58, 26, 0]), (0, [])])
def test_locator(length, want):
    ours = chain.locator_heights(length)
    assert ours == want


def test_locator_of_a_hundred():
    assert chain.locator_heights(100) == [99, 98, 97, 96, 95, 94, 93, 92, 91, 90, 89, 88, 86, 82, 74, 58, 26, 0]


def test_splice_keeps_longer_tail(spark):
    k = "node_internal_id int, height long, hash string"
    old = spark.createDataFrame([(1, i, f"a{i}") for i in range(6)] + [(2, 3, "a3")], k)
    new, stale = chain.splice(old, spark.createDataFrame([(1, 3, "b3"), (1, 4, "b4")], k))
    assert got(stale) == [(1, 3, "a3"), (1, 4, "a4")]
    assert (1, 5, "a5") in got(new) and (2, 3, "a3") in got(new) and (1, 4, "b4") in got(new)


CASES = [
    ([(300, 40, 6)], (40, 1.0, 40.0, 150.0), [(300, 1, 150.0), (340, 0, 0.0)]),
    ([(0, 100, 5), (250, 50, 1)], (150, 1.0, 75.0, 40.0), [(0, 1, 50.0), (100, 0, 0.0), (250, 1, 20.0), (300, 0, 0.0)]),
    ([(0, 400, 8), (100, 200, 10)], (400, 1.5, 300.0, 45.0), [(0, 1, 20.0), (100, 2, 70.0), (300, 1, 20.0), (400, 0, 0.0)]),
    ([(50, 10, 1), (50, 10, 2), (55, 20, 4)], (25, 1.6, 40 / 3, 280.0), [(50, 2, 300.0), (55, 3, 500.0), (60, 1, 200.0), (75, 0, 0.0)]),
    ([(70, 0, 3)], (0, 0.0, 0.0, 0.0), []),
]


@pytest.mark.parametrize(("rows", "want", "line"), CASES)
def test_throughput(spark, rows, want, line):
    df = spark.createDataFrame(rows, "start_ms long, duration_ms long, unit long")
    s = throughput.summary(df, ["unit"]).first()
    assert (s.active_ms, s.average_concurrency, s.average_duration_ms, s.unit_per_active_second) == pytest.approx(want)
    for bucket in (3_600_000, 60):
        assert [(r.time_ms, r.concurrency, pytest.approx(r.unit)) for r in sorted(throughput.timeline(df, ["unit"], bucket).collect())] == line


def test_long_authchain(spark):
    n = 70
    tx = [(i, bytearray(i.to_bytes(32, "big")), 1, 0, 1, False) for i in range(n)]
    outs = [(bytearray(i.to_bytes(32, "big")), 0, 1, bytearray(), None, None, None, None) for i in range(n)]
    ins = [(i, 0, 0, 0, bytearray((i - 1).to_bytes(32, "big")), bytearray()) for i in range(1, n)]
    lg = ledger(spark, transaction=tx, output=outs, input=ins)
    assert got(authchain.chain_ends(lg)) == [(i, n - 1, n - i) for i in range(n)]
    assert {(r.base, r.head, tuple(r.members)) for r in authchain.chains(lg).collect()} == {(i, n - 1, tuple(range(i, n))) for i in range(n)}


def test_upsert_keeps_first_connection(spark):
    old = spark.createDataFrame([("a", 1, 1, "x", START, START)], schema.struct("node"))
    seen = spark.createDataFrame([("a", 2, "y", LATER, LATER)], "name string, protocol_version int, user_agent string, first_connected_at timestamp_ntz, latest_connection_began_at timestamp_ntz")
    assert got(sinks.upsert_nodes(old, seen)) == [("a", 1, 2, "y", START, LATER)]


def test_retained_intervals(spark):
    now, five = 10_000_000, 300_000
    df = spark.createDataFrame([(now - five - 20, 10), (now - five - 20, 20), (now - five - 20, 30), (now, 5)], "start_ms long, duration_ms long")
    assert [r.duration_ms for r in throughput.retained(df, F.lit(now)).orderBy("start_ms", "duration_ms").collect()] == [20, 30, 5]


def test_sql_functions(spark):
    catalog.register(tree(spark, []), prefix="t_")
    assert [tuple(r) for r in spark.sql("SELECT lower(hex(authhead_transaction_hash)), authchain_length FROM authchains_of(10)").collect()] == [(bytes(h(14)).hex(), 4)]
    assert spark.sql("SELECT * FROM search_outputs('5293')").count() == spark.sql("SELECT * FROM search_outputs_prefix('52')").count() == 12
    assert spark.sql("SELECT * FROM search_outputs('52')").count() == 0
    assert spark.sql(f"SELECT * FROM data_carriers_of(X'{bytes(h(10)).hex()}')").count() == 0
    assert spark.sql("SELECT t.internal_id, c.authchain_length FROM t_transaction t, LATERAL authchains_of(t.internal_id) c WHERE t.internal_id > 12").count() == 3
    row = spark.sql("SELECT hex(compact_uint(252)), hex(compact_uint(300)), hex(compact_uint(70000)), hex(compact_uint(5000000000)), hex(reverse_bytes(X'0102FF')), hex(uint16le(258)), hex(uint32le(-2)), is_script_hash(X'51')").first()
    assert tuple(row) == ("FC", "FD2C01", "FE70110100", "FF00F2052A01000000", "FF0201", "0201", "FEFFFFFF", False)
