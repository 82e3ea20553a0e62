"""The same queries as SQL over the star schema, for an engine that knows nothing of this package."""

from __future__ import annotations

ZERO = "repeat('0', 64)"


def sha(x: str) -> str:
    return f"sha256(CAST({x} AS VARCHAR))"


def le(x: str, n: int) -> str:
    return "(" + " || ".join(f"format('{{:02x}}', (({x}) >> {8 * i}) & 255)" for i in range(n)) + ")"


def compact(x: str) -> str:
    return f"(CASE WHEN {x} <= 252 THEN {le(x, 1)} WHEN {x} <= 65535 THEN 'fd' || {le(x, 2)} WHEN {x} <= 4294967295 THEN 'fe' || {le(x, 4)} ELSE 'ff' || {le(x, 8)} END)"


def rev(h: str) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all({h}, '..')), '')"


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


PARTS = {
    "tx": f"SELECT o_orderkey AS id, {sha('o_orderkey')} AS hash, CAST(o_orderdate AS DATE) AS day, o_custkey AS locktime, 1 + o_orderkey % 2 AS version, 100 + o_orderkey % 900 AS size_bytes, lag(o_orderkey, 1) OVER w AS prev1, lag(o_orderkey, 2) OVER w AS prev2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "lines0": f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx, {sha('l_partkey')} AS part FROM lineitem",
    "lines": f"""SELECT l_orderkey AS tx, {sha('l_orderkey')} AS hash, idx, l_returnflag AS kind, part,
        CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 0 ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS value,
        CASE l_returnflag WHEN 'R' THEN 'a914' || substr(part, 1, 40) || '87' WHEN 'A' THEN '6a04' || substr(part, 1, 8) ELSE '76a914' || substr(part, 1, 40) || '88ac' END AS script,
        CASE WHEN l_linestatus = 'F' THEN {sha('l_suppkey')} END AS category, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END AS amount,
        CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN ['none', 'mutable', 'minting'][l_linenumber % 3 + 1] END AS capability,
        CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN substr(part, 1, 8) END AS note FROM lines0""",
    "spends": "SELECT id, prev1 AS source FROM tx UNION ALL SELECT id, prev2 FROM tx WHERE id % 20 = 0",
    "inp": f"""SELECT s.id AS tx, row_number() OVER (PARTITION BY s.id ORDER BY l.tx, l.idx) - 1 AS i, l.hash AS ohash, l.idx AS oidx, 4294967295 - s.id % 2 AS seq,
        CASE WHEN l.kind = 'R' THEN '0017a914' || substr(part, 1, 40) || '87' ELSE '41' || part || part || '012102' || part END AS script, CASE WHEN l.kind = 'R' THEN 'R' ELSE 'N' END AS kind
        FROM spends s JOIN lines l ON l.tx = s.source WHERE l.idx % 3 <> 2 UNION ALL SELECT id, 0, {ZERO}, 4294967295, 4294967295, '04' || substr(hash, 1, 8), 'C' FROM tx WHERE prev1 IS NULL""",
    "days": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS height, lag(day) OVER (ORDER BY day) AS previous, 86400 * date_diff('day', DATE '1970-01-01', day) AS ts FROM (SELECT DISTINCT day FROM tx)",
    "num": "SELECT t.id, t.size_bytes, d.day, d.height, d.ts FROM tx t JOIN days d ON d.day = t.day",
    "btx": "SELECT height, id AS tx, row_number() OVER (PARTITION BY height ORDER BY id) - 1 AS ti FROM num",
    "blk": f"""SELECT d.height, ts, 536870912 + d.height % 3 AS version, {sha('day')} AS hash, coalesce({sha('previous')}, {ZERO}) AS prev, sha256('m' || CAST(day AS VARCHAR)) AS merkle, 486604799 AS bits, d.height * 7919 % 4294967296 AS nonce,
        CAST(80 + (CASE WHEN n <= 252 THEN 1 WHEN n <= 65535 THEN 3 WHEN n <= 4294967295 THEN 5 ELSE 9 END) + bytes + (CASE WHEN d.height % 50 = 7 THEN 1 ELSE 0 END) AS BIGINT) AS size_bytes
        FROM days d JOIN (SELECT height, count(*) AS n, sum(size_bytes) AS bytes FROM num GROUP BY height) s ON s.height = d.height""",
    "nodes": "SELECT lower(r_name) AS name, CAST(r_regionkey AS BIGINT) AS id FROM region",
    "nb": "SELECT n.id AS node, d.height, CASE WHEN d.height % 4 <> 0 THEN d.ts + 3600 + 60 * n.id END AS accepted FROM days d, nodes n WHERE (d.height + n.id) % 11 <> 0",
    "nt": "SELECT n.id AS node, m.id AS tx, m.ts + n.id AS validated FROM num m, nodes n WHERE m.height >= (SELECT floor(max(height) * 9 / 10.0) FROM days) AND (m.id + n.id) % 4 <> 0",
    "iv": "SELECT i.*, l.value FROM inp i LEFT JOIN lines l ON l.hash = i.ohash AND l.idx = i.oidx",
    "tm": f"""SELECT t.id, t.hash, t.locktime, prev1 IS NULL AS is_coinbase, {long('coalesce(i.n, 0)')} AS ic, {long('coalesce(o.n, 0)')} AS oc, {long('coalesce(i.v, 0)')} AS iv, {long('o.v')} AS ov,
        CASE WHEN prev1 IS NULL THEN 0 ELSE {long('coalesce(i.v, 0) - o.v')} END AS fee FROM tx t LEFT JOIN (SELECT tx, count(*) AS n, sum(value) AS v FROM iv GROUP BY tx) i ON i.tx = t.id LEFT JOIN (SELECT tx, count(*) AS n, sum(value) AS v FROM lines GROUP BY tx) o ON o.tx = t.id""",
    "bm": f"""SELECT b.height, b.ts, b.size_bytes, count(t.id) AS n, {', '.join(f'{long(f"coalesce(sum({c}), 0)")} AS {c}' for c in ('ic', 'oc', 'iv', 'ov', 'fee'))} FROM blk b LEFT JOIN btx x ON x.height = b.height LEFT JOIN tm t ON t.id = x.tx GROUP BY ALL""",
    "edges": "SELECT DISTINCT p.id AS parent, i.tx AS child FROM inp i JOIN tx p ON p.hash = i.ohash WHERE i.oidx = 0",
    "op": f"SELECT tx, ohash, oidx FROM inp WHERE ohash <> {ZERO}",
    "cf": "SELECT DISTINCT a.tx AS a, b.tx AS b FROM op a JOIN op b ON a.ohash = b.ohash AND a.oidx = b.oidx WHERE a.tx <> b.tx",
    "kids": "SELECT DISTINCT p.id AS parent, o.tx AS child FROM op o JOIN tx p ON p.hash = o.ohash",
    "gone": "SELECT node, tx, validated, validated + 600 AS replaced FROM nt WHERE tx % 50 = 0",
    "live": "SELECT * FROM nt WHERE tx % 50 <> 0",
    "ms": "SELECT epoch_us(ts) // 1000 AS start_ms, event_id % 5000 AS duration_ms, 1 + user_id % 50 AS units FROM events",
    "steps": "SELECT t, sum(c) AS c, sum(r) AS r FROM (SELECT start_ms AS t, 1 AS c, units * 1000 / duration_ms AS r FROM ms WHERE duration_ms >= 1 UNION ALL SELECT start_ms + duration_ms, -1, -units * 1000 / duration_ms FROM ms WHERE duration_ms >= 1) GROUP BY t",
    "line": "SELECT t, sum(c) OVER (ORDER BY t) AS c, sum(r) OVER (ORDER BY t) AS r, lead(t) OVER (ORDER BY t) AS next FROM steps",
}
NEEDS = {"lines": "lines0", "spends": "tx", "inp": "spends lines tx", "days": "tx", "num": "tx days", "btx": "num", "blk": "days num", "nb": "days nodes", "nt": "num nodes days", "iv": "inp lines", "tm": "iv lines tx", "bm": "blk btx tm", "edges": "inp tx", "op": "inp", "cf": "op", "kids": "op tx", "gone": "nt", "live": "nt", "steps": "ms", "line": "steps"}


def sql(parts: str, body: str, recursive: str = "") -> str:
    """body over the parts and what they need; recursive: more parts, which may refer to themselves."""
    use: set[str] = set()
    todo = parts.split()
    while todo:
        if (p := todo.pop()) not in use:
            use.add(p)
            todo += NEEDS.get(p, "").split()
    shared = ", ".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in use)
    both = ", ".join(x for x in (shared, recursive) if x)
    return f"WITH {'RECURSIVE ' if recursive else ''}{both} {body}" if both else body


ARCHIVE = "SELECT p.node AS node_internal_id, p.tx AS transaction_internal_id, p.validated, {rep} AS replaced FROM ({events}) e JOIN nt p ON p.node = e.node AND p.tx = e.tx GROUP BY p.node, p.tx, p.validated"
EITHER = "CASE WHEN bool_or(e.rep IS NULL) THEN NULL ELSE min(e.rep) END"


def accepted(where: str) -> str:
    a = f"SELECT b.node, x.tx AS mined, b.accepted FROM nb b JOIN btx x ON x.height = b.height {where}"
    return sql("nb btx nt cf", ARCHIVE.format(rep=EITHER, events=f"SELECT node, mined AS tx, NULL AS rep FROM ({a}) UNION ALL SELECT a.node, cf.b, a.accepted FROM ({a}) a JOIN cf ON cf.a = a.mined"))


_CASCADE = sql("gone live kids", "SELECT p.node AS node_internal_id, p.tx AS transaction_internal_id, p.validated, min(r.rep) AS replaced FROM r JOIN live p ON p.node = r.node AND p.tx = r.tx GROUP BY ALL", "r(node, tx, rep) AS (SELECT l.node, l.tx, g.replaced FROM gone g JOIN kids k ON k.parent = g.tx JOIN live l ON l.node = g.node AND l.tx = k.child UNION SELECT l.node, l.tx, r.rep FROM r JOIN kids k ON k.parent = r.tx JOIN live l ON l.node = r.node AND l.tx = k.child)")


def size_text(x: str, over: str = "1") -> str:
    """x / over bytes: hundredths of the largest unit that isn't over 999.99 of the one below."""

    def hundredths(unit: int) -> str:
        return f"((200 * {x} + {over} * {unit}) // (2 * {over} * {unit}))"

    def two(unit: int, name: str) -> str:
        return f"CAST({hundredths(unit)} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths(unit)} % 100 AS VARCHAR), 2, '0') || ' {name}'"

    small = f"CAST({hundredths(1)} // 100 AS VARCHAR) || (CASE WHEN {hundredths(1)} % 100 = 0 THEN '' WHEN {hundredths(1)} % 10 = 0 THEN '.' || CAST({hundredths(1)} % 100 // 10 AS VARCHAR) ELSE '.' || lpad(CAST({hundredths(1)} % 100 AS VARCHAR), 2, '0') END) || ' B'"
    return f"(CASE WHEN 100 * {x} <= 99999 * {over} THEN {small} WHEN 100 * {x} <= 99999000 * {over} THEN {two(1000, 'KB')} WHEN 100 * {x} <= 99999000000 * {over} THEN {two(10**6, 'MB')} ELSE {two(10**9, 'GB')} END)"


_FORK = "SELECT node, b.height, b.hash AS old, sha256(unhex(b.hash)) AS hash FROM nb JOIN blk b ON b.height = nb.height WHERE node = 1 AND b.height % 5 = 3 AND b.height >= (SELECT floor(max(height) * 9 / 10.0) FROM blk)"
_IN = f"{rev('ohash')} || {le('oidx', 4)} || {compact('length(script) // 2')} || script || {le('seq', 4)}"
_FLAGS = "((CASE WHEN coalesce(amount, 0) > 0 THEN 16 ELSE 0 END) + (CASE WHEN note IS NULL THEN 0 ELSE 96 + (CASE capability WHEN 'mutable' THEN 1 WHEN 'minting' THEN 2 ELSE 0 END) END))"
_PREFIX = f"(CASE WHEN category IS NULL THEN '' ELSE 'ef' || {rev('category')} || {le(_FLAGS, 1)} || (CASE WHEN note IS NULL THEN '' ELSE {compact('length(note) // 2')} || note END) || (CASE WHEN coalesce(amount, 0) > 0 THEN {compact('amount')} ELSE '' END) END)"
_ENCODED = f"""ei AS (SELECT tx, count(*) AS n, string_agg({_IN}, '' ORDER BY i) AS s FROM inp GROUP BY tx),
    ls AS (SELECT tx, idx, value, {_PREFIX} || script AS body FROM lines), eo AS (SELECT tx, count(*) AS n, string_agg({le('value', 8)} || {compact('length(body) // 2')} || body, '' ORDER BY idx) AS s FROM ls GROUP BY tx),
    enc AS (SELECT t.id, {le('t.version', 4)} || {compact('coalesce(ei.n, 0)')} || coalesce(ei.s, '') || {compact('coalesce(eo.n, 0)')} || coalesce(eo.s, '') || {le('t.locktime', 4)} AS hex FROM tx t LEFT JOIN ei ON ei.tx = t.id LEFT JOIN eo ON eo.tx = t.id)"""
_HEADER = f"{le('version', 4)} || {rev('prev')} || {rev('merkle')} || {le('ts', 4)} || {le('bits', 4)} || {le('nonce', 4)}"
_WALK = "w(base, cur, n, path) AS (SELECT tx, tx, 1, CAST(tx AS VARCHAR) FROM lines WHERE idx = 0 UNION ALL SELECT base, child, n + 1, path || ',' || child FROM w JOIN edges ON parent = cur)"
_ENDS = "cur NOT IN (SELECT parent FROM edges)"
# the data of the last push, then its opcodes one at a time: pos counts bytes from 0
_PUSHED = """d AS (SELECT kind, CASE kind WHEN 'R' THEN substr(script, 5) WHEN 'C' THEN substr(script, 3) ELSE substr(script, 135) END AS data, count(*) AS n FROM inp GROUP BY ALL),
    r(kind, data, n, pos, pattern) AS (SELECT kind, data, n, 0, '' FROM d UNION ALL SELECT kind, data, n, CASE
        WHEN op BETWEEN 1 AND 75 THEN pos + 1 + op
        WHEN op = 76 THEN CASE WHEN pos + 2 > size THEN size ELSE pos + 2 + b1 END
        WHEN op = 77 THEN CASE WHEN pos + 3 > size THEN size ELSE pos + 3 + b1 + 256 * b2 END
        WHEN op = 78 THEN CASE WHEN pos + 5 > size OR b4 > 127 THEN size ELSE pos + 5 + b1 + 256 * b2 + 65536 * b3 + 16777216 * b4 END
        ELSE pos + 1 END, pattern || substr(data, 2 * pos + 1, 2) FROM (SELECT *, length(data) // 2 AS size, BYTE0 AS op, BYTE1 AS b1, BYTE2 AS b2, BYTE3 AS b3, BYTE4 AS b4 FROM r WHERE pos < length(data) // 2))"""
for _i in range(5):
    _PUSHED = _PUSHED.replace(f"BYTE{_i}", f"coalesce(TRY_CAST('0x' || nullif(substr(data, 2 * (pos + {_i}) + 1, 2), '') AS BIGINT), 0)")
_PATTERNS = "SELECT CASE kind WHEN 'R' THEN '0017' WHEN 'C' THEN '04' ELSE '4121' END AS pattern, r.pattern AS redeem, CAST(sum(n) AS BIGINT) AS inputs FROM r WHERE pos >= length(data) // 2 GROUP BY 1, 2"
_SHOWN = "SELECT hash AS transaction_hash, idx AS output_index"

ORACLES = {
    "block_fee_summary": sql("bm", "SELECT height, n AS transaction_count, ic AS input_count, fee AS fee_satoshis FROM bm"),
    "tx_value_aggregates": sql("tm", "SELECT id AS internal_id, iv AS input_value_satoshis, ov AS output_value_satoshis, fee AS fee_satoshis FROM tm"),
    "block_value_aggregates": sql("bm", "SELECT height, oc AS output_count, iv AS input_value_satoshis, ov AS output_value_satoshis, ov - iv AS generated_value_satoshis FROM bm"),
    "tx_counts": sql("tm", "SELECT id AS internal_id, ic AS input_count, oc AS output_count, is_coinbase FROM tm"),
    "input_value_lookup": sql("iv", "SELECT tx AS transaction_internal_id, i AS input_index, ohash AS outpoint_transaction_hash, oidx AS outpoint_index, value AS value_satoshis FROM iv"),
    "unspent_outputs": sql("inp lines", f"{_SHOWN}, value AS value_satoshis FROM lines WHERE NOT EXISTS (SELECT 1 FROM inp WHERE ohash = hash AND oidx = idx)"),
    "output_spenders": sql("inp lines", f"{_SHOWN}, count(i.tx) AS spenders, min(i.tx) AS first_spender FROM lines l LEFT JOIN inp i ON ohash = hash AND oidx = idx GROUP BY hash, idx"),
    "p2sh_outputs": sql("lines", f"{_SHOWN}, script AS locking_bytecode FROM lines WHERE kind = 'R'"),
    "p2sh_inputs_redeem": sql("iv", "SELECT tx AS transaction_internal_id, i AS input_index, 'a91487' AS redeem_pattern, value AS value_satoshis FROM iv WHERE kind = 'R'"),
    "data_carrier_outputs": sql("lines", f"{_SHOWN}, value AS value_satoshis FROM lines WHERE value = 0 OR script LIKE '6a%'"),
    "identity_signing_outputs": sql("lines tx", "SELECT id AS internal_id, a.value AS identity_value, b.value AS signing_value FROM tx LEFT JOIN lines a ON a.tx = id AND a.idx = 0 LEFT JOIN lines b ON b.tx = id AND b.idx = 1"),
    "search_output": sql("lines", f"{_SHOWN}, script AS locking_bytecode FROM lines WHERE script IN ('76a914' || substr(sha256('1'), 1, 40) || '88ac', '76a914' || substr(sha256('2'), 1, 40) || '88ac', '76a914' || substr(sha256('3'), 1, 40) || '88ac', '6a04' || substr(sha256('7'), 1, 8))"),
    "search_output_prefix": sql("lines", f"{_SHOWN}, script AS locking_bytecode FROM lines WHERE script LIKE 'a91425%'"),
    "token_search": sql("lines", f"{_SHOWN}, amount AS fungible_token_amount, capability AS nonfungible_token_capability, note AS nonfungible_token_commitment FROM lines WHERE category = sha256('3')"),
    "bytecode_patterns": sql("lines", "SELECT pattern, pattern AS with_lengths, count(*) AS outputs FROM (SELECT CASE kind WHEN 'R' THEN 'a91487' WHEN 'A' THEN '6a04' ELSE '76a91488ac' END AS pattern FROM lines) GROUP BY 1"),
    "unlocking_patterns": sql("inp", _PATTERNS, _PUSHED),
    "encode_ints": sql("lines", f"SELECT DISTINCT value AS value_satoshis, {le('value', 2)} AS u16, {le('value', 4)} AS u32, {le('-value', 4)} AS i32, {le('value * 1000003', 8)} AS u64 FROM lines"),
    "encode_compact_uint": sql("lines", f"SELECT DISTINCT value AS value_satoshis, {compact('value')} AS value, {compact('(value % 300)')} AS small, {compact('(value * 1000003)')} AS large FROM lines"),
    "reverse_hashes": sql("tx", f"SELECT id AS internal_id, {rev('hash')} AS reversed FROM tx"),
    "encode_block_header": sql("blk", f"SELECT height, header, {rev('sha256(unhex(sha256(unhex(header))))')} AS header_hash FROM (SELECT height, {_HEADER} AS header FROM blk)"),
    "encode_transaction": sql("inp lines tx", "SELECT id AS internal_id, hex AS encoded_hex FROM enc", _ENCODED).replace("WITH RECURSIVE", "WITH"),
    "encode_block": sql("inp lines tx blk btx", f"SELECT height, length(hex) // 2 AS bytes, sha256(hex) AS digest FROM (SELECT b.height, {_HEADER} || {compact('count(e.id)')} || string_agg(e.hex, '' ORDER BY ti) AS hex FROM blk b JOIN btx x ON x.height = b.height JOIN enc e ON e.id = x.tx GROUP BY b.height, version, prev, merkle, ts, bits, nonce)", _ENCODED).replace("WITH RECURSIVE", "WITH"),
    "authchains": sql("lines edges", f"SELECT DISTINCT base, cur AS head, {long('n')} AS length FROM w WHERE {_ENDS}", _WALK),
    "authchain_view": sql("lines edges", f"SELECT base, cur AS head, {long('n')} AS length, path AS members FROM w WHERE {_ENDS}", _WALK),
    "authchain_migrations": sql("lines edges", f"SELECT base, {long('u.i - 1')} AS migration_index, {long('list_extract(xs, u.i)')} AS tx FROM (SELECT base, string_split(path, ',') AS xs FROM w WHERE {_ENDS}), LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS i) u", _WALK),
    "double_spend_conflicts": sql("op", "SELECT a.tx AS a, b.tx AS b, a.ohash AS outpoint_transaction_hash, a.oidx AS outpoint_index FROM op a JOIN op b ON a.ohash = b.ohash AND a.oidx = b.oidx WHERE a.tx < b.tx"),
    "mempool_replacement": sql("nt cf", ARCHIVE.format(rep="min(e.rep)", events="SELECT n.node, cf.b AS tx, n.validated AS rep FROM nt n JOIN cf ON cf.a = n.tx WHERE n.tx % 20 = 0")),
    "mempool_confirmation": accepted("WHERE b.height >= (SELECT floor(max(height) * 19 / 20.0) FROM days)"),
    "accepted_mempool_repair": accepted(""),
    "mempool_cascade": _CASCADE,
    "mempool_orphan_backfill": _CASCADE,
    "mempool_expiry_scan": sql("nt nodes tx", "SELECT n.name, t.hash, validated + 1209600 AS expires FROM nt JOIN nodes n ON n.id = node JOIN tx t ON t.id = tx WHERE validated + 1209600 <= (SELECT max(validated) FROM nt)"),
    "mempool_expiry": sql("nt kids", "SELECT p.node AS node_internal_id, p.tx AS transaction_internal_id, p.validated, min(r.rep) AS replaced FROM r JOIN nt p ON p.node = r.node AND p.tx = r.tx GROUP BY ALL", "r(node, tx, rep) AS (SELECT node, tx, validated + 1209600 FROM nt WHERE validated + 1209600 <= (SELECT max(validated) FROM nt) UNION SELECT l.node, l.tx, r.rep FROM r JOIN kids k ON k.parent = r.tx JOIN nt l ON l.node = r.node AND l.tx = k.child)"),
    "node_unconfirmed_count": sql("nt nodes", "SELECT name, count(tx) AS unconfirmed_transaction_count FROM nodes LEFT JOIN nt ON node = id GROUP BY name"),
    "incomplete_block_audit": sql("blk num nb", f"SELECT height, hash, linked, linked_bytes, size_bytes FROM (SELECT b.*, n AS linked, {long('bytes')} AS linked_bytes FROM blk b JOIN (SELECT height, count(*) AS n, sum(size_bytes) AS bytes FROM num GROUP BY height) s ON s.height = b.height) b WHERE height IN (SELECT height FROM nb) AND 80 + linked_bytes + (CASE WHEN linked <= 252 THEN 1 WHEN linked <= 65535 THEN 3 ELSE 5 END) <> size_bytes"),
    "audit_report": sql("blk num nb", f"SELECT (SELECT count(*) FROM blk WHERE height IN (SELECT height FROM nb)) AS scanned, '[' || coalesce(string_agg('{{\"height\":' || height || ',\"hash\":\"' || hash || '\",\"linkedSizeBytes\":' || size_bytes - 1 || ',\"sizeBytes\":' || size_bytes || ',\"transactionCount\":' || n || '}}', ',' ORDER BY height), '') || ']' AS incomplete FROM blk JOIN (SELECT height AS h, count(*) AS n FROM num GROUP BY height) ON h = height WHERE height % 50 = 7 AND height IN (SELECT height FROM nb)"),
    "chain_gap_restore": sql("nb nodes", f"SELECT id AS node_internal_id, {long('coalesce(max(CASE WHEN dense THEN height END), -1)')} AS synced_to, {long('coalesce(sum(CASE WHEN NOT dense THEN 1 ELSE 0 END), 0)')} AS additional FROM nodes LEFT JOIN (SELECT node, height, row_number() OVER (PARTITION BY node ORDER BY height) - 1 = height AS dense FROM nb) ON node = id GROUP BY id"),
    "chain_gaps": sql("nb", "SELECT node AS node_internal_id, before + 1 AS first, height - 1 AS last FROM (SELECT node, height, coalesce(lag(height) OVER (PARTITION BY node ORDER BY height), -1) AS before FROM nb) WHERE height > before + 1"),
    "sync_percentages": sql("nb nodes days", f"SELECT node_internal_id, pending, best, round(100 * pending / greatest(best, 1), 6) AS percent FROM (SELECT id AS node_internal_id, {long('coalesce(max(CASE WHEN dense THEN height END), -1) + 1')} AS pending, (SELECT max(height) FROM days) AS best FROM nodes LEFT JOIN (SELECT node, height, row_number() OVER (PARTITION BY node ORDER BY height) - 1 = height AS dense FROM nb) ON node = id GROUP BY id)"),
    "header_locator": sql("nb blk", f"SELECT {long('pos')} AS position, b.height, b.hash FROM (SELECT pos, spot FROM g UNION ALL SELECT max(pos) + 1, 0 FROM g) JOIN nb ON node = 2 AND nb.height = spot JOIN blk b ON b.height = spot", "g(pos, spot, step) AS (SELECT 0, max(height), 1 FROM nb WHERE node = 2 UNION ALL SELECT pos + 1, spot - s, s FROM (SELECT pos, spot, CASE WHEN pos >= 11 THEN step * 2 ELSE step END AS s FROM g) WHERE spot - s > 0)"),
    "reorg_stale_blocks": sql("nb blk", f"SELECT f.node AS node_internal_id, f.height AS block_internal_id, n.accepted, {long('1000000000')} AS removed FROM ({_FORK}) f JOIN nb n ON n.node = f.node AND n.height = f.height"),
    "reorg_spliced_chain": sql("nb blk", f"SELECT n.node AS node_internal_id, count(*) AS blocks, min(coalesce(f.hash, b.hash)) AS least, max(coalesce(f.hash, b.hash)) AS most FROM nb n JOIN blk b ON b.height = n.height LEFT JOIN ({_FORK}) f ON f.node = n.node AND f.height = n.height GROUP BY n.node"),
    "nodes_with_block": sql("nb nodes", "SELECT height, string_agg(name, ',' ORDER BY name) AS nodes FROM nb JOIN nodes ON id = node GROUP BY height"),
    "catch_up_prefix": sql("nb", "SELECT h.node AS node_internal_id, h.height FROM nb h JOIN (SELECT node, max(CASE WHEN dense THEN height ELSE -1 END) + 1 AS pending FROM (SELECT node, height, row_number() OVER (PARTITION BY node ORDER BY height) - 1 = height AS dense FROM nb) GROUP BY node) p ON p.node = h.node AND h.height >= pending LEFT JOIN (SELECT x.node, min(x.height) AS miss FROM nb x JOIN (SELECT node, max(CASE WHEN dense THEN height ELSE -1 END) + 1 AS pending FROM (SELECT node, height, row_number() OVER (PARTITION BY node ORDER BY height) - 1 = height AS dense FROM nb) GROUP BY node) q ON q.node = x.node AND x.height >= q.pending WHERE x.height % 97 = 96 GROUP BY x.node) m ON m.node = h.node WHERE miss IS NULL OR h.height < miss"),
    "accept_headers": sql("nb blk", "SELECT node AS node_internal_id, b.height AS block_internal_id, CASE WHEN b.height % 3 <> 0 THEN ts + 7200 END AS accepted FROM nb JOIN blk b ON b.height = nb.height WHERE b.height % 4 <> 1"),
    "throughput_timeline": sql("line", f"SELECT t AS time_ms, {long('c')} AS concurrency, round(r + 1e-9, 3) AS rate, next AS next_ms FROM line"),
    "throughput_summary": sql("ms line", f"SELECT intervals, active_ms, round(area / active_ms, 6) AS average_concurrency, round(mean, 6) AS average_duration_ms, total_units, round(units / active_ms, 4) AS units_per_active_second FROM (SELECT count(*) AS intervals, avg(duration_ms) AS mean, {long('sum(units)')} AS total_units FROM ms WHERE duration_ms >= 1), (SELECT {long('sum(next - t)')} AS active_ms, sum(c * (next - t)) AS area, sum(r * (next - t)) AS units FROM line WHERE c > 0)"),
    "format_bytes": sql("lines", f"SELECT DISTINCT value AS value_satoshis, {size_text('value')} AS size, {size_text('(value * 1000)')} AS large, {size_text('(value * 2)', '3')} || '/s' AS rate, {size_text('(value % 100000)', '100')} || '/s' AS slow, {size_text('(value % 100000)', '7000')} || '/s' AS slower, '- B/s' AS none FROM lines"),
    "index_progress": sql("days", f"SELECT height, {long('round(40 * (height % 100) / 100 + CASE WHEN height % 3 = 0 THEN 0 ELSE 60 * (CASE WHEN height % 2 = 0 THEN height % 100 ELSE 0 END) / 100 END)')} AS percent FROM days"),
    "daily_statistics": sql("bm", f"SELECT {long("date_part('year', make_timestamp(ts * 1000000))")} AS year, {long('sum(n)')} AS transactions, round(avg(size_bytes), 6) AS average_size, {long('sum(size_bytes)')} AS bytes FROM bm GROUP BY 1"),
    "gql_where_tree": sql("tm", "SELECT id AS internal_id, fee AS fee_satoshis FROM tm WHERE ((fee > 1000000 AND fee <= 90000000) OR (is_coinbase AND oc IN (1, 2, 3))) AND NOT id < 100 AND locktime NOT IN (7, 8)"),
    "gql_relation_filter": sql("tm lines iv", "SELECT id AS internal_id FROM tm WHERE EXISTS (SELECT 1 FROM lines WHERE tx = id AND value > 9000000 AND category IS NULL) AND NOT EXISTS (SELECT 1 FROM iv WHERE tx = id AND value < 1000000)"),
    "gql_relation_or": sql("tm iv", "SELECT id AS internal_id FROM tm WHERE EXISTS (SELECT 1 FROM iv WHERE tx = id AND value = 0) OR fee < -20000000"),
    "gql_order_nulls": sql("tx lines", "SELECT id AS internal_id, coalesce(s, '') AS outputs FROM tx LEFT JOIN (SELECT tx, string_agg(coalesce(CAST(amount AS VARCHAR), '-') || ':' || value || ':' || idx, ',' ORDER BY amount DESC NULLS FIRST, value ASC NULLS LAST, idx) AS s FROM lines GROUP BY tx) ON tx = id"),
    "gql_distinct_on": sql("lines", "SELECT DISTINCT ON (idx) idx AS output_index, value AS value_satoshis FROM lines ORDER BY idx, value DESC"),
    "gql_limit_offset": sql("tm", "SELECT id AS internal_id, fee AS fee_satoshis FROM tm ORDER BY fee DESC NULLS LAST, id LIMIT 30 OFFSET 20"),
    "gql_topk_per_parent": sql("tx lines", "SELECT id AS internal_id, coalesce(top, '') AS top FROM tx LEFT JOIN (SELECT tx, string_agg(idx || ':' || value, ',' ORDER BY r) AS top FROM (SELECT tx, idx, value, row_number() OVER (PARTITION BY tx ORDER BY value DESC, idx) AS r FROM lines WHERE value > 0) WHERE r <= 2 GROUP BY tx) ON tx = id"),
    "gql_nested_objects": sql("iv tx", "SELECT iv.tx AS transaction_internal_id, i AS input_index, value, locktime FROM iv JOIN tx ON id = iv.tx"),
    "gql_aggregate_order_by": sql("tx lines", " UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT ON (locktime) locktime, id AS internal_id, '{f}' AS by FROM tx LEFT JOIN (SELECT tx, {f}({'*' if f == 'count' else 'value'}) AS m FROM lines GROUP BY tx) ON tx = id ORDER BY locktime, m DESC NULLS {'LAST' if f == 'count' else 'FIRST'}, id)" for f in ("count", "avg", "max", "min", "stddev", "stddev_pop", "stddev_samp", "sum", "var_pop", "var_samp", "variance"))),
    "gql_by_pk": sql("tx blk btx nodes nb inp lines nt", "SELECT 'transaction' AS root, id || ':' || hash || ':' || locktime AS row FROM tx WHERE id = 1 UNION ALL SELECT 'block', height || ':' || ts FROM blk WHERE height = 7 UNION ALL SELECT 'block_transaction', '7:' || ti FROM btx WHERE height = 7 AND tx = (SELECT min(tx) FROM btx WHERE height = 7) UNION ALL SELECT 'node', name FROM nodes WHERE id = 2 UNION ALL SELECT 'node_block', node || ':' || height FROM nb WHERE node = 2 AND height = 7 UNION ALL SELECT 'input', tx || ':' || oidx FROM inp WHERE tx = 1 AND i = 0 UNION ALL SELECT 'output', idx || ':' || value FROM lines WHERE tx = 1 AND idx = 0 UNION ALL SELECT 'node_transaction', node || ':' || tx FROM (SELECT node, tx FROM nt ORDER BY node, tx LIMIT 1)"),
    "gql_like_regex_similar": sql("nodes", "SELECT name, CAST(test AS BIGINT) AS test FROM (SELECT name, 0 AS test FROM nodes WHERE name LIKE 'a%' UNION ALL SELECT name, 1 FROM nodes WHERE name ILIKE '%EAST' UNION ALL SELECT name, 2 FROM nodes WHERE regexp_matches(name, 'r.p') UNION ALL SELECT name, 3 FROM nodes WHERE name SIMILAR TO '(afr|as)i(a|ca)' UNION ALL SELECT name, 4 FROM nodes WHERE regexp_matches(name, '(?i)^MIDDLE') UNION ALL SELECT name, 5 FROM nodes WHERE name NOT LIKE '%a%' UNION ALL SELECT name, 6 FROM nodes WHERE name NOT ILIKE '%A%' UNION ALL SELECT name, 7 FROM nodes WHERE NOT starts_with(name, 'a') UNION ALL SELECT name, 8 FROM nodes WHERE lower(substr(name, 1, 1)) NOT IN ('a', 'e') UNION ALL SELECT name, 9 FROM nodes WHERE name NOT LIKE 'a%' AND name NOT LIKE 'e%')"),
    "gql_first_outputs": sql("inp lines", "SELECT inp.tx AS transaction_internal_id, i AS input_index, f.idx AS first, f.value FROM inp LEFT JOIN (SELECT DISTINCT ON (hash) hash, idx, value FROM lines ORDER BY hash, idx) f ON f.hash = ohash"),
    "gql_block_relations": sql("blk nb btx", "SELECT b.height, p.height AS previous, coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM nb WHERE nb.height = b.height), '') AS nodes, (SELECT count(*) FROM btx WHERE btx.height = b.height) AS transactions FROM blk b LEFT JOIN blk p ON p.hash = b.prev"),
    "gql_node_relations": sql("nodes nb nt tx", f"SELECT name, (SELECT count(*) FROM nt WHERE node = n.id) AS unconfirmed_transaction_count, (SELECT count(*) FROM nb WHERE node = n.id AND height < 100) AS early_blocks, {long('coalesce((SELECT sum(locktime) FROM nt JOIN tx ON tx.id = nt.tx WHERE node = n.id), 0)')} AS owners FROM nodes n"),
    "gql_history_relations": sql("nb blk nodes gone tx", f"SELECT 'block' AS kind, f.height AS id, name, f.height AS value FROM ({_FORK}) f JOIN nodes n ON n.id = f.node UNION ALL SELECT 'transaction', g.tx, name, locktime FROM gone g JOIN nodes n ON n.id = g.node JOIN tx ON tx.id = g.tx"),
    "gql_validations": sql("nt gone inp tx", "SELECT t.id AS internal_id, v.n AS validations, coalesce(g.n, 0) AS replacements, coalesce(s.n, 0) AS spends FROM tx t JOIN (SELECT tx, count(*) AS n FROM nt GROUP BY tx) v ON v.tx = t.id LEFT JOIN (SELECT tx, count(*) AS n FROM gone GROUP BY tx) g ON g.tx = t.id LEFT JOIN (SELECT ohash, count(*) AS n FROM inp GROUP BY ohash) s ON s.ohash = t.hash"),
    "gql_authchains": sql("lines edges", f"SELECT e.base AS internal_id, cur AS head, {long('n')} AS length, least, most FROM (SELECT * FROM w WHERE {_ENDS}) e JOIN (SELECT base, min(m) AS least, max(m) AS most, max(n) AS longest FROM (SELECT base, n, CAST(unnest(string_split(path, ',')) AS BIGINT) AS m FROM w WHERE {_ENDS}) GROUP BY base) g ON g.base = e.base WHERE longest > 1", _WALK),
    "authchain_migration_transactions": sql("lines edges tx", f"SELECT base AS authbase_internal_id, {long('u.i - 1')} AS migration_index, tx.hash, locktime, size_bytes FROM (SELECT base, string_split(path, ',') AS xs FROM w WHERE {_ENDS}), LATERAL (SELECT unnest(range(1, len(xs) + 1)) AS i) u JOIN tx ON tx.id = CAST(list_extract(xs, u.i) AS BIGINT)", _WALK),
    "gql_computed_fields": sql("tm inp lines tx", "SELECT tm.id AS internal_id, fee AS fee_satoshis, sha256(enc.hex) AS digest, a.value AS identity_value, CASE a.kind WHEN 'R' THEN 'a91487' WHEN 'A' THEN '6a04' WHEN 'N' THEN '76a91488ac' END AS identity_pattern, b.value AS signing_value, (SELECT count(*) FROM lines c WHERE c.tx = tm.id AND (c.value = 0 OR c.kind = 'A')) AS carriers FROM tm JOIN enc ON enc.id = tm.id LEFT JOIN lines a ON a.tx = tm.id AND a.idx = 0 LEFT JOIN lines b ON b.tx = tm.id AND b.idx = 1", _ENCODED).replace("WITH RECURSIVE", "WITH"),
    "gql_computed_inputs": sql("iv", "SELECT tx AS transaction_internal_id, i AS input_index, value AS value_satoshis, 'a91487' AS redeem_bytecode_pattern FROM iv WHERE kind = 'R'"),
    "gql_nested_caps": sql("nt nodes", f"SELECT name, {long('count(tx)')} AS shown, max(tx) AS last FROM nodes LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY node ORDER BY tx) AS r FROM nt) ON node = id AND r <= 5000 GROUP BY name"),
    "gql_page_of_parents": sql("tx lines", "SELECT id AS internal_id, coalesce(top, '') AS top, (SELECT idx FROM lines WHERE tx = id AND idx = 0) AS identity FROM (SELECT id FROM tx ORDER BY id DESC LIMIT 40 OFFSET 5) LEFT JOIN (SELECT tx, string_agg(value, ',' ORDER BY r) AS top FROM (SELECT tx, value, row_number() OVER (PARTITION BY tx ORDER BY value DESC, idx) AS r FROM lines) WHERE r <= 3 GROUP BY tx) ON tx = id"),
    "gql_row_caps": sql("inp", "SELECT tx AS transaction_internal_id, i AS input_index FROM inp ORDER BY tx, i LIMIT 1000"),
    "gql_stream_cursor": sql("lines", "SELECT value AS value_satoshis, idx AS output_index, hash AS transaction_hash FROM lines WHERE value > 5000000 OR (value = 5000000 AND (idx > 2 OR (idx = 2 AND hash > '8'))) ORDER BY value, idx, hash LIMIT 50"),
    "gql_json": sql("blk", "SELECT '{\"height\":' || height || ',\"hash\":\"\\\\x' || hash || '\"}' AS json FROM blk"),
    "node_upsert": sql("nodes", "SELECT name, id AS internal_id, CAST(CASE WHEN id = 3 THEN 70015 ELSE 70016 END AS BIGINT) AS protocol_version, CASE WHEN id = 3 THEN '/agent:3/' ELSE 'new-' || name END AS user_agent, CAST(1000000000 AS BIGINT) AS first, CAST(CASE WHEN id = 3 THEN 1000000000 ELSE 1500000000 END AS BIGINT) AS latest FROM nodes"),
    "insert_if_absent": sql("tx lines", "SELECT id AS internal_id, count(l.tx) AS outputs FROM tx LEFT JOIN lines l ON l.tx = id WHERE id % 3 <> 0 GROUP BY id"),
    "assigned_ids": sql("tx", "SELECT hash, (SELECT max(id) FROM tx WHERE id % 2 = 0) + row_number() OVER (ORDER BY hash) AS internal_id FROM tx WHERE id % 2 = 1"),
    "announced_transactions": sql("nt", "SELECT node AS node_internal_id, tx AS transaction_internal_id, validated - 5 AS validated FROM nt WHERE tx % 3 <> 0"),
    "save_blocks": sql("blk btx bm num nb", f"SELECT height, n AS transactions, {long('coalesce((SELECT sum(size_bytes) FROM num WHERE num.height = bm.height), 0)')} AS bytes, ic AS inputs, ov AS value, (SELECT count(*) FROM nb WHERE nb.height = bm.height) AS nodes FROM bm"),
    "save_transactions": sql("nt tx", "SELECT node AS node_internal_id, hash, validated FROM nt JOIN tx ON tx.id = nt.tx"),
    "stream_ingest_blocks": sql("bm num", f"SELECT height, n AS transactions, {long('coalesce((SELECT sum(size_bytes) FROM num WHERE num.height = bm.height), 0)')} AS bytes, ic AS inputs, ov AS value FROM bm"),
    "raw_round_trip": sql("blk bm", f"SELECT b.height, prev AS previous, {rev(f'sha256(unhex(sha256(unhex({_HEADER}))))')} AS header_hash, n AS transactions, ic AS inputs, ov AS value, true AS whole FROM blk b JOIN (SELECT height AS h, n, ic, ov FROM bm) ON h = height"),
    "follow_headers": sql("nb", "SELECT node AS node_internal_id, height, 'stale' AS what FROM (SELECT node, height, min(height) OVER () AS least FROM nb WHERE node = 1 AND height >= (SELECT max(height) - 5 FROM nb WHERE node = 1)) WHERE height > least UNION ALL SELECT 2, NULL, 'known headers' UNION ALL SELECT 3, NULL, 'unknown parent'"),
    "sync_after_rewind": sql("nb nodes", f"SELECT id AS node_internal_id, {long('least(top, 6 * id - 1)')} AS synced_to, {long('least(top, 6 * id - 1) + 1')} AS next FROM (SELECT id, coalesce(max(CASE WHEN dense THEN height END), -1) AS top FROM nodes LEFT JOIN (SELECT node, height, row_number() OVER (PARTITION BY node ORDER BY height) - 1 = height AS dense FROM nb) ON node = id GROUP BY id)"),
    "mode_gates": sql("nb btx nt cf", "SELECT false AS live, CAST(0 AS BIGINT) AS cleared, CAST(0 AS BIGINT) AS heard UNION ALL SELECT true, (SELECT count(*) FROM (SELECT DISTINCT p.node, p.tx FROM (SELECT b.node, x.tx FROM nb b JOIN btx x ON x.height = b.height UNION ALL SELECT b.node, cf.b FROM nb b JOIN btx x ON x.height = b.height JOIN cf ON cf.a = x.tx) e JOIN nt p ON p.node = e.node AND p.tx = e.tx)), (SELECT count(*) FROM nt)"),
    "sql_functions": sql("lines", f"SELECT hash AS transaction_hash, idx AS output_index, {compact('value')} AS value, {le('idx', 4)} AS idx, script LIKE 'a914%' AS script_hash FROM lines WHERE script LIKE 'a91425%' OR script = '76a914' || substr(sha256('1'), 1, 40) || '88ac'"),
}
