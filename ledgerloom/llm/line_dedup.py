"""Line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

A line's key is hashed to 128 bits. Documents give their distinct keys' hashes; a partial aggregation counts the
documents of each and finds the largest id. The distinct hashes that reach `min_docs` are split into shards by hash. A
shard is a minimal perfect hash (three-way hypergraph peeling, vectorised by rounds) that indexes three compact
arrays: fingerprints, counts and the id that keeps the line. All lookups probe these arrays.

While all shards together have at most `broadcast_bytes` (27 bytes a key), they are broadcast, and each batch of
documents probes them where it is read. A larger index isn't held in one place: the hashes of the documents are
dealt to the shards, a task reads one shard at a time and probes it with a stream of hashes, and each document gets its
short list of hashes to drop. Hashes in more than one of `HOT` document lines (at most `HOT` of them, whatever the
input) have a small index of their own that is broadcast and probed first, so that no shard gets a hot key. Both
ways probe the same kind of arrays and give the same rows.

Defined cases: null or empty texts are one empty line; lines whose keys are shorter than `min_chars` code points always
stay; rows count as documents even if their ids repeat, and all rows of the keeping id keep; null ids count, and keep
only lines that no row with an id holds; rows of a document's own repeated line stay or go together; an empty table
gives none; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hold, importable, map_chunks, mix64, stored

_U = np.uint64
_NULL = -(1 << 63)  # stands for a null id in the arrays
HOT = 1 << 16
KEY_BYTES = 27  # 1.26 bytes of slots and 20 of arrays a key, and some


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() folds A-Z only


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) uint64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


class LineIndex:
    """Shards of one index, as flat arrays. Each has `third` slots in each of three ranges."""

    def __init__(self, shards: list[bytes]):
        parts = [np.frombuffer(s[:24], "<i8") for s in shards]
        self.third = np.array([p[0] for p in parts], np.int64)
        self.seed = np.array([p[1] for p in parts], np.int64).astype(_U)
        n = np.array([p[2] for p in parts], np.int64)
        self.slot0 = np.cumsum(3 * self.third) - 3 * self.third
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for s, third, k in zip(shards, self.third.tolist(), n.tolist(), strict=True):
            at = 24
            for col, kind, size in zip(columns, ("u1", "<u8", "<u4", "<i8"), (3 * third, k, k, k), strict=True):
                col.append(np.frombuffer(s, kind, size, at))
                at += size * col[-1].itemsize
        self.g, self.finger, self.count, self.keep = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        self.rank = np.cumsum(self.g >> 2, dtype=np.int64) - 1

    @staticmethod
    def slots(h: np.ndarray, third: np.ndarray | int, seed: np.ndarray | int) -> np.ndarray:
        x = mix64(h[:, 0] ^ seed)
        third = np.asarray(third).astype(_U)
        return np.stack([mix64(x + h[:, 1] * _U(2 * j + 1)) % third + third * _U(j) for j in range(3)], 1).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, count: np.ndarray, keep: np.ndarray) -> bytes:
        """One shard of distinct hashes."""
        n = len(h)
        third = max(2, int(0.42 * n) + 1)
        for seed in range(1, 1000):
            edges = cls.slots(h, third, _U(seed))
            alive, layers = np.arange(n), []
            while len(alive):
                e = edges[alive]
                single = np.bincount(e.ravel(), minlength=3 * third)[e] == 1
                free = single.any(1)
                if not free.any():
                    break
                layers.append((alive[free], single[free].argmax(1)))
                alive = alive[~free]
            if not len(alive):
                break
        else:
            raise ValueError("no seed peels this shard: are its hashes distinct?")
        g = np.zeros(3 * third, np.uint8)
        for ids, j in reversed(layers):
            e = edges[ids]
            own = e[np.arange(len(ids)), j]
            g[own] = (j - (g[e] & 3).sum(1, dtype=np.int64)) % 3 | 4  # own slot is still 0
        place = np.cumsum(g >> 2, dtype=np.int64) - 1
        at = place[cls._chosen(g, edges)]
        cols = [np.zeros(n, k) for k in ("<u8", "<u4", "<i8")]
        for col, values in zip(cols, (h[:, 1], np.minimum(count, 2**32 - 1), keep), strict=True):
            col[at] = values
        return np.array([third, seed, n], "<i8").tobytes() + g.tobytes() + b"".join(c.tobytes() for c in cols)

    @staticmethod
    def _chosen(g: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return edges[np.arange(len(edges)), (g[edges] & 3).sum(1, dtype=np.int64) % 3]

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeping id) of each hash; count 0 for a hash that isn't indexed."""
        if not len(self.finger) or not len(h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        shard = (h[:, 0] % _U(len(self.third))).astype(np.int64)
        edges = self.slots(h, self.third[shard], self.seed[shard]) + self.slot0[shard][:, None]
        slot = self._chosen(self.g, edges)
        at = np.maximum(self.rank[slot], 0)
        hit = (self.g[slot] >= 4) & (self.finger[at] == h[:, 1])
        return np.where(hit, self.count[at], 0).astype(np.int64), self.keep[at]


def _cut(texts: list[bytes | None], least: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; hashes of the long keys, the texts they are in and their line numbers."""
    lines = [(t or b"").split(b"\n") for t in texts]
    keys, doc, number = [], [], []
    for i, own in enumerate(lines):
        for j, line in enumerate(own):
            if len(line) >= least and _long(key := line_key(line), least):
                keys.append(key)
                doc.append(i)
                number.append(j)
    return lines, hashes(keys), np.array(doc, np.int64), np.array(number, np.int64)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, t): one row for each distinct key of each row of (id, t, text)."""

    def work(batch: pa.RecordBatch) -> dict:
        _, h, doc, _ = _cut(batch["text"].to_pylist(), min_chars)
        rows = np.empty(len(doc), [("d", "<i8"), ("a", "<u8"), ("b", "<u8")])
        rows["d"], rows["a"], rows["b"] = doc, h[:, 0], h[:, 1]
        rows = np.unique(rows)
        at = pa.array(rows["d"])
        return {"h1": rows["a"].view(np.int64), "h2": rows["b"].view(np.int64), "id": batch["id"].take(at), "t": batch["t"].take(at)}

    return map_chunks(docs, work, "h1 long, h2 long, id long, t long")


def _finish(texts: list[bytes | None], dropped: Callable, min_chars: int) -> dict:
    lines, h, doc, number = _cut(texts, min_chars)
    drop = dropped(h, doc)
    gone: dict[int, set[int]] = {}
    for d, j in zip(doc[drop].tolist(), number[drop].tolist(), strict=True):
        gone.setdefault(d, set()).add(j)
    kept = [b"\n".join(own if i not in gone else [x for j, x in enumerate(own) if j not in gone[i]]) for i, own in enumerate(lines)]
    return {"n_lines": list(map(len, lines)), "n_dropped": [len(gone.get(i, ())) for i in range(len(lines))], "kept": kept}


def _build(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, payload) from (h1, h2, n, keep); a shard without keys has no row."""
    # unsigned remainder of h1, as the probe takes it
    shard = F.pmod(F.pmod(F.shiftrightunsigned("h1", 1), F.lit(shards)) * 2 + F.col("h1").bitwiseAND(1), F.lit(shards))

    def build(t: pa.Table) -> pa.Table:
        h = np.stack([t[c].to_numpy().view(_U) for c in ("h1", "h2")], 1)
        keep = t["keep"].fill_null(_NULL).to_numpy() if t["keep"].null_count else t["keep"].to_numpy()
        return pa.table({"shard": [t["shard"][0].as_py()], "payload": pa.array([LineIndex.build(h, t["n"].to_numpy(), keep)], pa.binary())}, schema=pa.schema([("shard", pa.int64()), ("payload", pa.binary())]))

    return importable(counts.withColumn("shard", shard)).groupBy("shard").applyInArrow(build, "shard long, payload binary")


class _Held:
    """Shards that are broadcast, opened once in each worker."""

    def __init__(self, counts: DataFrame, shards: int):
        got = {r["shard"]: r["payload"] for r in _build(counts, shards).collect()}  # of a bounded number of keys
        empty = LineIndex.build(np.zeros((0, 2), _U), np.zeros(0), np.zeros(0))
        self.shared = counts.sparkSession.sparkContext.broadcast([got.get(i, empty) for i in range(shards)])
        self.index: LineIndex | None = None

    def losing(self, h: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
        """Which hashes (of documents with these ids) are indexed and kept by another document."""
        if self.index is None:
            self.index = LineIndex(self.shared.value)
        n, keep = self.index.probe(h)
        return (n >= min_docs) & (keep != ids)


def _in_place(rows: DataFrame, index: _Held, min_docs: int, min_chars: int) -> DataFrame:
    """Each batch of documents probes the broadcast shards."""

    def work(batch: pa.RecordBatch) -> dict:
        ids = batch["id"].fill_null(_NULL).to_numpy(zero_copy_only=False)
        return {"id": batch["id"]} | _finish(batch["text"].to_pylist(), lambda h, doc: index.losing(h, ids[doc], min_docs), min_chars)

    return map_chunks(rows, work, "id long, n_lines long, n_dropped long, kept binary")


def _routed(rows: DataFrame, found: DataFrame, counts: DataFrame, keys: int, min_docs: int, min_chars: int, shard_keys: int) -> DataFrame:
    """Hashes of documents are dealt to the shards and probe them there."""
    lines = found.count()
    often = F.col("n") > lines // HOT
    hot, shards = _Held(counts.where(often), 1), max(1, -(-keys // shard_keys))
    payloads = _build(counts.where(~often), shards)

    def cool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes that the hot index settles are answered at once (shard null); the others are given their shard."""
        hold(__name__)
        for batch in batches:
            h = np.stack([batch[c].to_numpy().view(_U) for c in ("h1", "h2")], 1)
            ids = batch["id"].fill_null(_NULL).to_numpy(zero_copy_only=False)
            lose, known = hot.losing(h, ids, min_docs), hot.index.probe(h)[0] > 0
            shard = pa.array((h[:, 0] % _U(shards)).astype(np.int64), mask=known)
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"]).filter(pa.array(lose | ~known))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(__name__)
        index, at = None, -1
        for batch in batches:
            number = batch["shard"].to_numpy()
            for a, b in _same(number):
                part = batch.slice(a, b - a)
                if number[a] != at:
                    index, at = None, int(number[a])
                if part["payload"][0].is_valid:  # it comes before its shard's hashes
                    index = LineIndex([part["payload"][0].as_py()])
                    part = part.slice(1)
                if index is None or not part.num_rows:  # a shard without keys
                    continue
                h = np.stack([part[c].to_numpy().view(_U) for c in ("h1", "h2")], 1)
                n, keep = index.probe(h)
                lose = (n >= min_docs) & (keep != part["id"].fill_null(_NULL).to_numpy(zero_copy_only=False))
                yield part.select(["h1", "h2", "id", "t"]).filter(pa.array(lose))

    asked = stored(importable(found).mapInArrow(cool, "h1 long, h2 long, id long, t long, shard long"), "line-asked")
    none, zero = F.lit(None), F.lit(0).cast("long")
    both = asked.where("shard is not null").select("shard", "h1", "h2", "id", "t", none.cast("binary").alias("payload"))
    both = both.unionAll(payloads.select("shard", zero.alias("h1"), zero.alias("h2"), none.cast("long").alias("id"), zero.alias("t"), "payload"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(parts, "shard").sortWithinPartitions("shard", F.col("payload").isNull())
    lose = importable(dealt).mapInArrow(probe, "h1 long, h2 long, id long, t long").unionAll(asked.where("shard is null").drop("shard"))
    lose = lose.groupBy("id", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("lose")).withColumnsRenamed({"id": "_i", "t": "_t"})
    wide = rows.join(lose.hint("merge"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("t") == F.col("_t")), "left").select("id", "text", "lose")

    def apart(batch: pa.RecordBatch) -> dict:
        sets = [{(x["h1"], x["h2"]) for x in own or ()} for own in batch["lose"].to_pylist()]

        def dropped(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
            return np.array([tuple(p) in sets[d] for p, d in zip(h.view(np.int64).tolist(), doc.tolist(), strict=True)], bool)

        return {"id": batch["id"]} | _finish(batch["text"].to_pylist(), dropped, min_chars)

    return map_chunks(wide, apart, "id long, n_lines long, n_dropped long, kept binary")


def _same(number: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
    return list(zip(start.tolist(), [*start[1:].tolist(), len(number)], strict=True)) if len(start) else []


def dedup_lines(docs: DataFrame, *, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64 << 20, shard_keys: int = 200_000) -> DataFrame:
    """(id, n_lines, n_dropped, kept): kept is the remaining text as bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    found = line_hashes(rows, min_chars)
    counts = stored(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs), "line-counts")
    keys = counts.count()
    if keys * KEY_BYTES <= broadcast_bytes:
        out = _in_place(rows, _Held(counts, max(1, -(-keys // shard_keys))), min_docs, min_chars)
    else:
        out = _routed(rows, found, counts, keys, min_docs, min_chars, shard_keys)
    return out.withColumnRenamed("id", id_col)


def digest(kept: DataFrame) -> DataFrame:
    """kept as kept_sha256."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
