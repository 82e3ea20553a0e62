"""Benchmark decontamination: the q-gram lemma on diagonal bands, then banded alignment.

Texts and items are normalised (lower case, every run of other characters than letters, digits and non-ASCII one
space). An item of m bytes may occur with up to k = rate * m edits, but no more than (m - q) // q, so that a bound
remains: at q = 10 and a rate of 8 %, items under 10 bytes match nothing, items of 10 to 19 bytes only exactly, and items
under about 50 bytes with fewer edits than 8 %. By the q-gram lemma such an occurrence shares at least m + 1 - q - k * q
q-grams with the item, on diagonals at most k apart. Text positions whose q-gram is the item's are counted in bands of
diagonals of a power of two wider than k that overlap by k, so one band holds them all; neighbouring bands that reach
the bound are a region, and each is verified by aligning the item in it (free ends in the text). An item must occur
as a whole: a document that holds only a part of it is kept.

A q-gram's places in an item are held as runs whose gaps are narrower than a band, and a text position counts once for
each band that a run touches (never less than its hits there that an occurrence needs). So a position gives at most
about 3 m / band rows, however often the item or the text repeats itself, and rows are counted slice by slice: memory
and time grow with the text, not with the number of hits.

Documents are read once. The items' index is cut into blocks of at most `block_bytes` of item text, which are broadcast
one by one; a bitmap of all items' q-grams (2 MB) tells which positions are held against the blocks at all, and a worker
holds one block at a time. Items are never joined with documents.

Defined cases: null or empty texts match nothing; null items and items of fewer than q normalised bytes are too short
to be evidence and match nothing; repeated items and documents are reported row by row; null ids pass through; a match
is never counted across two documents; an empty table gives none; other columns are ignored or carried unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import map_chunks, mix64, ragged_arange, slices, unused, window_codes

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BITS = 21
STEP = 1 << 20  # positions, or rows, that are looked at at once
REGION = 1 << 10  # neighbouring bands that are verified together
BATCH = 4 << 20  # bytes of text


def normal(text: bytes | None) -> bytes:
    text = text or b""
    text = text if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" ".join(text.translate(_FOLD).split())


class Match(NamedTuple):
    doc: int
    item: int
    edits: int
    end: int  # in the normalised text
    shared: int


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int | None = None) -> tuple[int, int]:
    """(edits, end) of the item's best place in the text, on diagonals first .. first + width - 1 only. Costs never
    fall from row to row, so it ends early once all are over `most`."""
    m = len(item)
    most = m if most is None else most
    at = first + np.arange(width)
    padded = np.full(m + width, 10, np.uint8)  # a byte that no item holds
    lo, hi = max(first, 0), min(first + m + width, len(text))
    if hi > lo:
        padded[lo - first : hi - first] = text[lo:hi]
    ramp = np.arange(width)
    cost = np.where((at >= 0) & (at <= len(text)), 0, m + 1)
    for i in range(m):
        step = cost + (padded[i : i + width] != item[i])
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(step - ramp) + ramp
        if i % 16 == 15 and cost.min() > most:
            return m + 1, 0
    best = int(np.argmin(cost))
    return int(cost[best]), m + first + best


class Grams:
    """The q-grams of a batch of texts that some item may hold."""

    def __init__(self, texts: list[bytes | None], q: int, maybe: np.ndarray):
        self.plain = [normal(t) for t in texts]
        self.raw = np.frombuffer(b"\n".join(self.plain) + b"\n", np.uint8)
        self.begins = np.cumsum([0] + [len(t) + 1 for t in self.plain])[:-1]
        pos, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a in range(0, len(self.raw), STEP):
            own = window_codes(self.raw[a : a + STEP + q - 1], q)
            at = np.flatnonzero(maybe[mix64(own) >> np.uint64(64 - _BITS)])
            pos.append(at + a)
            code.append(own[at])
        self.pos, self.code = np.concatenate(pos), np.concatenate(code)


class Items:
    """The q-grams of a block of items: by code, runs of places in an item."""

    def __init__(self, texts: list[bytes | None], q: int, rate: float):
        self.q, self.texts = q, [normal(t) for t in texts]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.maximum(np.minimum((rate * size).astype(np.int64), (size - q) // q), 0)
        self.need = size + 1 - q - self.k * q
        self.shift = np.array([int(k).bit_length() for k in self.k], np.int64)  # 2**shift > k
        use = np.flatnonzero(size >= q)
        codes = [window_codes(np.frombuffer(self.texts[i], np.uint8), q) for i in use]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(use, [len(c) for c in codes])
        at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
        order = np.lexsort((at, item, code))
        code, item, at = code[order], item[order], at[order]
        if len(code):
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (item[1:] != item[:-1]) | (np.diff(at) >= 1 << self.shift[item[1:]])])
            self.low, self.high = at[new].astype(np.int32), at[np.r_[new[1:], len(at)] - 1].astype(np.int32)
            code, item = code[new], item[new]
        else:
            self.low = self.high = np.zeros(0, np.int32)
        self.item = item.astype(np.int32)
        self.code, first, n = np.unique(code, return_index=True, return_counts=True)
        self.first, self.n = first.astype(np.int32), n.astype(np.int32)
        self.longest = 2 * int(size.max(initial=0))  # keeps bands from being negative

    def mark(self, maybe: np.ndarray) -> None:
        maybe[mix64(self.code) >> np.uint64(64 - _BITS)] = True

    def _rows(self, pos: np.ndarray, g: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, item and band, count) of some positions and their q-grams."""
        n = self.n[g].astype(np.int64)
        run = ragged_arange(self.first[g].astype(np.int64), n)
        pos = np.repeat(pos, n)
        item, at = self.item[run], pos + self.longest
        shift, k = self.shift[item], self.k[item]
        low, high = at - self.high[run] - k >> shift, at - self.low[run] >> shift  # the bands that the run's diagonals touch
        n = high - low + 1
        band = ragged_arange(low, n)
        doc = np.searchsorted(begins, pos, "right") - 1
        return _summed(np.repeat(doc, n), np.repeat(item.astype(np.int64) << 40, n) | band, np.ones(len(band), np.int64))

    def matches(self, grams: Grams) -> list[Match]:
        """The best match of each item in each text, if it is within the item's edits."""
        if not len(self.code) or not len(grams.pos):
            return []
        g = np.minimum(np.searchsorted(self.code, grams.code), len(self.code) - 1)
        same = self.code[g] == grams.code
        pos, g = grams.pos[same], g[same]
        counted = [np.zeros(0, np.int64)] * 3
        for a, b in slices(self.n[g], STEP // 4):
            more = self._rows(pos[a:b], g[a:b], grams.begins)
            counted = _summed(*(np.r_[x, y] for x, y in zip(counted, more, strict=True)))
        doc, key, count = counted
        enough = count >= self.need[key >> 40]
        doc, key, count = doc[enough], key[enough], count[enough]
        if not len(key):
            return []
        new = np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(key) != 1)]
        new[(np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))) % REGION == 0] = True
        start = np.flatnonzero(new)
        best: dict[tuple[int, int], Match] = {}
        for s, n in zip(start.tolist(), np.diff(np.r_[start, len(key)]).tolist(), strict=True):
            d, i, band = int(doc[s]), int(key[s]) >> 40, int(key[s]) & ((1 << 40) - 1)
            old = best.get((d, i))
            if old is not None and old.edits == 0:
                continue
            first = (band << int(self.shift[i])) - self.longest - int(grams.begins[d])
            m = self._verify(grams.plain[d], i, first, n, int(count[s : s + n].max()), d)
            if m and (old is None or (m.edits, m.end) < (old.edits, old.end)):
                best[d, i] = m
        return list(best.values())

    def _verify(self, text: bytes, i: int, d: int, bands: int, shared: int, doc: int) -> Match | None:
        item, k = self.texts[i], int(self.k[i])
        width = (bands << int(self.shift[i])) + k
        at = text.find(item, max(0, d), max(0, d + width + len(item)))
        if at >= 0:
            return Match(doc, i, 0, at + len(item), shared)
        edits, end = align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), d - k, width + 2 * k, k)
        return Match(doc, i, edits, min(end, len(text)), shared) if edits <= k else None


def _summed(doc: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts by (doc, key), in order."""
    if not len(key):
        return doc, key, count
    order = np.lexsort((key, doc))
    doc, key, count = doc[order], key[order], count[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    return doc[new], key[new], np.add.reduceat(count, new)


class Benchmark:
    """All items: a bitmap of their q-grams, and blocks of items with their names."""

    def __init__(self, bench: DataFrame, id_col: str, text_col: str, q: int, rate: float, most: int):
        self.q, self.blocks = q, []
        sc, maybe = bench.sparkSession.sparkContext, np.zeros(1 << _BITS, bool)
        held: list = []

        def close() -> None:
            if held:
                items = Items([bytes(x["t"]) for x in held], q, rate)
                items.mark(maybe)
                self.blocks.append(sc.broadcast((items, [x["i"] for x in held])))
                held.clear()

        size = 0
        for r in bench.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null").toLocalIterator():
            if held and size + len(r["t"]) > most:  # the driver holds one block at a time
                close()
                size = 0
            held.append(r)
            size += len(r["t"])
        close()
        self.maybe = sc.broadcast(maybe)

    def _load(self, block: Broadcast) -> tuple[Items, list]:
        """A block; of several, none is kept, so that a worker holds one at a time."""
        path = getattr(block, "_path", None)
        return block.value if len(self.blocks) == 1 or path is None else block.load_from_path(path)

    def matches(self, texts: list[bytes | None]) -> Iterator[tuple[Match, list]]:
        """In a worker: the matches in a batch of texts, each with the names of its block's items."""
        grams = Grams(texts, self.q, self.maybe.value)
        for block in self.blocks if len(grams.pos) else []:
            items, names = self._load(block)
            for m in items.matches(grams):
                yield m, names


def find_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 10, rate: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, item, edits, end, shared_grams): a row for each item that a document holds."""
    kind, item_kind = docs.schema[id_col].dataType, bench.schema[item_col].dataType
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([StructField("id", kind), StructField("item", item_kind), StructField("edits", IntegerType()), StructField("end", LongType()), StructField("shared_grams", IntegerType())])
    index = Benchmark(bench, item_col, item_text, q, rate, block_bytes)

    def work(batch: pa.RecordBatch) -> dict:
        found = list(index.matches(batch["text"].to_pylist()))
        at = pa.array([m.doc for m, _ in found], pa.int64())
        return {"id": batch["id"].take(at), "item": [names[m.item] for m, names in found], "edits": [m.edits for m, _ in found], "end": [m.end for m, _ in found], "shared_grams": [m.shared for m, _ in found]}

    return map_chunks(cut, work, schema, most=BATCH).withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 10, rate: float = 0.08, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs, all columns unchanged, that hold no item."""
    helper = unused(docs.columns, "leak_text")
    index = Benchmark(bench, item_col, item_text, q, rate, block_bytes)

    def work(batch: pa.RecordBatch) -> dict:
        keep = np.ones(batch.num_rows, bool)
        for m, _ in index.matches(batch[helper].to_pylist()):
            keep[m.doc] = False
        return {c: batch[c].filter(pa.array(keep)) for c in batch.schema.names}

    wide = docs.withColumn(helper, F.col(text_col).cast("binary"))
    return map_chunks(wide, work, wide.schema, column=helper, most=BATCH).drop(helper)
