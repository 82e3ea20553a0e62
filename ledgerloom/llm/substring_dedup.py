"""Suffix-array dedup: bytes covered by a `length`-byte string that starts twice or more in the corpus.

The corpus is never sorted as a whole. Every window of `length` bytes has one anchor, the least-hashed `gram`-byte
string in it (the first of equals), which depends on the window's bytes only: equal windows have equal anchors. The
windows of one anchor occurrence are consecutive, an extent. Extents are first counted by (anchor, digest of the
extent), which settles copies; anchors that occur once can't repeat. What is left are anchors with different extents:
an anchor is a suffix bucket whose windows must be compared.

Suffix buckets are sorted in bounded blocks of whole buckets by difference-cover construction: positions in a
difference cover modulo `V` are sampled and ranked (names of V-byte strings, then doubling up to `length`); one prefix
range at a time, windows are sorted by their first V bytes, and long ties are resolved by the ranks of the sampled positions that
the cover gives for both positions of a pair (a three-way quicksort of all ties at once). Neighbours whose first
`length` bytes agree are repeats. Memory depends on the block, not on the corpus or on the length of ties.

A bucket of more than `bucket` different extents isn't held in one block: it is refined by a deeper prefix. Its windows
are taken `CELL` neighbours at a time, and these cells are dealt to buckets by the length - CELL + 1 bytes that all of a
cell's windows hold; equal cells are settled by their count, and the refined buckets are sorted in blocks like the
others. Where even more than `bucket` different cells agree in that many bytes, the prefix is deepened to the whole
window: then a bucket holds equal windows only, nothing is left to sort, and its size (a sum with partial sums) tells
whether they repeat. So no task holds an unbounded group, and each level gives the windows that sorting would.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows are repeats of one another;
null ids are told apart by the text's hash; an empty table gives none; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, join_counted, map_chunks, mix64, ragged_arange, runs, stored, window_codes

CELL = 16  # windows of a hot extent that are counted together
_U = np.uint64


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(v, cover): a cover of 6r + 4 residues modulo v = 24r² + 36r + 13, from its steps (Colbourn and Ling)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


V, COVER = difference_cover(0)
_IN = np.isin(np.arange(V), COVER)
#: _SHIFT[i, j]: the least d < V such that i + d and j + d are both in the cover.
_SHIFT = np.array([[next(d for d in range(V) if _IN[(i + d) % V] and _IN[(j + d) % V]) for j in range(V)] for i in range(V)], np.int64)


def _words(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Big-endian 8-byte words at positions at + 8k; text is padded with zeros."""
    out = np.zeros(len(at), _U)
    for j in range(8):
        out = out << _U(8) | text[at + 8 * k + j]
    return out


def _prefix_order(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of positions by their first V bytes (13: two words, the second cut), and where the sorted values change."""
    first, second = _words(text, at, 0), _words(text, at, 1) >> _U(8 * (16 - V))
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]


def cover_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of the sampled positions by at least `depth` bytes (0 elsewhere and past the end); text is zero-padded."""
    at = np.flatnonzero(_IN[np.arange(size) % V])
    rank = np.zeros(size + 2 * depth + 2 * V, np.int64)
    order, new = _prefix_order(text, at)
    rank[at[order]] = np.cumsum(new)
    step = V  # a sampled position plus V is sampled
    while step < depth and not new.all():
        one, two = rank[at], rank[at + step]
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        rank[at[order]] = np.cumsum(new)
        step *= 2
    return rank


def _resolve(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order of the positions, which come by groups of equal prefixes, by cover ranks within each group."""
    order = np.arange(len(at))
    open_ = np.arange(len(at))  # places that aren't settled
    label = group
    while len(open_):
        start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        size = np.diff(np.r_[start, len(label)])
        mine = at[order[open_]]
        pivot = np.repeat(mine[start + size // 2], size)
        d = _SHIFT[mine % V, pivot % V]
        side = np.sign(rank[mine + d] - rank[pivot + d])
        key = np.repeat(np.arange(len(start)), size) * 3 + side + 1
        turn = np.argsort(key, kind="stable")
        order[open_] = order[open_][turn]
        key = key[turn]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        more = np.repeat((n > 1) & (key[first] % 3 != 1), n)  # those equal to the pivot are settled
        open_, label = open_[more], key[more]
    return order


def suffix_order(text: bytes | np.ndarray, at: np.ndarray, depth: int, bucket: int = 1 << 21) -> np.ndarray:
    """The positions `at` sorted by (at least) the `depth` bytes that follow, one suffix bucket at a time. A bucket is a
    range of two-byte prefixes with about `bucket` positions."""
    size = len(text)
    text = np.r_[np.frombuffer(text, np.uint8), np.zeros(depth + 4 * V, np.uint8)].astype(_U) if isinstance(text, bytes) else np.r_[text, np.zeros(depth + 4 * V, np.uint8)].astype(_U)
    rank = cover_ranks(text, size, depth)
    lead = (text[at] << _U(8) | text[at + 1]).astype(np.int64)
    filled = np.cumsum(np.bincount(lead, minlength=1 << 16))
    which = (filled - 1) // bucket
    out = []
    for b in np.unique(which[lead]).tolist():
        own = at[which[lead] == b]
        order, new = _prefix_order(text, own)
        own = own[order]
        out.append(own[_resolve(own, np.cumsum(new), rank)])
    return np.concatenate([np.zeros(0, np.int64), *out])


def repeated(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions start a `length`-byte string that another of them starts too."""
    hit = np.zeros(len(text) + 1, bool)
    if len(at) > 1:
        sa = suffix_order(text, at, length)
        code = window_codes(text, length)[sa]
        same = np.flatnonzero(code[1:] == code[:-1])
        view = np.lib.stride_tricks.sliding_window_view(text, length)
        for i in range(0, len(same), 1 << 14):  # the codes only save comparisons
            s = same[i : i + (1 << 14)]
            s = s[(view[sa[s]] == view[sa[s + 1]]).all(1)]
            hit[sa[s]] = hit[sa[s + 1]] = True
    return hit[at]


def gram(length: int) -> int:
    """Bytes of an anchor: long, so that common lines and phrases alone don't make hot anchors."""
    return length * 2 // 5


def leftmost_least(x: np.ndarray, span: int) -> np.ndarray:
    """For each `span` consecutive values, the place of the least one, the first of equals."""
    n = len(x) - span + 1
    grid = np.r_[x, np.full(-len(x) % span, _U(2**64 - 1))].reshape(-1, span)
    place = np.arange(grid.size).reshape(grid.shape)
    new = np.ones(grid.shape, bool)
    left = np.minimum.accumulate(grid, 1)  # from the start of a row
    new[:, 1:] = grid[:, 1:] < left[:, :-1]
    left_at = np.maximum.accumulate(np.where(new, place, 0), 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)  # from the end of a row
    new[:, 1:] = grid[:, -2::-1] <= right[:, :-1]
    right_at = np.minimum.accumulate(np.where(new, place[:, ::-1], grid.size), 1)[:, ::-1].ravel()
    a, b = right_at[:n], left_at[span - 1 : span - 1 + n]
    return np.where(x[a] <= x[b], a, b)


def extents(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor's code) of each anchor occurrence, in order."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    code = mix64(window_codes(raw, gram(length)))
    anchor = leftmost_least(code, length - gram(length) + 1)
    begin = np.cumsum(size) - size
    windows = ragged_arange(begin, np.maximum(size - length + 1, 0))
    text = np.repeat(np.arange(len(texts)), np.maximum(size - length + 1, 0))
    mine = anchor[windows]
    new = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (text[1:] != text[:-1])]) if len(mine) else none
    last = np.r_[new[1:], len(mine)] - 1
    own = text[new]
    return own, windows[new] - begin[own], windows[last] - begin[own], code[mine[new]].view(np.int64)


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(ah, dg, id, t, a, b): anchor, digest of the extent, document, first and last window."""

    def work(batch: pa.RecordBatch) -> dict:
        texts = [t or b"" for t in batch["text"].to_pylist()]
        own, a, b, code = extents(texts, length)
        views = list(map(memoryview, texts))
        digest = [_long(xxhash.xxh3_64_intdigest(views[i][x : y + length])) for i, x, y in zip(own.tolist(), a.tolist(), b.tolist(), strict=True)]
        at = pa.array(own)
        return {"ah": code, "dg": digest, "id": batch["id"].take(at), "t": batch["t"].take(at), "a": a, "b": b}

    return map_chunks(docs, work, "ah long, dg long, id long, t long, a int, b int", most=1 << 20)


def _block_repeats(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(id, t, a, b) of repeated windows in contexts (ah, id, t, a, n, ctx), sorted in blocks of whole buckets."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        ctx = t["ctx"].to_pylist()
        size = np.fromiter(map(len, ctx), np.int64, len(ctx))
        start = np.cumsum(size) - size
        count = size - length + 1
        at = ragged_arange(start, count)
        hit = repeated(np.frombuffer(b"".join(ctx), np.uint8), at, length) & np.repeat(t["n"].to_numpy() == 1, count)
        owner = np.repeat(np.arange(len(ctx)), count)
        place = at - start[owner] + t["a"].to_numpy()[owner]
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)) != 0)
        first, last = edge[::2], edge[1::2] - 1
        cut = np.flatnonzero(owner[first] != owner[last]) if len(first) else first
        if len(cut):  # a run over two contexts is two runs
            inner = np.flatnonzero(hit[1:] & hit[:-1] & (owner[1:] != owner[:-1]))
            first, last = np.sort(np.r_[first, inner + 1]), np.sort(np.r_[last, inner])
        doc = pa.array(owner[first])
        return pa.RecordBatch.from_arrays([pa.array(t["id"].combine_chunks().take(doc)), pa.array(t["t"].combine_chunks().take(doc)), pa.array(place[first], pa.int32()), pa.array(place[last], pa.int32())], names=["id", "t", "a", "b"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            if sum(x["ctx"].nbytes for x in held) >= block_bytes:
                t = pa.concat_tables(held)
                ah = t["ah"].to_numpy()
                change = np.flatnonzero(ah[1:] != ah[:-1]) + 1
                if len(change):
                    held = [t.slice(int(change[-1]))]
                    yield solve(t.slice(0, int(change[-1])))
        if held and (t := pa.concat_tables(held)).num_rows:
            yield solve(t)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = contexts.repartition(parts, "ah").sortWithinPartitions("ah")
    return importable(ready).mapInArrow(work, "id long, t long, a int, b int")


def _cells(contexts: DataFrame, length: int) -> DataFrame:
    """(ah, sub, id, t, a, k, n, ctx): a row for each cell of an extent. A cell's windows are those whose distance to the
    anchor, divided by CELL, is the same; ah is the digest of the bytes that all windows of such a cell hold, sub of all
    bytes of the k windows that are there, and a the first window's place."""

    def work(batch: pa.RecordBatch) -> dict:
        names = ("ah", "sub", "row", "a", "k", "ctx")
        out: dict[str, list] = {k: [] for k in names}
        for i, (c, ah, a) in enumerate(zip(*(batch[k].to_pylist() for k in ("ctx", "ah", "a")), strict=True)):
            last = len(c) - length  # of the windows
            code = mix64(window_codes(np.frombuffer(c, np.uint8), gram(length))).view(np.int64)
            anchor = last + int(np.argmax(code[last:] == ah))
            v = memoryview(c)
            cell = (anchor - np.arange(last + 1)) // CELL
            for x in np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist():
                y = int(np.searchsorted(-cell, -cell[x], "right"))  # cells fall from left to right
                core = anchor - CELL * int(cell[x])
                own = v[x : y - 1 + length]
                for k, value in zip(names, (_long(xxhash.xxh3_64_intdigest(v[core : core + length - CELL + 1])), _long(xxhash.xxh3_64_intdigest(own)), i, a + x, y - x, bytes(own)), strict=True):
                    out[k].append(value)
        at = pa.array(out.pop("row"), pa.int64())
        return {"ah": out["ah"], "sub": out["sub"], "id": batch["id"].take(at), "t": batch["t"].take(at), "a": out["a"], "k": out["k"], "n": batch["n"].take(at), "ctx": out["ctx"]}

    return map_chunks(contexts, work, "ah long, sub long, id long, t long, a int, k int, n long, ctx binary", column="ctx", most=1 << 18)


def _windows(cells: DataFrame, length: int) -> DataFrame:
    """(w1, w2, id, t, a, n): the fingerprint of each window of a cell."""

    def work(batch: pa.RecordBatch) -> dict:
        row, place, prints = [], [], []
        for i, c in enumerate(batch["ctx"].to_pylist()):
            v = memoryview(c)
            count = len(c) - length + 1
            row += [i] * count
            place += range(count)
            prints += [xxhash.xxh3_128_digest(v[j : j + length]) for j in range(count)]
        w = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
        at = pa.array(row, pa.int64())
        return {"w1": w[:, 0], "w2": w[:, 1], "id": batch["id"].take(at), "t": batch["t"].take(at), "a": batch["a"].to_numpy()[row] + np.array(place, np.int32), "n": batch["n"].take(at)}

    return map_chunks(cells, work, "w1 long, w2 long, id long, t long, a int, n long", column="ctx", most=1 << 18)


def _refined(contexts: DataFrame, length: int, bucket: int, block_bytes: int) -> DataFrame:
    """(id, t, a, b) of repeated windows in extents of buckets that are too large for a block."""
    cells = stored(_cells(contexts, length), "sub-cells")
    kinds = cells.groupBy("ah", "sub").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n", "id", "t", "a")).alias("one"), F.first("ctx").alias("ctx"))
    kinds = stored(kinds.select("ah", "sub", "c", "one.id", "one.t", "one.a", F.greatest("c", "one.n").alias("n"), "ctx"), "sub-kinds")
    whole = join_counted(cells.where("n = 1").select("ah", "sub", "id", "t", "a", "k"), kinds.where("c > 1").select("ah", "sub", "c"), ["ah", "sub"], "c", cells.count())
    width = stored(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("width")).where("width > 1"), "sub-widths")
    differ = stored(kinds.join(width.hint("merge"), "ah").select("width", "ah", "id", "t", "a", "n", "ctx"), "sub-differ")
    blocks = _block_repeats(differ.where(F.col("width") <= bucket).drop("width"), length, block_bytes)
    windows = stored(_windows(differ.where(F.col("width") > bucket), length), "sub-windows")
    twice = stored(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sub-more")
    equal = join_counted(windows.where("n = 1"), twice, ["w1", "w2"], "k", windows.count()).select("id", "t", "a", F.col("a").alias("b"))
    return whole.select("id", "t", "a", (F.col("a") + F.col("k") - 1).alias("b")).unionAll(blocks).unionAll(equal)


def repeats(docs: DataFrame, *, length: int = 400, bucket: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, t, a, b): runs of windows a .. b of document (id, t) that occur elsewhere; docs has (id, t, text)."""
    found = stored(anchor_rows(docs, length), "sub-anchors")
    twice = found.groupBy("ah").agg(F.count(F.lit(1)).alias("k"), (F.min("dg") != F.max("dg")).alias("mixed")).where("k > 1")
    twice = stored(twice, "sub-twice")  # a join right after an aggregate isn't split where it is skewed
    total = found.count()
    again = stored(join_counted(found, twice, ["ah"], "k", total).drop("k"), "sub-again")
    classes = again.groupBy("ah", "dg", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "t", "a", "b")).alias("rep"))
    classes = stored(classes.where("mixed or n > 1"), "sub-classes")
    copies = join_counted(again, classes.where("n > 1").select("ah", "dg", "n"), ["ah", "dg"], "n", total).select("id", "t", "a", "b")

    # different extents of one anchor: fetch the bytes of one of each
    mixed = classes.where("mixed")
    width = stored(mixed.groupBy("ah").agg(F.count(F.lit(1)).alias("k")), "sub-width")
    asked = mixed.join(width.hint("merge"), "ah").groupBy(F.col("rep.id").alias("_i"), F.col("rep.t").alias("_t")).agg(F.collect_list(F.struct("ah", "n", "rep.a", "rep.b", "k")).alias("want"))
    texts = docs.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("t") == F.col("_t"))).select("id", "t", "text", "want")
    cut = F.explode(F.transform("want", lambda w: F.struct(w["ah"].alias("ah"), w["n"].alias("n"), w["k"].alias("k"), w["a"].alias("a"), F.substring(F.col("text"), w["a"] + 1, w["b"] - w["a"] + length).alias("ctx"))))
    contexts = texts.select("id", "t", cut.alias("c")).select("id", "t", "c.*")
    contexts = stored(contexts.dropDuplicates(["id", "t", "ah", "a"]), "sub-contexts")
    found_in_blocks = _block_repeats(contexts.where(F.col("k") <= bucket).drop("k"), length, block_bytes)

    hot = contexts.where(F.col("k") > bucket).drop("k")
    return copies.unionAll(found_in_blocks).unionAll(_refined(hot, length, bucket, block_bytes))


def drop_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", bucket: int = 512, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row; kept is what remains, as bytes."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spans = repeats(docs, length=length, bucket=bucket, block_bytes=block_bytes)
    spans = spans.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumnsRenamed({"id": "_i", "t": "_t"})
    rows = docs.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("t") == F.col("_t")), "left").select("id", "text", "spans")

    def work(batch: pa.RecordBatch) -> dict:
        texts, lost, count, kept = batch["text"].to_pylist(), [], [], []
        flat, off = batch["spans"].flatten(), batch["spans"].offsets.to_numpy()
        a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
        off = off - off[0]
        for i, t in enumerate(texts):
            s, e = runs(a[off[i] : off[i + 1]].astype(np.int64), b[off[i] : off[i + 1]].astype(np.int64) + length)
            lost.append(int((e - s).sum()))
            count.append(len(s))
            kept.append(b"".join(t[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(t)], strict=True)) if len(s) else t)
        return {"id": batch["id"], "n_bytes": list(map(len, texts)), "n_removed": lost, "n_spans": count, "kept": kept}

    return map_chunks(rows, work, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def digest(kept: DataFrame) -> DataFrame:
    """kept as kept_sha256."""
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
