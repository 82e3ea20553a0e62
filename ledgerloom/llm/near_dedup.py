"""MinHash near-dedup with b-bit signatures, exact on the links it confirms.

A document's set is its distinct five-word shingles, hashed to 64 bits. Equal sets are one node. Of `HASHES` minima of
a node, the first 128 make 32 bands of four; the low `B` bits of all minima are packed into a signature. Two
signatures' equal fields, counted by bit operations and corrected for chance collisions, estimate the similarity.

Nodes that share a band are candidates:
1. Within a band, signatures choose a spanning forest of the most similar pairs (at most one pair a member). A band
   with many members is cut into blocks that share some members, so no task holds an unbounded group.
2. The pairs are confirmed on the full sets, and the links' components are found.
3. Only pairs of a band whose nodes are still in different components can add anything: all of those whose estimate is
   within the margin are compared on the full sets too, and one link is given for each two components it joins.
   Members outside the band's largest component meet its members and one another in blocks. A band with more than
   `BLOCK` such members, which are mostly unlike texts that share a passage, isn't laid out: the members of all such
   bands are dealt by the shingles of their prefixes. With the shingles of each set in one order, the rarest among these
   members first, two sets of similarity 0.75 share one of the first n / 4 + 1, so no pair is left out. Rows grow with
   the members' shingles, not with the members' square; a group of any width is laid out in blocks in full (texts that
   share rare shingles without being near copies).
4. Pairs of different components that share no band, or a wide one, are found by all sets' prefixes, in one order of
   all shingles: those that a sample of texts has more than once come last, the more frequent the later, the others go
   by hash. Any two sets of similarity 0.75 share a shingle of both prefixes, whatever the sample is. They are compared
   at the first one only: a pair that has one of the `EARLIER` shingles before in common meets elsewhere, and one with
   too few shingles left behind its places isn't similar enough. No pairs are made: a group's members with any pair to
   compare come with their texts, and its links leave, at most one fewer than its components.
So every pair of the table is either confirmed, or refused by its sets or its estimate, or joined already by other
links. In step 4 an estimate refuses less than 1e-23 of the pairs of similarity 0.75.

A set is identified by 128 bits: nodes are numbered by 64 of them, and where two sets have the same 64, the second is
numbered anew.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing; fewer than five words are
one shingle; rows with null ids take part, but never name a component unless it has no other id; repeated rows and
ids are linked like any copies; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hold, importable, join_counted, map_chunks, mix64, named, ragged_arange, slices, stored, trim, unused
from .components import components

HASHES, BANDS, ROWS, B, WORDS = 256, 32, 4, 4, 5
BLOCK, SHARED = 512, 16
SETS, LEVELS = 16, 2
SAMPLE, FREQUENT, FEW, EARLIER = 1 << 14, 1 << 18, 64, 4
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240229)
    byte = rng.integers(0, 2**63, 256).astype(_U) * _U(2) + _U(1)
    flip, odd = (rng.integers(0, 2**32, HASHES).astype(np.uint32) for _ in range(2))
    return byte, flip, odd | np.uint32(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse**i modulo 2**64."""
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, inverse))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hold(__name__, _powers.cache_clear)
    lowered = [(t or b"").lower() for t in texts]
    raw = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    space = _IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space]))  # word begins, word ends, ...
    begins, ends = edge[::2], edge[1::2]
    up, down = _powers(max(1 << 21, 1 << int(len(raw)).bit_length()))
    total = np.r_[_U(0), np.cumsum(_constants()[0][raw] * up[: len(raw)])]
    words = mix64((total[ends] - total[begins]) * down[begins])
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    at = np.searchsorted(begins, np.r_[0, np.cumsum(size)])
    rolled = np.full(max(len(words) - WORDS + 1, 0), _U(WORDS))
    for k in range(WORDS):
        rolled = rolled * _BASE + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            h = _U(b - a)
            for w in words[a:b]:
                h = np.multiply(h, _BASE) + w
            out.append(mix64(np.array([h], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    _, flip, odd = _constants()
    x = (shingles >> _U(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, ((x[i : i + 2048, None] ^ flip) * odd).min(0), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys from (rows, HASHES) minima."""
    v = low[:, : BANDS * ROWS].astype(_U).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), v.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * _BASE + v[:, :, k])
    return key


def pack(low: np.ndarray) -> np.ndarray:
    """(rows, HASHES * B / 8) bytes: the low B = 4 bits of each minimum."""
    bits = (low & np.uint32(15)).astype(np.uint8)
    return bits[:, ::2] | bits[:, 1::2] << 4


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed signatures as uint64 words (last axis)."""
    x = a ^ b
    x |= x >> _U(1)
    x |= x >> _U(2)
    differ = np.bitwise_count(x & _U(0x1111111111111111)).sum(-1, dtype=np.int64)
    return ((HASHES - differ) / HASHES - 2.0**-B) / (1 - 2.0**-B)


def features(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """(id, t, n, s, s2, bands, sig) from (id, t, text); s and s2 identify the set, and are null with bands and sig for an
    empty set. id_bits: of s, fewer in tests."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch["text"].to_pylist())
        n = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(n)
        low = np.stack([minima(sets[i]) for i in full]) if len(full) else np.zeros((0, HASHES), np.uint32)
        ids: list = [None] * len(sets)
        more: list = [None] * len(sets)
        bands: list = [None] * len(sets)
        sigs: list = [None] * len(sets)
        for i, key, sig in zip(full.tolist(), bands_of(low).view(np.int64).tolist() if len(full) else [], pack(low), strict=True):
            high, low64 = divmod(xxhash.xxh3_128_intdigest(sets[i].tobytes()), 1 << 64)
            ids[i], more[i] = np.array([low64 & ((1 << id_bits) - 1), high], _U).view(np.int64).tolist()
            bands[i], sigs[i] = key, sig.tobytes()
        return {"id": batch["id"], "t": batch["t"], "n": n, "s": ids, "s2": more, "bands": bands, "sig": sigs}

    return map_chunks(docs, work, "id long, t long, n long, s long, s2 long, bands array<long>, sig binary", most=1 << 20)


def sets_of(feats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feats, nodes): a node for each different set, with an s of its own."""
    again = 0
    while True:
        nodes = feats.where("n > 0").groupBy("s", "s2").agg(F.first("n").alias("n"), F.min(F.struct("id", "t")).alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        nodes = stored(nodes, "near-nodes")
        clash = stored(nodes.groupBy("s").agg(F.count(F.lit(1)).alias("_c"), F.min("s2").alias("_own")).where("_c > 1"), "near-clash")
        if clash.isEmpty():
            return feats, nodes
        again += 1
        other = F.when(F.col("s2") != F.col("_own"), F.xxhash64("s", "s2", F.lit(again))).otherwise(F.col("s"))
        feats = stored(feats.join(clash.hint("merge"), "s", "left").withColumn("s", other).drop("_c", "_own"), "near-features")


def _per_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """work(table of whole groups, where each begins, its size) over rows dealt and sorted by keys. Groups are streamed
    from the partitions, so that many tiny groups cost no calls."""

    def begins(t: pa.Table) -> np.ndarray:
        key = np.stack([t[k].to_numpy().astype(np.int64) for k in keys], 1)
        return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(__name__)
        rest: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
            start = begins(t)
            cut = int(start[-1])
            rest = [t.slice(cut)]
            if cut:
                yield work(t.slice(0, cut), start[:-1], np.diff(start))
        for t in rest:
            start = begins(t)
            yield work(t, start, np.diff(np.r_[start, t.num_rows]))
        t = batch = None
        rest.clear()
        trim()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return importable(rows.repartition(parts, *keys).sortWithinPartitions(*keys)).mapInArrow(run, schema)


def _bits(t: pa.Table, column: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(t[column].to_pylist()), "<u8").reshape(t.num_rows, -1).astype(_U)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _forests(t: pa.Table, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    s, n, sig = t["s"].to_numpy(), t["n"].to_numpy(), _bits(t)
    two = start[size == 2]
    two = two[(similarity(sig[two], sig[two + 1]) >= FLOOR) & (n[two] * 4 >= n[two + 1] * 3) & (n[two + 1] * 4 >= n[two] * 3)]
    a, b = [two], [two + 1]
    for i, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        x, y = forest(s[i : i + m], n[i : i + m], sig[i : i + m])
        a.append(x + i)
        b.append(y + i)
    return _pairs(s[np.concatenate(a)], s[np.concatenate(b)])


class _Open:
    """Rows of whole groups, and which pairs of members of one group, whose components differ, are to be compared there."""

    def __init__(self, t: pa.Table):
        self.s, self.n, self.side, self.place, self.rule, self.diagonal = (t[c].to_numpy() for c in ("s", "n", "side", "place", "rule", "diagonal"))
        self.comp, self.sig, self.before = t["comp"].to_numpy().copy(), _bits(t), _bits(t, "before")
        self.least = np.where(self.rule, FLOOR, LEAST)
        self.bands = np.zeros((t.num_rows, BANDS), np.int64)
        self.bands[self.rule] = pc.list_flatten(t["bands"]).to_numpy().reshape(-1, BANDS)
        self.at = (self.bands == t["band"].to_numpy()[:, None]).argmax(1)

    def pairs(self, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (left, right) to compare, some at a time; groups of at most FEW together, larger ones member by member."""
        few = size <= FEW
        a, m = start[few], size[few]
        for step in range(1, int(m.max(initial=1))):
            a, m = a[m > step], m[m > step]
            left = ragged_arange(a, m - step)
            yield self._meet(left, left + step)
        for first, end in zip(start[~few].tolist(), (start + size)[~few].tolist(), strict=True):
            for i in range(first, end - 1):
                yield self._meet(np.full(end - 1 - i, i), np.arange(i + 1, end))

    def _meet(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of different components, within the sizes and the floor; under the rule only those whose first common
        band is this, by prefixes not those that are known to share an earlier shingle, as others meet there."""

        def only(ok: np.ndarray) -> None:
            nonlocal left, right
            left, right = left[ok], right[ok]

        n, place, before = self.n, self.place, self.before
        only((self.comp[left] != self.comp[right]) & (self.diagonal[left] | (self.side[left] != self.side[right])))
        only(7 * np.minimum(n[left] - place[left], n[right] - place[right]) >= 3 * (n[left] + n[right]))
        known = np.zeros(len(left), bool)
        for k in range(before.shape[1]):
            one = before[left, k]
            known |= (one != 0) & (before[right] == one[:, None]).any(1)
        only(~known)
        only(similarity(self.sig[left], self.sig[right]) >= self.least[left])
        rule = self.rule[left]
        if rule.any():
            only(~rule | ((self.bands[left] == self.bands[right]).argmax(1) == self.at[left]))
        return left, right


def _involved(t: pa.Table, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The members that have any pair to compare."""
    need = np.zeros(t.num_rows, bool)
    for left, right in _Open(t).pairs(start, size):
        need[left] = True
        need[right] = True
    t = t.filter(pa.array(need)).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], names=t.column_names)


def _compare(t: pa.Table, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Links between components, confirmed on the full sets: at most one fewer than a group's components."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    long = np.add.reduceat(pc.binary_length(t["text"]).to_numpy().astype(np.int64), start)
    for x, y in slices(long, 1 << 20):
        first, end = int(start[x]), int(start[y - 1] + size[y - 1])
        part = t.slice(first, end - first)
        rows = _Open(part)
        comp, n = rows.comp, rows.n
        _, one, at = np.unique(rows.s, return_index=True, return_inverse=True)
        sets = shingle_sets(part["text"].take(pa.array(one)).to_pylist())
        count = np.stack([np.minimum(np.bincount((x >> _U(55)).astype(np.int64), minlength=512), 255) for x in sets]).astype(np.uint8)
        for left, right in rows.pairs(start[x:y] - first, size[x:y]):
            i, j = at[left], at[right]
            both = np.minimum(count[i], count[j]).sum(1, dtype=np.int64)  # no more can be common than by parts of the hashes' range
            ok = (100 * both >= 75 * (n[left] + n[right] - both)) | (count[j] == 255).any(1)
            for u, v in zip(left[ok].tolist(), right[ok].tolist(), strict=True):
                if comp[u] != comp[v] and alike(sets[at[u]], sets[at[v]]):
                    comp[comp == comp[v]] = comp[u]
                    a.append(rows.s[[u]])
                    b.append(rows.s[[v]])
    return _pairs(np.concatenate(a), np.concatenate(b))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


#: Estimates below this are refused: seven deviations under 0.75.
FLOOR = 0.55
#: The same where nothing may be lost: by Hoeffding's bound less than 1e-23 of the pairs at 0.75.
LEAST = 0.4


def forest(s: np.ndarray, n: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A maximum spanning forest of the members' estimates (Prim), without edges below the floor."""
    m = len(s)
    best, parent, out = np.full(m, -1.0), np.zeros(m, np.int64), np.zeros(m, bool)
    cur, a, b = int(np.argmin(s)), [], []
    for _i in range(m - 1):
        out[cur] = True
        best[cur] = -2.0
        est = similarity(sig, sig[cur])
        est[(n * 4 < n[cur] * 3) | (n[cur] * 4 < n * 3)] = 0.0
        near = ~out & (est > best)
        best[near], parent[near] = est[near], cur
        cur = int(np.argmax(best))
        if best[cur] >= FLOOR:
            a.append(parent[cur])
            b.append(cur)
    return np.array(a, np.int64), np.array(b, np.int64)


def texts_of(ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(s, text): one text for each node of ends (s)."""
    which = nodes.join(ends, "s").select("s", F.col("rep.id").alias("_i"), F.col("rep.t").alias("_t"))
    texts = docs.join(which, (F.col("t") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_i"))).select("s", "text")
    return stored(texts.dropDuplicates(["s"]), "near-texts")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets intersect in at least three quarters of their union."""
    ends = pairs.select(F.col("a").alias("s")).unionAll(pairs.select(F.col("b").alias("s"))).distinct()
    texts = texts_of(ends, nodes, docs)

    def work(batch: pa.RecordBatch) -> dict:
        left, right = (shingle_sets(batch[c].to_pylist()) for c in ("ta", "tb"))
        at = pa.array([alike(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
        return {"u": batch["a"].filter(at), "v": batch["b"].filter(at)}

    full = pairs.join(texts.select(F.col("s").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").join(texts.select(F.col("s").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    return stored(map_chunks(full, work, "u long, v long", column="ta", most=1 << 20), "near-links")


def _refined(rows: DataFrame, level: int) -> DataFrame:
    """(g, band, rule, s, comp) from (g, s, comp, sig): SETS rows a member, one for each set of eight fields."""

    def work(batch: pa.RecordBatch) -> dict:
        order = np.random.default_rng(level).permutation(64)  # of the bytes that hold the fields which make no bands
        sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, HASHES * B // 8)
        fields = np.ascontiguousarray(sig[:, 64:][:, order]).view("<u4").astype(_U)
        g = batch["g"].to_numpy().view(_U)[:, None] + np.arange(1, SETS + 1, dtype=_U) * _BASE
        key = mix64(mix64(g + _U(level)) ^ fields).view(np.int64).ravel()
        at = pa.array(np.repeat(np.arange(batch.num_rows), SETS))
        return {"g": key, "band": np.zeros(len(key), np.int64), "rule": np.zeros(len(key), bool), "s": batch["s"].take(at), "comp": batch["comp"].take(at)}

    return map_chunks(rows, work, "g long, band long, rule boolean, s long, comp long", column="sig", most=1 << 20)


def _named(members: DataFrame, label: DataFrame) -> DataFrame:
    """(g, band, rule, s, comp) of the members of bands that more than one pair can share."""
    rows = members.where("m > 2").join(label.withColumnRenamed("node", "s").hint("merge"), "s", "left")
    return stored(rows.select(F.col("band").alias("g"), "band", F.lit(True).alias("rule"), "s", F.coalesce("label", "s").alias("comp")), "near-named")


def _mains(now: DataFrame) -> DataFrame:
    """(g, main, k, m, wide) of the groups of several components: the largest one, its members, all members, and whether
    over BLOCK are outside it."""
    by_comp = now.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = by_comp.groupBy("g").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).where("comps > 1")
    return stored(main.select("g", F.col("top.comp").alias("main"), F.col("top.k").alias("k"), "m", (F.col("m") - F.col("top.k") > BLOCK).alias("wide")), "near-main")


def meetings(members: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame | None = None, wide: bool = True) -> DataFrame:
    """(g, block, diagonal, side, band, rule, s, comp): who is to be compared with whom; in a block that isn't diagonal,
    only members of different sides. With docs, wide bands are dealt by prefixes and no pair of a band that could be a
    link is left out; without, they are refined by signatures alone, which can part pairs. wide: whether they take part."""
    now = _named(members, label)
    out = []
    for level in range(LEVELS + 1):
        main = _mains(now)
        rows = now.join(main.hint("merge"), "g")
        if level == LEVELS or main.where("wide").isEmpty():
            out.append(_in_blocks(rows))
            break
        out.append(_in_blocks(rows.where("not wide")))
        if not wide:
            break
        rows = rows.where("wide")
        if docs is not None:
            now = stored(_prefixes(rows.select("s", "comp").distinct(), nodes, docs), "near-prefixes")
            out.append(_in_blocks(now.join(_mains(now).hint("merge"), "g")))
            break
        now = stored(_refined(rows.select("g", "s", "comp").join(nodes.select("s", "sig").hint("merge"), "s"), level), "near-named")
    return reduce(DataFrame.unionAll, out)


def _prefixes(ends: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(g, band, rule, s, comp) from (s, comp): a row for each shingle of a prefix that another node has too."""

    def work(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch["text"].to_pylist())
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        return {"s": batch["s"].take(at), "g": np.concatenate([np.zeros(0, _U), *sets]).view(np.int64)}

    shingles = stored(map_chunks(texts_of(ends.select("s"), nodes, docs), work, "s long, g long", most=1 << 20), "near-shingles")
    often = stored(shingles.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-often")
    common = join_counted(shingles, often, ["g"], "c", shingles.count())
    common = common.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("all")).join(nodes.select("s", "n").hint("merge"), "s").join(ends.hint("merge"), "s")
    single = F.col("n") - F.size("all")  # they come first, and nobody else has them
    room = F.greatest(F.floor(F.col("n") / 4) + 1 - single, F.lit(0)).cast("int")
    return common.select(F.explode(F.slice("all", F.lit(1), room)).alias("x"), "s", "comp").select("x.g", F.lit(0).cast("long").alias("band"), F.lit(False).alias("rule"), "s", "comp")


def _in_blocks(rows: DataFrame) -> DataFrame:
    big, top = F.col("m") > BLOCK, F.col("comp") == F.col("main")
    d_all, h_all = (F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("int") for x in (F.col("k"), F.col("m") - F.col("k")))
    own = F.xxhash64("s", "g")
    rows = rows.withColumns({"_d": F.when(big, d_all), "_h": F.when(big, h_all)})
    rows = rows.withColumn("side", F.when(~big, 0).when(top, -1).otherwise(F.pmod(own, F.col("_h"))).cast("int"))

    def spot(code, diagonal):
        return F.struct(code.cast("int").alias("block"), diagonal.alias("diagonal"))

    no, d, h, side = F.lit(False), F.col("_d"), F.col("_h"), F.col("side")
    of_top = F.transform(F.sequence(F.lit(0), h - 1), lambda x: spot(F.pmod(own, d) * h + x, no))
    of_rest = F.concat(F.transform(F.sequence(F.lit(0), d - 1), lambda x: spot(x * h + side, no)), F.transform(F.sequence(F.lit(0), h - 1), lambda x: spot(d * h + F.least(x, side) * h + F.greatest(x, side), x == side)))
    rows = rows.withColumn("_at", F.explode(F.when(~big, F.array(spot(F.lit(0), F.lit(True)))).when(top, of_top).otherwise(of_rest)))
    return rows.select("g", "_at.block", "_at.diagonal", "side", "band", "rule", "s", "comp", *(c for c in ("place", "before") if c in rows.columns))


def between_components(members: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame, wide: bool = True) -> DataFrame:
    """Links (u, v) between components that share a band; without `wide`, one that isn't wide."""
    return _compared(meetings(members, label, nodes, docs, wide), nodes, docs)


def _compared(met: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) among those who meet."""
    if "place" not in met.columns:
        met = met.withColumns({"place": F.lit(0), "before": F.lit(bytes(8 * EARLIER))})
    sigs = nodes.select("s", "n", "sig", "bands")
    rows = met.join(sigs.hint("merge"), "s").withColumn("bands", F.when(F.col("rule"), F.col("bands")))
    rows = rows.select("g", "block", "diagonal", "side", "band", "rule", "s", "n", "comp", "place", "before", "sig", "bands")
    kept = "g long, block int, diagonal boolean, side int, band long, rule boolean, s long, n long, comp long, place int, before binary, sig binary, bands array<long>"
    need = stored(_per_group(rows, ["g", "block"], _involved, kept), "near-open")
    texts = texts_of(need.select("s").distinct(), nodes, docs)
    found = _per_group(need.join(texts.hint("merge"), "s").select(*need.columns, "text"), ["g", "block"], _compare, "a long, b long")
    return stored(found.distinct().select(F.col("a").alias("u"), F.col("b").alias("v")), "near-more")


def _frequent(docs: DataFrame, nodes: int) -> np.ndarray:
    """Shingles that several texts of a sample of about SAMPLE have, rarest first. They only order the shingles: what the
    sample misses costs time, never a pair."""
    sample = docs.where(F.pmod("t", F.lit(max(1, nodes // SAMPLE))) == 0).dropDuplicates(["t"]).select("text")

    def work(batch: pa.RecordBatch) -> dict:
        return {"g": np.concatenate([np.zeros(0, _U), *shingle_sets(batch["text"].to_pylist())]).view(np.int64)}

    often = map_chunks(sample, work, "g long", most=1 << 20).groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return often.orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()["g"].to_numpy()[::-1].astype(np.int64).view(_U)


def prefix(shingles: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n / 4 + 1 shingles in the order of all: those that aren't known by hash, then the known ones by rank."""
    need = len(shingles) // 4 + 1
    if not len(known):
        return shingles[:need]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    hit = known[at] == shingles
    first = shingles[~hit][:need]
    if len(first) == need:
        return first
    return np.concatenate([first, shingles[hit][np.argsort(rank[at[hit]])[: need - len(first)]]])


def _prefix_rows(docs: DataFrame, frequent: np.ndarray) -> tuple[DataFrame, Broadcast]:
    """(g, s2, place): a row for each shingle of each set's prefix; copies that a task meets give none."""
    order = np.argsort(frequent)
    given = docs.sparkSession.sparkContext.broadcast((frequent[order], order))
    seen: set[int] = set()

    def work(batch: pa.RecordBatch) -> dict:
        known, rank = given.value
        g, s2, place = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        for x in shingle_sets(batch["text"].to_pylist()):
            high = xxhash.xxh3_128_intdigest(x.tobytes()) >> 64
            if len(x) and high not in seen:
                if len(seen) == 1 << 18:
                    seen.clear()
                seen.add(high)
                g.append(prefix(x, known, rank))
                s2.append(np.full(len(g[-1]), high, _U))
                place.append(np.arange(len(g[-1])))
        return {"g": np.concatenate(g).view(np.int64), "s2": np.concatenate(s2).view(np.int64), "place": np.concatenate(place).astype(np.int32)}

    return map_chunks(docs.select("text"), work, "g long, s2 long, place int", most=1 << 20), given


def _shared(t: pa.Table, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """The rows of the shingles that several sets have, each once."""
    many = np.repeat(size > 1, size)
    g, s2, place = (t[c].to_numpy()[many] for c in ("g", "s2", "place"))
    order = np.lexsort((s2, g))
    g, s2, place = g[order], s2[order], place[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (s2[1:] != s2[:-1])][: len(g)]
    g, s2, place = g[new], s2[new], place[new]
    same = g[1:] == g[:-1]
    many = (np.r_[same, False] | np.r_[False, same])[: len(g)]
    return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (g, s2, place)], names=["g", "s2", "place"])


def _preceded(t: pa.Table, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Each set's rows with the EARLIER shared shingles before each, 0 where there are fewer. Of different sets with one s2
    the places aren't known: their rows are as if they were the first."""
    s2, s, place, g, comp = (t[c].to_numpy() for c in ("s2", "s", "place", "g", "comp"))
    order = np.lexsort((place, s2))
    s, place, g, comp = s[order], place[order].copy(), g[order], comp[order]
    before, at = np.zeros((len(s), EARLIER), np.int64), np.arange(len(s)) - np.repeat(start, size)
    for k in range(EARLIER):
        far = np.flatnonzero(at > k)
        before[far, k] = g[far - k - 1]
    unsure = np.repeat(np.minimum.reduceat(s, start) != np.maximum.reduceat(s, start), size)
    before[unsure], place[unsure] = 0, 0
    raw = pa.array([x.tobytes() for x in before], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(comp), pa.array(place), raw], names=["g", "s", "comp", "place", "before"])


def beyond_bands(label: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) between components, whether or not they share a band: all of them that exist."""
    rows, given = _prefix_rows(docs, _frequent(docs, nodes.count()))
    shared = stored(_per_group(rows, ["g"], _shared, "g long, s2 long, place int"), "near-shared")
    given.destroy()
    own = nodes.select("s", "s2").join(label.withColumnRenamed("node", "s").hint("merge"), "s", "left").select("s", "s2", F.coalesce("label", "s").alias("comp"))
    placed = _per_group(shared.join(own.hint("merge"), "s2"), ["s2"], _preceded, "g long, s long, comp long, place int, before binary")
    now = stored(placed.select("g", F.lit(0).cast("long").alias("band"), F.lit(False).alias("rule"), "s", "comp", "place", "before"), "near-prefixes")
    return _compared(_in_blocks(now.join(_mains(now).hint("merge"), "g")), nodes, docs)


def _classes(docs: DataFrame, id_col: str, text_col: str, id_bits: int = 64) -> DataFrame:
    """(id, t, n, c) for each row: t the hash of its text, c its component, null for an empty set."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    feats, nodes = sets_of(stored(features(docs, id_bits), "near-features"))
    members = nodes.select("s", F.explode("bands").alias("band"))
    sizes = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "near-sizes")
    members = stored(members.join(sizes.hint("merge"), "band"), "near-members")

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("s", "band"), blocks).cast("int")
    shared = F.pmod(F.xxhash64("s", F.lit(1)), F.col("m")) < SHARED
    spread = members.withColumn("block", F.explode(F.when((blocks > 1) & shared, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))))
    spread = spread.join(nodes.select("s", "n", "sig").hint("merge"), "s").select("band", "block", "s", "n", "sig")
    pairs = _per_group(spread, ["band", "block"], _forests, "a long, b long").where("a < b").distinct()
    links = confirm(stored(pairs, "near-pairs"), nodes, docs)
    links = links.unionAll(between_components(members, components(links), nodes, docs, wide=False))
    label = components(links)
    rest = beyond_bands(label, nodes, docs)
    if not rest.isEmpty():
        label = components(links.unionAll(rest))

    rows = feats.select("id", "t", "n", "s").join(label.withColumnRenamed("node", "s").hint("merge"), "s", "left")
    return rows.select("id", "t", "n", F.coalesce("label", "s").alias("c"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row."""
    rows = _classes(docs, id_col, text_col, id_bits).select("id", "n", "c")
    full = rows.where("n > 0")
    first = stored(full.groupBy("c").agg(F.min("id").alias("component_id")), "near-first")
    full = full.join(first.hint("merge"), "c").select("id", "n", "component_id")
    out = full.unionAll(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """Of each component the rows of its smallest id (null last) and, of that id's texts, one; all columns unchanged. Rows
    with empty sets stay. once: of repeated rows of one id and text, one stays; they are dealt as the join deals them."""
    rows = _classes(docs, id_col, text_col)
    first = rows.where("n > 0").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "t")).alias("x")).select("x.id", "x.t")
    kept = first.unionAll(rows.where("n = 0").select("id", "t")).distinct()
    keys = [unused(docs.columns, x) for x in ("_null", "_kept", "_text")]

    def key(row: Column, t: Column) -> list[Column]:  # without nulls, so that the join's partitions are by these columns
        return [x.alias(k) for x, k in zip((row.isNull(), F.coalesce(row, F.lit(0)), t), keys, strict=True)]

    kept = stored(kept.select(*key(F.col("id").cast("long"), F.col("t"))), "near-kept")
    given = docs.select(*map(named, docs.columns), *key(named(id_col).cast("long"), F.xxhash64(named(text_col))))
    out = given.join(kept.hint("merge"), keys, "left_semi")
    if once:
        out = out.dropDuplicates([*keys, id_col, text_col])
    return out.select(*map(named, docs.columns))
