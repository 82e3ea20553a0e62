import itertools
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import common, components, near_dedup


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() if len(v) > 1 for k, a in enumerate(v) for b in v[k + 1 :]}
    for a, b in pairs:
        if find(a) != find(b):
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(s), low.get(find(i)), r.doc_id == low.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets)))


def test_near_tables(documents, odd, none):
    for df in (documents, odd, none):
        assert Counter(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == brute(df.collect())


def chains(seed, n):
    """Near copies of one text with many degrees of change, and texts that share a passage."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(14)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        out.append((i, " ".join(t)))
    for i in range(n, n + 60):
        out.append((i, " ".join(base[:60] + [f"y{rng.randrange(9999)}" for _ in range(rng.randrange(10, 90))])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("block", [512, 20])
def test_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    df = spark.createDataFrame(chains(block, 400), "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == brute(df.collect())


def test_equal_identities_of_different_sets(documents):
    rows = documents.limit(120)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(rows, id_bits=3).collect()) == brute(rows.collect())


def test_wide_bands_grow_with_their_members(spark, monkeypatch):
    """Unlike texts that share a passage, and some near copies among them: rows grow with the members, links are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(100)]
    rows = [(i, " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(60)])) for i in range(3000)]
    rows += [(3000 + i, " ".join([*rows[3 * i][1].split()[:-6], *[f"z{rng.randrange(10**6)}" for _ in range(4)]])) for i in range(300)]
    for n in (1000, 3000):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(4)
        docs = df.selectExpr("doc_id id", "xxhash64(text) t", "cast(text as binary) text")
        _, nodes = near_dedup.sets_of(near_dedup.stored(near_dedup.features(docs), "f"))
        members = nodes.selectExpr("s", "explode(bands) band")
        members = members.join(members.groupBy("band").count().withColumnRenamed("count", "m"), "band")
        wide = members.where("m > 64").count()
        rows_met = near_dedup.meetings(members.where("m > 64"), spark.createDataFrame([], "node long, label long"), nodes).count()
        assert wide > 2 * n and rows_met < 2 * wide  # blocks of pairs alone would be wide * (m / 64)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3000 + i] == got[3 * i] == 3 * i for i in range(300)) and sum(i == c for i, c in got.items()) == 3000


def test_refined_bands_lose_no_link(spark, monkeypatch):
    """Where refining parts most pairs near the threshold, all that share a wide band are linked all the same."""
    refined = near_dedup._refined
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "_refined", lambda rows, level: refined(rows, level).where("pmod(g, 16) = 0"))
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(100)]
    rows = [(i, " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(40)])) for i in range(500)]
    rows += [(500 + i, " ".join([*rows[i][1].split()[:-17], *[f"z{rng.randrange(10**6)}" for _ in range(16)]])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("doc_id id", "xxhash64(text) t", "cast(text as binary) text")
    _, nodes = near_dedup.sets_of(near_dedup.stored(near_dedup.features(docs), "f"))
    members = nodes.selectExpr("s", "explode(bands) band")
    members = near_dedup.stored(members.join(members.groupBy("band").count().withColumnRenamed("count", "m").where("m > 64"), "band"), "m")
    node = {r.id: r.s for r in nodes.select("rep.id", "s").collect()}
    bands = {}
    for r in members.collect():
        bands.setdefault(r.s, set()).add(r.band)
    pairs = [(node[i], node[500 + i]) for i in range(200) if bands.get(node[i], set()) & bands.get(node[500 + i], set())]
    sets = [shingles(t) for _, t in rows]
    assert all(100 * len(sets[i] & sets[500 + i]) >= 75 * len(sets[i] | sets[500 + i]) for i in range(200)) and len(pairs) > 150
    found = near_dedup.between_components(members, spark.createDataFrame([], "node long, label long"), nodes, docs)
    assert {tuple(sorted(p)) for p in pairs} == {tuple(sorted((r.u, r.v))) for r in found.collect()}


def test_workers_release_what_sets_need():
    near_dedup.shingle_sets([b"a b c d e f"])
    assert near_dedup._powers.cache_info().currsize == 1
    common.hold("another operator")
    assert near_dedup._powers.cache_info().currsize == 0


def test_sets_and_estimates():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 3000))).encode() for _ in range(40)] + [b"", None, b"a b", b"A  B\n", b"a b c d e"]
    sets = near_dedup.shingle_sets(texts)
    assert [len(x) for x in sets] == [len(shingles((t or b"").decode())) for t in texts]
    assert sets[-3].tolist() == sets[-2].tolist()
    base = np.unique(np.random.default_rng(1).integers(0, 2**63, 900).astype(np.uint64))
    low = np.stack([near_dedup.minima(base[:600]), near_dedup.minima(base[60:660])])
    sig = near_dedup.pack(low).view("<u8")
    assert abs(near_dedup.similarity(sig[0], sig[1]) - 540 / 660) < 0.12


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(420)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5300)]
    label = {}
    for u, v in edges:
        label.setdefault(u, u), label.setdefault(v, v)
    while True:
        moved = False
        for u, v in edges:
            low = min(label[u], label[v])
            moved |= label[u] != low or label[v] != low
            label[u] = label[v] = low
        if not moved:
            break
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()}
    assert got == {k: v for k, v in label.items() if k != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize(("few", "sample", "frequent"), [(64, 1 << 14, 1 << 18), (3, 100, 5)])
def test_pairs_without_a_common_band_are_linked(spark, monkeypatch, few, sample, frequent):
    """Bands that no two sets share: all links are found all the same, whatever the order of shingles."""
    features = near_dedup.features
    apart = "transform(bands, x -> xxhash64(x, s, s2))"
    monkeypatch.setattr(near_dedup, "features", lambda docs, id_bits: features(docs, id_bits).selectExpr("id", "t", "n", "s", "s2", f"{apart} bands", "sig"))
    for name, value in (("FEW", few), ("SAMPLE", sample), ("FREQUENT", frequent), ("BLOCK", 30)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(few)
    rows = chains(few, 150) + [(300 + i, t) for i, t in enumerate(["a b c d e f g", "A b c d e f g h", "b c d e f g", "a b", "A  B\n", "", None, "b a"])]
    for i in range(60):  # just at the threshold, and just under it
        t = [f"v{rng.randrange(10**6)}" for _ in range(88)]
        rows += [(1000 + i, " ".join(t)), (2000 + i, " ".join(t[:76] + [f"u{rng.randrange(10**6)}" for _ in range(12 + i % 2)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(df.collect())
    assert sum(kept for *_, kept in want.elements()) < 260
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == want


def test_rows_of_prefixes_grow_with_their_members(spark, monkeypatch):
    """Changed copies of one text, none within the threshold: four times the members give no sixteen times the rows."""
    rng = random.Random(10)
    made = {}

    def counted(df, label, **options):
        out = stored(df, label, **options)
        made.setdefault(label, []).append(out.count())
        return out

    stored = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", counted)
    rows, counts = [], {}
    for places in rng.sample(list(itertools.combinations(range(4, 116, 8), 3)), 48):
        for family in range(4):
            t = [f"f{family}w{i}" for i in range(120)]
            for at in places:
                t[at] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(t)))
    for n in (48, 192):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(4).selectExpr("doc_id id", "xxhash64(text) t", "cast(text as binary) text")
        _, nodes = near_dedup.sets_of(stored(near_dedup.features(docs), "f"))
        made.clear()
        assert near_dedup.beyond_bands(spark.createDataFrame([], "node long, label long"), nodes, docs).isEmpty()
        counts[n] = {k: sum(v) for k, v in made.items()}
    assert counts[192]["near-shared"] > 800
    assert all(v <= 8 * max(counts[48][k], 64) for k, v in counts[192].items())


def test_places_of_sets_with_one_name_are_not_used():
    """What precedes a shared shingle is known only where the 64 bits name one set."""
    import pyarrow as pa

    t = pa.table({"s2": [1, 1, 1, 2, 2, 2], "s": [7, 7, 7, 8, 9, 8], "place": [5, 0, 2, 1, 0, 3], "g": [50, 51, 52, 60, 61, 62], "comp": [7, 7, 7, 8, 9, 8]})
    got = near_dedup._preceded(t, np.array([0, 3]), np.array([3, 3])).to_pylist()
    assert [(r["g"], r["place"], np.frombuffer(r["before"], np.int64).tolist()) for r in got[:3]] == [(51, 0, [0, 0, 0, 0]), (52, 2, [51, 0, 0, 0]), (50, 5, [52, 51, 0, 0])]
    assert {r["g"] for r in got[3:]} == {60, 61, 62} and all(r["place"] == 0 and not any(r["before"]) for r in got[3:])
