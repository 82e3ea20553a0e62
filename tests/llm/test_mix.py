import math
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import source_mix


def goals(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def words(t):
    return len((t or "").translate({i: " " for i in (9, 10, 11, 12, 13, 32)}).split(" ")) - (t or "").translate({i: " " for i in (9, 10, 11, 12, 13, 32)}).split(" ").count("")


def test_mix(spark, documents, odd, none, sf):
    more = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    for df in (documents, odd, more):
        got = source_mix.mix(df).collect()
        rows = df.collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r.source] += words(r.text)
        want = goals(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
            taken[r.source] += r.taken
        if df is more:
            for s, t in taken.items():
                assert abs(t - want[s]) <= 0.01 * want[s], (s, t, want[s])
    assert source_mix.mix(none).collect() == []


def test_reruns_agree_and_carry(spark, documents):
    a = Counter((r.doc_id, r.taken) for r in source_mix.mix(documents).collect())
    b = source_mix.mix(documents.repartition(7), carry=True).collect()
    assert a == Counter((r.id, r.taken) for r in b)
    assert all(r["row"].doc_id == r.id for r in b)


def test_weighted_rows_are_likelier(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    got = source_mix.mix(df, weights=(1.0, 4.0), weight=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).collect()
    low = [r for r in got if r.source == "a"]
    heavy = sum(r.copies for r in low if r.doc_id % 4 < 2)
    light = sum(r.copies for r in low if r.doc_id % 4 >= 2)
    assert 2.3 < heavy / light < 3.8 and abs(sum(r.taken for r in low) - 8000) <= 20


@pytest.mark.parametrize("tail", [256, 3])
def test_a_very_long_document_at_the_cut_leaves_no_gap(spark, tail):
    rows = [(i, "w " * (8 + i % 5), "a") for i in range(3000)] + [(3000, "w " * 30000, "a")]
    rows += [(4000 + i, "w " * 100, "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    for seed in range(6 if tail > 3 else 2):
        got = [r for r in source_mix.mix(df, weights=(3.0, 7.0), seed=seed, tail=tail).collect() if r.source == "a"]
        assert len(got) == 3001 and all(r.copies in (0, 1) for r in got)
        short = min(r["size"] for r in got if not r.copies)
        assert abs(sum(r.taken for r in got) - got[0].target) <= short / 2 + 1, seed


def selection(rows, target, most=3.0):
    """Copies of one source's rows (h, size, w), read in the order of their ranks."""
    words = defaultdict(int)
    for _, size, w in rows:
        words[w] += size
    level, before = None, 0
    for w in sorted(words, reverse=True):
        mass = sum(n * x for x, n in words.items() if x <= w)
        c = (target - most * before) / mass if mass else None
        if c is not None and c * w <= most:
            level = c
            break
        before += words[w]
    out, ranks = [], []
    for n, (h, size, w) in enumerate(rows):
        hope = round(most if level is None else min(most, level * w), 12) if words[w] else 0.0
        whole = math.floor(hope)
        out.append(whole)
        lam = min(max(hope - whole, 1e-9), 1 - 1e-9)
        u = (h % 2**52 + 0.5) / 2**52
        q = (u / (1 - u)) / (lam / (1 - lam))
        if whole < most and size:
            ranks.append((q / (1 + q), h, size, n))
    room = math.floor(target - sum(k * size for k, (_, size, _) in zip(out, rows)) + 0.5)
    skipped = []
    for z, h, size, n in sorted(ranks):
        if size <= room:
            out[n] += 1
            room -= size
        else:
            skipped.append((size, z, h, n))
    if skipped and min(skipped)[0] < 2 * room:
        out[min(skipped)[3]] += 1
    return out


@pytest.mark.parametrize(("weight", "tail", "which"), [(source_mix.by_length, 256, "documents"), (None, 2, "odd")])
def test_selection_equals_brute_force(spark, request, weight, tail, which):
    from pyspark.sql import functions as F

    for df in (request.getfixturevalue(which),):
        by = defaultdict(list)
        for r in df.select("doc_id", "source", "text", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect():
            size = words(r.text)
            w = 1.0 if weight is None else 2.0 ** (math.floor(8 * math.log2(math.log2(size + 2)) + 0.5) / 8)
            by[r.source].append((r.doc_id, r.h, size, w))
        got = source_mix.mix(df, weight=weight, tail=tail).collect()
        goal = {r.source: r.target for r in got}
        want = Counter()
        for source, rows in by.items():
            copies = selection([x[1:] for x in rows], goal[source])
            want.update((i, source, size, n) for (i, _, size, _), n in zip(rows, copies))
        assert Counter((r.doc_id, r.source, r["size"], r.copies) for r in got) == want


def test_long_documents_are_likelier(spark):
    df = spark.createDataFrame([(i, "w " * (4 if i % 2 else 64), "ab"[i // 3000]) for i in range(6000)], "doc_id long, text string, source string")
    got = [r for r in source_mix.mix(df, weights=(1.0, 4.0), weight=source_mix.by_length).collect() if r.source == "a"]
    long, short = (sum(r.copies for r in got if r["size"] == n) for n in (64, 4))
    assert 1.9 < long / short < 2.8  # log2 66 / log2 6 is 2.3
    assert abs(sum(r.taken for r in got) - got[0].target) <= 4
