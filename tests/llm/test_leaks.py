import random

import numpy as np
import pytest

from ledgerloom.llm import decontaminate as D


def best(item, text):
    """Fewest edits of item against any part of text."""
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(cost[j] + (c != x), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return min(cost)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcdef ")
        elif kind == 1:
            s.insert(i, rng.choice("abcdef"))
        elif len(s) > 5:
            del s[i]
    return "".join(s)


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "ti", "re", "so", "el", "qu"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(3, 30))) for i in range(12)] + [(12, None), (13, ""), (14, "an"), (15, "Ça, c'est DÉJÀ vu: l'été à Paris!")]
    docs = [(0, None), (1, ""), (2, text(200)), (3, "ÇA c est déjà -- vu l été à  paris")]
    for i in range(4, 60):
        item = items[rng.randrange(12)][1]
        docs.append((i, text(rng.randrange(30)) + " " + edited(rng, item, rng.randrange(0, max(1, len(item) // 9))) + " " + text(rng.randrange(30))))
    docs.append((60, items[0][1][:40]))
    docs.append((61, items[0][1][40:]))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    index = D.Items([(t or "").encode() for _, t in items], 10, 0.08)
    for d, t in docs:
        plain = D.normal((t or "").encode())
        for (i, _), item, k in zip(items, index.texts, index.k.tolist()):
            if len(item) >= 10 and (e := best(item, plain)) <= k:
                want[d, i] = e
    for block in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r.edits for r in D.find_leaks(df, bench, block_bytes=block).collect()}
        assert got == want
        kept = {r.doc_id for r in D.drop_leaks(df, bench, block_bytes=block).collect()}
        assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert (3, 15) in want and len(want) > 20


@pytest.mark.parametrize("edits", range(5))
def test_align(edits):
    rng = random.Random(edits)
    item = "".join(rng.choice("abcd") for _ in range(60))
    text = "x" * 7 + edited(rng, item, edits) + "y" * 9
    got, _ = D.align(np.frombuffer(item.encode(), np.uint8), np.frombuffer(text.encode(), np.uint8), -10, 40)
    assert got == best(item, text)


def test_tables(spark, documents, odd, none, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.item_id: r.text for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents, bench).collect()}
    exact = {(r.doc_id, i) for r in documents.collect() for i, t in texts.items() if t in (r.text or "")}
    assert exact <= got
    assert D.find_leaks(none, bench).collect() == [] and D.find_leaks(odd, none.selectExpr("doc_id item_id", "text")).collect() == []
    assert D.drop_leaks(odd, bench).count() == odd.count() and D.drop_leaks(odd, bench).schema == odd.schema
    assert D.drop_leaks(odd, none.selectExpr("doc_id item_id", "text")).count() == odd.count()
