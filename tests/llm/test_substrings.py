import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import substring_dedup as S


def brute(rows, length=400):
    seen = Counter()
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows]
    for _, t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]])
        out[(i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def check(df, **kw):
    assert Counter(tuple(r) for r in S.digest(S.drop_repeats(df, **kw)).collect()) == brute(df.collect(), kw.get("length", 400))


def test_tables(documents, odd, none):
    for df in (documents, odd, none):
        check(df)


def test_anchors_are_the_leftmost_least():
    rng = np.random.default_rng(3)
    for n, span in ((50, 1), (50, 7), (64, 8), (300, 41), (41, 41)):
        x = rng.integers(0, 9, n).astype(np.uint64)
        want = [i + int(np.argmin(x[i : i + span])) for i in range(n - span + 1)]
        assert S.leftmost_least(x, span).tolist() == want


@pytest.mark.parametrize("bucket", [256, 3])
def test_planted(spark, bucket):
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, edge, tiny = junk(700), junk(400), junk(399)
    docs = []
    for i in range(40):
        docs.append((i, junk(rng.randrange(300)) + rng.choice([shared, edge, tiny, shared[100:], shared[:500], shared + edge]) + junk(rng.randrange(300))))
    docs += [(50, "ab" * 900), (51, "x" * 401), (52, "x" * 400), (53, "y" * 400), (54, shared + junk(50) + shared), (55, junk(1200)), (None, junk(500)), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(df, bucket=bucket)
    check(df, bucket=bucket, length=64)
    check(df, bucket=bucket, block_bytes=2000)


@pytest.mark.parametrize("bucket", [1 << 21, 7])
def test_suffix_order(bucket):
    rng = np.random.default_rng(bucket)
    for text in (rng.integers(97, 99, 900).astype(np.uint8), np.tile(rng.integers(97, 123, 37).astype(np.uint8), 30), np.full(500, 97, np.uint8), rng.integers(0, 256, 300).astype(np.uint8)):
        raw = text.tobytes()
        at = np.flatnonzero(rng.random(len(text)) < 0.7)
        got = S.suffix_order(raw, at, 100, bucket).tolist()
        pad = raw + bytes(200)
        assert sorted(got) == at.tolist()
        keys = [pad[i : i + 100] for i in got]
        assert keys == sorted(keys)


def test_cover():
    for r in range(3):
        v, cover = S.difference_cover(r)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) == 6 * r + 4
