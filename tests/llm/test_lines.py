import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import line_dedup


def brute(rows):
    keys, docs = {}, []
    for n, r in enumerate(rows):
        lines = (r.text or "").split("\n")
        own = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        docs.append((r.doc_id, lines, own))
        for k in {k for k in own if len(k) >= 20}:
            keys.setdefault(k, []).append((n, r.doc_id))
    keep = {k: max((i for _, i in v if i is not None), default=None) for k, v in keys.items() if len(v) >= 3}
    out = Counter()
    for i, lines, own in docs:
        left = [x for x, k in zip(lines, own) if k not in keep or keep[k] == i]
        out[(i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_lines(documents, odd, none, bound):
    for df in (documents, odd, none):
        got = line_dedup.digest(line_dedup.dedup_lines(df, broadcast_bytes=bound, shard_keys=50))
        assert Counter(tuple(r) for r in got.collect()) == brute(df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 5000])
def test_index(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 2**63, (n, 2)).astype(np.uint64) * np.uint64(2)
    shards = [line_dedup.LineIndex.build(h[i::3], np.arange(n)[i::3] + 3, -np.arange(n)[i::3]) for i in range(3)]
    one = line_dedup.LineIndex([line_dedup.LineIndex.build(h, np.arange(n) + 3, -np.arange(n))])
    count, keep = one.probe(h)
    assert count.tolist() == list(range(3, n + 3)) and keep.tolist() == [-i for i in range(n)]
    assert not one.probe(h ^ np.uint64(1))[0].any() and len(shards) == 3
