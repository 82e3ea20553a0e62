import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import language_id as L
from ledgerloom.llm.registry import op9_language_id


def test_held_out_accuracy(spark, documents, sf):
    truth = {r.doc_id: (r.lang, r.text) for r in documents.collect()}
    got = op9_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in truth[r.doc_id][1] or ""):
            assert r.lang_pred == "und"
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in out) >= 0.95 * len(out)


def test_odd_rows(odd, none):
    langs, matrix = L.fit(odd, F.lit(True))
    assert langs == ["de", "en", "es", "fr"]
    got = L.predict(odd, langs, matrix).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == by[10] == "und" and by[11] == "en"
    assert {r.lang_pred for r in L.predict(odd, *L.fit(none, F.lit(True))).collect()} == {"und"}
    assert L.predict(none, langs, matrix).collect() == []


def test_long_text_equals_pieces():
    import numpy as np

    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(L.BUCKETS, 3)).astype(np.float32)
    text = bytes(rng.integers(97, 123, 5 << 20).astype(np.uint8))
    whole = L.score([text], matrix)
    raw = np.frombuffer(b" " + text + b" " * L.LONGEST, np.uint8)
    want = sum(matrix[g[: len(text) + 1]].astype(float).sum(0) for g in L.gram_buckets(raw)) / (len(text) + 1) / (L.LONGEST - 1)
    assert np.allclose(whole[0], want)


def test_rare_languages_are_learned(spark):
    import numpy as np

    name = lambda k: f"l{k:03d}"
    text = lambda k: " ".join(chr(0x4E00 + 40 * k + j) * 3 for j in range(8))
    rows = [(k * 10 + i, text(k), name(k)) for k in range(150) for i in range(1 + (k % 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    langs, matrix = L.fit(docs, F.lit(True))
    assert langs == [name(k) for k in range(150)] and matrix.shape == (L.BUCKETS, 150)
    got = L.predict(docs, langs, matrix, keep=["lang"]).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)
    ll = L.score([text(7).encode()], matrix)[0]
    want = 1 / np.exp((ll - ll.max()) * 40).sum()
    assert all(np.isclose(r.score, want) for r in got if r.lang == name(7))


def test_against_brute_force(spark, documents, odd):
    """Counting and scoring n-gram by n-gram, text by text."""
    import math
    from collections import Counter, defaultdict

    def buckets(text):
        raw = b" " + text.encode().lower() + b" " * L.LONGEST
        for n in range(2, L.LONGEST + 1):
            for i in range(len(text.encode()) + 1):
                h = raw[i] + 1
                for x in raw[i + 1 : i + n]:
                    h = (h * 0x9E3779B1 + x) % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                yield h >> 17

    docs = documents.select("doc_id", "text", "lang").where("length(text) < 1500").limit(60).unionAll(odd.select("doc_id", "text", "lang").where("text is null or length(text) < 1500"))
    rows = docs.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.lang is not None and r.text is not None and r.doc_id is not None and r.doc_id % 3:
            counts[r.lang].update(buckets(r.text))
    langs = sorted(counts)
    logs = {x: (lambda c, total: lambda g: math.log((c[g] + 0.5) / total))(counts[x], sum(counts[x].values()) + 0.5 * L.BUCKETS) for x in langs}
    got_langs, matrix = L.fit(docs.repartition(3), F.col("doc_id") % 3 != 0)
    assert got_langs == langs
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in L.predict(docs.repartition(2), got_langs, matrix).collect())
    want = Counter()
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            want[(r.doc_id, "und", 0.0)] += 1
            continue
        grams, size = list(buckets(r.text)), len(r.text.encode())
        ll = {x: sum(map(logs[x], grams)) / (size + 1) / (L.LONGEST - 1) for x in langs}
        best = max(langs, key=lambda x: ll[x])
        want[(r.doc_id, best, round(1 / sum(math.exp((v - ll[best]) * min(size, 40)) for v in ll.values()), 4))] += 1
    assert got == want
