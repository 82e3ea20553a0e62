import random
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_mix import goals, words
from test_near import brute as near_brute
from tokenizers import Tokenizer

from ledgerloom.llm import near_dedup
from ledgerloom.llm.common import stored


def test_stages(spark, documents, sf):
    docs = documents
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        after = out.collect()
        if name != "tokens":
            assert out.columns == documents.columns
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "language":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert all(not any(c.isalpha() for c in r.text or "") for r in before if r.doc_id in gone)
        elif name == "near_duplicates":
            assert Counter(r.doc_id for r in after) == Counter(i for i, _, _, kept in near_brute(before) if kept)
        elif name == "benchmark":
            gone = {r.doc_id for r in before} - {r.doc_id for r in after}
            assert {r.doc_id for r in before if any(t in (r.text or "") for t in bench)} <= gone
            assert len(gone) < 0.1 * len(before)
        elif name == "mixing":
            sizes, taken, times = defaultdict(int), defaultdict(int), Counter(r.doc_id for r in after)
            for r in before:
                sizes[r.source] += words(r.text)
            for r in after:
                taken[r.source] += words(r.text)
            assert max(times.values()) <= 3
            want = goals(sizes)
            largest = max(words(r.text) for r in before)
            assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
        else:
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = {r.doc_id: np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in before}
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == Counter((r.doc_id, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())) for r in before)
        docs = spark.createDataFrame(after, out.schema)


def test_run_equals_stages(spark, sf, documents):
    docs = documents
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert Counter(tuple(r) for r in P.run(spark, sf).collect()) == Counter(tuple(r) for r in docs.collect())


def test_near_duplicates_of_wide_bands(spark, monkeypatch):
    """Pairs at the threshold among unlike texts that share a passage: one of each stays, even if refining parts all."""
    refined = near_dedup._refined
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "_refined", lambda rows, level: refined(rows, level).where("false"))
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(160)]
    rows = [(i, " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(40)])) for i in range(250)]
    rows += [(250 + i, " ".join([*rows[i][1].split()[:-27], *[f"z{rng.randrange(10**6)}" for _ in range(27)]])) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter(i for i, _, _, kept in near_brute(docs.collect()) if kept)
    assert len(want) == 250
    assert Counter(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == want


def test_near_duplicates_without_ids_of_their_own(spark):
    """One row of a group of near copies stays, even if their ids are null or also another text's."""
    text = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcd"]
    near = [f"{t} more" for t in text]
    rows = [(None, text[0]), (None, near[0]), (1, text[1]), (2, near[1]), (2, text[2]), (None, near[2]), (3, text[3]), (3, near[3]), (3, near[3]), (None, None), (None, ""), (4, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in P.near_duplicates(spark, df, "").collect()]
    groups = Counter(text.index(t.removesuffix(" more")) for _, t in got if t and t.strip())
    assert groups == {0: 1, 1: 1, 2: 1, 3: 1} and {(1, text[1]), (2, text[2]), (None, None), (None, ""), (4, " ")} <= set(got) and len(got) == 7


ODD_NAMES = ("my col", "a.b", "lang_pred", "score", "__text", "row", "_kept", "_copy", "copies", "leak_text", "h", "w", "`q`")


def test_odd_rows(spark, odd, none, sf, tmp_path):
    named = odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(ODD_NAMES) if c != "row"])
    for df in (named, none):
        docs = df
        for name, stage in P.STAGES:
            docs = stage(spark, docs, sf)
            if name != "tokens":
                assert docs.columns == df.columns
        got = docs.collect()
        assert len(got) > 3 if df is named else got == []


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_stored_leaves_no_shuffle_files(spark):
    """What a write has shuffled is deleted when it ends, not when the driver's memory is collected."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), shuffle_files(spark)
    counts = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count(), "t")
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and counts.count() == 7 and spark.conf.get(setting) == was


def test_repeated_rows_stay_once_without_another_shuffle(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z q w e"), (None, "x y z q w e"), (0, "k l m n b v"), (2, None), (2, None), (3, "A B c d e f"), (0, None)]
    out = P.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert str(out._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 2  # of documents, and of what is kept
    assert sorted(map(tuple, out.collect()), key=repr) == [(0, "k l m n b v"), (0, None), (1, "a b c d e f"), (2, None), (None, "x y z q w e")]
