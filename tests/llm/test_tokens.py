import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerloom.llm import token_count, token_store

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def awkward(n=400):
    rng = random.Random(3)
    return ["", "a", "a" * 3000, "ΑΣ ΟΔΟΣ. Σ", "İ é ½²", "x<|endoftext|>y <|startoftext|>", "it's DON'T they'll \x1c ok\u3000z", "foo\n \nbar", " \nfoo", "a  b", "tail \n", *("".join(rng.choice("aeb's tTΣ1 .!é\n 日<|>") for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_counts_equal_library():
    texts = awkward()
    want = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert token_count.WordCounter(WORD).texts(texts).tolist() == want
    assert token_count.WordCounter(WORD, remembered=3).texts(texts).tolist() == want


def test_every_character_counts_as_in_the_library():
    """All of Unicode: alone after a letter, and before one."""
    lib, own = Tokenizer.from_file(WORD), token_count.WordCounter(WORD)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xD7A4 <= c < 0x1F000 or c % 499 == 0)]
    texts = ["".join(f"a{chr(c)}b " for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    assert [own.normal(t).split() for t in texts] == [lib.normalizer.normalize_str(t).split() for t in texts]
    assert own.texts(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_count_tables(documents, odd, none):
    lib = Tokenizer.from_file(WORD)
    for df in (documents, odd, none):
        got = Counter(tuple(r) for r in token_count.count_tokens(df, WORD).collect())
        want = Counter()
        for r in df.collect():
            t = r.text or ""
            n = len(lib.encode(t, add_special_tokens=False).ids)
            want[(r.doc_id, len(t.encode()), n, n > 2048)] += 1
        assert got == want


def test_encoder_equals_library(documents):
    texts = awkward() + [r.text or "" for r in documents.collect()]
    lib = Tokenizer.from_file(BYTE)
    got = token_store.TextEncoder(BYTE, 0).texts(texts)
    got2 = token_store.TextEncoder(BYTE, 0, remembered=8).texts(texts)
    assert got == got2
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids + [0] for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_words_go_to_the_model_together():
    """Words that occur once cost no call each, whether or not marks follow."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß日Ω") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(w + rng.choice(["", "", ",", "...", "'", "|>"]) for w in words[i : i + 100]) for i in range(0, 3000, 100)]
    texts += ["one<|endoftext|>", "two <|endoftext|>", "", " ", "ab'll it's \n x"]
    own, calls = token_store.TextEncoder(BYTE, 0), []
    one = own.words.tokenize
    own.words.tokenize = lambda x: calls.append(x) or one(x)
    got = own.texts(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids + [0] for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert len(calls) < 100


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1 << 15, (1 << 15) + 5, 300_000])
def test_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50000).astype(np.uint16)
    coder = token_store.Coder(token_store.scaled(np.bincount(ids, minlength=1 << 16)))
    lengths = np.array([n // 2, n - n // 2])
    raw = token_store.write_file(coder, np.array([7, 9]), np.array([False, True]), lengths, ids)
    back = token_store.TokenFile(raw, coder)
    assert (back.tokens() == ids).all() and back.ids.tolist() == [7, 9] and back.nulls.tolist() == [False, True]
    if n > 1 << 15:  # one block alone
        assert (back.blocks([1])[0] == ids[1 << 15 : 2 << 15]).all()
    if n:
        bad = bytearray(raw)
        bad[-9] ^= 1
        with pytest.raises(ValueError):
            token_store.TokenFile(bytes(bad), coder)


def test_wide_vocabulary(spark, tmp_path):
    """Ids beyond 65,536 take four bytes."""
    tok = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70_000)}, unk_token="w1"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "wide.json"))
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.choice([3, 69_999, rng.randrange(70_000)])}" for _ in range(rng.randrange(2000)))) for i in range(40)]
    got = sorted(token_store.store_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "wide.json")).collect())
    want = [np.array([*tok.encode(t).ids, 0], "<u4") for _, t in rows]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()


def test_starts_over_several_files(spark):
    df = spark.range(300).selectExpr("id doc_id", "repeat('some words ', cast(id % 7 as int)) text")
    tokens = token_store.stored(token_store.token_ids(df, BYTE), "t")
    freq = token_store.frequencies(tokens)
    files = token_store.write_files(tokens, freq, file_ids=64, parts=3)
    got = sorted(token_store.read_files(files, freq).collect(), key=lambda r: r.id)
    assert files.count() > 20 and [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_scaled_keeps_rare_ids():
    f = token_store.scaled(np.r_[10**9, np.ones(60000, np.int64), 0])
    assert f.sum() == 1 << token_store.SCALE and f[1:-1].min() == 1 and f[-1] == 0


def test_store_tables(documents, odd, none):
    lib = Tokenizer.from_file(BYTE)
    for df in (documents, odd, none):
        got = sorted(token_store.store_and_read(df, BYTE).collect(), key=lambda r: r.start)
        want = Counter()
        for r in df.collect():
            ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
            want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        ids = [-1 if r.doc_id is None else r.doc_id for r in got]
        assert ids == sorted(ids)
