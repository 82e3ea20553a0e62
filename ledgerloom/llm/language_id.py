"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams (two to `LONGEST` bytes of lower-cased text) of labelled rows; the log-probability
matrix (buckets x languages, float32, 128 KB a language) is broadcast. Scoring hashes a batch of texts at once and sums
matrix rows text by text, `BLOCK` languages at a time.

The fit uses a bounded sample: about `sample` rows of each language, chosen by a hash of text and id, all rows where a language
has fewer; each counts with its whole text. Every language that a row names is learned. Predictions read whole texts of
all rows.

Defined cases: null text or a text without a letter gives `und` and score 0; an empty or unlabelled training table
gives `und` and 0 for all rows; ties go to the language that sorts first; rows with null language are not learned
from; repeated and null ids are scored row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import importable, map_chunks, named, ragged_arange, slices, stored, unused

BUCKETS, LONGEST, PIECE = 1 << 15, 4, 1 << 20
BLOCK = 64  # languages that are counted, collected or scored at once
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _LETTER.search(text)
    return bool(m) and (m.group().isalpha() or any(map(str.isalpha, text)))


def gram_buckets(raw: np.ndarray) -> list[np.ndarray]:
    """For n = 2 .. LONGEST, the bucket of the n-gram that begins at each byte (the last ones run into what follows)."""
    x = raw.astype(np.uint32)
    h, out = x + np.uint32(1), []
    for n in range(2, LONGEST + 1):
        h = h[:-1] * _STEP + x[n - 1 :]
        m = h ^ (h >> np.uint32(15))
        m *= np.uint32(0x2C1B3C6D)
        out.append((m >> np.uint32(32 - 15)).astype(np.uint32))
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each with a space before and LONGEST behind it, and where each begins. A text's n-grams begin at the space
    before it and at its bytes, and run into spaces only: they don't depend on the texts beside it."""
    raw = np.frombuffer(b" " + (b" " * LONGEST).join(texts) + b" " * LONGEST, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + LONGEST
    return raw, np.cumsum(lengths) - lengths


def fit(docs: DataFrame, train: Column, *, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, sample: int = 4000, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, matrix). Reads language counts, then a sample of the rows where `train` holds."""
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    draw = F.pmod(F.xxhash64(F.col(text_col) if key is None else key), F.lit(1 << 30)) / float(1 << 30)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample / r["count"])) for r in sizes], "lang string, share double")
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"), draw.alias("draw"))
    chosen = drawn.join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share")).select("lang", "text")

    def counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lang in set(names):
                if lang not in total and len(total) == BLOCK:
                    yield from counted(total)
                    total = {}
                own = [t for t, n in zip(texts, names, strict=True) if n == lang]
                for a, b in slices(np.fromiter(map(len, own), np.int64, len(own)), PIECE):
                    raw, starts = _joined([t.lower() for t in own[a:b]])
                    at = ragged_arange(starts, np.fromiter(map(len, own[a:b]), np.int64, b - a) + 1)
                    total[lang] = total.get(lang, 0) + sum(np.bincount(g[at], minlength=BUCKETS) for g in gram_buckets(raw))
        yield from counted(total)

    summed = importable(chosen).mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = summed if len(langs) <= BLOCK else stored(summed, "language-grams")
    matrix = np.empty((BUCKETS, len(langs)), np.float32, order="F")
    for a in range(0, len(langs), BLOCK):
        some = langs[a : a + BLOCK]
        got = (summed if len(langs) <= BLOCK else summed.where(F.col("lang").isin(some))).toPandas()  # at most BLOCK x BUCKETS rows
        counts = np.zeros((BUCKETS, len(some)))
        counts[got["bucket"].to_numpy(), got["lang"].map({x: i for i, x in enumerate(some)}).to_numpy(np.int64)] = got["n"]
        matrix[:, a : a + BLOCK] = np.log((counts + alpha) / (counts.sum(0) + alpha * BUCKETS))
    return langs, matrix


def score(texts: list[bytes], matrix: np.ndarray) -> np.ndarray:
    """Mean log-probability of each text's n-grams, by language. Long texts are summed piece by piece."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), matrix.shape[1]))
    for a, b in slices(lengths, PIECE):
        raw, starts = _joined([t.lower() for t in texts[a:b]])
        total = int(starts[-1] + lengths[b - 1]) + 1
        edges = np.stack([starts, starts + lengths[a:b] + 1], 1).ravel()[:-1]  # a text, what is between, a text, ...
        for at in range(0, total, 4 * PIECE):  # several steps only for one long text
            stop = min(at + 4 * PIECE, total)
            for grams in gram_buckets(raw[at : stop + LONGEST - 1]):
                for k in range(matrix.shape[1]):
                    out[a:b, k] += np.add.reduceat(matrix[:, k][grams[: stop - at]].astype(np.float64), edges if total <= 4 * PIECE else [0])[::2]
    return out / (lengths + 1)[:, None] / (LONGEST - 1)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns `keep`, then lang_pred and score: the posterior of the best language under a flat prior, with the
    log-likelihoods of at most 40 n-grams so that long texts don't all give 1."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix)))

    def work(batch: pa.RecordBatch) -> dict:
        langs, matrix = shared.value
        out = {c: batch[c] for c in kept}
        texts = batch[helper].to_pylist()
        fine = np.array([bool(langs) and has_letter(t) for t in texts], bool)
        names, value = np.array(["und"] * len(texts), object), np.zeros(len(texts))
        at = np.flatnonzero(fine)
        if len(at):
            chosen = [texts[i].encode() for i in at]
            n = np.minimum([len(t) for t in chosen], 40)
            best, top, odds = np.zeros(len(at), np.int64), np.full(len(at), -np.inf), np.zeros(len(at))
            for a in range(0, len(langs), BLOCK):
                ll = score(chosen, matrix[:, a : a + BLOCK])
                high = np.maximum(top, ll.max(1))
                best = np.where(high > top, a + ll.argmax(1), best)
                odds = odds * np.exp((top - high) * n) + np.exp((ll - high[:, None]) * n[:, None]).sum(1)
                top = high
            names[at] = np.array(langs, object)[best]
            value[at] = 1 / odds
        return out | {"lang_pred": names, "score": value}

    kept = list(dict.fromkeys([id_col, *keep]))
    helper = unused(kept, "__text")
    cut = docs.select(*map(named, kept), named(text_col).alias(helper))
    schema = StructType([*cut.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_chunks(cut, work, schema, column=helper)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
