"""Token counts by rank-synchronous array merging.

Texts are normalised and cut into pre-tokens; the distinct pre-tokens of a batch are held as one ragged numpy array of
symbol ids. In each round every sequence finds its lowest-ranked adjacent pair and merges all occurrences of it at
once, leftmost first; sequences without a mergeable pair leave the array. The symbols that survive are the tokens.

Every merge of the supported vocabularies makes a symbol of its own, so a pair that a merge creates always has a
higher rank, and merging all occurrences at once equals merging them one by one.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a text without pre-tokens has 0 tokens; repeated rows
and repeated or null ids are counted row by row; columns beside id and text are ignored; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_symbols, hold, map_chunks

_NONE = np.int32(2**31 - 1)
#: Unicode white space as the vocabulary's patterns use it (without the separators \x1c-\x1f). A fixed value.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATE = re.compile("[\u0378-\U0010ffff]").search  # the first code point that is unassigned, and all beyond


class PairMerger:
    """Counts the symbols of byte-level BPE words, many words at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if len({a + b for a, b in merges}) != len(merges):
            raise ValueError("two merges make the same symbol; synchronous merging needs one merge a symbol")
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Symbols of each non-empty word after all merges."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        ids = np.arange(len(words))
        starts = ends + 1 - lengths
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
        if len(sym) > 1:
            rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends] = _NONE
        while len(ids):
            low = np.minimum.reduceat(rank, starts)
            busy = low != _NONE
            if not busy.all():
                out[ids[~busy]] = lengths[~busy]
                keep = np.repeat(busy, lengths)
                sym, rank = sym[keep], rank[keep]
                ids, lengths, low = ids[busy], lengths[busy], low[busy]
                starts = np.cumsum(lengths) - lengths
                if not len(ids):
                    break
            hit = rank == np.repeat(low, lengths)
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # within a run every second pair merges
            parity = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[parity % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            gone = np.add.reduceat(~keep, starts)
            place = np.cumsum(keep) - 1
            sym, rank = sym[keep], rank[keep]
            lengths = lengths - gone
            starts = np.cumsum(lengths) - lengths
            touched = place[at]
            fresh = np.unique(np.r_[touched, touched[touched > 0] - 1])
            fresh = fresh[fresh < len(sym) - 1]
            rank[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
            rank[starts + lengths - 1] = _NONE
        return out


class WordCounter(PairMerger):
    """Token counts of whole texts for a lower-casing word vocabulary."""

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.find = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+").findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, int] = {}
        self.remembered = remembered

    def normal(self, text: str) -> str:
        """As the library normalises. Python's tables do the same for all characters that they know; a text with another
        one goes to the library, whose tables may be newer."""
        if text.isascii():
            return text.lower()
        if _LATE(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        if self.cut and any(x in text for x in self.special):
            parts = self.cut(text)
            return [w for p in parts for w in self.find(self.normal(p))], len(parts) - 1
        return self.find(self.normal(text)), 0

    def texts(self, texts: list[str]) -> np.ndarray:
        cut = [self.pieces(t) for t in texts]
        fresh = list(set().union(*(w for w, _ in cut)).difference(self.known))
        rest: dict[str, int] = {}
        if fresh:
            counts = self.count([w.encode() for w in fresh]).tolist()
            if len(self.known) + len(fresh) > self.remembered:
                self.known.clear()
                fresh = list(set().union(*(w for w, _ in cut)))
                counts = self.count([w.encode() for w in fresh]).tolist()
            for w, n in zip(fresh, counts, strict=True):
                (self.known if len(w) <= 64 else rest)[w] = n
        get = self.known.__getitem__ if not rest else lambda w: self.known.get(w) or rest[w]
        return np.array([sum(map(get, w)) + n for w, n in cut], np.int64)


@lru_cache(maxsize=4)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; one narrow pass, nothing is shuffled or broadcast."""

    def count(batch: pa.RecordBatch) -> dict:
        hold(__name__, _counter.cache_clear)
        texts = [t or "" for t in batch["text"].to_pylist()]
        n = _counter(path).texts(texts)
        return {"id": batch["id"], "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit}

    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_chunks(cut, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
