"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

Texts are encoded with the tokenizers library, an end id is appended to each, and ids are kept in ascending id order of
the documents. One frequency table, counted over all ids and scaled to 2**20, is shared by all files. A file holds the
ids of some consecutive documents as independent blocks; a block's ids are dealt to `LANES` interleaved coder states,
so a block is coded step by step over all lanes and many blocks are coded at once as numpy arrays.

File format (little-endian): the magic, then a header of 8-byte integers (version, lanes, ids a block, CRC of the
frequency table, documents, ids, blocks); the documents' ids (8 bytes) and whether each is null (1 byte) and its number
of tokens (4 bytes); a checkpoint a block (offset of its words and their number, CRC of the words, CRC of its ids, each 8 bytes,
then the final state of each lane, 8 bytes); all blocks' 4-byte words; and the CRC of all that precedes. A block needs
only its checkpoint, its words and the table, so blocks can be decoded in any order or in parallel.

Files are rows of a table (part, seq, before, n_ids, payload) that Spark writes to the shared folder: tasks that are lost are
written again by others, and no executor's own disk is used. `payload` is the file, byte for byte; `before` counts the
ids of the part's earlier files, so that only one number for each part is shared to know where documents start.

Ids are kept in 2 bytes while the vocabulary has at most 65,536, in 4 bytes beyond; it may have up to 2**20.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of equal or null ids are ordered by
their tokens; an empty table gives none; other columns are ignored. Ids of documents are integers.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_symbols, hold, importable, ragged_arange, slices, stored

MAGIC, VERSION, LANES, BLOCK, SCALE = b"RANSIDS1", 1, 64, 1 << 15, 20
_U = np.uint64
_LOW = _U(1 << 31)


class _Whole(Exception):
    """The text must be encoded as a whole."""


def kind_of(size: int) -> str:
    """How ids of a vocabulary are kept."""
    if size > 1 << SCALE:
        raise ValueError(f"a vocabulary of {size} ids is over {1 << SCALE}")
    return "<u2" if size <= 1 << 16 else "<u4"


class _Words:
    """Ids of a piece that follows `before`, by the library's model. Pieces of letters are one pre-token as they are;
    others of common characters are cut by the byte-level pattern; the rest go through the library's whole chain."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.tokenize, self.chars = self.tok.model.tokenize, dict(enumerate(byte_symbols()))
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.common = re.compile("[\t\n\r!-~À-ÖØ-öø-ɏ]*").fullmatch
        self.known: dict[str, bytes] = {}
        self.code = "H" if kind_of(vocabulary(self.tok)) == "<u2" else "I"
        vocab, model = self.tok.get_vocab(with_added_tokens=False), spec["model"]
        self.together = self.plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout")) and vocab.keys() >= set(byte_symbols())
        self.bare = Tokenizer(self.tok.model)  # the model alone, over pre-tokens between spaces
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.length = np.zeros(vocabulary(self.tok), np.int64)
        self.length[list(vocab.values())] = list(map(len, vocab))

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word(self, pre_token: str) -> list[int]:
        return [t.id for t in self.tokenize(pre_token.encode().decode("latin-1").translate(self.chars))]

    def many(self, mark: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pre-tokens of letters, each after the symbols `mark`, and how many are of each. A token has as many
        symbols as bytes, so that the tokens' lengths tell which word they are of."""
        ids, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1 << 12):
            text = " ".join(words[i : i + (1 << 12)])
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.chars | {32: " "})
            symbols = [mark + w for w in text.split(" ")]
            found = self.bare.encode_batch_fast([" ".join(symbols[k : k + 128]) for k in range(0, len(symbols), 128)], add_special_tokens=False)
            own = np.concatenate([np.array(x.ids, np.int64) for x in found])
            have, want = np.cumsum(self.length[own]), np.cumsum(np.fromiter(map(len, symbols), np.int64, len(symbols)))
            last = np.searchsorted(have, want)
            if have[-1] != want[-1] or (have[last] != want).any():
                raise ValueError("tokens that don't spell their words")
            ids.append(own)
            size.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(size)

    def __call__(self, before: str, piece: str) -> bytes:
        if self.plain and piece.isalpha():
            return array(self.code, self.word(before + piece)).tobytes()
        if self.plain and self.common(piece):
            ids = []
            for w in self.cut(before + piece):
                if (own := self.known.get(w)) is None:
                    own = array(self.code, self.word(w)).tobytes()
                    if len(self.known) < 100_000 and len(w) <= 64:
                        self.known[w] = own
                ids.append(own)
            return b"".join(ids)
        return self.whole(before + piece)


_MARKS = string.punctuation


class _Pieces(dict):
    """Ids of pieces by text. A piece that isn't remembered is checked and encoded alone; once full, it keeps what it has
    until as many pieces again were missed, and then starts anew."""

    def __init__(self, words: _Words, special: list[str], before: str, most: int):
        self.words, self.special, self.before, self.most, self.missed = words, special, before, most, 0
        self.mark = before.translate(words.chars)
        self.quick = words.plain and not any(x.isalpha() for x in special)  # then a word of letters holds none
        self.together = self.quick and words.together and not any(not (x := y.rstrip(_MARKS)) or x.isalpha() for y in special)  # nor one with marks

    def __missing__(self, piece: str) -> bytes:
        if self.quick and piece.isascii() and piece.isalpha():  # one pre-token, and its bytes are their own symbols
            ids = array(self.words.code, [t.id for t in self.words.tokenize(self.mark + piece)]).tobytes()
        elif (self.before and (not piece or piece[0].isspace())) or any(x in piece for x in self.special):
            raise _Whole
        elif self.words.plain and (core := piece.rstrip(_MARKS)) != piece and core.isalpha():  # a word and its marks are two pre-tokens
            known = core in self
            ids = self[core] + self.words("", piece[len(core) :])
            if not known:  # as rare as its word, which is remembered
                return ids
        else:
            ids = self.words(self.before, piece) if piece else b""
        self.missed += 1
        if self.missed > 2 * self.most:
            self.clear()
            self.missed = 0
        if self.missed <= self.most and len(piece) <= 64:
            self[piece] = ids
        return ids


def vocabulary(tok) -> int:
    """One more than the largest id."""
    return max(tok.get_vocab(with_added_tokens=True).values()) + 1


class TextEncoder:
    """Ids of texts as little-endian strings of 2 or 4 bytes an id, from pieces between single spaces. Words go to the model
    together, each once in a call; other pieces are remembered.

    Byte-level pre-tokens never reach over the space before a word, so a text whose spaces are all followed by
    something else than white space is the sequence of its pieces. Other texts, and texts that hold a special string
    (none has a space), go to the library whole.
    """

    def __init__(self, path: str, end_id: int, remembered: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if sys.byteorder != "little":
            raise ValueError("ids are written in the machine's order, which must be little-endian")
        self.words = _Words(path)
        special = [t.content for t in self.words.tok.get_added_tokens_decoder().values()]
        if any(" " in x for x in special):
            raise ValueError("a special string with a space could span pieces")
        self.size, self.end = vocabulary(self.words.tok), array(self.words.code, [end_id]).tobytes()
        self.first, self.later = _Pieces(self.words, special, "", remembered // 8), _Pieces(self.words, special, " ", remembered)

    def texts(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Each different piece is encoded once: what is one word of letters, with or without marks behind, by the model
        together with all others. Its ids are then copied to all its places, as up to two units."""
        if not len(texts):
            return []
        given = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        cut = pc.split_pattern(given, " ")
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        which, first = coded.indices.to_numpy().astype(np.int64), np.r_[0, ends[:-1]]
        leads, lead = np.unique(which[first], return_inverse=True)
        later = np.ones(len(which), bool)
        later[first] = False
        asked = np.zeros(len(coded.dictionary), bool)  # a piece that only begins texts isn't asked for elsewhere
        asked[which[later]] = True
        pieces = coded.dictionary.to_pylist()

        ids, size, one = self._words(coded.dictionary, asked)
        words, more = len(size), [b"", self.end]  # units beyond the words
        two = np.full(len(pieces) + len(leads) + 1, words)  # of the empty unit
        one = np.r_[one, np.full(len(leads) + 1, words + 1)]
        whole = np.zeros(len(one), bool)
        tails: dict[str, int] = {}

        def unit(place: int, piece: str, known: _Pieces) -> None:
            try:
                more.append(known[piece])
                one[place] = words + len(more) - 1
            except _Whole:
                whole[place] = True

        for k in np.flatnonzero(asked & (one[: len(pieces)] < 0)).tolist():
            unit(k, pieces[k], self.later)
        for j, k in enumerate(leads.tolist()):
            unit(len(pieces) + j, pieces[k], self.first)
        if words:
            marked = np.flatnonzero((one[: len(pieces)] >= 0) & (one[: len(pieces)] < words) & asked)
            ending = [pieces[k] for k in marked.tolist()]
            marked = marked[~np.fromiter(map(str.isalpha, ending), bool, len(ending))]
            for k in marked.tolist():
                tail = pieces[k][len(pieces[k].rstrip(_MARKS)) :]
                if (at := tails.get(tail)) is None:
                    at = tails[tail] = words + len(more)
                    more.append(self.words("", tail))
                two[k] = at
        width = len(self.end)
        ids = np.concatenate([ids.astype(kind_of(self.size)), np.frombuffer(b"".join(more), kind_of(self.size))])
        size = np.r_[size, np.fromiter(map(len, more), np.int64, len(more)) // width]

        which[first] = len(pieces) + lead
        which = np.insert(which, ends, len(one) - 1)  # the end id after each text's last piece
        ends = ends + np.arange(1, len(ends) + 1)
        units = np.stack([one[which], two[which]], 1).ravel()
        sizes = size[units]
        out = memoryview(ids[ragged_arange((np.cumsum(size) - size)[units], sizes)]).cast("B")
        to = np.r_[0, np.cumsum(sizes)[2 * ends - 1]] * width
        got = [bytes(out[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        for i in np.flatnonzero(np.logical_or.reduceat(whole[which], np.r_[0, ends[:-1]])).tolist():
            got[i] = self.words.whole(given[i].as_py()) + self.end
        return got

    def _words(self, pieces: pa.Array, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of the different words that the asked pieces after a space are, less marks behind; and which one
        each piece is, -1 for others."""
        none = np.zeros(0, np.int64)
        if not self.later.together:
            return none, none, np.full(len(pieces), -1)
        cores = pc.utf8_rtrim(pieces, characters=_MARKS).dictionary_encode()
        text, of = cores.dictionary.to_pylist(), cores.indices.to_numpy()
        use = np.zeros(len(text), bool)
        use[of[asked]] = True
        use &= np.fromiter(map(str.isalpha, text), bool, len(text))
        ids, size = self.words.many(self.later.mark, [text[k] for k in np.flatnonzero(use).tolist()])
        return ids, size, np.where(use, np.cumsum(use) - 1, -1)[of]


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> TextEncoder:
    return TextEncoder(path, end_id)


def token_ids(docs: DataFrame, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, counts): ids with the end id, counts null; and a row for each task with its counts of all ids (8-byte
    numbers), id and ids null."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token ids", _encoder.cache_clear)
        total = np.zeros(_encoder(path, end_id).size, np.int64)
        kind = kind_of(len(total))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, 8 << 20):
                part = batch.slice(a, b - a)
                ids = _encoder(path, end_id).texts(pc.fill_null(part["text"], ""))
                total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["id", "ids", "counts"])

    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return importable(cut).mapInArrow(work, "id long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids, scaled so that they sum to 2**SCALE and every id that occurs has at least 1."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch["counts"].to_pylist():
                own = np.frombuffer(x, np.int64)
                total = total + own if len(total) else own
        if len(total):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), len(total) - 1], pa.int32()), pa.array([*total[at].tolist(), 0])], names=["token", "n"])

    got = importable(tokens.select("counts").where("counts is not null")).mapInArrow(spread, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row for each id at most, and the last id
    counts = np.zeros(max((r["token"] for r in got), default=0) + 1, np.int64)
    for r in got:
        counts[r["token"]] = r["n"]
    return scaled(counts)


def scaled(counts: np.ndarray) -> np.ndarray:
    total, goal = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts * (goal / total))), 0).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    spare, i = goal - int(f.sum()), 0
    while spare:  # the most frequent ids take up the rounding
        step = spare if spare > 0 else -min(-spare, int(f[order[i]]) // 2)
        f[order[i]] += step
        spare -= step
        i += 1
    return f.astype(np.uint32)


class Coder:
    """Codes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.base = (np.cumsum(freq, dtype=np.int64) - freq).astype(_U)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.kind = kind_of(len(freq))
        self.symbol = np.repeat(np.arange(len(freq), dtype=self.kind), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """ids: (blocks, steps * LANES). Final states (blocks, LANES), and each block's words."""
        blocks = len(ids)
        grid = ids.reshape(blocks, -1, LANES)
        x = np.full((blocks, LANES), _LOW, _U)
        words, owner = [], []
        for step in range(grid.shape[1] - 1, -1, -1):
            s = grid[:, step, :]
            f = self.freq[s]
            full = x >= f << _U(63 - SCALE)
            if full.any():
                words.append(x[full].astype(np.uint32))
                owner.append(np.repeat(np.arange(blocks), full.sum(1)))
                x = np.where(full, x >> _U(32), x)
            q = x // f
            x = (q << _U(SCALE)) + (x - q * f) + self.base[s]
        if not words:
            return x, [np.zeros(0, np.uint32)] * blocks
        own = np.concatenate(owner)
        flat = np.concatenate(words)[np.argsort(own, kind="stable")]
        return x, np.split(flat, np.cumsum(np.bincount(own, minlength=blocks))[:-1])

    def decode(self, x: np.ndarray, words: list[np.ndarray], steps: int) -> np.ndarray:
        """The ids of blocks of the same number of steps."""
        blocks = len(words)
        out = np.empty((blocks, steps, LANES), self.kind)
        top = np.cumsum([len(w) for w in words])
        flat = np.concatenate(words) if blocks else np.zeros(0, np.uint32)
        mask = _U((1 << SCALE) - 1)
        for step in range(steps):
            slot = x & mask
            s = self.symbol[slot]
            out[:, step, :] = s
            x = self.freq[s] * (x >> _U(SCALE)) + slot - self.base[s]
            low = x < _LOW
            n = low.sum(1)
            if n.any():
                top = top - n
                at = np.repeat(top, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                x[low] = x[low] << _U(32) | flat[at]
        if (x != _LOW).any():
            raise ValueError("a block doesn't end in the initial state")
        return out.reshape(blocks, -1)


def write_file(coder: Coder, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The bytes of one file."""
    cuts = range(0, len(tokens), BLOCK)
    parts = [tokens[a : a + BLOCK] for a in cuts]
    full = sum(len(p) == BLOCK for p in parts)
    states, words = [], []
    for group in ([p for p in parts[i : min(i + 128, full)]] for i in range(0, full, 128)):
        x, w = coder.encode(np.stack(group))
        states += list(x)
        words += w
    for p in parts[full:]:
        x, w = coder.encode(np.r_[p, np.full(-len(p) % LANES, p[-1], p.dtype)][None, :])
        states += list(x)
        words += w
    head = MAGIC + struct.pack("<7q", VERSION, LANES, BLOCK, coder.crc, len(ids), len(tokens), len(parts))
    table = ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u4").tobytes()
    marks, at = [], 0
    for p, x, w in zip(parts, states, words, strict=True):
        marks.append(struct.pack("<4q", at, len(w), zlib.crc32(w.astype("<u4").tobytes()), zlib.crc32(p.astype(coder.kind).tobytes())) + x.astype("<u8").tobytes())
        at += len(w)
    body = head + table + b"".join(marks) + b"".join(w.astype("<u4").tobytes() for w in words)
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """Reads a file's documents; blocks are decoded on demand and each checksum is verified."""

    def __init__(self, payload: bytes, coder: Coder):
        if payload[:8] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a token file, or damaged")
        version, lanes, self.block, crc, docs, self.n, blocks = struct.unpack_from("<7q", payload, 8)
        if version != VERSION or lanes != LANES or crc != coder.crc:
            raise ValueError("another version, number of lanes or frequency table")
        self.coder, at = coder, 64
        self.ids = np.frombuffer(payload, "<i8", docs, at)
        self.nulls = np.frombuffer(payload, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        size = 32 + 8 * LANES
        marks = np.frombuffer(payload, np.uint8, blocks * size, at).reshape(blocks, size)
        self.marks = np.ascontiguousarray(marks[:, :32]).view("<i8")
        self.states = np.ascontiguousarray(marks[:, 32:]).view("<u8")
        self.words = np.frombuffer(payload[at + blocks * size : -4], "<u4")

    def blocks(self, which: list[int]) -> list[np.ndarray]:
        """The ids of some blocks, decoded together where they are equally long."""
        out: dict[int, np.ndarray] = {}
        size = {b: min(self.block, self.n - b * self.block) for b in which}
        for steps in sorted({-(-n // LANES) for n in size.values()}):
            same = [b for b in which if -(-size[b] // LANES) == steps]
            for i in range(0, len(same), 128):
                group = same[i : i + 128]
                words = [self.words[a : a + n] for a, n in self.marks[group, :2].tolist()]
                if any(zlib.crc32(w.tobytes()) != c for w, c in zip(words, self.marks[group, 2].tolist(), strict=True)):
                    raise ValueError("a block's words are damaged")
                got = self.coder.decode(self.states[group].astype(_U), words, steps)
                for b, ids in zip(group, got, strict=True):
                    out[b] = ids[: size[b]]
                    if zlib.crc32(out[b].astype(self.coder.kind).tobytes()) != self.marks[b, 3]:
                        raise ValueError("a block's ids are damaged")
        return [out[b] for b in which]

    def tokens(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.coder.kind), *self.blocks(list(range(len(self.marks))))])


def write_files(tokens: DataFrame, freq: np.ndarray, *, file_ids: int = 1 << 22, parts: int | None = None) -> DataFrame:
    """(part, seq, before, n_ids, payload), in ascending order of the documents' ids by part and seq."""
    shared = tokens.sparkSession.sparkContext.broadcast(freq)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token files")
        coder, part, seq, before = Coder(shared.value), TaskContext.get().partitionId(), 0, 0
        width = np.dtype(coder.kind).itemsize
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nulls = np.array([i is None for i in ids], bool)
            lengths = np.array([len(x) // width for x in held], np.int64)
            payload = write_file(coder, np.array([i or 0 for i in ids], np.int64), nulls, lengths, np.frombuffer(b"".join(held), coder.kind))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "before", "n_ids", "payload"])

        for batch in batches:
            for i, x in zip(batch["id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                ids.append(i)
                held.append(x)
                size += len(x) // width
                if size >= file_ids:
                    yield flush()
                    ids, held, size, seq, before = [], [], 0, seq + 1, before + size
        if ids:
            yield flush()

    n = parts or int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.where("counts is null").select("id", "ids").withColumn("h", F.xxhash64("ids")).repartitionByRange(n, F.col("id").asc_nulls_first(), "h")
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "ids").select("id", "ids")
    return stored(importable(ordered).mapInArrow(work, "part int, seq int, before long, n_ids long, payload binary"), "token-files")


def read_files(files: DataFrame, freq: np.ndarray) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    shared = files.sparkSession.sparkContext.broadcast(freq)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))  # as many rows as partitions

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token files")
        coder = Coder(shared.value)
        for batch in batches:
            for first, payload in zip(batch["first"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                f = TokenFile(payload, coder)
                raw = memoryview(f.tokens().astype("<u4").tobytes())
                ends = np.cumsum(f.lengths, dtype=np.int64)
                begins = ends - f.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.ids, mask=f.nulls), pa.array(begins + first), pa.array(f.lengths, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return importable(files.join(F.broadcast(starts), "part").select((F.col("first") + F.col("before")).alias("first"), "payload")).mapInArrow(work, "id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    tokens = stored(token_ids(docs, path, end_id=end_id, id_col=id_col, text_col=text_col), "token-ids", **{"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"})
    freq = frequencies(tokens)
    return read_files(write_files(tokens, freq), freq).withColumnRenamed("id", id_col)
