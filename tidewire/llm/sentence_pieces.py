"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read as plain protobuf; encoding is numpy work over flat symbol arrays. In a text every piece starts
at a run of meta spaces or lies inside one word, so words are independent: the distinct words of a batch are laid out
in one flat array, each round finds the best-scored adjacent pair of every word, merges its leftmost non-overlapping
places in all words at once and compacts, until no word has a pair left. Merging all places at once gives what one merge
at a time gives, where no pair with the merged piece scores better than that piece; for other pieces only the leftmost
place is merged. Only pairs beside a merge are looked up again. Symbols outside the vocabulary become byte pieces.

Words of over ``LONG`` symbols are first cut between characters that stand side by side in no piece of the vocabulary,
which no merge can cross.

Defined cases: a null text is an empty text, which encodes to the end id alone and decodes to ''; repeated rows give
repeated results; texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "▁"
WORD = re.compile(f"{META}+[^{META}]*")
LONG, CACHE, CHUNK = 256, 150_000, 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Vocabulary, pair table and merge rounds of one BPE model (the file's bytes)."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        score: list[float] = []
        self.kind: list[int] = []
        self.eos = None
        dummy = True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                score.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.kind.append(f.get(3, NORMAL))
            elif number == 3:
                f = dict(_fields(value))
                dummy = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not dummy:
                    raise ValueError("only models with identity normalisation, a leading meta space and kept spaces are supported")
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kind[i] == NORMAL}
        if any(META in p.lstrip(META) for p in self.id):
            raise ValueError("pieces that span words are not supported")
        self.eos = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kind[i] == BYTE}
        # a symbol is a piece's id, or for a single character outside the vocabulary a number past all ids
        self.extra = len(self.pieces)
        symbols = dict(self.id)
        for p in self.id:
            for c in p:
                symbols.setdefault(c, len(symbols) + self.extra)
        self.symbol = symbols
        left, right, made = [], [], []
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbols and b in symbols:
                    left.append(symbols[a])
                    right.append(symbols[b])
                    made.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self._index(keys, np.array(made, np.int64))
        ranks = np.unique(-np.array(score, np.float32), return_inverse=True)[1]
        self.rank = ranks.astype(np.int64)  # by piece; lower merges first, equal scores share a rank
        # pieces that make a better-scored one with some neighbour
        self.first_only = np.zeros(len(self.pieces), bool)
        for part in (np.array(left, np.int64), np.array(right, np.int64)):
            whole = part < self.extra
            better = self.rank[np.array(made, np.int64)[whole]] <= self.rank[part[whole]]
            self.first_only[part[whole][better]] = True
        sides = {ord(a) << 21 | ord(b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self.sides = np.array(sorted(sides), np.int64)  # characters side by side in a piece
        self.text: dict[int, str] = {i: p.replace(META, " ") for p, i in self.id.items()}
        self.texts = [self.text.get(i) for i in range(len(self.pieces))]  # None: a byte or control piece
        self.names = list(map(str, range(len(self.pieces))))
        # symbol of each code point, and what its character becomes if no merge takes it
        self.points = np.arange(len(symbols) + self.extra, len(symbols) + self.extra + 0x110000, dtype=np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.points[ord(c)] = i
        self.base = len(symbols) + self.extra
        self.named = {i: c for c, i in symbols.items() if i >= self.extra}

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open-addressing table of pairs: at its hash or the next free places stands each key."""
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.keys = np.full(1 << int(64 - self.shift), -1, np.int64)
        self.made = np.full(len(self.keys), -1, np.int64)
        place = self._hash(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[place] == -1)
            _, first = np.unique(place[free], return_index=True)
            put = free[first]
            self.keys[place[put]], self.made[place[put]] = keys[put], made[put]
            rest = self.keys[place] != keys
            keys, made, place = keys[rest], made[rest], (place[rest] + 1) & (len(self.keys) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left << 32 | right
        place = self._hash(key)
        found = self.keys[place]
        out = np.where(found == key, self.made[place], -1)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[place[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.made[place[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _merges(self, made: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the pairs to merge in this round: those of the best rank of each word, without overlaps."""
        at = np.flatnonzero(made >= 0)
        if not len(at):
            return at
        w, rank = word[at], self.rank[made[at]]
        edge = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        sizes = np.diff(np.r_[edge, len(at)])
        best = at[rank == np.repeat(np.minimum.reduceat(rank, edge), sizes)]
        first = np.r_[True, word[best[1:]] != word[best[:-1]]]
        best = best[first | ~self.first_only[made[best]]]
        # of places in a row every second one, from the left
        start = np.r_[True, best[1:] != best[:-1] + 1]
        run = np.flatnonzero(start)
        return best[(np.arange(len(best)) - np.repeat(run, np.diff(np.r_[run, len(best)]))) % 2 == 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Piece ids of each word (a word is a run of meta spaces and what follows it)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat, owner = self.points[points], np.repeat(np.arange(len(words)), sizes)
        cut = np.r_[True, owner[1:] != owner[:-1]] if len(flat) else np.zeros(0, bool)
        if (sizes > LONG).any():
            beside = points[:-1].astype(np.int64) << 21 | points[1:]
            near = self.sides[np.minimum(np.searchsorted(self.sides, beside), len(self.sides) - 1)] == beside
            cut[1:] |= ~near & (sizes > LONG)[owner[1:]]
        word = np.cumsum(cut) - 1  # parts of words, each merged on its own
        owner = owner[cut]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(flat), -1, np.int64)  # what each symbol makes with the next of its word
        if len(flat) > 1:
            made[:-1] = np.where(cut[1:], -1, self._look(flat[:-1], flat[1:]))
        while len(merge := self._merges(made, word)):
            flat[merge] = made[merge]
            keep = np.ones(len(flat), bool)
            keep[merge + 1] = False
            # words without a pair are finished and leave the array
            alive = np.zeros(len(owner), bool)
            alive[word[merge]] = True
            rest = alive[word]
            done.append((word[~rest], flat[~rest]))
            keep &= rest
            place = np.cumsum(keep) - 1
            flat, word, made, merge = flat[keep], word[keep], made[keep], place[merge]
            for left in (merge, merge[merge > 0] - 1):
                right = np.minimum(left + 1, len(flat) - 1)
                made[left] = np.where((right > left) & (word[left] == word[right]), self._look(flat[left], flat[right]), -1)
        done.append((word, flat))
        word, flat = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(word, kind="stable")
        word, flat = owner[word[order]], flat[order]
        out: list[list[int]] = []
        ids, begin = flat.tolist(), 0
        for end in np.cumsum(np.bincount(word, minlength=len(words))).tolist():
            out.append(ids[begin:end])
            begin = end
        for w in np.unique(word[flat >= self.extra]).tolist():
            out[w] = [i for s in out[w] for i in ([s] if s < self.extra else self._bytes(s))]
        return out

    def _bytes(self, symbol: int) -> list[int]:
        """Byte pieces of a character outside the vocabulary."""
        c = self.named.get(symbol) or chr(symbol - self.base)
        return [self.byte[b] for b in c.encode("utf-8", "replace")]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without an end id."""
        if not text:
            return []
        words = WORD.findall((META + text).replace(" ", META))
        ids = dict(zip(dict.fromkeys(words), self.encode_words(list(dict.fromkeys(words))), strict=True))
        return [i for w in words for i in ids[w]]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a list of ids: byte pieces are joined as UTF-8, control ids are nothing, one leading space goes."""
        return self._decode(ids).removeprefix(" ")

    def _decode(self, ids: Iterable[int]) -> str:
        try:
            return "".join(map(self.texts.__getitem__, ids))
        except TypeError:  # byte or control pieces
            pass
        out, run = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                run.append(int(self.pieces[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text.get(i, ""))
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)


#: The model of this worker, by the digest of its file.
_MODEL: dict[bytes, PieceModel] = {}
Word = tuple[str, int, str]


class _Words:
    """Results by word, of the words met lately: two generations of at most ``CACHE`` entries, the older one goes."""

    def __init__(self) -> None:
        self.new: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def of(self, model: PieceModel, words: set[str]) -> dict[str, Word]:
        """Ids joined by a space, their number and the decoded text of each word."""
        new, old = self.new, self.old
        if len(new) > CACHE:
            new, old = {}, new
        missing, names = [], model.names.__getitem__
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    missing.append(w)
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            for w, ids in zip(part, model.encode_words(part), strict=True):
                new[w] = (" ".join(map(names, ids)), len(ids), model._decode(ids))
        self.new, self.old = new, old
        return new


def _rows(model: PieceModel, texts: list[str], words: _Words, with_ids: bool) -> list[tuple]:
    split = [WORD.findall((META + t).replace(" ", META)) if t else [] for t in texts]
    known = words.of(model, set().union(*split))
    out = []
    for found in split:
        parts, counts, back = zip(*[known[w] for w in found], strict=True) if found else ((), (), ())
        ids = " ".join([*parts, str(model.eos)])
        row = (sum(counts) + 1, hashlib.sha256(ids.encode()).hexdigest(), "".join(back).removeprefix(" "))
        out.append(row + (list(map(int, ids.split())),) if with_ids else row)
    return out


def encode_decode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded[, ids])`` for each row: whole texts, an end id, no sampling.

    The model (a file of fixed size) is read once and broadcast as bytes. Tasks hold one chunk of texts and a word
    cache of two times ``CACHE`` entries and the words of a chunk; nothing is shuffled.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        data = f.read()
    digest, shared = hashlib.sha256(data).digest(), spark.sparkContext.broadcast(data)
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODEL.get(digest) or _MODEL.setdefault(digest, PieceModel(shared.value))
        words = _Words()
        for batch in batches:
            texts, begin, size = batch.column(1), 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > CHUNK:
                    if i > begin:
                        rows = _rows(model, [x or "" for x in texts.slice(begin, i - begin).to_pylist()], words, with_ids)
                        cols = list(zip(*rows, strict=True))
                        types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i - begin), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=schema.names)
                    begin, size = i, 0
                if i < batch.num_rows:
                    size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
