"""Byte-level BPE by backtracking over longest matches, and back."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowwarden.llm.text import sealed

PIECES_KEPT = 150_000
PAIRS_KEPT = 500_000
BATCH_BYTES = 4 << 20


class Vocabulary:
    """Tokens by id, and for each the two tokens whose merge makes it (-1 where none does)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"a byte-level vocabulary needs all bytes; {missing[:4]} are missing")
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = self._merged(t, i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
        self.key = hash(tuple(tokens))

    def _merged(self, raw: bytes, below: int) -> list[int]:
        """Ids after all merges that rank before ``below``."""
        parts = [raw[k:k + 1] for k in range(len(raw))]
        while len(parts) > 2:
            rank, at = min((self.ids.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]


def read_ranks(path: str) -> Vocabulary:
    """A rank file: one base64 token and its rank per line, ranks from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return Vocabulary(tokens)


class Encoder:
    """Encodes pieces of text; made once per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.length = [len(t) for t in vocabulary.tokens]
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(vocabulary.left, vocabulary.right)) if a >= 0}
        # Every beginning of a token, as Latin-1 text, and the longest token that it begins with.
        self.paths = ahocorasick.Automaton()
        self.longest: dict[str, int] = {}
        self.shorter = [-1] * len(vocabulary.tokens)
        self.reach = max(self.length)
        usable = {t.decode("latin-1"): i for i, t in enumerate(vocabulary.tokens) if len(t) == 1 or vocabulary.left[i] >= 0}
        for word in sorted(usable, key=len):
            self.paths.add_word(word, usable[word])
            for n in range(1, len(word) + 1):
                path = word[:n]
                if path not in self.longest:
                    self.longest[path] = usable.get(path, self.longest.get(path[:-1], -1))
        for word, token in usable.items():
            self.shorter[token] = self.longest.get(word[:-1], -1)
        self.fits: dict[int, bool] = {}

    def _compatible(self, first: int, second: int) -> bool:
        """Whether merging leaves the border between two neighbours in place.

        Walks the merges that touch the border backwards in time, last made
        first: a pair across it that would have merged before the piece it
        cuts was made removes the border.
        """
        left, right, merge = self.v.left, self.v.right, self.merge
        a, b, limit = first, second, len(left)
        while True:
            made = merge.get((a, b))
            if made is not None and made < limit:
                return False
            inner_a, inner_b = right[a], left[b]
            if a > b:
                if inner_a >= 0:
                    a, limit = inner_a, a
                elif inner_b >= 0:
                    b, limit = inner_b, b + 1
                else:
                    return True
            elif inner_b >= 0:
                b, limit = inner_b, b + 1
            elif inner_a >= 0:
                a, limit = inner_a, a
            else:
                return True

    def compatible(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[key] = self._compatible(first, second)
        return known

    def encode(self, raw: bytes) -> list[int]:
        whole = self.v.ids.get(raw)
        if whole is not None:
            return [whole]
        text, size, length, shorter, fits = raw.decode("latin-1"), len(raw), self.length, self.shorter, self.fits
        reach, prefix, longest = self.reach, self.paths.longest_prefix, self.longest
        dead: set[int] = set()
        out: list[int] = []
        at, last = 0, -1
        ahead = text[:reach]
        token = longest[ahead[:prefix(ahead)]]
        while at < size:
            while token >= 0:
                after = at + length[token]
                if after not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = after, token
                if at < size:
                    ahead = text[at:at + reach]
                    token = longest[ahead[:prefix(ahead)]]
            else:
                # Only one valid encoding ends here, so nothing else can come through this place.
                dead.add(at)
                gone = out.pop()
                at -= length[gone]
                token, last = shorter[gone], out[-1] if out else -1
        return out


class Pieces(dict):
    """Piece of text to its ids as packed integers; keeps the recent pieces, in two generations."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.encoder.encode(piece.encode("utf-8"))).tobytes()
        if len(piece) <= 64:
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}
        self.encoder.fits.clear()


_WORKER: dict[str, object] = {}


def _pieces(vocabulary: Vocabulary) -> Pieces:
    if _WORKER.get("key") != vocabulary.key:
        _WORKER.update(key=vocabulary.key, pieces=Pieces(Encoder(vocabulary)))
    return _WORKER["pieces"]


def _slices(column: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` bytes."""
    begin = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        held += n
        if held >= most:
            yield begin, i + 1 - begin
            begin, held = i + 1, 0
    if begin < len(column):
        yield begin, len(column) - begin


def _encode(batches, shared, pattern: str, text_col: str, ids_col: str, keep: list[str], schema: pa.Schema | None = None):
    pieces, find = _pieces(shared.value), regex.compile(pattern).findall
    try:
        for batch in batches:
            for begin, n in _slices(batch.column(text_col)):
                part = batch.slice(begin, n)
                packed = [b"".join(map(pieces.__getitem__, find(t))) if t else b"" for t in part.column(text_col).to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, ids_col])
    finally:
        # The worker outlives the task: whatever runs in it next would have less of the executor's memory.
        pieces.forget()


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The input rows with ``ids``: the tokens of the whole text, as the merges of the ranks give them.

    Every match of ``pattern`` is encoded by itself, without special tokens.
    The vocabulary is broadcast; its size does not depend on the rows.  Tasks
    keep the ids of recent pieces, up to a fixed number, and drop them at their end.

    Null and empty texts have no ids.  All other columns pass through
    (``ids_col`` is replaced).  Rows are independent of each other, so repeated
    rows give repeated results and an empty table none.
    """
    keep = [c for c in docs.columns if c != ids_col]
    docs, inner, _ = sealed(docs, [ids_col])
    names = [inner[c] for c in keep]
    schema = T.StructType([*(docs.schema[n] for n in names), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    work = partial(_encode, shared=shared, pattern=pattern, text_col=inner[text_col], ids_col=ids_col, keep=names)
    return docs.select(*names).mapInArrow(lambda batches: work(batches), schema).toDF(*keep, ids_col)


def _decode(batches, shared, ids_col: str, out_col: str, keep: list[str]):
    tokens = shared.value
    for batch in batches:
        decoded = [b"".join(map(tokens.__getitem__, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else None
                   for ids in batch.column(ids_col)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(decoded, pa.binary())], [*keep, out_col])


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input rows with ``decoded``: the bytes of the tokens in ``ids_col`` (null for null ids)."""
    keep = [c for c in rows.columns if c != out_col]
    rows, inner, _ = sealed(rows, [out_col])
    names = [inner[c] for c in keep]
    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField(out_col, T.BinaryType(), True)])
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    work = partial(_decode, shared=shared, ids_col=inner[ids_col], out_col=out_col, keep=names)
    return rows.select(*names).mapInArrow(lambda batches: work(batches), schema).toDF(*keep, out_col)
