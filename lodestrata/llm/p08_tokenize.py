"""Problem 8: encode a corpus with a byte-level BPE rank file.

Every piece of the pre-tokenizer is merged with a segment tree over the ranks
of its adjacent pairs. The root holds the leftmost pair of lowest rank; a
merge is a point update of at most three leaves, each logarithmic in the
piece's length, until the root holds no mergeable pair. Merged words are kept
in a bounded per-worker dictionary, so that a word which recurs is merged once
in a while and not once per occurrence.

Defined results: a null text, an empty text: an empty list. Marker-like
strings are ordinary text. Repeated rows give repeated results. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words a worker remembers before its dictionary starts anew.
MEMO_WORDS = 200_000

#: The pattern that comes with the public rank files (fixed value).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Path of the installed public vocabulary ``byte_bpe_50k``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> bytes:
    """The raw rank file; its size is fixed by the vocabulary (0.8 MB)."""
    with open(path, "rb") as f:
        return f.read()


class PairTree:
    """Segment tree whose root is the smallest (rank, position) key of a piece."""

    __slots__ = ("width", "node")

    NONE = 1 << 62

    def __init__(self, keys: list[int]) -> None:
        width = 1
        while width < len(keys):
            width *= 2
        node = [self.NONE] * (2 * width)
        node[width : width + len(keys)] = keys
        for i in range(width - 1, 0, -1):
            left, right = node[2 * i], node[2 * i + 1]
            node[i] = left if left < right else right
        self.width, self.node = width, node

    def put(self, position: int, key: int) -> None:
        node, i = self.node, position + self.width
        node[i] = key
        i >>= 1
        while i:
            left, right = node[2 * i], node[2 * i + 1]
            best = left if left < right else right
            if node[i] == best:
                return
            node[i] = best
            i >>= 1


class _Memo(dict):
    """Result by word; a missing word is worked out, and kept while short."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> object:
        result = self.make(word)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = result
        return result


class Encoder:
    """A rank file ready to encode; made once per worker process.

    A text is cut at its spaces before the pre-tokenizer's pattern is applied:
    a space with a character other than white space on at least one side always
    starts a piece, so the pieces of " word" don't depend on what surrounds it
    and can be remembered. In texts with a space inside a run of white space the
    words are remembered with the whole run before them.
    """

    def __init__(self, raw: bytes, pattern: str = SPLIT_PATTERN) -> None:
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line)}
        self.longest = max(map(len, self.ranks), default=1)
        self.split = regex.compile(pattern).findall
        self.spaced = re.compile(r"\s*\S+|\s+").findall
        self.inner_space = re.compile(r"\s \s").search
        self.pieces = _Memo(lambda piece: self.merge(piece.encode("utf-8", "replace")))
        self.runs = _Memo(self.pattern_ids)
        self.words = _Memo(lambda word: self.pattern_ids(" " + word))
        self.sizes = _Memo(lambda word: len(self.words[word]))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        ranks, longest, n = self.ranks, self.longest, len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return (ranks[part[0]],)
        none = PairTree.NONE

        def key(i: int, j: int) -> int:
            if len(part[i]) + len(part[j]) > longest:
                return none
            rank = ranks.get(part[i] + part[j])
            return none if rank is None else rank * n + i

        tree = PairTree([key(i, i + 1) for i in range(n - 1)])
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (best := tree.node[1]) != none:
            i = best % n
            j = after[i]
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                tree.put(i, key(i, k))
            else:
                tree.put(i, none)
            if (h := before[i]) >= 0:
                tree.put(h, key(h, i))
        return tuple(ranks[p] for p in part if p)

    def pattern_ids(self, text: str) -> tuple[int, ...]:
        """Token ids of a text by the pattern's pieces."""
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def whole(self, text: str) -> tuple[int, ...]:
        """Token ids of a text by its words, each with the white space before it."""
        return tuple(chain.from_iterable(map(self.runs.__getitem__, self.spaced(text))))

    def encode_into(self, text: str, out: list[int]) -> None:
        if self.inner_space(text):
            out.extend(self.whole(text))
            return
        first, *rest = text.split(" ")
        out.extend(self.whole(first))
        out.extend(chain.from_iterable(map(self.words.__getitem__, rest)))

    def count(self, text: str) -> int:
        if self.inner_space(text):
            return len(self.whole(text))
        first, *rest = text.split(" ")
        return len(self.whole(first)) + sum(map(self.sizes.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            self.encode_into(text, out)
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(raw: bytes, pattern: str = SPLIT_PATTERN) -> Encoder:
    """The worker's encoder for this vocabulary."""
    name = (hashlib.sha256(raw).hexdigest(), pattern)
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(raw, pattern)
    return _ENCODERS[name]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; map-only, no shuffle.

    The vocabulary reaches the workers as one broadcast of fixed size.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat: list[int] = []
                offsets = array("i", [0])
                for t in part.column(1).to_pylist():
                    if t:
                        enc.encode_into(t, flat)
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of every row; as ``token_ids`` without the ids."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            n = pa.array([enc.count(t) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
