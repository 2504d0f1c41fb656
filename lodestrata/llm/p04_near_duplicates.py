"""Problem 4: groups of texts that are edited copies of each other.

Exact similarity join on the sets of three-word sequences (Jaccard at least
one half) by rare-first prefix filtering:

* Texts with the same words in the same order form a class; a class takes part
  once, however many copies it has.
* The texts are read once; from then on sets of hashed sequences travel, packed.
* Sequences are ordered by how many classes have them, rare ones first. The
  counts are exact: sets are cut into shards by hash, counted there, and the
  counts of what several classes have go back to the classes. What no other
  class has can't match anything and stays behind. The few hot sequences (at
  most ``HOT_SHARE``) are counted where they lie, so no shard is hot.
* Two sets that are similar enough share at least ``SHARED`` sequences of their
  prefixes. The smaller set's index prefix meets the larger one's (longer) probe
  prefix in an equi-join on the sequence, under length and positional filters;
  pairs that share too few prefix sequences are dropped by their count.
* Each remaining pair is verified once: a suffix filter (counts of the sets in
  ranges of hash values bound the overlap), then the exact intersection of what
  the two classes share with others, which holds all they share with each other.

Defined results: null texts and texts of fewer than ``LEAST_WORDS`` words are
similar to nothing; a node that was written several times counts as its row of
the largest ``ord``. Pairs among more than ``EXPAND`` exact copies are given as
pairs with the copies' representative (their smallest id), and so are their
pairs with other texts: the classes and their members lose no link.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.components import connected_components
from lodestrata.operators.latest import latest_by
from lodestrata.session import staged

TYPES = ("memory", "document", "transcript", "prompt", "turn")
LEAST_WORDS = 20
WIDTH = 3
THRESHOLD = Fraction(1, 2)
#: Prefix sequences that a pair must share; longer prefixes for more of them keep the join exact.
SHARED = 3
#: Sequences of a chunk of sets, and those a shard counts at once.
CHUNK = 1 << 20
SHARD = 1 << 22
#: A sequence is hot if more than this share of all sequences are it; a chunk names those it has as often as this.
HOT_SHARE = 1 << 18
LOCALLY_HEAVY = 8
#: Exact copies up to which all their pairs are listed.
EXPAND = 64
#: Words whose hashes a worker remembers.
MEMO_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sequences(words: list[str], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes (48 bits) of the word sequences of a text."""
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = w[:n].copy()
    for i in range(1, width):
        h = _mix(h) + w[i : i + n]
    return np.unique(_mix(h) & np.uint64((1 << 48) - 1))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def class_of(words: list[str]) -> bytes:
    """A digest of the words in order."""
    return hashlib.md5(" ".join(words).encode("utf-8", "replace")).digest()


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _counted_texts(nodes: DataFrame) -> DataFrame:
    kept = F.when(F.col("node_type").isin(*TYPES), F.col("text"))
    return nodes.select("id", "ord", kept.alias("text"))


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits of hashes, six bytes each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(packed: bytes) -> np.ndarray:
    """Hashes of six bytes each as numbers."""
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _outline(texts: DataFrame) -> DataFrame:
    """Heads (id, ord, class, set size) of all rows, and the sets of their classes in chunks.

    One pass over the texts, the only one. A chunk holds the sets of up to
    ``CHUNK`` sequences, each class once: ``seqs``, ``classes`` and ``runs`` (set
    sizes); ``heavy`` and ``times`` are sequences that several of its classes have.
    """
    names = ["id", "ord", "digest", "cls", "size", "seqs", "classes", "runs", "heavy", "times"]
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def chunk(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        all_ = np.concatenate(list(sets.values()))
        found, n = np.unique(all_, return_counts=True)
        often = n >= LOCALLY_HEAVY
        columns = (_six(all_), np.fromiter(sets, np.int64).tobytes(), np.array([len(s) for s in sets.values()], np.int32).tobytes(), _six(found[often]), n[often].astype(np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in types[:5]] + [pa.array([c], pa.binary()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            digests: list[bytes | None] = []
            keys: list[int | None] = []
            sizes: list[int | None] = []
            for t in batch.column(2).to_pylist():
                digest = key = size = None
                words = words_of(t) if t else ()
                if len(words) >= LEAST_WORDS:
                    digest = class_of(words)
                    key = _key(digest)
                    s = sets.get(key)
                    if s is None:
                        if held >= CHUNK:
                            yield chunk(sets)
                            sets, held = {}, 0
                        s = sets[key] = sequences(words)
                        held += len(s)
                    size = len(s)
                digests.append(digest)
                keys.append(key)
                sizes.append(size)
            n = len(digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(5))], names=names)
        if sets:
            yield chunk(sets)

    return texts.mapInArrow(run, "id string, ord bigint, digest binary, cls bigint, size int, seqs binary, classes binary, runs binary, heavy binary, times binary")


def _code(n: np.ndarray) -> np.ndarray:
    """A small number that grows with a count."""
    return np.minimum(255, 8 * np.log2(np.maximum(n, 1))).astype(np.uint8)


def _hot(chunks: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, and codes of their counts, that make up more than 1 / ``HOT_SHARE`` of all; so there are at most ``HOT_SHARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heavy, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_wide(heavy).view(np.int64)), pa.array(np.frombuffer(times, np.int32))], names=["seq", "n"])

    counted = chunks.select("heavy", "times").mapInArrow(run, "seq bigint, n int").groupBy("seq").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in counted.where(F.col("n") * HOT_SHARE > F.lit(total)).collect())
    return np.array([r[0] for r in rows], np.uint64), _code(np.array([r[1] for r in rows], np.int64))


def _mail(to: np.ndarray, cls: np.ndarray, rest: list[np.ndarray], whose: np.ndarray, sizes: np.ndarray | None) -> Iterator[tuple]:
    """Rows ``(to, classes, runs, sizes, *rest)`` of entries that lie by class; ``whose`` is each entry's class number."""
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.diff(to[order], append=-1)) + 1
    at = 0
    for end in ends:
        rows = order[at:end]
        runs = np.bincount(whose[rows], minlength=len(cls)) if len(cls) < 4 * len(rows) else None
        if runs is None:
            held, counts = np.unique(whose[rows], return_counts=True)
        else:
            held = np.flatnonzero(runs)
            counts = runs[held]
        yield int(to[rows[0]]), cls[held].tobytes(), counts.astype(np.int32).tobytes(), None if sizes is None else sizes[held].tobytes(), *(r[rows] for r in rest)
        at = end


def _sharded(chunks: DataFrame, hot, shards: int) -> DataFrame:
    """The sets' sequences but the hot ones, sent to the shard that counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seqs, classes, runs in zip(*(c.to_pylist() for c in batch.columns)):
                s, cls = _wide(seqs), np.frombuffer(classes, np.int64)
                whose = np.repeat(np.arange(len(cls)), np.frombuffer(runs, np.int32))
                cold = ~np.isin(s, hot.value[0])
                s, whose = s[cold], whose[cold]
                rows = list(_mail((s % np.uint64(shards)).astype(np.int32), cls, [s], whose, None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([_six(r[4]) for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["shard", "seqs", "classes", "runs"],
                )

    return chunks.select("seqs", "classes", "runs").mapInArrow(run, "shard int, seqs binary, classes binary, runs binary")


_LETTER = "bucket int, classes binary, runs binary, sizes binary, seqs binary, codes binary"


def _letters(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*((r[0], r[1], r[2], r[3], _six(r[4]), r[5].tobytes()) for r in rows))) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[p.split()[0] for p in _LETTER.split(", ")])


def _counted(sharded: DataFrame, buckets: int) -> DataFrame:
    """Sequences that several classes have, with a code that grows with how many, sent back by class."""

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, owners = [], []
        for batch in batches:
            for s, classes, runs in zip(*(batch.column(c).to_pylist() for c in ("seqs", "classes", "runs"))):
                seqs.append(_wide(s))
                owners.append(np.repeat(np.frombuffer(classes, np.int64), np.frombuffer(runs, np.int32)))
        s, cls = np.concatenate(seqs), np.concatenate(owners)
        order = np.lexsort((cls, s))
        s, cls = s[order], cls[order]
        # a class may come from several chunks
        new = np.r_[True, (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])]
        s, cls = s[new], cls[new]
        _, inverse, n = np.unique(s, return_inverse=True, return_counts=True)
        often = n[inverse]
        several = often > 1
        s, cls, often = s[several], cls[several], often[several]
        held, whose = np.unique(cls, return_inverse=True)
        code = _code(often)
        order = np.argsort(whose, kind="stable")
        s, whose, code = s[order], whose[order], code[order]
        yield _letters(list(_mail((held[whose] % buckets).astype(np.int32), held, [s, code], whose, None)))

    return sharded.groupBy("shard").applyInArrow(count, _LETTER)


def _sizes(chunks: DataFrame, hot, buckets: int) -> DataFrame:
    """The set size of each class, and its hot sequences, sent to the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seqs, classes, runs in zip(*(c.to_pylist() for c in batch.columns)):
                s, cls, sizes = _wide(seqs), np.frombuffer(classes, np.int64), np.frombuffer(runs, np.int32)
                whose = np.repeat(np.arange(len(cls)), sizes)
                known, codes = hot.value
                warm = np.isin(s, known)
                s, whose = s[warm], whose[warm]
                rows = list(_mail((cls[whose] % buckets).astype(np.int32), cls, [s, codes[np.searchsorted(known, s)]], whose, sizes))
                without = np.setdiff1d(np.arange(len(cls)), whose)
                to = (cls[without] % buckets).astype(np.int32)
                for b in np.unique(to):
                    mine = without[to == b]
                    rows.append((int(b), cls[mine].tobytes(), np.zeros(len(mine), np.int32).tobytes(), sizes[mine].tobytes(), np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
                yield _letters(rows)

    return chunks.select("seqs", "classes", "runs").mapInArrow(run, _LETTER)


def _prefixes(letters: DataFrame) -> DataFrame:
    """``seq``, ``cls``, ``size``, ``pos``, ``indexed`` of the prefix members that may match, and a row per class
    with ``shared`` (its sequences that other classes have too).

    In a class's order come the sequences no other class has, then by how many
    have them, ties by hash.
    """

    def choose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, codes, owners, sized, sizes = [], [], [], [], []
        for batch in batches:
            for classes, runs, size, s, code in zip(*(batch.column(c).to_pylist() for c in ("classes", "runs", "sizes", "seqs", "codes"))):
                cls = np.frombuffer(classes, np.int64)
                owners.append(np.repeat(cls, np.frombuffer(runs, np.int32)))
                seqs.append(_wide(s))
                codes.append(np.frombuffer(code, np.uint8))
                if size is not None:
                    sized.append(cls)
                    sizes.append(np.frombuffer(size, np.int32))
        s, code, cls = np.concatenate(seqs), np.concatenate(codes), np.concatenate(owners)
        order = np.lexsort((s, code, cls))
        s, code, cls = s[order], code[order], cls[order]
        new = np.r_[True, (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])] if len(s) else np.zeros(0, bool)
        s, cls = s[new], cls[new]
        known, first = np.unique(np.concatenate(sized), return_index=True)
        size = np.concatenate(sizes)[first].astype(np.int64)
        whose = np.searchsorted(known, cls)
        several = np.bincount(whose, minlength=len(known))
        begins = np.cumsum(several) - several
        pos = np.arange(len(s)) - begins[whose] + (size - several)[whose]
        p, q = THRESHOLD.numerator, THRESHOLD.denominator
        probe = np.minimum(size, size - -(-size * p // q) + SHARED)
        index = np.minimum(size, size - -(-size * 2 * p // (p + q)) + SHARED)
        inside = pos < probe[whose]
        held = np.flatnonzero(several)
        sets = [_six(s[b : b + n]) for b, n in zip(begins[held], several[held])]
        n, m = int(inside.sum()), len(held)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(s[inside].view(np.int64)), pa.nulls(m, pa.int64())]),
                pa.array(np.r_[cls[inside], known[held]]),
                pa.array(np.r_[size[whose][inside], size[held]].astype(np.int32)),
                pa.concat_arrays([pa.array(pos[inside].astype(np.int32)), pa.nulls(m, pa.int32())]),
                pa.array(np.r_[pos[inside] < index[whose][inside], np.zeros(m, bool)]),
                pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(sets, pa.binary())]),
            ],
            names=["seq", "cls", "size", "pos", "indexed", "shared"],
        )

    return letters.groupBy("bucket").applyInArrow(choose, "seq bigint, cls bigint, size int, pos int, indexed boolean, shared binary")


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs of classes that share enough prefix sequences under length and positional filters.

    Enough are ``SHARED``, or all that the threshold asks of a pair of smaller sets.
    """
    # size, position and whether it is indexed travel as one number
    at = F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("bigint"), 1)).bitwiseOR(F.col("indexed").cast("bigint"))
    packed = rows.select("seq", "cls", at.alias("at"))
    low = F.lit((1 << 31) - 1).cast("bigint")
    x = packed.select("seq", F.col("cls").alias("a"), F.col("at").alias("at_a"))
    y = packed.select("seq", F.col("cls").alias("b"), F.col("at").alias("at_b"))
    # overlap of at least (m + n) / 3 for a Jaccard similarity of one half, in whole numbers
    t = THRESHOLD
    p, q = t.numerator, t.numerator + t.denominator
    m, n = (F.shiftright(c, 32) for c in ("at_a", "at_b"))
    i, j = (F.shiftright(c, 1).bitwiseAND(low) for c in ("at_a", "at_b"))
    best = F.least(i, j) + 1 + F.least(m - i - 1, n - j - 1)
    # that the smaller set's member is indexed is asked with both sides: asked of one, it would go below the shuffle, which both sides then couldn't share
    near = (F.col("at_a").bitwiseAND(F.lit(1).cast("bigint")) * n > 0) & ((m < n) | ((m == n) & (F.col("a") < F.col("b")))) & (m * t.denominator >= n * t.numerator) & (best * q >= (m + n) * p)
    met = x.join(y, (x["seq"] == y["seq"]) & near).groupBy("a", "b").agg(F.count("*").alias("common"), F.first(m.cast("int")).alias("m"), F.first(n.cast("int")).alias("n"))
    least = F.least(F.lit(SHARED), F.ceil((F.col("m") + F.col("n")) * p / q))
    return met.where(F.col("common") >= least).select("a", "b", "m", "n")


def similar(a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD, sizes: tuple[int, int] | None = None) -> bool:
    """Whether two sets reach the threshold; the suffix filter goes first.

    ``a`` and ``b`` are sorted and may lack members the other can't have; ``sizes`` are then those of the whole sets.
    """
    m, n = sizes or (len(a), len(b))
    need = math.ceil(Fraction(m + n) * threshold / (1 + threshold))
    if min(len(a), len(b)) < need:
        return False
    edges = np.arange(1, 16, dtype=np.uint64) * np.uint64(1 << 44)
    ca = np.diff(np.r_[0, np.searchsorted(a, edges), len(a)])
    cb = np.diff(np.r_[0, np.searchsorted(b, edges), len(b)])
    if np.minimum(ca, cb).sum() < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _verified(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates that are similar; ``sets`` has ``cls`` and ``shared``: what two classes have in common lies in both."""
    left = sets.select(F.col("cls").alias("a"), F.col("shared").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("shared").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[bytes, np.ndarray] = {}

            def of(packed: bytes) -> np.ndarray:
                if packed not in memo:
                    memo[packed] = np.sort(_wide(packed))
                return memo[packed]

            good = [similar(of(a), of(b), sizes=(m, n)) for a, b, m, n in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return candidates.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b", "m", "n").mapInArrow(run, "a bigint, b bigint")


def prefix_rows(outline: DataFrame) -> DataFrame:
    """The prefixes and shared sets of all classes of an outline (see ``_prefixes``)."""
    spark = outline.sparkSession
    chunks = outline.where("seqs is not null").select("seqs", "classes", "runs", "heavy", "times")
    total = chunks.agg(F.coalesce(F.sum(F.octet_length("seqs") / 6), F.lit(0)).cast("bigint")).first()[0]
    hot = spark.sparkContext.broadcast(_hot(chunks, total))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD + 1)
    return _prefixes(_counted(_sharded(chunks, hot, shards), shards).unionByName(_sizes(chunks, hot, shards)))


def class_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id``, ``rep`` of every text that counts, and ``rep_a``, ``rep_b`` of similar classes.

    Both are written to the shared folder.
    """
    outline = staged(_outline(_counted_texts(nodes)), "outline")
    heads = latest_by(outline.where("seqs is null"), "id", "ord", "digest", "cls").where("digest is not null")
    heads = staged(heads, "heads")
    classes = staged(heads.groupBy("digest").agg(F.min("id").alias("rep"), F.first("cls").alias("cls")), "classes")
    members = staged(heads.join(classes.select("digest", "rep"), "digest").select("id", "rep"), "members")
    rows = staged(prefix_rows(outline), "prefixes")
    candidates = staged(_candidates(rows.where("seq is not null")), "candidates")
    # both joins share one shuffle of the sets
    links = _verified(candidates, rows.where("seq is null").select("cls", "shared"))
    # a class of rows that don't count has no representative
    rep = lambda c, name: classes.select(F.col("cls").alias(c), F.col("rep").alias(name))
    return members, staged(links.join(rep("a", "rep_a"), "a").join(rep("b", "rep_b"), "b").select("rep_a", "rep_b"), "similar")


def similar_pairs(nodes: DataFrame) -> DataFrame:
    """``id_a``, ``id_b`` (the smaller id first) of similar nodes."""
    members, links = class_links(nodes)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    listed = members.join(sizes, "rep").where((F.col("n") <= EXPAND) | (F.col("id") == F.col("rep"))).select("id", "rep")
    several = members.join(sizes.where("n > 1"), "rep")
    few = several.where(F.col("n") <= EXPAND)
    same = few.select("rep", F.col("id").alias("x")).join(few.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    many = several.where((F.col("n") > EXPAND) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    across = (
        links.join(listed.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), "rep_a").join(listed.select(F.col("rep").alias("rep_b"), F.col("id").alias("y")), "rep_b").select("x", "y")
    )
    return same.unionByName(many).unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(nodes: DataFrame) -> DataFrame:
    """One row per text that counts: ``node_id``, ``class_id`` (representative of its exact
    copies), ``group_id`` (smallest class of all it is linked to), ``links`` (of its class to others)."""
    members, links = class_links(nodes)
    parts = connected_components(links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")))
    degree = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        members.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select(F.col("id").alias("node_id"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
