"""Problem 9: fill packs of fixed capacity with documents of known token count.

Non-negative least squares over the length histogram: shallow combinations
(one, two or three lengths) that fill a window below the capacity are the
columns, the histogram is the right side, and the solution says how often each
combination is used. Repeats are rounded down to what the histogram holds; the
lengths left over are packed greedily, largest first, also as combinations with
repeats. All of this happens on the histogram, which has at most ``capacity``
entries whatever the number of documents; documents meet their packs through
their rank among those of equal length.

Defined results: a document without tokens (null or empty text) is in no pack;
one longer than the capacity is cut into full pieces and a rest, and only such
a document is in more than one pack; equal lengths are interchangeable and are
ranked by (block of the id, id). Repeated ids are items of their own. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.p08_tokenize import token_counts
from lodestrata.session import staged

#: Room below the capacity that a combination may leave.
FILL_WINDOW = 16
#: Choices of the middle length in a combination of three.
MIDDLE_CHOICES = 48
#: Steps of the non-negative least squares iteration.
NNLS_STEPS = 150
#: Rows in a block within which equal lengths are numbered.
BLOCK_ROWS = 200_000


@dataclass
class PackPlan:
    """Runs of equal packs, by length: rank ``first[length][i]`` opens run i."""

    first: dict[int, np.ndarray]
    pack: dict[int, np.ndarray]
    packs: int


def combinations(lengths: np.ndarray, capacity: int, window: int = FILL_WINDOW) -> np.ndarray:
    """Rows of one to three lengths (0 pads) whose sum lies within ``window`` of the capacity."""
    lengths = np.sort(lengths)
    rows = [np.array([[x, 0, 0]]) for x in lengths[lengths >= capacity - window]]
    for a in lengths[::-1]:
        rest = capacity - a
        lo, hi = np.searchsorted(lengths, [rest - window, rest + 1])
        b = lengths[max(lo, 0) : hi]
        b = b[(b <= a) & (b > 0)]
        if len(b):
            rows.append(np.stack([np.full(len(b), a), b, np.zeros(len(b), int)], 1))
        b = lengths[(lengths <= a) & (lengths < rest)]
        if not len(b):
            continue
        b = b[np.unique(np.linspace(0, len(b) - 1, MIDDLE_CHOICES).astype(int))]
        at = np.searchsorted(lengths, rest - b, side="right") - 1
        c = np.where(at >= 0, lengths[at], 0)
        good = (c > 0) & (c <= b) & (a + b + c >= capacity - window)
        if good.any():
            rows.append(np.stack([np.full(good.sum(), a), b[good], c[good]], 1))
    return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), int)


def nnls_repeats(combos: np.ndarray, histogram: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the combinations' lengths close to the histogram.

    Projected, row- and column-scaled gradient steps on the squared residual;
    a combination touches at most three rows, so a step is two gathers.
    """
    top = len(histogram)
    b = histogram.astype(float)
    b[0] = 0
    used = (combos > 0).astype(float)
    row_sum = np.bincount(combos.ravel(), weights=used.ravel(), minlength=top)
    row_scale = np.where(row_sum > 0, 1 / np.maximum(row_sum, 1), 0)
    col_scale = 1 / np.maximum(used.sum(1), 1)
    x = np.zeros(len(combos))
    for _ in range(steps):
        held = np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=top)
        pull = (b - held) * row_scale
        pull[0] = 0
        x = np.maximum(0, x + col_scale * pull[combos].sum(1) * 1.5)
    return x


def plan_packs(histogram: np.ndarray, capacity: int) -> PackPlan:
    """Runs of packs that hold exactly ``histogram[n]`` items of each length n from 1 to capacity."""
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    combos = combinations(lengths[lengths > 0], capacity)
    if len(combos):
        x = nnls_repeats(combos, left)
        for i in np.argsort(-x, kind="stable"):
            n = int(x[i] + 1e-6)
            if n < 1:
                break
            members = tuple(int(v) for v in combos[i] if v)
            for v in set(members):
                n = min(n, int(left[v]) // members.count(v))
            if n > 0:
                runs.append((members, n))
                for v in members:
                    left[v] -= n
    while len(present := np.flatnonzero(left)):
        members, room, take = [], capacity, left.copy()
        while room > 0:
            fits = present[(present <= room) & (take[present] > 0)]
            if not len(fits):
                break
            v = int(fits[-1])
            n = min(int(take[v]), room // v)
            members += [v] * n
            take[v] -= n
            room -= v * n
        used = np.unique(members, return_counts=True)
        repeats = int(min(left[v] // n for v, n in zip(*used)))
        runs.append((tuple(members), repeats))
        for v, n in zip(*used):
            left[v] -= n * repeats
    first: dict[int, list[int]] = {}
    pack: dict[int, list[int]] = {}
    reached = np.zeros(len(histogram), np.int64)
    base = 0
    for members, n in runs:
        for v in members:
            first.setdefault(v, []).append(int(reached[v]))
            pack.setdefault(v, []).append(base)
            reached[v] += n
        base += n
    return PackPlan({v: np.array(a) for v, a in first.items()}, {v: np.array(a) for v, a in pack.items()}, base)


def pack_counts(counts: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Packs for rows of ``key`` and ``n_tokens``.

    Result: ``key``, ``piece_no`` (from 0), ``n_tokens`` (of the piece),
    ``pack_id`` (from 0). The rows are numbered within (length, block) so that
    a length which a third of all documents have is spread over many tasks.
    """
    pieces = counts.where("n_tokens > 0").select(
        F.col(key),
        F.posexplode(
            F.expr(f"transform(sequence(0, cast((n_tokens - 1) div {capacity} as int)), i -> cast(least({capacity}, n_tokens - i * {capacity}) as int))")
        ).alias("piece_no", "size"),
    )
    by_size = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in by_size.items():
        histogram[size] = n
    plan = counts.sparkSession.sparkContext.broadcast(plan_packs(histogram, capacity))
    blocks = int(max(by_size.values(), default=0)) // BLOCK_ROWS + 1
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64(F.col(key), "piece_no"), F.lit(blocks)))
    within = Window.partitionBy("size", "block").orderBy(F.col(key), "piece_no")
    ranked = pieces.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    if blocks > 1:
        filled = pieces.groupBy("size", "block").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = filled.select("size", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        ranked = ranked.join(offsets, ["size", "block"]).withColumn("rank", F.col("rank") + F.col("before"))
    kind = dict(counts.dtypes)[key]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            size = batch.column(2).to_numpy(zero_copy_only=False)
            rank = batch.column(3).to_numpy(zero_copy_only=False)
            out = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(group):
                    v = int(size[group[0]])
                    run = np.searchsorted(p.first[v], rank[group], side="right") - 1
                    out[group] = p.pack[v][run] + rank[group] - p.first[v][run]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(out)], names=[key, "piece_no", "n_tokens", "pack_id"]
            )

    return ranked.select(key, "piece_no", "size", "rank").mapInArrow(place, f"`{key}` {kind}, piece_no int, n_tokens int, pack_id bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Packs of all ``docs`` (``doc_id``, ``text``) by the tokenizer of problem 8.

    The counts are written once to the shared folder; they are read for the
    histogram and again for the numbering.
    """
    return pack_counts(staged(token_counts(docs, vocabulary=vocabulary), "token-counts"), capacity)


def over_capacity(packed: DataFrame) -> DataFrame:
    """Ids that are spread over several packs."""
    return packed.where("piece_no = 1").select("doc_id").distinct()


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: packs, tokens, and the share of the packs' room in use."""
    fills = packed.groupBy("pack_id").agg(F.sum("n_tokens").alias("used"))
    return fills.agg(
        F.count("*").alias("packs"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 4).alias("fill"),
    )
