"""Problem 3: the k most similar vectors of every vector, by vantage-point trees per shard.

A router, itself an unbalanced vantage-point tree fitted on a bounded sample,
cuts a collection into cells (its vantage points are centres of dense regions,
its radii lie in the sparsest shell around them, or halve what has none). Cells
that are still too large get a router of their own rows, and so on, until each
fits a block; so neither routers nor blocks grow with the collection. Rows meet
routers in a shuffle, nothing is broadcast. A query first asks the cell it lies
in, and with the distance of its k-th best there walks down from the root to the
other cells that the triangle inequality can't rule out. Each block builds a
vantage-point tree of its cell and answers its queries in batches.

Pruning is relaxed by ``relax``: a subtree is skipped if it begins farther than
``relax`` times the distance of the k-th best so far. One restores exact search;
smaller values trade recall for work. ``min_cosine`` bounds the distance from the
start, where only close neighbours are asked for.

Rows with equal vectors are each other's neighbours at distance zero: of each
distinct vector only the 2k smallest ids (k per node) can be anyone's
neighbours, and only they are searched, so copies that hold a third of all rows
cost nothing.

Defined results: null, all-zero and wrongly sized vectors (the model's name ends
in its dimension) and rows without a usable scale neither ask nor answer; a
repeated id counts once (its smallest vector in byte order); equal similarity is
ordered by id; an entry with fewer than k usable others has fewer neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import staged

K = 10
#: Rows of a cell that its router is fitted on (up to twice as many); every row is indexed.
SAMPLE_ROWS = 8_000
#: Rows of a cell that isn't parted any further; a cell and twice as many queries meet in one block.
CELL_ROWS = 8_192
#: Rows that meet a router at once.
ROUTE_ROWS = 1 << 16
#: Rows of a block of the brute-force search.
BLOCK_ROWS = 16_384
#: Rows of a tree's leaf.
LEAF_ROWS = 512
#: Error of an angle in single precision, at most (near zero).
ROUNDING = 1e-3
#: Default relaxation of the triangle inequality.
RELAX = 0.3
#: Relaxation where only close pairs are asked for.
PAIR_RELAX = 0.5
#: Stands between the steps of a cell's name.
_DOWN = "\x1f"
#: Default share that a shell may hold of the smaller side for a router split.
SHELL = 0.6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def angles(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Angles (a metric) between unit rows and unit points."""
    return np.arccos(np.clip(x @ v.T, -1, 1))


@dataclass
class Router:
    """Vantage points with radii; child >= 0 is a node, below 0 the leaf ~child."""

    points: np.ndarray
    radius: np.ndarray
    inner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)
    leaves: int = 1

    def walk(self, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Which leaves (columns) each row may have to visit, given distances to all points."""
        out = np.zeros((len(d), self.leaves), bool)
        if not len(self.inner):
            out[:] = True
            return out
        stack = [(0, np.arange(len(d)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows, ~node] = True
                continue
            x = d[rows, node]
            stack.append((self.inner[node], rows[x - slack[rows] <= self.radius[node]]))
            stack.append((self.outer[node], rows[x + slack[rows] > self.radius[node]]))
        return out

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds each unit row."""
        d = angles(x, self.points) if len(self.inner) else np.zeros((len(x), 0))
        return self.walk(d, np.zeros(len(x))).argmax(1)


def _best_shell(a: np.ndarray, least: int, slack: float) -> tuple[float, float]:
    """(badness, radius) of the sparsest shell that parts the angles into two sides."""
    a = np.sort(a)
    radii = np.arange(0.25, 1.75, 0.03)
    inside = np.searchsorted(a, radii)
    shell = np.searchsorted(a, radii + slack) - np.searchsorted(a, radii - slack)
    smaller = np.minimum(inside, len(a) - inside)
    bad = np.where(smaller >= least, shell / np.maximum(smaller, 1), np.inf)
    i = int(bad.argmin())
    return float(bad[i]), float(radii[i])


def fit_router(sample: np.ndarray, seed: int = 7, slack: float = 0.12, tries: int = 12, share: float = 1.0, most: int = CELL_ROWS) -> Router:
    """A router for a sample of unit rows, each of which stands for ``share`` rows.

    Sides are parted at sparse shells. A side that stands for more than ``most``
    rows is parted even where there is none: at the median angle to the vantage
    point whose angles differ most. One with fewer than a quarter of that stays whole.
    """
    rng = np.random.default_rng(seed)
    points: list[np.ndarray] = []
    radius: list[float] = []
    inner: list[int] = []
    outer: list[int] = []
    leaves = 0

    def vantage(rows: np.ndarray) -> tuple[np.ndarray, float] | None:
        x = sample[rows]
        least = max(24, len(sample) // 500)
        best = (np.inf, 0.0, None)
        if len(rows) >= 2 * least:
            for start in rng.choice(len(rows), min(tries, len(rows)), replace=False):
                centre = x[start]
                for _ in range(4):
                    d = angles(x, centre[None])[:, 0]
                    bad, r = _best_shell(d, least, slack)
                    if bad < best[0]:
                        best = (bad, r, centre)
                    near = d <= (r if np.isfinite(bad) else 1.2)
                    if near.sum() < 2:
                        break
                    centre = unit(x[near].mean(0))
        if best[0] <= SHELL:
            return best[2], best[1]
        if len(rows) * share <= most or len(rows) < 2:
            return None
        picks = x[rng.choice(len(rows), min(tries, len(rows)), replace=False)]
        d = angles(x, picks)
        i = int(d.std(0).argmax())
        return picks[i], float(np.median(d[:, i]))

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        found = vantage(rows) if len(rows) * share > most / 4 else None
        near = angles(sample[rows], found[0][None])[:, 0] <= found[1] if found else None
        if found is None or near.all() or not near.any():
            leaves += 1
            return ~(leaves - 1)
        node = len(points)
        points.append(found[0])
        radius.append(found[1])
        inner.append(0)
        outer.append(0)
        inner[node] = grow(rows[near])
        outer[node] = grow(rows[~near])
        return node

    grow(np.arange(len(sample)))
    dims = sample.shape[1] if sample.ndim == 2 else 0
    return Router(unit(np.array(points, np.float64).reshape(-1, dims)), np.array(radius), inner, outer, leaves)


class VantageTree:
    """A vantage-point tree over a block's rows that answers queries in batches."""

    def __init__(self, raw: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> None:
        self.raw = raw.astype(np.float32)
        self.norm = np.linalg.norm(self.raw.astype(np.float64), axis=1)
        self.leaf_rows = leaf_rows
        self.rng = np.random.default_rng(seed)
        x = (self.raw / self.norm[:, None]).astype(np.float32)
        self.root = self._grow(x, np.arange(len(raw)))

    def _grow(self, x: np.ndarray, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            return rows
        picks = self.rng.choice(len(rows), min(5, len(rows)), replace=False)
        d = angles(x[rows], x[rows[picks]])
        best = d.std(0).argmax()
        d, v = d[:, best], x[rows[picks[best]]]
        mu = np.median(d)
        near = d <= mu
        if near.all() or not near.any():
            return rows
        bounds = (d[near].min(), d[near].max(), d[~near].min(), d[~near].max())
        return (v, bounds, self._grow(x, rows[near]), self._grow(x, rows[~near]))

    def search(self, queries: np.ndarray, node: np.ndarray, own: np.ndarray, k: int, relax: float, max_angle: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, row) of the k best of each query, -2 where there are fewer; rows of the query's own node are left out.

        ``max_angle`` may be one for each query. Of equal cosines the smaller rows come first, so rows in the order of their ids give ties by id.
        """
        raw = queries.astype(np.float32)
        norms = np.linalg.norm(raw.astype(np.float64), axis=1)
        q = (raw / norms[:, None]).astype(np.float32)
        self.best = np.full((len(q), k), -2.0)
        self.who = np.full((len(q), k), -1, np.int64)
        max_angle = np.broadcast_to(max_angle, len(q))
        self.floor = np.cos(max_angle) - 1e-9
        self._visit(self.root, q, raw, norms, node, own, np.arange(len(q)), k, relax, max_angle)
        return self.best, self.who

    def _visit(self, tree, q, raw, norms, node, own, at, k, relax, max_angle) -> None:
        if not len(at):
            return
        if isinstance(tree, np.ndarray):
            for part in np.array_split(at, len(at) // 2048 + 1):
                self._leaf(tree, raw, norms, node, own, part, k)
            return
        v, (lo_in, hi_in, lo_out, hi_out), inside, outside = tree
        d = angles(q[at], v[None])[:, 0]
        gap_in = np.maximum(np.maximum(lo_in - d, d - hi_in), 0)
        gap_out = np.maximum(np.maximum(lo_out - d, d - hi_out), 0)
        first = gap_in <= gap_out
        for child, gap, mask in ((inside, gap_in, first), (outside, gap_out, ~first), (outside, gap_out, first), (inside, gap_in, ~first)):
            rows = at[mask]
            if len(rows):
                worst = np.arccos(np.clip(self.best[rows, -1], -1, 1))
                reach = np.where(self.best[rows, -1] > -2, np.minimum(worst, max_angle[rows]), max_angle[rows])
                self._visit(child, q, raw, norms, node, own, rows[gap[mask] <= relax * reach + ROUNDING], k, relax, max_angle)

    def _leaf(self, rows, raw, norms, node, own, at, k) -> None:
        # whole numbers below 2^24 in single precision: the products are exact
        s = (raw[at] @ self.raw[rows].T).astype(np.float64)
        s /= self.norm[rows][None]
        s /= norms[at][:, None]
        s[own[at][:, None] == node[rows][None]] = -2
        np.putmask(s, s < self.floor[at][:, None], -2)
        keep = min(k, len(rows))
        most = s.max(1) if keep else np.full(len(at), -2.0)
        hot = np.flatnonzero((most >= self.best[at, -1]) & (most > -2))
        if not len(hot):
            return
        s, at = s[hot], at[hot]
        if keep < len(rows):
            top = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            last = np.take_along_axis(s, top, 1).min(1)[:, None]
            for i in np.flatnonzero((s >= last).sum(1) > keep):
                # a tie at the cut goes to the smallest rows (a leaf's are in order)
                above, equal = np.flatnonzero(s[i] > last[i]), np.flatnonzero(s[i] == last[i])
                top[i] = np.r_[above, equal[: keep - len(above)]]
        else:
            top = np.tile(np.arange(len(rows)), (len(at), 1))
        both = np.concatenate([self.best[at], np.take_along_axis(s, top, 1)], 1)
        who = np.concatenate([self.who[at], rows[top]], 1)
        order = np.lexsort((who, -both), axis=1)[:, :k]
        self.best[at] = np.take_along_axis(both, order, 1)
        self.who[at] = np.take_along_axis(who, order, 1)


def usable_entries(entries: DataFrame) -> DataFrame:
    """``id``, ``node_id``, ``model``, ``vector`` of rows that can ask and answer, each id once."""
    dims = F.regexp_extract("model", r"(\d+)$", 1).try_cast("int")
    good = entries.where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & (F.octet_length("vector") == dims)
        & F.regexp_replace(F.hex("vector"), "0", "").rlike(".")
        & F.col("scale").isNotNull()
        & ~F.isnan("scale")
        & (F.col("scale") > 0)
    )
    return good.groupBy("id").agg(F.min(F.struct("vector", F.coalesce("node_id", F.lit("")).alias("node_id"), "model")).alias("r")).select("id", "r.node_id", "r.model", "r.vector")


def _stack(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.int8).reshape(len(parts), -1).astype(np.float32) if parts else np.zeros((0, 1), np.float32)


_ROW = "cell string, id string, node_id string, vector binary, asks boolean, bound double"
_NAMES = ["cell", "id", "node_id", "vector", "asks", "bound"]


def _fit(rows: DataFrame, most: int) -> DataFrame:
    """``cell``, ``router`` of each cell of more than ``most`` rows that can be parted, from ``SAMPLE_ROWS`` of its rows by hash."""
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
    some = rows.join(sizes, "cell").where(F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), (F.col("n") / SAMPLE_ROWS).cast("bigint"))) == 0)

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        # thinning leaves up to twice as many
        table = table.sort_by("id").slice(0, 2 * SAMPLE_ROWS)
        router = fit_router(unit(_stack(table.column("vector").combine_chunks()).astype(np.float64)), share=table.column("n")[0].as_py() / len(table), most=most)
        made = [(key[0].as_py(), pickle.dumps(router))] if router.leaves > 1 else []
        return pa.table([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["cell", "router"])

    return some.select("cell", "id", "vector", "n").groupBy("cell").applyInArrow(fit, "cell string, router binary")


def _route(rows: DataFrame, routers: DataFrame) -> DataFrame:
    """``rows`` of cells that have a router, with the cells below: the one a row lies in or, where ``bound`` is given, all
    that it can't rule out. Rows meet the router of their cell in portions of bounded size."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(ROUTE_ROWS)).cast("int").alias("parts"))
    known = routers.join(parts, "cell")
    salted = rows.join(known.select("cell", "parts"), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    guides = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = salted.select(*_NAMES, "salt", F.lit(None).cast("binary").alias("router")).unionByName(guides.select("cell", "salt", "router"), allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        guide = table.column("router").is_valid()
        router = pickle.loads(table.filter(guide).column("router")[0].as_py())
        table = table.filter(pc.invert(guide)).select(_NAMES)
        x = unit(_stack(table.column("vector").combine_chunks()).astype(np.float64)) if len(table) else np.zeros((0, router.points.shape[1]))
        bound = np.array(table.column("bound").to_pylist(), float)  # null becomes nan
        d = angles(x, router.points)
        row, leaf = np.nonzero(router.walk(d, np.where(np.isnan(bound), 0.0, bound)))
        cell = key[0].as_py()
        names = np.array([f"{cell}{_DOWN}{i}" for i in range(router.leaves)], object)
        return table.take(pa.array(row)).set_column(0, "cell", pa.array(names[leaf], pa.string()))

    return met.groupBy("cell", "salt").applyInArrow(run, _ROW)


def _answer(k: int, relax: float):
    """Within one cell, the k best of each asking row among the rows held."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        asks, held = (np.array(table.column(c).to_pylist(), bool) for c in ("asks", "held"))
        ids = np.array(table.column("id").to_pylist(), object)
        _, node = np.unique(np.array(table.column("node_id").to_pylist(), object).astype(str), return_inverse=True)
        out_id: list[str] = []
        hits: list[list[dict]] = []
        if asks.any() and held.any():
            x = _stack(table.column("vector").combine_chunks())
            bound = np.array(table.column("bound").to_pylist(), float)[asks]
            best, who = VantageTree(x[held]).search(x[asks], node[held], node[asks], k, relax, bound)
            held_ids = ids[held]
            for i, name in enumerate(ids[asks]):
                found = [{"c": -float(c), "i": held_ids[j]} for c, j in zip(best[i], who[i]) if c > -2]
                if found:
                    out_id.append(name)
                    hits.append(found)
        kind = pa.list_(pa.struct([("c", pa.float64()), ("i", pa.string())]))
        return pa.table([pa.array(out_id, pa.string()), pa.array(hits, kind)], names=["id", "hits"])

    return run


def nearest(entries: DataFrame, k: int = K, relax: float = RELAX, min_cosine: float = -1.0, asking: Column | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The ``k`` most similar entries of each usable entry (of those for which ``asking`` holds).

    Result: ``id``, ``rank`` (from 1), ``neighbour``, ``cosine``; neighbours have
    the same model and another node, and at least ``min_cosine``.
    """
    rows = staged(usable_entries(entries), "vectors")
    same = Window.partitionBy("model", "vector", "node_id").orderBy("id")
    # one query per (vector, node): its smallest id asks for all
    capped = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).withColumn("asks", F.col("_r") == 1).drop("_r")
    kept = capped.withColumn("_r", F.row_number().over(Window.partitionBy("model", "vector").orderBy("id"))).where(F.col("_r") <= 2 * k).drop("_r")
    if asking is not None:
        chosen = rows.where(asking)
        kept = kept.join(chosen.select("model", "vector", "node_id").distinct().withColumn("_chosen", F.lit(True)), ["model", "vector", "node_id"], "left")
        kept = kept.withColumn("asks", F.col("asks") & F.coalesce("_chosen", F.lit(False))).drop("_chosen")
    kept = staged(kept, "distinct-vectors")
    asked = rows if asking is None else rows.where(asking)
    max_angle = float(np.arccos(np.clip(min_cosine, -1, 1)))

    # cells are parted until each fits a block; a cell's router is fitted on its own rows
    nowhere = F.lit(None).cast("double").alias("bound")
    open_ = kept.select(F.col("model").alias("cell"), "id", "node_id", "vector", "asks", nowhere)
    closed: list[DataFrame] = []
    levels: list[DataFrame] = []
    while True:
        routers = staged(_fit(open_, cell_rows), "routers")
        if routers.isEmpty():
            closed.append(open_)
            break
        closed.append(open_.join(routers.select("cell"), "cell", "left_anti").select(_NAMES))
        open_ = staged(_route(open_, routers), "cells")
        levels.append(routers)
    held = closed[0]
    for more in closed[1:]:
        held = held.unionByName(more)
    held = staged(held, "held") if levels else held
    held = held.withColumn("held", F.lit(True))

    answer = _answer(k, relax)
    hit = "id string, hits array<struct<c:double,i:string>>"
    anywhere = F.lit(max_angle)
    first = staged(held.withColumn("bound", anywhere).groupBy("cell").applyInArrow(answer, hit), "first")
    # the k-th best so far bounds the way to other cells; where there are fewer, nothing but min_cosine does
    merged = first
    if levels:
        kth = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.element_at("hits", k)["c"])))
        bound = F.when(F.size("hits") >= k, F.least(kth, anywhere)).otherwise(anywhere)
        queries = held.where("asks").withColumnRenamed("cell", "home").join(first.select("id", bound.alias("reach")), "id", "left").withColumn("reach", F.coalesce("reach", anywhere))
        queries = staged(queries.select("home", "id", "node_id", "vector", "asks", "reach"), "queries")
        far = queries.select(F.split("home", _DOWN)[0].alias("cell"), "id", "node_id", "vector", "asks", (F.col("reach") * relax + F.lit(1e-6)).alias("bound"))
        ends: list[DataFrame] = []
        for routers in levels:
            ends.append(far.join(routers.select("cell"), "cell", "left_anti").select(_NAMES))
            far = staged(_route(far, routers), "visits")
        visits = far
        for more in ends[1:]:
            visits = visits.unionByName(more)
        visits = visits.select("cell", "id", "node_id", "vector").join(queries.select("id", "home", F.col("reach").alias("bound")), "id").where("cell <> home")
        visits = staged(visits.select("cell", "id", "node_id", "vector", "bound"), "asked")
        parts = visits.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * cell_rows)).cast("int").alias("parts"))
        others = held.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        guests = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        shape = ["cell", "part", "id", "node_id", "vector"]
        met = others.select(*shape, F.lit(False).alias("asks"), F.lit(True).alias("held"), nowhere).unionByName(guests.select(*shape, F.lit(True).alias("asks"), F.lit(False).alias("held"), "bound"))
        second = met.groupBy("cell", "part").applyInArrow(answer, hit)
        merged = first.unionByName(second).groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
        merged = staged(merged, "merged")

    # copies: entries of a (vector, node) share its answer; nodes beyond the kept ones take the kept ids
    askers = kept.where("asks").select("id", "model", "vector", "node_id")
    copies = asked.join(askers.select("id"), "id", "left_anti")
    inner = askers.withColumnRenamed("id", "asker")
    shared = copies.join(inner, ["model", "vector", "node_id"], "left")
    through = shared.where("asker is not null").select("id", "asker").join(merged.withColumnRenamed("id", "asker"), "asker").select("id", "hits")
    full = kept.groupBy("model", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") >= 2 * k)
    full = full.select("model", "vector", F.transform(F.slice("ids", 1, k), lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("i"))).alias("hits"))
    beyond = shared.where("asker is null").join(full, ["model", "vector"]).select("id", "hits")
    listed = merged.join(asked.select("id"), "id", "left_semi") if asking is not None else merged
    listed = listed.unionByName(through).unionByName(beyond)
    return listed.select("id", F.posexplode("hits").alias("rank", "h")).select(
        "id", (F.col("rank") + 1).alias("rank"), F.col("h.i").alias("neighbour"), F.round(-F.col("h.c"), 9).alias("cosine")
    )


def mutual_pairs(entries: DataFrame, k: int = K, min_cosine: float = 0.9, relax: float = PAIR_RELAX, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``entry_a``, ``entry_b``: entries among each other's ``k`` most similar with at least ``min_cosine``."""
    near = staged(nearest(entries, k, relax, min_cosine - 1e-9, cell_rows=cell_rows).where(F.col("cosine") >= min_cosine).select("id", "neighbour"), "near")
    back = near.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    return near.join(back, ["id", "neighbour"], "left_semi").where("id < neighbour").select(F.col("id").alias("entry_a"), F.col("neighbour").alias("entry_b"))


def divisible(id_: str, by: int = 50) -> Column:
    """Whether a hexadecimal id is a number divisible by ``by``."""
    total = F.lit(0).cast("bigint")
    for at in range(1, 33, 8):
        piece = F.conv(F.substring(id_, at, 8), 16, 10).cast("bigint")
        total = F.pmod(total * F.lit(16**8 % by) + piece, F.lit(by))
    return total == 0


def brute_force(entries: DataFrame, k: int = K, asking: Column | None = None) -> DataFrame:
    """As ``nearest`` for a stated set of queries, against all rows in blocks; for measuring recall."""
    rows = staged(usable_entries(entries), "vectors")
    asked = rows if asking is None else rows.where(asking)
    blocks = asked.count() // 2048 + 1
    q = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("model", "b").agg(F.collect_list(F.struct("id", "node_id", "vector")).alias("qs"))
    parts = rows.count() // BLOCK_ROWS + 1
    held = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = held.select("model", "h", "b", F.lit(False).alias("asks"), "id", "node_id", "vector").unionByName(
        q.select("model", "b", F.explode("qs").alias("q")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("model", "h", "b", F.lit(True).alias("asks"), "q.id", "q.node_id", "q.vector")
    )

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids = np.array(table.column("id").to_pylist(), object)
        node = np.array(table.column("node_id").to_pylist(), object)
        x = _stack(table.column("vector").combine_chunks())
        out: list[tuple[str, float, str]] = []
        if asks.any() and not asks.all():
            norm = np.linalg.norm(x.astype(np.float64), axis=1)
            s = (x[asks] @ x[~asks].T).astype(np.float64) / norm[~asks][None] / norm[asks][:, None]
            s[node[asks][:, None] == node[~asks][None]] = -2
            held_ids = ids[~asks]
            for i, name in enumerate(ids[asks]):
                out += [(name, -s[i, j], held_ids[j]) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] > -2]
        return pa.table([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.string())], names=["id", "c", "i"])

    found = met.groupBy("model", "h", "b").applyInArrow(answer, "id string, c double, i string")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("c", "i"))).where(F.col("rank") <= k)
    return best.select("id", "rank", F.col("i").alias("neighbour"), F.round(-F.col("c"), 9).alias("cosine"))


def recall(entries: DataFrame, k: int = K, relax: float = RELAX, min_cosine: float = -1.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: queries (ids divisible by 50), neighbours expected (of at least ``min_cosine``), and the share ``nearest`` finds."""
    asking = divisible("id")
    truth = brute_force(entries, k, asking).where(F.col("cosine") >= min_cosine)
    got = nearest(entries, k, relax, min_cosine - 1e-9, asking, cell_rows).select("id", "neighbour").withColumn("hit", F.lit(1))
    return truth.join(got, ["id", "neighbour"], "left").agg(
        F.countDistinct("id").alias("queries"), F.count("*").alias("expected"), F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)), 4).alias("recall")
    )
