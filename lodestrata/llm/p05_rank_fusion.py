"""Problem 5: one ranking from several scores on different scales.

Robust rank aggregation. Each source's scores become normalised ranks within
the query (equal scores share the mean of their places, so each gets equal
credit); an item's ranks are sorted, the k-th smallest of n is weighed by the
probability that the k-th order statistic of n uniform ranks is as small (a beta
distribution), and the least of these, corrected for having looked at n of
them, is the item's significance. Items are ordered by it.

Defined results: null and NaN scores count as missing; a missing score takes
the worst place, shared by all that miss it; of repeated rows the highest score
counts; a source in which all candidates are alike is left out for the query,
and where that leaves no source all candidates are equal; equal significance is
ordered by the product of the ranks, then by id. A query without candidates
gives no row; rows with a null query or node are dropped.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.slices import HOT_ROWS, running_before, with_slices
from lodestrata.session import staged


def significance(ranks: Column, sources: int) -> Column:
    """The corrected least beta probability of an array of normalised ranks, at most ``sources`` long."""

    def of(n: int) -> Column:
        terms = []
        for k in range(1, n + 1):
            r = F.element_at("_sorted_ranks", k)
            at_least_k = sum((F.lit(float(comb(n, j))) * F.pow(r, j) * F.pow(F.lit(1.0) - r, n - j) for j in range(k, n + 1)), F.lit(0.0))
            terms.append(at_least_k)
        least = terms[0] if n == 1 else F.least(*terms)
        return F.least(F.lit(1.0), least * n)

    result = F.lit(1.0)
    for n in range(1, sources + 1):
        result = F.when(F.size(ranks) == n, of(n)).otherwise(result)
    return result


def _places(scores: DataFrame, query: str, sources: list[str]) -> DataFrame:
    """``scores`` with, per source, the mean place of equal scores, and what the query as a whole says; one shuffle by query."""
    whole = Window.partitionBy(query)
    added = {"_items": F.count("*").over(whole)}
    for s in sources:
        # places are counted from the front; rows without a score come after all others
        ordered, alike = Window.partitionBy(query).orderBy(F.col(s).desc_nulls_last()), Window.partitionBy(query, s)
        added |= {
            f"_n_{s}": F.count(s).over(whole),
            f"_spread_{s}": F.coalesce(F.max(s).over(whole) > F.min(s).over(whole), F.lit(False)),
            f"_place_{s}": F.when(F.col(s).isNotNull(), F.rank().over(ordered) + (F.count("*").over(alike) - 1) / 2),
        }
    return scores.withColumns(added)


def _places_in_slices(scores: DataFrame, query: str, item: str, sources: list[str]) -> DataFrame:
    """As ``_places`` for queries too large for one task: places are counted in slices of the scores' order."""
    totals = scores.groupBy(query).agg(
        F.count("*").alias("_items"),
        *(F.count(s).alias(f"_n_{s}") for s in sources),
        *(F.coalesce(F.max(s) > F.min(s), F.lit(False)).alias(f"_spread_{s}") for s in sources),
    )
    placed = scores.join(totals, query)
    for s in sources:
        distinct = scores.where(F.col(s).isNotNull()).groupBy(query, s).agg(F.count("*").alias("n"))
        places = running_before(with_slices(distinct, [query], s, hot_rows=0), [query], s, "n", "above", descending=True)
        placed = placed.join(places.select(query, s, (F.col("above") + (F.col("n") + 1) / 2).alias(f"_place_{s}")), [query, s], "left")
    return placed


def aggregate_ranks(scores: DataFrame, query: str, item: str, sources: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ranking of ``scores``: one row per (query, item), a nullable double per source.

    Result: ``query``, ``item``, ``significance``, ``rank_product``. The sources
    of an item stay in one row. A query of more than ``hot_rows`` items is cut
    into slices, with the same result.
    """
    hot = staged(scores.groupBy(query).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select(query), "hot-queries")
    if hot.isEmpty():
        placed = _places(scores, query, sources)
    else:
        rest = _places(scores.join(hot, query, "left_anti"), query, sources)
        placed = rest.unionByName(_places_in_slices(scores.join(hot, query, "left_semi"), query, item, sources).select(rest.columns))
    ranks = []
    for s in sources:
        n, items = F.col(f"_n_{s}"), F.col("_items")
        tells = F.col(f"_spread_{s}") | ((n > 0) & (n < items))
        ranks.append(F.when(tells, F.coalesce(F.col(f"_place_{s}"), n + (items - n + 1) / 2) / items))
    told = placed.select(query, item, F.sort_array(F.array_compact(F.array(*ranks))).alias("_sorted_ranks"))
    return told.select(
        query,
        item,
        significance(F.col("_sorted_ranks"), len(sources)).alias("significance"),
        F.aggregate("_sorted_ranks", F.lit(1.0), lambda a, r: a * r).alias("rank_product"),
    )


def candidate_scores(queries: DataFrame, results: DataFrame, hits: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id``, ``node_id`` and the highest ``result``, ``hit`` and ``related`` score of each candidate.

    Candidates are the nodes in a query's results and hits. Partial maxima are
    taken before the shuffle; the edges meet only candidates of their query.
    """
    known = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    scored = (
        results.select("query_id", "node_id", known.alias("result"), F.lit(None).cast("double").alias("hit"))
        .unionByName(hits.select("query_id", "node_id", F.lit(None).cast("double").alias("result"), known.alias("hit")))
        .where("query_id is not null and node_id is not null")
        .groupBy("query_id", "node_id")
        .agg(F.max("result").alias("result"), F.max("hit").alias("hit"))
    )
    seeds = queries.where("query_id is not null").groupBy("query_id").agg(F.max("seed_id").alias("seed_id"))
    weight = F.when(F.isnan("weight"), None).otherwise(F.col("weight"))
    related = (
        edges.where("edge_type = 'RELATED' and src is not null and dst is not null")
        .join(seeds.select(F.col("seed_id").alias("src")).distinct(), "src", "left_semi")
        .groupBy("src", "dst")
        .agg(F.max(weight).alias("related"))
    )
    return (
        scored.join(seeds, "query_id")
        .join(related, (F.col("seed_id") == F.col("src")) & (F.col("node_id") == F.col("dst")), "left")
        .select("query_id", "node_id", "result", "hit", "related")
    )


def rank_candidates(queries: DataFrame, results: DataFrame, hits: DataFrame, edges: DataFrame) -> DataFrame:
    """All candidates of all queries with their significance."""
    scores = staged(candidate_scores(queries, results, hits, edges), "scores")
    return aggregate_ranks(scores, "query_id", "node_id", ["result", "hit", "related"])


def first_candidates(ranked: DataFrame) -> DataFrame:
    """``query_id``, ``node_id`` of the candidate that comes first; partial minima before the shuffle."""
    return ranked.groupBy("query_id").agg(F.min(F.struct("significance", "rank_product", "node_id")).alias("_first")).select("query_id", "_first.node_id")
