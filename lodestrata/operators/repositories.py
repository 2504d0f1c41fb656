"""State of managed repositories: what is due, what changed, counters of a refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = (
    "slug string, url string, local_path string, default_branch string, visibility string, indexed_commit string, files int, functions int, "
    "last_checked_at string, last_indexed_at string, error string"
)


def due(state: DataFrame, now: str, hours: int = 24, force: bool = False) -> DataFrame:
    """``due``: not checked for ``hours`` before ``now`` (ISO text), or never, or forced; ``failed``: has an error."""
    passed = F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.try_to_timestamp(F.col("last_checked_at")))
    late = F.coalesce(passed >= F.lit(hours * 3_600_000_000), F.lit(True))
    return state.withColumn("due", F.lit(True) if force else late).withColumn("failed", F.col("error").isNotNull())


def changed(state: DataFrame, heads: DataFrame) -> DataFrame:
    """Repositories whose head commit (``slug``, ``commit``) isn't the indexed one."""
    return state.join(heads, "slug").where(~F.col("commit").eqNullSafe(F.col("indexed_commit")))


def merge_state(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``fresh`` rows replace those of their slug; a failed one keeps its commit and counts."""
    old = state.select("slug", *(F.col(c).alias("_" + c) for c in ("indexed_commit", "files", "functions", "last_indexed_at")))
    kept = fresh.join(old, "slug", "left")
    for c in ("indexed_commit", "files", "functions", "last_indexed_at"):
        kept = kept.withColumn(c, F.when(F.col("error").isNotNull(), F.coalesce(F.col("_" + c), F.col(c))).otherwise(F.col(c)))
    return kept.select(state.columns).unionByName(state.join(fresh.select("slug"), "slug", "left_anti").select(state.columns))


def ordered(state: DataFrame, ranks: DataFrame) -> DataFrame:
    """By activity rank (``slug``, ``rank``); unknown repositories last."""
    return state.join(ranks, "slug", "left").withColumn("rank", F.coalesce("rank", F.lit(999))).orderBy("rank", "slug")


def totals(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("repositories"), F.count("error").alias("failed"), F.sum("files").alias("files"), F.sum("functions").alias("functions"))


def refresh_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``updated``, ``unchanged``, ``failed`` of a refresh."""
    both = after.join(before.select("slug", F.col("indexed_commit").alias("_c")), "slug", "left")
    same = F.col("indexed_commit").eqNullSafe(F.col("_c"))
    ok = F.col("error").isNull()
    return both.agg(F.count(F.when(ok & ~same, 1)).alias("updated"), F.count(F.when(ok & same, 1)).alias("unchanged"), F.count("error").alias("failed"))


def refresh_each(slugs: list[str], work: Callable[[str], None]) -> dict[str, str | None]:
    """Runs ``work`` per repository; one that fails doesn't stop the others. The checkout itself is a step outside Spark."""
    outcome: dict[str, str | None] = {}
    for slug in slugs:
        try:
            work(slug)
            outcome[slug] = None
        except Exception as e:
            outcome[slug] = str(e) or type(e).__name__
    return outcome
