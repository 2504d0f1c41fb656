"""Retrieval quality: cases against ranked results, all cases in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import lexical

CASE = (
    "id string, question string, expectedFacts array<string>, goldSourceIDs array<string>, goldSourcePaths array<string>, expectedNodeTypes array<string>, "
    "forbiddenClaims array<string>, tags array<string>, minimumGoldSources int"
)
METRICS = "recall_at_1 recall_at_5 reciprocal_rank fact_coverage forbidden_rate redundancy passes".split()


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a suite file; raises on what no suite may be."""
    fields = ", ".join(p.replace(" ", ":", 1) for p in CASE.split(", "))
    whole = spark.read.schema(f"version int, name string, createdAt string, cases array<struct<{fields}>>").json(path, multiLine=True)
    version = whole.select("version").first()
    if version is None or version[0] != 1:
        raise ValueError("a suite has version 1")
    return validate(whole.select(F.explode("cases").alias("c")).select("c.*"))


def validate(cases: DataFrame) -> DataFrame:
    golds = F.coalesce(F.size("goldSourceIDs"), F.lit(0)) + F.coalesce(F.size("goldSourcePaths"), F.lit(0))
    least = F.coalesce("minimumGoldSources", F.lit(1))
    bad = cases.where((golds < 1) | (least > golds) | (F.coalesce(F.size("tags"), F.lit(0)) < 1)).select("id").limit(5).collect()
    if bad:
        raise ValueError(f"cases without gold, without tags, or asking for more gold than they have: {[r[0] for r in bad]}")
    return cases.withColumn("minimumGoldSources", least)


def evaluate(cases: DataFrame, results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Metrics per case: ``id``, ``tags``, the names in ``METRICS``.

    ``results`` has ``query_id`` (the case), ``rank`` from 1, ``id`` (node). An
    id and a path of one source are two gold keys; no facts, and no claims, count
    as reached.
    """
    keys = cases.select(
        "id",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.transform(F.coalesce("goldSourceIDs", F.array()), lambda x: F.concat(F.lit("id:"), x)),
                    F.transform(F.coalesce("goldSourcePaths", F.array()), lambda x: F.concat(F.lit("path:"), T.clean_path(x))),
                )
            )
        ).alias("key"),
    )
    found = results.select(F.col("query_id").alias("case"), "rank", F.col("id").alias("node")).join(
        nodes.select(F.col("id").alias("node"), "label", "text", "path", "metadata"), "node"
    )
    own = F.array_compact(
        F.array(
            F.concat(F.lit("id:"), "node"),
            F.concat(F.lit("id:"), F.get_json_object("metadata", "$.sourceID")),
            F.concat(F.lit("path:"), T.clean_path("path")),
            F.concat(F.lit("path:"), T.clean_path(F.get_json_object("metadata", "$.sourcePath"))),
        )
    )
    hits = found.select("case", "rank", F.explode(own).alias("key")).join(keys.withColumnRenamed("id", "case"), ["case", "key"])
    gold = keys.groupBy("id").agg(F.count("*").alias("gold"))
    got = hits.groupBy(F.col("case").alias("id")).agg(F.countDistinct(F.when(F.col("rank") == 1, F.col("key"))).alias("at_1"), F.countDistinct("key").alias("at_5"), F.min("rank").alias("first"))
    texts = found.groupBy(F.col("case").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", T.normal_phrase(F.concat_ws("\n", "label", "text")).alias("t")))), lambda s: s["t"]), " ").alias("said"),
        F.count("*").alias("results"),
        F.countDistinct(T.source_family(F.col("node"), F.col("path"), F.col("metadata"))).alias("families"),
    )

    def reached(c: str) -> Column:
        values = F.coalesce(F.col(c), F.array().cast("array<string>"))
        held = F.size(F.filter(values, lambda v: F.contains(F.coalesce("said", F.lit("")), T.normal_phrase(v))))
        return T.ratio(held.cast("double"), F.size(values))

    one = cases.join(gold, "id", "left").join(got, "id", "left").join(texts, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return one.select(
        "id",
        "tags",
        T.ratio(zero("at_1").cast("double"), zero("gold")).alias("recall_at_1"),
        T.ratio(zero("at_5").cast("double"), zero("gold")).alias("recall_at_5"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        reached("expectedFacts").alias("fact_coverage"),
        reached("forbiddenClaims").alias("forbidden_rate"),
        F.coalesce(F.lit(1.0) - F.col("families") / F.col("results"), F.lit(0.0)).alias("redundancy"),
        (zero("at_5") >= F.coalesce("minimumGoldSources", F.lit(1))).cast("double").alias("passes"),
    )


def summarize(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("cases"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS))


def by_tag(report: DataFrame) -> DataFrame:
    return report.select(F.explode("tags").alias("tag"), *METRICS).groupBy("tag").agg(F.count("*").alias("cases"), *(F.avg(m).alias(m) for m in METRICS))


def run_lexical(cases: DataFrame, nodes: DataFrame) -> DataFrame:
    """All cases by lexical search, five results each, as one job."""
    found = lexical.search_many(nodes, cases.select(F.col("id").alias("query_id"), "question"), 5)
    return evaluate(cases, found, nodes)


def run_with(cases: DataFrame, nodes: DataFrame, search: Callable[[str], list[str]]) -> DataFrame:
    """All cases by a search of one's own: question to ranked ids, called once per case of a suite."""
    spark = cases.sparkSession
    rows = [(r["id"], i + 1, n) for r in cases.select("id", "question").toLocalIterator() for i, n in enumerate(search(r["question"])[:5])]
    return evaluate(cases, spark.createDataFrame(rows, "query_id string, rank int, id string"), nodes)


def markdown(name: str, report: DataFrame) -> str:
    """The report as text."""
    total = summarize(report).first()
    show = lambda r: " | ".join(f"{r[m]:.3f}" for m in METRICS)
    out = [f"# {name}", "", f"| scope | cases | {' | '.join(METRICS)} |", "|" + "---|" * (len(METRICS) + 2), f"| all | {total['cases']} | {show(total)} |"]
    out += [f"| {r['tag']} | {r['cases']} | {show(r)} |" for r in by_tag(report).orderBy("tag").collect()]
    return "\n".join(out) + "\n"
