"""Lexical and phonetic search over nodes, for one question or for many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.session import staged

#: Points of a term: exact in the label, exact in the text, alike in the label, alike in the text (fixed values).
POINTS = (5, 2, 3, 1)
#: Distinct terms that are sent to where the vocabulary lies; more of them meet it in a shuffle.
FEW_TERMS = 20_000


def _types(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    kept = nodes.where("node_type <> 'keyword'")
    return kept.where(F.col("node_type").isin(types)) if types else kept


def token_lists(nodes: DataFrame) -> DataFrame:
    """``id``, ``label_tokens``, ``body_tokens``: the distinct tokens of each node's label and text."""
    return nodes.select("id", F.array_distinct(T.tokens("label")).alias("label_tokens"), F.array_distinct(T.tokens("text")).alias("body_tokens"))


def postings(lists: DataFrame) -> DataFrame:
    """``token, id, in_label, in_body``: an inverted index of ``token_lists``, made without a shuffle."""
    one = lambda t, in_label, in_body: F.struct(t.alias("token"), in_label.alias("in_label"), in_body.alias("in_body"))
    both = F.concat(
        F.transform("label_tokens", lambda t: one(t, F.lit(True), F.array_contains("body_tokens", t))), F.transform(F.array_except("body_tokens", "label_tokens"), lambda t: one(t, F.lit(False), F.lit(True)))
    )
    return lists.select("id", F.explode_outer(both).alias("p")).where("p is not null").select("p.token", "id", "p.in_label", "p.in_body")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``token``, ``signature`` (null for short words) of each distinct ``token``."""
    # as an aggregate of the distinct words it is worked out once a word: what is asked of it later isn't pushed below and
    # doesn't repeat it; a first value, as the optimizer would take the distinct words for needless below a largest one
    return tokens.select("token").distinct().groupBy("token").agg(F.first(F.when(F.length("token") >= 5, T.phonetic_signature("token"))).alias("signature"))


def _half(n: Column, head: Column, tail: Column) -> Column:
    return F.array(F.struct(n.alias("n"), F.lit(True).alias("first"), head.alias("part")), F.struct(n.alias("n"), F.lit(False).alias("first"), tail.alias("part")))


def _halves(s: Column) -> Column:
    """Length and either half of a word's signature: whatever is one edit away begins or ends with one of them."""
    h = F.floor(F.length(s) / 2).cast("int")
    return _half(F.length(s), F.substring(s, F.lit(1), h), F.substring(s, h + 1, F.length(s)))


def _ends(s: Column) -> Column:
    """Of a term's signature, what the ``_halves`` of a word of its length, one less or one more would be."""
    lengths = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.length(s) + d), lambda n: n >= 0)

    def of(n: Column) -> Column:
        h = F.floor(n / 2).cast("int")
        return _half(n, F.substring(s, F.lit(1), h), F.substring(s, F.greatest(F.lit(1), F.length(s) - (n - h) + 1), F.length(s)))

    return F.flatten(F.transform(lengths, of))


def exploded(df: DataFrame, tokens: Column, name: str, *kept: str | Column) -> DataFrame:
    """``kept`` and one row per distinct token. The outer form keeps the optimizer from adding a
    condition on the array, which would work the tokens out a second time."""
    return df.select(*kept, F.explode_outer(F.array_distinct(tokens)).alias(name)).where(F.col(name).isNotNull())


def matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, token, exact``: the words of a vocabulary that ``terms`` (``term``) are, or sound like.

    Terms meet the vocabulary, not the nodes: equal tokens by an equi-join, those
    that sound alike by an equi-join on length and halves of signatures, verified after it.
    The vocabulary grows with the nodes, so it is never broadcast.
    """
    one = terms.select("term").distinct()
    few = one.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    meet = lambda far, near, on: far.join(F.broadcast(near), on) if few else far.hint("merge").join(near, on)
    exact = meet(words.select("token"), one.withColumnRenamed("term", "token"), "token").select(F.col("token").alias("term"), "token", F.lit(True).alias("exact"))
    long_terms = one.where(F.length("term") >= 5).groupBy("term").agg(F.max(T.phonetic_signature("term")).alias("ts"))
    left = long_terms.select("term", "ts", F.explode_outer(_ends(F.col("ts"))).alias("v"))
    right = words.where("signature is not null").select("token", "signature", F.explode_outer(_halves(F.col("signature"))).alias("v"))
    alike = meet(right, left, "v").where((F.col("term") != F.col("token")) & T.within_one_edit(F.col("ts"), F.col("signature"))).select("term", "token").distinct()
    return exact.unionByName(alike.withColumn("exact", F.lit(False)))


def scored(index: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, score`` from postings, ``matches`` and ``terms`` (``query_id``, ``term``); each term counts once per field."""
    # written first, as the planner takes the product of both sizes for a join, and would shuffle the postings
    hits = staged(terms.join(found, "term"), "wanted").join(index, "token")
    flag = lambda exact, field: F.max(F.col("exact") & F.col(field)) if exact else F.max(~F.col("exact") & F.col(field))
    per_term = hits.groupBy("query_id", "id", "term").agg(flag(True, "in_label").alias("le"), flag(True, "in_body").alias("be"), flag(False, "in_label").alias("la"), flag(False, "in_body").alias("ba"))
    points = F.when(F.col("le"), POINTS[0]).when(F.col("la"), POINTS[2]).otherwise(0) + F.when(F.col("be"), POINTS[1]).when(F.col("ba"), POINTS[3]).otherwise(0)
    return per_term.groupBy("query_id", "id").agg(F.sum(points).cast("int").alias("score"))


def ranked(scores: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """``query_id, rank, id, score`` of the best ``limit`` of each question: by score, then date, then label, then order."""
    keys = nodes.select("id", "label", "ord", T.node_millis("metadata").alias("millis"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("millis").desc(), F.expr("collate(label, 'UNICODE')"), "ord")
    return scores.join(keys, "id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def search_many(nodes: DataFrame, questions: DataFrame, limit: int = 5, types: list[str] | None = None) -> DataFrame:
    """Lexical and phonetic search for each row of ``questions`` (``query_id``, ``question``): ``query_id, rank, id, score``.

    The nodes are tokenised once; the vocabulary and then only the postings of
    the tokens that matched are drawn from the written lists.
    """
    kept = _types(nodes, types)
    lists = staged(token_lists(kept), "tokens")
    terms = staged(exploded(questions, T.tokens("question"), "term", "query_id"), "terms")
    tokens = lists.select(F.explode(F.array_union("label_tokens", "body_tokens")).alias("token"))
    return ranked(scored(postings(lists), matches(vocabulary(tokens), terms), terms), kept, limit)


def search(nodes: DataFrame, query: str, limit: int = 20, types: list[str] | None = None) -> DataFrame:
    """The best ``limit`` (1 to 100) nodes: ``id, node_type, label, path, score``, best first."""
    one = nodes.sparkSession.createDataFrame([(0, query)], "query_id int, question string")
    return listed(search_many(nodes, one, max(1, min(limit, 100)), types), nodes)


def listed(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The hits of one question with what is shown of them, best first."""
    return found.join(nodes.select("id", "node_type", "label", "path"), "id").orderBy("rank").select("id", "node_type", "label", "path", "score")


def excerpt(text: str | Column, query: str, limit: int = 700) -> Column:
    """The part of a text around the first query token it has, else around the first that sounds alike, else its head."""
    clean = F.regexp_replace(F.coalesce(T.col(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    wanted = T.tokens_plain(query)
    lower = F.lower(clean)
    at = F.coalesce(*(F.when(F.instr(lower, t) > 0, F.instr(lower, t) - 1) for t in wanted), F.lit(-1)) if wanted else F.lit(-1)
    long_terms = [(t, T.signature_plain(t)) for t in wanted if len(t) >= 5]
    if long_terms:
        sounds = lambda t: (F.length(t) >= 5) & F.greatest(*( (t != w) & T.within_one_edit(T.phonetic_signature(t), F.lit(s)) for w, s in long_terms), F.lit(False))  # noqa: E731,E201
        near = F.try_element_at(F.filter(T.tokens(clean), sounds), F.lit(1))
        at = F.when(at >= 0, at).otherwise(F.coalesce(F.instr(lower, near) - 1, F.lit(-1)))
    start = F.greatest(F.lit(0), at - limit // 3)
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), F.substring(clean, start + 1, F.lit(limit)), F.when(start + limit < F.length(clean), "…").otherwise("")
    )
    return F.when(F.length(clean) <= limit, clean).when(at < 0, F.substring(clean, 1, limit)).otherwise(cut)
