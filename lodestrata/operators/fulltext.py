"""Trigram full-text search with BM25, as the full-text engine of the reference behaviour ranks.

A term matches where it is contained, case folded, in a label, a text or a
path; terms under three characters match nothing. Frequencies, row counts and
lengths are those of all indexed rows, whatever the type filter.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical as L
from lodestrata.session import staged

K1, B = 1.2, 0.75
#: Factors by node type; any other type has 1 (fixed values).
TYPE_BOOST = {
    "decision": 4.0, "claim": 4.0, "preference": 4.0, "memory": 4.0, "transcript": 2.5, "recording": 2.5, "session": 2.0, "turn": 2.0, "project": 2.0,
    "document": 2.0, "prompt": 2.0, "entity": 1.5, "task": 1.5, "event": 1.5, "file": 1.0, "function": 1.0,
}
FIELDS = ("label", "text", "path")
#: Characters of a text that an excerpt is taken from (fixed value).
EXCERPT_OF = 6000
#: Postings of trigrams that a task holds before it hands them on.
POSTINGS = 1 << 20


def occurrences(text: Column, term: str) -> Column:
    """How often a lower-cased literal occurs, overlaps included."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    overlaps = any(term[i:] == term[: len(term) - i] for i in range(1, len(term)))
    if overlaps:
        return F.regexp_count(folded, F.lit("(?=" + re.escape(term) + ")"))
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(term), F.lit("")))) / len(term)).cast("int")


def type_boost(c: str = "node_type") -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPE_BOOST.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.col(c)), F.lit(1.0))


def indexed(nodes: DataFrame) -> DataFrame:
    """What is searched: every node but keywords, with its length in trigrams."""
    length = sum((F.greatest(F.lit(0), F.length(F.coalesce(F.col(f), F.lit(""))) - 2) for f in FIELDS), F.lit(0))
    return nodes.where("node_type <> 'keyword'").select("id", "node_type", "label", "text", "path", "metadata", "ord", length.alias("trigrams"))


@dataclass
class CorpusStats:
    rows: int
    mean: float
    holding: list[int]


def _holds(term: str) -> Column:
    return F.greatest(*(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(term)) for f in FIELDS))


def corpus_stats(docs: DataFrame, terms: list[str]) -> CorpusStats:
    """Rows, mean length and rows holding each term: one aggregation, one row to the driver."""
    r = docs.agg(F.count("*"), F.avg("trigrams"), *(F.count(F.when(_holds(t), 1)) for t in terms)).first()
    return CorpusStats(r[0], float(r[1] or 0.0), list(r[2:]))


def holding(docs: DataFrame, terms: list[str]) -> list[int]:
    """Rows holding each term."""
    return list(docs.agg(*(F.count(F.when(_holds(t), 1)) for t in terms)).first())


def bm25(terms: list[str], stats: CorpusStats) -> Column:
    """Positive BM25 of a row of ``indexed``."""
    import math

    score = F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("trigrams") / F.lit(stats.mean or 1.0))
    for term, n in zip(terms, stats.holding):
        idf = math.log((stats.rows - n + 0.5) / (n + 0.5))
        f = sum((occurrences(F.col(x), term) for x in FIELDS), F.lit(0))
        score = score + F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + norm)
    return score


def search(docs: DataFrame, query: str, limit: int = 20, types: list[str] | None = None, stats: CorpusStats | None = None, boost_before_limit: bool = False) -> DataFrame:
    """``id, node_type, label, path, score`` of the best rows of ``docs`` (see ``indexed``).

    The first ``limit`` (1 to 100) by plain rank are taken and then ordered by
    boosted score; ``boost_before_limit`` boosts first.
    """
    limit = max(1, min(limit, 100))
    terms = [t for t in T.query_terms(query) if len(t) >= 3]
    kept = docs.where(F.col("node_type").isin(types)) if types else docs
    if not terms:
        return kept.limit(0).select("id", "node_type", "label", "path", F.lit(0.0).alias("score"))
    plain = bm25(terms, corpus_stats(docs, terms) if stats is None else stats)
    matched = F.greatest(*(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t)) for t in terms for f in FIELDS), F.lit(False))
    ranked = kept.where(matched).select("id", "node_type", "label", "path", "ord", plain.alias("rank"))
    ranked = ranked.withColumn("score", F.round(F.col("rank") * type_boost(), 9)).withColumn("rank", F.round("rank", 9))
    first = F.col("score") if boost_before_limit else F.col("rank")
    best = ranked.orderBy(first.desc(), "ord", "id").limit(limit)
    return best.orderBy(F.col("score").desc(), F.col("rank").desc(), "ord").select("id", "node_type", "label", "path", "score")


def gram_postings(docs: DataFrame) -> DataFrame:
    """``gram``, ``held``: the numbers (``no``) of the rows of ``docs`` that hold a trigram, case folded, in one of their fields.

    A trigram has a row for every ``POSTINGS`` postings of a task, so no more than these are held at once. No shuffle.
    """
    bits, low = 21, (1 << 21) - 1

    def flush(codes: list[np.ndarray], numbers: list[int]) -> pa.RecordBatch:
        code, no = np.concatenate(codes), np.repeat(np.array(numbers, "int64"), [len(c) for c in codes])
        order = np.argsort(code, kind="stable")
        code, no = code[order], no[order]
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        each = code[starts]
        letters = np.stack([each >> 2 * bits, each >> bits & low, each & low], 1).astype("<u4").tobytes().decode("utf-32-le")
        grams = pa.array([letters[i : i + 3] for i in range(0, len(letters), 3)], pa.string())
        return pa.RecordBatch.from_arrays([grams, pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(no))], names=["gram", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, numbers, size = [], [], 0
        for batch in batches:
            for no, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                letters = [np.frombuffer(t.encode("utf-32-le"), "<u4").astype("int64") for t in texts]
                own = np.unique(np.concatenate([x[:-2] << 2 * bits | x[1:-1] << bits | x[2:] for x in letters]))
                if len(own):
                    codes.append(own)
                    numbers.append(no)
                    size += len(own)
                if size >= POSTINGS:
                    yield flush(codes, numbers)
                    codes, numbers, size = [], [], 0
        if codes:
            yield flush(codes, numbers)

    return docs.select("no", *(F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS)).mapInArrow(run, "gram string, held array<bigint>")


class Index:
    """A written index: documents, trigram and token postings, the vocabulary, and a fingerprint of its source.

    Each task writes the postings of its documents, sorted, so the statistics of
    pages prune the read to what a term needs, and nothing is shuffled. Candidates of a term hold all its trigrams; they are verified by
    the search itself. Each rebuild is a new version beside the one that is read,
    complete once its marker exists: a failed one changes nothing.
    """

    PARTS = ("docs", "grams", "tokens", "words", "meta")
    #: Ending of the marker of a complete version; versions of another layout aren't read.
    DONE = ".done2"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._meta: dict[str, dict] = {}

    def _p(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[str]:
        """Complete versions, oldest first."""
        if not self._fs.exists(self._p()):
            return []
        return sorted(n.removesuffix(self.DONE) for n in (s.getPath().getName() for s in self._fs.listStatus(self._p())) if n.endswith(self.DONE))

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[-1]}/{part}")

    def meta(self) -> dict | None:
        """``fingerprint``, ``rows`` and ``mean`` (length in trigrams) of the version that is read; None where there is none."""
        done = self.versions()
        if not done:
            return None
        if done[-1] not in self._meta:
            self._meta = {done[-1]: self.read("meta").first().asDict()}
        return self._meta[done[-1]]

    def fingerprint(self) -> str | None:
        meta = self.meta()
        return meta and meta["fingerprint"]

    def rebuild(self, nodes: DataFrame, fingerprint: str) -> bool:
        """Writes the index anew unless its fingerprint is ``fingerprint``; whether it did."""
        if self.fingerprint() == fingerprint:
            return False
        done = self.versions()
        name = f"v{(int(done[-1][1:9]) + 1 if done else 0):08d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{name}"
        indexed(nodes).withColumn("no", F.monotonically_increasing_id()).write.parquet(f"{at}/docs")
        docs = self.spark.read.parquet(f"{at}/docs")
        # the second version of the format writes numbers as differences
        gram_postings(docs).sortWithinPartitions("gram").write.options(**{"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}).parquet(f"{at}/grams")
        L.postings(L.token_lists(docs)).sortWithinPartitions("token").write.parquet(f"{at}/tokens")
        L.vocabulary(self.spark.read.parquet(f"{at}/tokens")).write.parquet(f"{at}/words")
        docs.agg(F.lit(fingerprint).alias("fingerprint"), F.count("*").alias("rows"), F.coalesce(F.avg("trigrams"), F.lit(0.0)).alias("mean")).coalesce(1).write.parquet(f"{at}/meta")
        self._fs.create(self._p(name + self.DONE), True).close()
        for old in done[:-1]:
            self._fs.delete(self._p(old + self.DONE), False)
            self._fs.delete(self._p(old), True)
        return True

    def candidates(self, terms: list[str]) -> DataFrame:
        grams = self.read("grams")
        found = None
        for t in terms:
            parts = sorted({t[i : i + 3] for i in range(len(t) - 2)})
            held = grams.where(F.col("gram").isin(parts)).select(F.explode("held").alias("no")).groupBy("no").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("no")
            found = held if found is None else found.unionByName(held)
        return found.distinct()

    def search(self, query: str, limit: int = 20, types: list[str] | None = None) -> DataFrame:
        """As ``search``; row counts and lengths come from the index, frequencies from the verified candidates."""
        docs = self.read("docs")
        terms = [t for t in T.query_terms(query) if len(t) >= 3]
        if not terms:
            return search(docs, query, limit, types)
        near = docs.join(self.candidates(terms), "no", "left_semi")
        meta = self.meta()
        return search(near, query, limit, types, stats=CorpusStats(meta["rows"], meta["mean"], holding(near, terms)))

    def search_lexical(self, query: str, limit: int = 20, types: list[str] | None = None) -> DataFrame:
        """Lexical and phonetic search through the written postings: ``id, node_type, label, path, score``, best first."""
        one = self.spark.createDataFrame([(0, query)], "query_id int, question string")
        return L.listed(self.search_many(one, max(1, min(limit, 100)), types), self.read("docs"))

    def search_many(self, questions: DataFrame, limit: int = 5, types: list[str] | None = None) -> DataFrame:
        """As ``lexical.search_many``, without tokenising anything but the questions."""
        docs = self.read("docs")
        terms = staged(L.exploded(questions, T.tokens("question"), "term", "query_id"), "terms")
        scores = L.scored(self.read("tokens"), L.matches(self.read("words"), terms), terms)
        return L.ranked(scores, docs.where(F.col("node_type").isin(types)) if types else docs, limit)

    def hits(self, found: DataFrame, query: str, edges: DataFrame, related: int = 5) -> DataFrame:
        """``found`` (``id`` and the columns shown) with an ``excerpt`` of the text's first 6,000 characters and up to five
        ``related`` nodes, best first."""
        docs = self.read("docs")
        text = docs.select("id", L.excerpt(F.substring("text", 1, EXCERPT_OF), query).alias("excerpt"))
        shown = G.with_related(found.join(text, "id", "left"), G.related_any(edges, docs, found, related), docs)
        return shown.orderBy(F.col("score").desc(), "id")
