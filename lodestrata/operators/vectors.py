"""Embedding entries: chunks, quantised vectors, similarity, fusion, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical

#: Nodes of these types aren't embedded (fixed values).
NOT_EMBEDDED = "keyword recording project session function".split()
ENTRY = "id string, node_id string, chunk_index int, text_hash string, vector binary, scale double, norm double, model string"
POOL, SEEDS, RRF, SPREAD, TAIL, PER_TYPE = 40, 12, 60, 0.35, 0.12, 4


class Embedder(Protocol):
    """Turns texts into vectors; ``model`` names it."""

    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic vectors of hashed tokens, for tests and for runs without a model."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self.model = dims, f"hashing-{dims}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for token in T.tokens_plain(t):
                h = zlib.crc32(token.encode())
                v[h % self.dims] += 1 if h & 0x10000 else -1
            out.append(v.tolist())
        return out


class HttpEmbedder:
    """POSTs batches of texts to an embedding endpoint; never called unless configured."""

    def __init__(self, url: str, model: str, timeout: float = 120.0) -> None:
        self.url, self.model, self.timeout = url, model, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"content-type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            data = json.load(response)["data"]
        if len(data) != len(texts):
            raise ValueError("the endpoint returned another number of vectors than texts")
        return [d["embedding"] for d in data]


def chunks(c: str | Column, size: int = 1800, overlap: int = 200, most: int = 120) -> Column:
    """Overlapping cuts every ``size - overlap`` characters, the first ``most``; an empty text is one chunk."""
    text = F.coalesce(T.col(c), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.slice(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))), 1, most)


def node_chunks(nodes: DataFrame, most: int = 120) -> DataFrame:
    """``id`` (content address), ``node_id``, ``chunk_index``, ``text_hash``, ``chunk`` of every embeddable node."""
    kept = nodes.where(~F.col("node_type").isin(NOT_EMBEDDED)).select(F.col("id").alias("node_id"), F.concat(F.coalesce("label", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("_t"))
    cut = kept.select("node_id", F.posexplode(chunks("_t", most=most)).alias("chunk_index", "chunk")).withColumn("text_hash", T.stable_id("chunk", 32))
    return cut.select(T.stable_id(F.concat_ws(":", "node_id", F.col("chunk_index").cast("string"), "text_hash"), 32).alias("id"), "node_id", "chunk_index", "text_hash", "chunk")


def quantize(v: Column) -> Column:
    """``scale`` and whole numbers from -127 to 127, halves rounded up, and the norm of what they stand for."""
    top = F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(float(np.finfo(float).eps)))
    scale = top / 127
    bytes_ = F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x / scale + 0.5).cast("double"))).cast("int"))
    norm = F.sqrt(F.aggregate(bytes_, F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale)))
    return F.struct(scale.alias("scale"), bytes_.alias("bytes"), norm.alias("norm"))


def cosine_scores(entries: DataFrame, query: list[float]) -> DataFrame:
    """``id, node_id, score`` of every entry with a vector against a float vector; shorter of the two lengths counts."""
    q = np.asarray(query, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, scale, norm = (batch.column(i).to_pylist() for i in (2, 3, 4))
            score = np.zeros(len(raw))
            by_size: dict[int, list[int]] = {}
            for i, b in enumerate(raw):
                by_size.setdefault(len(b), []).append(i)
            for size, at in by_size.items():
                n = min(size, len(q))
                x = np.frombuffer(b"".join(raw[i] for i in at), np.int8).reshape(len(at), size)[:, :n] if size else np.zeros((len(at), 0))
                below = np.sqrt((q[:n] ** 2).sum()) * np.array([norm[i] or 0.0 for i in at])
                dot = x.astype(float) @ q[:n] * np.array([scale[i] or 0.0 for i in at])
                score[at] = dot / np.where(below == 0, 1.0, below)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["id", "node_id", "score"])

    return entries.where("vector is not null").select("id", "node_id", "vector", "scale", "norm").mapInArrow(run, "id string, node_id string, score double")


def live_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries of nodes that exist."""
    return entries.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(entries.columns)


def best_per_node(scores: DataFrame) -> DataFrame:
    return scores.groupBy("node_id").agg(F.max("score").alias("score")).where("score > -1")


def fuse(*rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of rankings (``id``, ``rank`` from 1): ``id``, ``score``; a ranking without an id adds nothing."""
    all_ = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select("id", "rank"))
    return all_.groupBy("id").agg(F.sum(F.lit(1.0) / (RRF + F.col("rank"))).alias("score"))


def expand(fused: DataFrame, edges: DataFrame, nodes: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """Neighbours of the best ``seeds`` take at least a share of their score; the seeds' scores are taken first."""
    top = F.broadcast(fused.orderBy(F.col("score").desc(), "id").limit(seeds))
    near = G.both_ways(edges.where(F.col("edge_type").isin(G.EVIDENCE_EDGES))).join(top, "id").groupBy(F.col("other").alias("id")).agg(F.max(F.col("score") * SPREAD).alias("score"))
    near = near.join(nodes.select("id"), "id", "left_semi")
    return fused.unionByName(near).groupBy("id").agg(F.max("score").alias("score"))


def pack_evidence(ranked: DataFrame, nodes: DataFrame, limit: int, query: str = "", types: list[str] | None = None) -> DataFrame:
    """Derived facts folded into their sources, then at most four of a type first: ``rank, id, score``.

    A source scores its best item plus a share of its second and third. Asked
    for derived types or entities, the ranking is returned as it is.
    """
    order = [F.col("score").desc(), F.expr("collate(label, 'UNICODE')"), F.col("id")]
    top = lambda df, *by: df.orderBy(*by).limit(limit).select("id", "score")
    kept = ranked.join(nodes.select("id", "node_type", "label", "metadata"), "id")
    if types and any(t in [*G.DERIVED_TYPES, "entity"] for t in types):
        best = top(kept, *order)
    else:
        want = T.wants_preference(query)
        boost = F.when((F.col("node_type") == "preference") & want, 1.6).when((F.col("node_type") == "task") & want, 1.15).otherwise(1.0)
        source = F.when(F.col("node_type").isin(G.DERIVED_TYPES), F.coalesce(F.get_json_object("metadata", "$.sourceID"), "id")).otherwise(F.col("id"))
        items = kept.where("node_type <> 'entity'").select(source.alias("id"), (F.col("score") * boost).alias("s"))
        sums = items.groupBy("id").agg(F.sort_array(F.collect_list("s"), False).alias("s")).select(
            "id", (F.element_at("s", 1) + TAIL * F.aggregate(F.slice("s", 2, 2), F.lit(0.0), lambda a, x: a + x)).alias("score")
        )
        sources = sums.join(nodes.select("id", "node_type", "label"), "id")
        if limit < 5:
            best = top(sources, *order)
        else:
            place = F.row_number().over(Window.partitionBy("node_type").orderBy(*order))
            best = top(sources.withColumn("_late", place > PER_TYPE), "_late", *order)
            late = sources.withColumn("_late", place > PER_TYPE).select("id", "_late")
            best = best.join(late, "id")
    by = [F.col("_late")] if "_late" in best.columns else []
    labelled = best.join(nodes.select("id", "label"), "id")
    return labelled.withColumn("rank", F.row_number().over(Window.orderBy(*by, *order))).select("rank", "id", "score")


def hybrid_search(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None, embed: Callable[[str], list[float]] | None, query: str, limit: int, types: list[str] | None = None) -> DataFrame:
    """``rank, id, score`` of lexical and vector search fused, spread over the graph and packed.

    Without entries or an embedder, or where embedding fails, the lexical
    ranking is the result.
    """
    found = lexical.search(nodes, query, POOL, types)
    order = Window.orderBy(F.col("score").desc(), "_o")
    lex = found.withColumn("_o", F.monotonically_increasing_id()).coalesce(1).withColumn("rank", F.row_number().over(order)).select("id", "rank", F.col("score").cast("double").alias("score"))
    vector = None
    if entries is not None and embed is not None:
        try:
            vector = embed(query)
        except Exception:
            vector = None
    if vector is None:
        return lex.where(F.col("rank") <= limit).select("rank", "id", "score")
    best = best_per_node(cosine_scores(live_entries(entries, nodes), vector)).orderBy(F.col("score").desc(), "node_id").limit(POOL)
    vec = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "node_id"))).select(F.col("node_id").alias("id"), "rank")
    spread = expand(fuse(lex, vec), edges, nodes)
    kept = nodes.where("node_type <> 'keyword'")
    if types:
        kept = kept.where(F.col("node_type").isin(types))
    return pack_evidence(spread.join(kept.select("id"), "id", "left_semi"), nodes, limit, query, types)


class EmbeddingIndex:
    """Entries on disk, in versions: a write stands beside what is read until it is complete.

    The format's number stands in the folder's name; entries of another format
    aren't seen, those of another model aren't reused or searched.
    """

    VERSION = 1

    def __init__(self, spark: SparkSession, path: str) -> None:
        from lodestrata.streaming.ingest import GraphTable

        self.table = GraphTable(spark, f"{path.rstrip('/')}/format-{self.VERSION}", ENTRY)

    def load(self, model: str | None = None) -> DataFrame | None:
        """All entries (of ``model``); None where there is no index, or none of that model."""
        if not self.table.versions():
            return None
        entries = self.table.read() if model is None else self.table.read().where(F.col("model") == model)
        return None if entries.isEmpty() else entries

    def refresh(self, nodes: DataFrame, embedder: Embedder, batch: int = 16, most: int = 120) -> dict[str, int]:
        """Writes the entries of all chunks of ``nodes``; returns ``entries``, ``reused`` and ``embedded``."""
        old = self.load(embedder.model)
        self.table.write(refresh_entries(nodes, old, embedder, batch, most))
        written = self.table.read()
        total = written.count()
        reused = 0 if old is None else written.join(old.select("id").distinct(), "id", "left_semi").count()
        return {"entries": total, "reused": reused, "embedded": total - reused}


def refresh_entries(nodes: DataFrame, old: DataFrame | None, embedder: Embedder, batch: int = 16, most: int = 120) -> DataFrame:
    """Entries of all chunks; those of an equal id and model are taken over, the others embedded in batches."""
    made = node_chunks(nodes, most)
    model = embedder.model
    shape = ENTRY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column(4).to_pylist()
            vectors, scales, norms = [], [], []
            for at in range(0, len(texts), batch):
                for v in embedder.embed(texts[at : at + batch]):
                    x = np.asarray(v, float)
                    scale = max(np.abs(x).max(initial=0.0), np.finfo(float).eps) / 127
                    q = np.clip(np.floor(x / scale + 0.5), -127, 127).astype(np.int8)
                    vectors.append(q.tobytes())
                    scales.append(scale)
                    norms.append(float(np.sqrt(((q * scale) ** 2).sum())))
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), part.column(3), pa.array(vectors, pa.binary()), pa.array(scales, pa.float64()), pa.array(norms, pa.float64()), pa.array([model] * n, pa.string())],
                names=["id", "node_id", "chunk_index", "text_hash", "vector", "scale", "norm", "model"],
            )

    if old is None:
        return made.mapInArrow(run, shape)
    same = old.where(F.col("model") == model).dropDuplicates(["id"])
    reused = same.join(made.select("id"), "id", "left_semi").select("id", "node_id", "chunk_index", "text_hash", "vector", "scale", "norm", "model")
    return made.join(same.select("id"), "id", "left_anti").select("id", "node_id", "chunk_index", "text_hash", "chunk").mapInArrow(run, shape).unionByName(reused)
