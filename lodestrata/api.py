"""One object with the engine's tools; each returns a DataFrame, or text where it draws."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import callgraph as C
from lodestrata.operators import evalbench as B
from lodestrata.operators import fulltext as X
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical as L
from lodestrata.operators import repositories as R
from lodestrata.operators import semantic as S
from lodestrata.operators import vectors as V
from lodestrata.session import staged
from lodestrata.sources import checkout, code, files
from lodestrata.sources.store import GraphStore


#: Characters of a text that browsing shows (fixed value).
HEAD = 700


class Engine:
    """Call graphs by repository and one evidence graph, with ingestion, search and reports."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.store = GraphStore(spark, self.path + "/graph")
        self.index = X.Index(spark, self.path + "/index")
        self.embeddings = V.EmbeddingIndex(spark, self.path + "/embeddings")
        self.repositories: dict[str, DataFrame] = {}
        self.active: str | None = None

    # ---- call graphs

    def initialize_graph(self, repo: str, language: str | None = None, functions: DataFrame | None = None) -> DataFrame:
        """Reads a repository's call graph, or takes one, and makes it the active one."""
        repo = repo.rstrip("/")
        if functions is None:
            language = language or files.language(files.walk(self.spark, repo).where(~F.substring("path", len(repo) + 2, 4096).contains("/")))
            functions = code.repository_functions(self.spark, repo, "typescript" if language == "typescript" else "python")
        self.repositories[repo], self.active = functions, repo
        return C.summary(functions)

    def switch_repository(self, repo: str) -> None:
        if repo.rstrip("/") not in self.repositories:
            raise KeyError(repo)
        self.active = repo.rstrip("/")

    def list_repositories(self) -> list[str]:
        return list(self.repositories)

    def functions(self, repo: str | None = None) -> DataFrame:
        name = (repo or self.active or "").rstrip("/")
        if name not in self.repositories:
            raise KeyError(name or "no repository is active")
        return self.repositories[name]

    def function_call_graph(self, filepath: str, name: str) -> DataFrame | None:
        part = C.enrich(self.functions(), filepath, name)
        return None if part is None else C.call_report(part)

    def dependencies(self, module: str | None = None, filepath: str | None = None) -> DataFrame:
        f = self.functions()
        return C.dependents(f, C.module_keys(f, module, filepath))

    def change_impact(self, filepath: str, name: str) -> DataFrame:
        f = self.functions()
        return C.change_impact(f, C.entry_points(f, filepath, name).select("key"))

    def diagram(self, filepath: str, name: str, kind: str = "flowchart") -> str | None:
        f = self.functions()
        part = C.enrich(f, filepath, name)
        if part is None:
            return None
        entry = C.entry_points(f, filepath, name).first()["key"]
        return (C.sequence if kind == "sequence" else C.flowchart)(part, entry)

    def impact_report(self, filepath: str, name: str) -> str:
        """The impact of a change as text: direct callers by file, indirect ones by depth, tests, level."""
        f = self.functions()
        return C.impact_text(f, C.entry_points(f, filepath, name).select("key"), f"{name} in {filepath}", self.active or "")

    # ---- evidence

    def ingest(
        self, archive: str | None = None, prompts: list[str] = (), sources: list[str] = (), texts: list[str | tuple[str, str, str]] = (), repositories: list[str] = (), reset: bool = False, kind: str | None = None, label: str | None = None
    ) -> dict:
        """Merges what is given into the graph, code graphs of known repositories too, and says what was imported.

        ``texts`` are pasted texts, or (label, text, kind). What an earlier reading
        of the same files or archive left goes first. Returns ``recordings``,
        ``prompts``, ``documents``, ``memories``, ``sessions``, ``turns``,
        ``repositories``, ``files``, ``functions``, ``nodes`` and ``edges``.
        """
        if reset:
            self.store.save(self.store.nodes().limit(0), self.store.edges().limit(0))
        done = dict.fromkeys("recordings prompts documents memories sessions turns repositories files functions".split(), 0)

        def merge(nodes: DataFrame, edges: DataFrame, counted: dict[str, str], **replaced) -> None:
            nodes, edges = staged(nodes, "read-nodes"), staged(edges, "read-edges")
            for r in nodes.where(F.col("node_type").isin(list(counted))).groupBy("node_type").agg(F.countDistinct("id")).collect():
                done[counted[r[0]]] += r[1]
            self.store.merge(nodes, G.drop_related(edges), **replaced)

        if archive:
            merge(*files.recording_archive(self.spark, archive), {"recording": "recordings"}, below=archive, types=["recording", "transcript"])
        for p in prompts:
            merge(*files.prompt_directory(self.spark, p), {"prompt": "prompts"})
        imported = {"document": "documents", "memory": "memories", "session": "sessions", "turn": "turns"}
        given = [(p, kind, label) for p in sources]
        for t in texts:
            name, text, sort = (None, t, "agent-context") if isinstance(t, str) else t
            given.append((files.pasted_text(self.path.removeprefix("file://") + "/imports", text, name or ""), sort, name))
        for path, sort, name in given:
            merge(*files.knowledge_path(self.spark, path, sort, name), imported, paths=files.filled_files(self.spark, path).select("path"), types=files.REPLACED)
        for source in repositories:
            root = checkout.checkout(source, self.path.removeprefix("file://") + "/repositories")
            nodes, edges, counts = checkout.with_repository(self.spark, self.store.nodes(), self.store.edges(), root, None if os.path.exists(source) else source)
            merge(nodes, edges, {})
            done = {**done, "repositories": done["repositories"] + 1, "files": done["files"] + counts["files"], "functions": done["functions"] + counts["functions"]}
        for root, functions in self.repositories.items():
            merge(*G.merge_code_graph(functions, self.store.nodes(), root), {})
            done["repositories"] += 1
        return {**done, "nodes": self.store.nodes().count(), "edges": self.store.edges().count()}

    def ingest_if_newer(self, archive: str) -> bool:
        """Reads a recording archive if anything in it is newer than the graph; a failure never stops the search behind it."""
        try:
            newest = files.walk(self.spark, archive, hidden=True).agg(F.max("modified")).first()[0]
            written = self.store.written_at()
            if newest is None or written is not None and newest <= written:
                return False
            self.ingest(archive=archive)
            return True
        except Exception:
            return False

    def refresh_managed(self, managed: list[checkout.Managed], state_path: str, force: bool = False) -> dict:
        return checkout.refresh_managed(self.store, managed, self.path.removeprefix("file://") + "/repositories", state_path, force)

    def remove_repository(self, root: str) -> None:
        self.store.save(*G.remove_repository(self.store.nodes(), self.store.edges(), root))

    def search(self, query: str, limit: int = 20, types: list[str] | None = None) -> DataFrame:
        """Full-text search through the written index, which is made anew when the graph has changed."""
        self.fresh_index()
        return self.index.search(query, limit, types)

    def search_hits(self, query: str, limit: int = 20, types: list[str] | None = None, archive: str | None = None) -> DataFrame:
        """As ``search``, with an excerpt and up to five related nodes of each hit; new recordings of ``archive`` are read first."""
        if archive:
            self.ingest_if_newer(archive)
        return self.index.hits(self.search(query, limit, types), query, self.store.edges())

    def fresh_index(self) -> X.Index:
        self.index.rebuild(self.store.nodes(), self.store.fingerprint())
        return self.index

    def search_lexical(self, query: str, limit: int = 20, types: list[str] | None = None) -> DataFrame:
        """Lexical and phonetic search through the written postings, with excerpts."""
        index = self.fresh_index()
        hits = index.search_lexical(query, limit, types).withColumn("_n", F.monotonically_increasing_id())
        return hits.join(index.read("docs").select("id", L.excerpt("text", query).alias("excerpt")), "id").orderBy("_n").drop("_n")

    def search_hybrid(self, query: str, limit: int = 10, types: list[str] | None = None, entries: DataFrame | None = None, embedder: V.Embedder | None = None) -> DataFrame:
        """Lexical and vector search fused; ``entries`` are those on disk where none are given."""
        embed = None if embedder is None else lambda q: embedder.embed([q])[0]
        if embedder is not None:
            entries = self.embeddings.load(embedder.model) if entries is None else entries.where(F.col("model") == embedder.model)
        return V.hybrid_search(self.store.nodes(), self.store.edges(), entries, embed, query, limit, types)

    def browse(self, node_type: str | None = None, limit: int = 50) -> DataFrame:
        """Newest nodes of a type, with the head of their text and related nodes."""
        if node_type not in (None, "all", *G.BROWSED_TYPES):
            raise ValueError(f"unknown type {node_type}")
        nodes = self.store.nodes()
        found = G.browse(nodes, node_type, limit).withColumn("_n", F.monotonically_increasing_id())
        heads = nodes.select("id", F.substring("text", 1, HEAD).alias("excerpt"))
        shown = G.with_related(found.join(heads, "id"), G.related(self.store.edges(), nodes, found), nodes)
        return shown.orderBy("_n").drop("_n")

    def visualize(self, query: str) -> DataFrame:
        nodes, edges = self.store.nodes(), self.store.edges()
        one = self.spark.createDataFrame([(0, query)], "query_id int, question string")
        hits = staged(L.search_many(nodes, one, 18).select("id", "rank"), "hits")
        return G.visible_subgraph(hits, G.related(edges, nodes, hits), edges)

    def stats(self) -> DataFrame:
        return G.node_stats(self.store.nodes()).withColumn("part", F.lit("nodes")).unionByName(G.edge_stats(self.store.edges()).withColumnRenamed("edge_type", "node_type").withColumn("part", F.lit("edges")))

    def refresh_semantic(self, extractor: S.Extractor, limit: int | None = None) -> dict[str, int]:
        nodes, edges, counts = S.refresh(self.store.nodes(), self.store.edges(), extractor, limit=limit)
        self.store.save(nodes, edges)
        return counts

    def refresh_embeddings(self, embedder: V.Embedder) -> dict[str, int]:
        """Writes the embedding index anew, taking over what hasn't changed."""
        return self.embeddings.refresh(self.store.nodes(), embedder)

    def benchmark(self, suite: str, search: Callable[[str], list[str]] | None = None, embedder: V.Embedder | None = None) -> DataFrame:
        """A suite by lexical search, by a search of one's own, or by hybrid search with an embedder."""
        cases = B.load_suite(self.spark, suite)
        if embedder is not None:
            entries = self.embeddings.load(embedder.model)
            if entries is None:
                raise ValueError("no embedding index of this model; refresh it first")
            search = lambda q: [r["id"] for r in self.search_hybrid(q, 5, None, entries, embedder).orderBy("rank").collect()]
        return B.run_with(cases, self.store.nodes(), search) if search else B.run_lexical(cases, self.store.nodes())

    def due_repositories(self, state: DataFrame, now: str, force: bool = False) -> DataFrame:
        return R.due(state, now, force=force)
