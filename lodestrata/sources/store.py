"""Sinks: versioned graph tables, JSON export, reports, registry and state files."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import graphstore as G
from lodestrata.operators.repositories import STATE
from lodestrata.streaming.ingest import EDGES, NODES, GraphTable


def write_private(path: str, text: str) -> None:
    """Writes a small file for its owner only, complete or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


class GraphStore:
    """Nodes and edges of an evidence graph in versioned tables below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.nodes_table = GraphTable(spark, self.path + "/nodes", NODES)
        self.edges_table = GraphTable(spark, self.path + "/edges", EDGES)

    def nodes(self) -> DataFrame:
        return self.nodes_table.read()

    def edges(self) -> DataFrame:
        return self.edges_table.read()

    def save(self, nodes: DataFrame, edges: DataFrame) -> None:
        self.nodes_table.write(nodes.select(G.NODE_COLUMNS))
        self.edges_table.write(edges.select(G.EDGE_COLUMNS))

    def merge(self, nodes: DataFrame, edges: DataFrame, paths: DataFrame | None = None, types: list[str] = (), below: str | None = None) -> None:
        """Adds nodes and edges behind what is there, in their own order.

        First goes what an earlier reading left: nodes of ``types`` with one of
        ``paths`` (``path``), or whose path lies ``below`` a folder; keywords that
        nothing refers to any more go with the latter.
        """
        old_nodes, old_edges = self.nodes(), self.edges()
        if paths is not None:
            old_nodes, old_edges = G.remove_by_path(old_nodes, old_edges, paths, list(types))
        if below is not None:
            old_nodes, old_edges = G.remove_below(old_nodes, old_edges, below, list(types))
        last = max(df.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0] for df in (self.nodes(), self.edges()))
        behind = lambda df, *ties: df.orderBy("ord", *ties).withColumn("ord", F.lit(last + 1) + F.monotonically_increasing_id())
        all_nodes = G.upsert_nodes(old_nodes.select(G.NODE_COLUMNS).unionByName(behind(nodes, "id").select(G.NODE_COLUMNS)))
        all_edges = G.upsert_edges(old_edges.select(G.EDGE_COLUMNS).unionByName(behind(edges, "src", "dst").select(G.EDGE_COLUMNS)))
        all_edges = G.valid_edges(all_edges, all_nodes).select(G.EDGE_COLUMNS)
        if below is not None:
            all_nodes, all_edges = G.without_orphan_keywords(all_nodes, all_edges)
        self.save(all_nodes, all_edges)

    def replace_repository(self, root: str, url: str, branch: str, commit: str) -> dict[str, int | str]:
        """Puts a repository's present files and functions, with their provenance, in the place of what was read of it before."""
        from lodestrata.sources.checkout import later, with_repository

        nodes, edges = G.remove_repository(self.nodes(), self.edges(), root)
        read_nodes, read_edges, counts = with_repository(self.spark, nodes, edges, root, url)
        all_nodes = G.upsert_nodes(later(nodes.select(G.NODE_COLUMNS), read_nodes))
        all_nodes = G.attach_provenance(all_nodes, root, url, branch, commit)
        all_edges = G.upsert_edges(later(edges.select(G.EDGE_COLUMNS), read_edges))
        self.save(all_nodes, G.drop_related(G.valid_edges(all_edges, all_nodes)).select(G.EDGE_COLUMNS))
        return counts

    def fingerprint(self) -> str:
        """Names the versions that are read now."""
        return ":".join((t.versions() or ["none"])[-1] for t in (self.nodes_table, self.edges_table))

    def written_at(self) -> int | None:
        """When the graph was written last, in milliseconds; None where it never was."""
        return self.nodes_table.written_at()

    def export_json(self, folder: str) -> None:
        """One JSON document per line: nodes and edges, for other tools; written by the tasks."""
        self.nodes().select("id", F.col("node_type").alias("type"), "label", "text", "path", "metadata").write.mode("overwrite").json(folder + "/nodes")
        self.edges().select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("edge_type").alias("type"), "weight", "metadata").write.mode("overwrite").json(folder + "/edges")


def write_state(path: str, state: DataFrame, refreshed_at: str | None) -> None:
    """The state of managed repositories as one small file (one row per repository, in the order given)."""
    rows = [r.asDict() for r in state.collect()]
    write_private(path, json.dumps({"version": 1, "lastRefreshAt": refreshed_at, "entries": rows}, indent=2))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state written by ``write_state``; a missing file is an empty state."""
    if not os.path.exists(path):
        return spark.createDataFrame([], STATE)
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["entries"]
    names = [p.split()[0] for p in STATE.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], STATE)


def state_refreshed_at(path: str) -> str | None:
    """When the state's repositories were refreshed last, or None."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("lastRefreshAt")


def write_report(stem: str, name: str, report: DataFrame) -> None:
    """A benchmark report as ``stem.json`` and ``stem.md``; it has a row per case of a suite."""
    from lodestrata.operators import evalbench as B

    cases = [r.asDict() for r in report.orderBy("id").collect()]
    write_private(stem + ".json", json.dumps({"name": name, "metrics": B.summarize(report).first().asDict(), "cases": cases}, indent=2))
    write_private(stem + ".md", B.markdown(name, report))
