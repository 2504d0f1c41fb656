"""Checkouts of repositories with git: import of one, and the refresh of managed ones."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import graphstore as G
from lodestrata.operators import repositories as R
from lodestrata.sources import code, files
from lodestrata.sources.store import GraphStore, read_state, state_refreshed_at, write_state


def git(*arguments: str, timeout: float = 600.0) -> str:
    """The output of a git command; raises with what it says where it fails."""
    done = subprocess.run(["git", *arguments], capture_output=True, text=True, timeout=timeout, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git ended with {done.returncode}")
    return done.stdout.strip()


def checkout(source: str, folder: str) -> str:
    """A local path as it is, else a shallow clone of an address below ``folder``, brought up to date if it is there."""
    if os.path.exists(source):
        return os.path.abspath(source)
    name = re.sub(r"[^a-zA-Z0-9._-]", "-", os.path.basename(source.rstrip("/").removesuffix(".git")))
    target = os.path.join(folder, name)
    if os.path.isdir(target):
        git("-C", target, "pull", "--ff-only")
    else:
        os.makedirs(folder, exist_ok=True)
        git("clone", "--depth", "1", source, target)
    return target


def update(url: str, target: str) -> tuple[str, str]:
    """Clones or fetches a managed repository; its default branch and that branch's commit."""
    if not os.path.isdir(os.path.join(target, ".git")):
        git("clone", "--filter=blob:none", url, target)
    git("-C", target, "fetch", "--prune", "origin")
    git("-C", target, "remote", "set-head", "origin", "--auto")
    reference = git("-C", target, "symbolic-ref", "--short", "refs/remotes/origin/HEAD")
    branch = reference.removeprefix("origin/")
    if branch in ("", reference):
        raise RuntimeError(f"no default branch in {target}")
    return branch, git("-C", target, "rev-parse", f"origin/{branch}")


def with_repository(spark: SparkSession, nodes: DataFrame, edges: DataFrame, root: str, url: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int | str]]:
    """A graph with a repository's files and, where its language is known, its call graph; and counts."""
    tree = files.walk(spark, root)
    kind = files.language(tree.where(files.T.directory("path") == root.rstrip("/")))
    read_nodes, read_edges = files.repository_files(spark, root, url)
    count = read_nodes.where("node_type = 'file'").count()
    functions = 0
    if kind != "generic":
        graph = code.repository_functions(spark, root, kind)
        code_nodes, code_edges = G.merge_code_graph(graph, read_nodes, root)
        # the call graph comes behind the files it is merged into
        read_nodes, read_edges = later(read_nodes, code_nodes), later(read_edges, code_edges)
        functions = graph.count()
    return read_nodes, read_edges, {"language": kind, "files": count, "functions": functions}


def later(first: DataFrame, then: DataFrame) -> DataFrame:
    """Both tables, all rows of ``then`` behind those of ``first``."""
    from pyspark.sql import functions as F

    place = lambda df, n: df.withColumn("ord", F.struct(F.lit(n).alias("n"), F.col("ord").alias("o")))
    both = place(first, 0).unionByName(place(then.select(first.columns), 1))
    return both.orderBy("ord").withColumn("ord", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Managed:
    """A repository that is kept up to date: ``slug`` (owner/name), its address, and its place in the list."""

    slug: str
    url: str
    rank: int = 999


def refresh_managed(store: GraphStore, managed: list[Managed], folder: str, state_path: str, force: bool = False, hours: int = 24, now: datetime | None = None, visibility: Callable[[str], str] = lambda slug: "unknown") -> dict[str, int | bool]:
    """Brings managed repositories up to date; one that fails keeps its entry, with the error, and stops no other.

    Not before ``hours`` have passed since the last refresh. A repository whose
    commit is the indexed one is left as it is. Of another the new graph is made
    from the stored one, which it replaces only once it is whole.
    """
    spark = store.spark
    now = now or datetime.now(timezone.utc)
    stamp = now.isoformat(timespec="milliseconds").replace("+00:00", "Z")
    state = {r["slug"]: r.asDict() for r in read_state(spark, state_path).collect()}
    last = state_refreshed_at(state_path)
    if not force and last and (now - datetime.fromisoformat(last.replace("Z", "+00:00"))).total_seconds() < hours * 3600:
        return {"due": False, "checked": 0, "updated": 0, "unchanged": len(managed), "failed": 0}
    os.makedirs(folder, exist_ok=True)
    counts = {"updated": 0, "unchanged": 0, "failed": 0}
    ranks = {m.slug: m.rank for m in managed}
    for m in managed:
        root = os.path.join(os.path.abspath(folder), m.slug.replace("/", "--"))
        entry = state.get(m.slug) or {"slug": m.slug, "url": m.url, "local_path": root, "default_branch": "", "visibility": "unknown", "indexed_commit": "", "files": 0, "functions": 0, "last_checked_at": stamp, "last_indexed_at": None, "error": None}
        try:
            branch, commit = update(m.url, root)
            entry = {**entry, "default_branch": branch, "visibility": visibility(m.slug), "last_checked_at": stamp, "error": None}
            if entry["indexed_commit"] == commit:
                counts["unchanged"] += 1
            else:
                git("-C", root, "checkout", "--force", "-B", branch, f"origin/{branch}")
                done = store.replace_repository(root, m.url, branch, commit)
                entry = {**entry, "indexed_commit": commit, "files": done["files"], "functions": done["functions"], "last_indexed_at": stamp}
                counts["updated"] += 1
        except Exception as e:
            entry = {**entry, "last_checked_at": stamp, "error": (str(e) or type(e).__name__)[:1000]}
            counts["failed"] += 1
        state[m.slug] = entry
        write_state(state_path, rows_of(spark, state, ranks), last)
    write_state(state_path, rows_of(spark, state, ranks), stamp)
    return {"due": True, "checked": len(managed), **counts}


def rows_of(spark: SparkSession, state: dict[str, dict], ranks: dict[str, int]) -> DataFrame:
    """The state as a table, in the order of ``ranks``."""
    names = [p.split()[0] for p in R.STATE.split(", ")]
    ordered = sorted(state.values(), key=lambda e: (ranks.get(e["slug"], 999), e["slug"]))
    return spark.createDataFrame([tuple(e[n] for n in names) for e in ordered], R.STATE).coalesce(1)
