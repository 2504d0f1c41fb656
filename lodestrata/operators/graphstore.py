"""The evidence graph as two tables: merging, removal, neighbourhood, listing.

Nodes: ``id, node_type, label, text, path, metadata, ord``. Edges: ``src, dst,
edge_type, weight, metadata, ord``. ``ord`` stands for insertion order; results
that depend on order end with it, so they don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

NODE_COLUMNS = ["id", "node_type", "label", "text", "path", "metadata", "ord"]
EDGE_COLUMNS = ["src", "dst", "edge_type", "weight", "metadata", "ord"]
#: Kinds of nodes and edges (fixed values).
NODE_TYPES = "project file function recording transcript prompt document memory session turn entity claim decision preference task event keyword".split()
EDGE_TYPES = "CONTAINS CALLS HAS_TRANSCRIPT HAS_TURN NEXT TAGGED MENTIONS DERIVED_FROM CONTRADICTS SUPERSEDES RELATED".split()
#: Types of nodes that can be browsed by themselves (fixed values).
BROWSED_TYPES = "project file function recording transcript prompt document memory session turn".split()
#: Edges along which evidence is related.
EVIDENCE_EDGES = "CALLS HAS_TRANSCRIPT HAS_TURN NEXT CONTAINS DERIVED_FROM MENTIONS CONTRADICTS SUPERSEDES".split()
DERIVED_TYPES = "claim decision preference task event".split()


def upsert_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last version of each node, at its first position; partial aggregation on the map side.

    Only ``columns`` (all, where none are named) beside ``id`` and ``ord`` are read and shuffled.
    """
    rest = [c for c in (NODE_COLUMNS if columns is None else columns) if c not in ("id", "ord")]
    first = F.min("ord").alias("ord")
    if not rest:
        return nodes.groupBy("id").agg(first)
    last = nodes.select("id", "ord", *rest).groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("_v"), first)
    return last.select("id", "_v.*", "ord").select([c for c in NODE_COLUMNS if c in ("id", "ord") or c in rest])


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, edge_type): largest weight, first metadata and position."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.max("weight").alias("weight"), F.min_by("metadata", "ord").alias("metadata"), F.min("ord").alias("ord")).select(EDGE_COLUMNS)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different existing nodes."""
    ids = nodes.select("id").distinct()
    return (
        edges.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """``id``, ``other`` in either direction, so that a neighbourhood is an equi-join."""
    kept = ["edge_type", "weight", "ord"]
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), *kept).unionByName(
        edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), *kept)
    )


def related(edges: DataFrame, nodes: DataFrame, of: DataFrame, top: int = 5) -> DataFrame:
    """The strongest ``top`` evidence edges of each id in ``of``; ends that don't exist drop out afterwards.

    Result: ``id``, ``rank``, ``other``, ``weight``.
    """
    near = both_ways(edges.where(F.col("edge_type").isin(EVIDENCE_EDGES))).join(of.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy("id").orderBy(F.col("weight").desc(), "ord")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(nodes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "rank", "other", "weight")


def related_any(edges: DataFrame, nodes: DataFrame, of: DataFrame, top: int = 5) -> DataFrame:
    """Up to ``top`` distinct neighbours over any edge that aren't keywords, by first edge, then id."""
    near = both_ways(edges).join(of.select("id").distinct(), "id", "left_semi").groupBy("id", "other").agg(F.min("ord").alias("ord"))
    near = near.join(nodes.where("node_type <> 'keyword'").select(F.col("id").alias("other")), "other", "left_semi")
    order = Window.partitionBy("id").orderBy("ord", "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("id", "rank", "other")


RELATED = "array<struct<id:string,node_type:string,label:string,path:string>>"


def with_related(found: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """``found`` (``id``) with ``related``: the nodes of ``near`` (``id``, ``rank``, ``other``) in order, with what is shown of them."""
    shown = nodes.select(F.col("id").alias("other"), F.struct("id", "node_type", "label", "path").alias("n"))
    listed = near.join(shown, "other").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "n"))), lambda s: s["n"]).alias("related"))
    return found.join(listed, "id", "left").withColumn("related", F.coalesce("related", F.array().cast(RELATED)))


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def browse(nodes: DataFrame, node_type: str | None = None, limit: int = 50) -> DataFrame:
    """Newest nodes first (at most 100), keywords never; ``id, node_type, label, path, millis``."""
    kept = nodes.where("node_type <> 'keyword'")
    if node_type and node_type != "all":
        kept = kept.where(F.col("node_type") == node_type)
    dated = kept.select("id", "node_type", "label", "path", T.node_millis("metadata").alias("millis"), "ord")
    return dated.orderBy(F.col("millis").desc(), F.expr("collate(label, 'UNICODE')"), "ord").limit(max(1, min(limit, 100))).drop("ord")


def tag_keywords(nodes: DataFrame, terms: Column, cap: int = 24) -> tuple[DataFrame, DataFrame]:
    """Keyword nodes and TAGGED edges of each node's ``terms`` (array): normalised, three characters or more, distinct, first ``cap``."""
    kept = F.slice(F.array_distinct(F.filter(F.transform(terms, T.normal_token), lambda t: F.length(t) >= 3)), 1, cap)
    tagged = nodes.select(F.col("id").alias("src"), F.col("ord").alias("_o"), F.posexplode(kept).alias("_p", "term"))
    edges = tagged.select("src", F.concat(F.lit("keyword:"), "term").alias("dst"), F.lit("TAGGED").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("metadata"), F.col("_o").alias("ord"))
    keywords = tagged.groupBy("term").agg(F.min("_o").alias("ord")).select(
        F.concat(F.lit("keyword:"), "term").alias("id"), F.lit("keyword").alias("node_type"), F.col("term").alias("label"), F.col("term").alias("text"),
        F.lit(None).cast("string").alias("path"), F.lit("{}").alias("metadata"), "ord",
    )
    return keywords, edges


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids in ``gone`` and the edges at them."""
    ids = gone.select("id").distinct()
    return (
        nodes.join(ids, "id", "left_anti").select(nodes.columns),
        edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns),
    )


def orphans(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str) -> DataFrame:
    """``id`` of nodes of a type at which no edge of a type ends (keywords/TAGGED, entities/MENTIONS)."""
    held = edges.where(F.col("edge_type") == edge_type).select(F.col("dst").alias("id")).distinct()
    return nodes.where(F.col("node_type") == node_type).join(held, "id", "left_anti").select("id")


def remove_by_path(nodes: DataFrame, edges: DataFrame, path: str | DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without what an earlier reading of ``path`` (one, or a table with ``path``) left; types limit it."""
    mine = nodes.where(F.col("node_type").isin(types))
    mine = mine.where(F.col("path") == path) if isinstance(path, str) else mine.join(path.select("path").distinct(), "path", "left_semi")
    return without_nodes(nodes, edges, mine.select("id"))


def remove_below(nodes: DataFrame, edges: DataFrame, root: str, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Without nodes of ``types`` whose path lies below ``root``."""
    return without_nodes(nodes, edges, nodes.where(F.col("node_type").isin(types) & F.col("path").startswith(root.rstrip("/") + "/")).select("id"))


def of_project(root: str, project: str | None = None) -> Column:
    """Whether a node is a repository's own: its path is the root, or its metadata names the project, which the engine
    itself names by its root; tables may name it otherwise (``project``)."""
    root = root.rstrip("/")
    return F.coalesce(F.col("path") == root, F.lit(False)) | F.coalesce(F.get_json_object("metadata", "$.project") == (project or root), F.lit(False))


def repository_ids(nodes: DataFrame, root: str, project: str | None = None) -> DataFrame:
    """Ids that go with a repository: nodes of any type that are its own, and what derives from them."""
    direct = nodes.where(of_project(root, project)).select("id")
    derived = nodes.select("id", F.get_json_object("metadata", "$.sourceID").alias("source_id")).where("source_id is not null")
    return direct.unionByName(derived.join(direct.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("id")).distinct()


def remove_repository(nodes: DataFrame, edges: DataFrame, root: str, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Without a repository, what derives from it, and keywords that nothing refers to any more."""
    return without_orphan_keywords(*without_nodes(nodes, edges, repository_ids(nodes, root, project)))


def without_orphan_keywords(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return without_nodes(nodes, edges, orphans(nodes, edges, "keyword", "TAGGED"))


def drop_related(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type <> 'RELATED'")


def remove_derived(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without facts derived from ``sources`` (id), and entities that nothing mentions any more."""
    gone = nodes.where(F.col("node_type").isin(DERIVED_TYPES)).select("id", F.get_json_object("metadata", "$.sourceID").alias("source_id"))
    left, held = without_nodes(nodes, edges, gone.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi"))
    return without_nodes(left, held, orphans(left, held, "entity", "MENTIONS"))


def visible_subgraph(hits: DataFrame, near: DataFrame, edges: DataFrame, nodes_cap: int = 40, edges_cap: int = 100) -> DataFrame:
    """Edges among the first ``nodes_cap`` ids of hits (``id``, ``rank``) and their related nodes (``id``, ``other``, ``rank``).

    Both caps are the feature: it is a drawing. The ids are broadcast only
    because their number is capped.
    """
    listed = hits.select("id", F.col("rank").alias("_a"), F.lit(0).alias("_b")).unionByName(
        near.join(hits.select("id", F.col("rank").alias("_a")), "id").select(F.col("other").alias("id"), "_a", F.col("rank").alias("_b"))
    )
    ids = F.broadcast(listed.groupBy("id").agg(F.min(F.struct("_a", "_b")).alias("_k")).orderBy("_k", "id").limit(nodes_cap).select("id"))
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.orderBy("ord").limit(edges_cap).select("src", "dst", "edge_type", "weight")


def metadata_with(metadata: str | Column, **added: Column) -> Column:
    """A JSON object with fields set; other fields keep their JSON values. Null fields are written as null."""
    had = F.coalesce(F.from_json(T.col(metadata), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    raw = F.transform_values(had, lambda k, _: F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(T.col(metadata)), F.lit("$"), "map<string,variant>")[k]), F.lit("null")))
    kept = F.transform(F.map_entries(F.map_filter(raw, lambda k, _: ~k.isin(list(added)))), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"]))
    new = F.array(*(F.concat(json_string(F.lit(k)), F.lit(":"), F.coalesce(json_string(v), F.lit("null"))) for k, v in added.items()))
    return F.concat(F.lit("{"), F.array_join(F.concat(kept, new), ","), F.lit("}"))


def json_string(c: Column) -> Column:
    """A string as JSON writes it."""
    return F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def merge_code_graph(functions: DataFrame, nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Project, file, function and keyword nodes and CONTAINS, CALLS and TAGGED edges of a call graph.

    Files that are known keep their label, text and metadata, and get the
    project's name. Calls of functions that aren't in the graph are left out.
    """
    repo = repo.rstrip("/")
    project = F.concat(F.lit("project:"), T.stable_id(F.lit(repo)))
    function_id = lambda key: F.concat(F.lit("function:"), T.stable_id(F.concat(F.lit(repo + ":"), key)))
    file_id = F.concat(F.lit("file:"), T.stable_id("filepath"))
    null = F.lit(None).cast("string")
    # insertion order: the project, then each function behind its file
    place = lambda n: F.col("ord") * 2 + n
    head = functions.sparkSession.range(1).select(
        project.alias("id"), F.lit("project").alias("node_type"), F.lit(repo.rsplit("/", 1)[-1]).alias("label"), F.lit(repo).alias("text"), F.lit(repo).alias("path"), F.lit("{}").alias("metadata"), F.lit(-(2**62)).cast("bigint").alias("ord")
    )
    known = nodes.where("node_type = 'file'").select("id", F.col("label").alias("_label"), F.col("text").alias("_text"), F.col("metadata").alias("_metadata"))
    files = (
        functions.groupBy("filepath").agg(F.min(place(0)).alias("ord")).select(file_id.alias("id"), "filepath", "ord").join(known, "id", "left")
        .select("id", F.lit("file").alias("node_type"), F.coalesce("_label", T.relative_path("filepath", repo)).alias("label"), F.coalesce("_text", "filepath").alias("text"), F.col("filepath").alias("path"), metadata_with(F.coalesce("_metadata", F.lit("{}")), project=F.lit(repo)).alias("metadata"), "ord")
    )
    made = functions.select(
        function_id(F.col("key")).alias("id"), F.lit("function").alias("node_type"), F.col("key").alias("label"), F.concat("key", F.lit(" "), T.relative_path("filepath", repo)).alias("text"), F.col("filepath").alias("path"),
        F.to_json(F.struct("lineno", "end_lineno", F.lit(repo).alias("project"))).alias("metadata"), place(1).alias("ord"),
    )
    keywords, tagged = tag_keywords(made, T.tokens("label"))
    edge = lambda src, dst, kind: (src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"), null.alias("metadata"), F.col("ord"))
    contains = functions.select(*edge(project, file_id, "CONTAINS")).unionByName(functions.select(*edge(file_id, function_id(F.col("key")), "CONTAINS")))
    calls = functions.select("key", "ord", F.explode("callees").alias("callee")).join(functions.select(F.col("key").alias("callee")), "callee", "left_semi").where("key <> callee")
    calls = calls.select(*edge(function_id(F.col("key")), function_id(F.col("callee")), "CALLS"))
    return upsert_nodes(head.unionByName(files).unionByName(made).unionByName(keywords)), upsert_edges(contains.unionByName(calls).unionByName(tagged))


def attach_provenance(nodes: DataFrame, root: str, repository: str, branch: str, commit: str, project: str | None = None) -> DataFrame:
    """Metadata of a repository's own nodes with repository, branch, commit and relative path (null for the project) added."""
    root = root.rstrip("/")
    relative = F.when(F.col("path") != root, F.substring("path", len(root) + 2, 2**31 - 1))
    added = metadata_with("metadata", repository=F.lit(repository), branch=F.lit(branch), commit=F.lit(commit), relativePath=relative)
    return nodes.withColumn("metadata", F.when(of_project(root, project), added).otherwise(F.col("metadata")))
