"""Registered queries of the core operators, and the SQL they are held against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import callgraph as C
from lodestrata.operators import evalbench as B
from lodestrata.operators import fulltext as X
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical as L
from lodestrata.operators import semantic as S
from lodestrata.operators import vectors as V
from lodestrata.plans import sql as Q
from lodestrata.session import staged, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A question, a misspelt one, full-text words and a repository; parameters of the queries.
QUESTION = "Which release keeps the cache of the terminal reviewer"
MISSPELT = "resolvr partitoin sessoin"
WORDS = "threshold ledger"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The graph's nodes; with ``columns`` only these beside id and order are read."""
    kept = [c for c in G.NODE_COLUMNS if not columns or c in ("id", "ord", *columns)]
    both = table(spark, d, "knowledge_nodes").select(kept).unionByName(table(spark, d, "shared_nodes").select(kept))
    return G.upsert_nodes(both, list(columns) if columns else None)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.upsert_edges(table(spark, d, "knowledge_edges"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """A call graph over the parts: each calls up to two others and a name that isn't in the graph."""
    part = table(spark, d, "part").select("p_partkey")
    n = part.agg(F.max("p_partkey")).first()[0]
    p = F.col("p_partkey")
    key = lambda k: F.concat(F.lit("mod_"), (k % 97).cast("string"), F.lit(".fn_"), k.cast("string"))
    callee = F.array_compact(
        F.array(
            F.when(p % 4 != 0, key((7 * p + 3) % n + 1)),
            F.when(p % 5 == 0, key((13 * p + 1) % n + 1)),
            F.when(p % 5 == 0, F.concat(F.lit("ext_"), (p % 13).cast("string"))),
        )
    )
    folder = F.when((p % 97) % 10 == 0, "/repo/tests/mod_").otherwise("/repo/mod_")
    return part.select(
        key(p).alias("key"), F.concat(folder, (p % 97).cast("string"), F.lit(".py")).alias("filepath"), callee.alias("callees"), p.cast("int").alias("lineno"), (p + 9).cast("int").alias("end_lineno"), p.alias("ord")
    )


def _key(spark: SparkSession, key: str) -> DataFrame:
    return spark.createDataFrame([(key,)], "key string")


# ---- merging and statistics -----------------------------------------------------------------


@query(f"WITH {Q.NODES} SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def node_stats(spark, d):
    return G.node_stats(_nodes(spark, d, "node_type"))


@query(f"WITH {Q.EDGES} SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def edge_stats(spark, d):
    return G.edge_stats(_edges(spark, d))


@query(f"WITH {Q.NODES} SELECT id, node_type, label, path, ord, coalesce(length(text), -1) AS chars FROM nodes")
def node_upsert_last(spark, d):
    return _nodes(spark, d).select("id", "node_type", "label", "path", "ord", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"))


@query(f"WITH {Q.EDGES} SELECT src, dst, edge_type, weight, metadata, ord FROM edges")
def edge_upsert_max(spark, d):
    return _edges(spark, d)


@query(f"WITH {Q.NODES}, {Q.EDGES} SELECT e.src, e.dst, e.edge_type, e.weight FROM edges e WHERE e.src <> e.dst AND e.src IN (SELECT id FROM nodes) AND e.dst IN (SELECT id FROM nodes)")
def edge_endpoints_valid(spark, d):
    return G.valid_edges(_edges(spark, d), _nodes(spark, d, "node_type")).select("src", "dst", "edge_type", "weight")


@query(f"WITH {Q.NODES} SELECT count(*) AS nodes, count(DISTINCT path) AS files FROM nodes WHERE node_type = 'file'")
def distinct_files(spark, d):
    return _nodes(spark, d, "node_type", "path").where("node_type = 'file'").agg(F.count("*").alias("nodes"), F.countDistinct("path").alias("files"))


# ---- text functions -------------------------------------------------------------------------


@query(f"WITH t AS (SELECT doc_id, unnest({Q.tokens('text')}) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode_outer(T.tokens("text")).alias("token")).where("token is not null")
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"WITH t AS (SELECT DISTINCT unnest({Q.tokens('label')}) AS token FROM knowledge_nodes) SELECT token, {Q.signature('token')} AS signature FROM t")
def phonetic_signature(spark, d):
    t = table(spark, d, "knowledge_nodes").select(F.explode(T.tokens("label")).alias("token")).distinct()
    return t.select("token", T.phonetic_signature("token").alias("signature"))


@query(f"SELECT id, ord, {Q.phrase('label')} AS phrase, regexp_replace({Q.folded('label')}, '[^a-z0-9]', '', 'g') AS token FROM knowledge_nodes")
def normalize_text(spark, d):
    return table(spark, d, "knowledge_nodes").select("id", "ord", T.normal_phrase("label").alias("phrase"), T.normal_token("label").alias("token"))


@query("SELECT id, ord, substr(sha256(id || ':' || coalesce(label, '')), 1, 20) AS sid, coalesce(nullif(substr(trim(regexp_split_to_array(label, '\\r?\\n')[1]), 1, 80), ''), 'Untitled memory') AS first FROM knowledge_nodes")
def stable_ids(spark, d):
    n = table(spark, d, "knowledge_nodes")
    return n.select("id", "ord", T.stable_id(F.concat("id", F.lit(":"), F.coalesce("label", F.lit("")))).alias("sid"), T.first_line("label").alias("first"))


@query(f"SELECT id, ord, {Q.millis('metadata')} AS millis FROM knowledge_nodes")
def node_dates(spark, d):
    return table(spark, d, "knowledge_nodes").select("id", "ord", T.node_millis("metadata").alias("millis"))


# ---- browsing, neighbourhood, tags ----------------------------------------------------------


@query(f"WITH {Q.NODES} SELECT id, node_type, label, {Q.millis('metadata')} AS millis FROM nodes WHERE node_type = 'recording' ORDER BY millis DESC, label COLLATE en, ord LIMIT 50")
def browse_recent(spark, d):
    return G.browse(_nodes(spark, d, "node_type", "label", "path", "metadata"), "recording", 50).select("id", "node_type", "label", "millis")


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH},
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC NULLS LAST, ord) AS rank FROM both_ways WHERE edge_type IN {Q.EVIDENCE} AND id IN (SELECT seed_id FROM search_queries))
SELECT id, rank, other, weight FROM best WHERE rank <= 5 AND other IN (SELECT id FROM nodes)"""
)
def related_top5(spark, d):
    seeds = table(spark, d, "search_queries").select(F.col("seed_id").alias("id"))
    return G.related(_edges(spark, d), _nodes(spark, d, "node_type"), seeds)


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH},
near AS (SELECT id, other, min(ord) AS ord FROM both_ways WHERE id IN (SELECT seed_id FROM search_queries) AND other IN (SELECT id FROM nodes WHERE node_type <> 'keyword') GROUP BY 1, 2)
SELECT id, rank, other FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, other) AS rank FROM near) WHERE rank <= 5"""
)
def related_any5(spark, d):
    seeds = table(spark, d, "search_queries").select(F.col("seed_id").alias("id"))
    return G.related_any(_edges(spark, d), _nodes(spark, d, "node_type"), seeds)


@query(
    f"""WITH {Q.NODES}, t AS (SELECT id, list_transform(string_split(label, ' '), lambda x: regexp_replace({Q.folded('x')}, '[^a-z0-9]', '', 'g')) AS ts FROM nodes WHERE node_type IN ('memory','document')),
u AS (SELECT id, unnest(list_filter(ts, lambda x: length(x) >= 3)) AS term FROM t)
SELECT DISTINCT id AS src, 'keyword:' || term AS dst FROM u"""
)
def keyword_tag_edges(spark, d):
    n = _nodes(spark, d, "node_type", "label").where(F.col("node_type").isin("memory", "document"))
    return G.tag_keywords(n, F.split("label", " "))[1].select("src", "dst")


@query(f"WITH {Q.NODES}, {Q.EDGES} SELECT id FROM nodes WHERE node_type = 'keyword' AND id NOT IN (SELECT dst FROM edges WHERE edge_type = 'TAGGED' AND dst IS NOT NULL AND src LIKE 'memory:%')")
def keyword_orphans(spark, d):
    edges = _edges(spark, d).where("src like 'memory:%'")
    return G.orphans(_nodes(spark, d, "node_type"), edges, "keyword", "TAGGED")


@query(f"WITH {Q.NODES}, {Q.EDGES} SELECT id FROM nodes WHERE node_type = 'entity' AND id NOT IN (SELECT dst FROM edges WHERE edge_type = 'MENTIONS' AND dst IS NOT NULL)")
def entity_orphans(spark, d):
    return G.orphans(_nodes(spark, d, "node_type"), _edges(spark, d), "entity", "MENTIONS")


# ---- removal --------------------------------------------------------------------------------

_GONE = f"""
root AS (SELECT local_path AS path, slug FROM managed_repos ORDER BY local_path LIMIT 1),
direct AS (SELECT nodes.id FROM nodes, root WHERE nodes.path = root.path OR json_extract_string(metadata, '$.project') = root.slug),
gone AS (SELECT id FROM direct UNION SELECT id FROM nodes WHERE json_extract_string(metadata, '$.sourceID') IN (SELECT id FROM direct)),
left_edges AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
left_nodes AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)),
kept AS (SELECT * FROM left_nodes WHERE node_type <> 'keyword' OR id IN (SELECT dst FROM left_edges WHERE edge_type = 'TAGGED'))
"""


def _without_repository(spark, d):
    # in these tables a node names its project by the repository's slug, not by its path
    root = table(spark, d, "managed_repos").orderBy("local_path").select("local_path", "slug").first()
    return G.remove_repository(_nodes(spark, d, "node_type", "path", "metadata"), _edges(spark, d), root["local_path"], root["slug"])


@query(f"WITH {Q.NODES}, {Q.EDGES}, {_GONE} SELECT id FROM kept")
def remove_repository(spark, d):
    return _without_repository(spark, d)[0].select("id")


@query(f"WITH {Q.NODES}, {Q.EDGES}, {_GONE} SELECT src, dst, edge_type FROM left_edges WHERE dst NOT IN (SELECT id FROM left_nodes WHERE id NOT IN (SELECT id FROM kept))")
def remove_repository_edges(spark, d):
    return _without_repository(spark, d)[1].select("src", "dst", "edge_type")


@query(f"WITH {Q.NODES}, {Q.EDGES}, p AS (SELECT min(path) AS path FROM nodes WHERE node_type = 'memory') SELECT node_type, count(*) AS n FROM nodes, p WHERE NOT (nodes.path IS NOT DISTINCT FROM p.path AND node_type IN ('memory','session','turn')) GROUP BY 1")
def replace_by_path(spark, d):
    nodes = _nodes(spark, d, "node_type", "path")
    path = nodes.where("node_type = 'memory'").agg(F.min("path")).first()[0]
    return G.node_stats(G.remove_by_path(nodes, _edges(spark, d), path, ["memory", "session", "turn"])[0])


@query(f"WITH {Q.EDGES} SELECT edge_type, count(*) AS n, round(sum(weight), 4) AS weight FROM edges WHERE edge_type <> 'RELATED' GROUP BY 1")
def drop_related_edges(spark, d):
    return G.drop_related(_edges(spark, d)).groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


# ---- search ---------------------------------------------------------------------------------


def _bm25_sql(words: str, limit: int, types: str = "", boosted: bool = True) -> str:
    terms = [t for t in T.query_terms(words) if len(t) >= 3]
    fields = ("label", "text", "path")
    low = lambda f: f"lower(coalesce({f}, ''))"
    count = lambda t: " + ".join(f"(length({low(f)}) - length(replace({low(f)}, '{t}', ''))) / {len(t)}" for f in fields)
    holds = lambda t: "(" + " OR ".join(f"contains({low(f)}, '{t}')" for f in fields) + ")"
    size = " + ".join(f"greatest(0, length(coalesce({f}, '')) - 2)" for f in fields)
    stats = ", ".join(f"count(*) FILTER (WHERE {holds(t)}) AS n{i}" for i, t in enumerate(terms))
    idf = lambda i: f"(CASE WHEN ln((s.n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((s.n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END)"
    rank = " + ".join(f"{idf(i)} * ({count(t)}) * 2.2 / (({count(t)}) + 1.2 * (0.25 + 0.75 * size / s.mean))" for i, t in enumerate(terms))
    boost = "CASE " + " ".join(f"WHEN node_type = '{k}' THEN {v}" for k, v in X.TYPE_BOOST.items()) + " ELSE 1.0 END"
    return f"""WITH {Q.NODES}, docs AS (SELECT *, {size} AS size FROM nodes WHERE node_type <> 'keyword'),
s AS (SELECT count(*) AS n, avg(size) AS mean, {stats} FROM docs),
r AS (SELECT id, node_type, label, path, ord, round({rank}, 9) AS rank, round(({rank}) * {boost}, 9) AS score FROM docs, s WHERE ({" OR ".join(holds(t) for t in terms)}){types}),
b AS (SELECT * FROM r ORDER BY {"rank" if boosted else "score"} DESC, ord, id LIMIT {limit})
SELECT id, node_type, label, path, round(score, 6) AS score FROM b"""


def _fts(spark, d, **kw):
    docs = X.indexed(_nodes(spark, d))
    return X.search(docs, WORDS, **kw).withColumn("score", F.round("score", 6))


@query(_bm25_sql(WORDS, 20))
def fts_bm25_topk(spark, d):
    return _fts(spark, d)


@query(_bm25_sql(WORDS, 20, " AND node_type IN ('memory', 'document')"))
def fts_type_filter(spark, d):
    return _fts(spark, d, types=["memory", "document"])


@query(_bm25_sql(WORDS, 10, boosted=False))
def fts_boosted(spark, d):
    return _fts(spark, d, limit=10, boost_before_limit=True)


@query(_bm25_sql("of it ledger", 20))
def fts_short_terms(spark, d):
    # words under three characters match nothing and count for nothing
    return X.search(X.indexed(_nodes(spark, d)), "of it ledger").withColumn("score", F.round("score", 6))


def _lexical_sql(question: str, limit: int) -> str:
    wanted = list(dict.fromkeys(T.tokens_plain(question)))
    parts = []
    for w in wanted:
        s = T.signature_plain(w)
        for toks, exact, near in (("l", 5, 3), ("b", 2, 1)):
            alike = f"len(list_filter({toks}, lambda t: length(t) >= 5 AND t <> '{w}' AND levenshtein({Q.signature('t')}, '{s}') <= 1)) > 0" if len(w) >= 5 else "false"
            parts.append(f"(CASE WHEN list_contains({toks}, '{w}') THEN {exact} WHEN {alike} THEN {near} ELSE 0 END)")
    return f"""WITH {Q.NODES}, k AS (SELECT id, node_type, ord, {Q.millis('metadata')} AS millis, list_distinct({Q.tokens('label')}) AS l, list_distinct({Q.tokens('text')}) AS b FROM nodes WHERE node_type <> 'keyword'),
s AS (SELECT id, ord, millis, {" + ".join(parts)} AS score FROM k)
SELECT score, count(*) AS n FROM s WHERE score > 0 GROUP BY 1 ORDER BY 1 DESC LIMIT {limit}"""


def _lexical_scores(spark, d, question):
    """How many nodes have each of the best scores; ties of the ranking don't matter to it."""
    nodes = _nodes(spark, d)
    one = spark.createDataFrame([(1, question)], "query_id int, question string")
    found = L.search_many(nodes, one, 2**31 - 1)
    return found.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.col("score").desc()).limit(6)


@query(_lexical_sql(QUESTION, 6))
def lexical_search(spark, d):
    return _lexical_scores(spark, d, QUESTION)


@query(_lexical_sql(MISSPELT, 6))
def lexical_phonetic(spark, d):
    return _lexical_scores(spark, d, MISSPELT)


@query()
def lexical_top20(spark, d):
    return L.search(_nodes(spark, d), QUESTION, 20)


@query()
def lexical_many(spark, d):
    # a suite of questions; each meets all nodes
    suite = [(1, QUESTION), (2, MISSPELT), (3, WORDS), (4, "Which reviewer prefers the quiet archive")]
    return L.search_many(_nodes(spark, d), spark.createDataFrame(suite, "query_id int, question string"), 5)


_OUTER = "[\\s\\p{Z}\\x0b]+"


@query(
    f"""WITH {Q.NODES}, t AS (SELECT id, regexp_replace(text, '^{_OUTER}|{_OUTER}$', '', 'g') AS c FROM nodes WHERE node_type = 'memory' AND text IS NOT NULL),
n AS (SELECT id, c, strpos(lower(c), 'cache') AS here, list_filter({Q.tokens('c')}, lambda t: length(t) >= 5 AND t <> 'cache' AND levenshtein({Q.signature('t')}, '{T.signature_plain('cache')}') <= 1)[1] AS near FROM t),
p AS (SELECT id, c, CASE WHEN here > 0 THEN here - 1 WHEN near IS NOT NULL THEN strpos(lower(c), near) - 1 ELSE -1 END AS pos FROM n)
SELECT id, CASE WHEN length(c) <= 120 THEN c WHEN pos < 0 THEN substr(c, 1, 120) ELSE (CASE WHEN greatest(0, pos - 40) > 0 THEN '…' ELSE '' END) || substr(c, greatest(0, pos - 40) + 1, 120) || (CASE WHEN greatest(0, pos - 40) + 120 < length(c) THEN '…' ELSE '' END) END AS excerpt FROM p"""
)
def excerpt(spark, d):
    return _nodes(spark, d, "node_type", "text").where("node_type = 'memory' and text is not null").select("id", L.excerpt("text", "cache", 120).alias("excerpt"))


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, h AS (SELECT node_id AS id, row_number() OVER (ORDER BY s DESC, node_id) AS rank FROM (SELECT node_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s FROM search_results WHERE query_id = 1 GROUP BY 1) WHERE s IS NOT NULL QUALIFY row_number() OVER (ORDER BY s DESC, node_id) <= 18),
{Q.BOTH}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC NULLS LAST, ord) AS r FROM both_ways WHERE edge_type IN {Q.EVIDENCE} AND id IN (SELECT id FROM h)),
near AS (SELECT h.rank AS a, best.r AS b, best.other AS id FROM best JOIN h USING (id) WHERE best.r <= 5 AND other IN (SELECT id FROM nodes)),
ids AS (SELECT id FROM (SELECT id, min((a, b)) AS k FROM (SELECT rank AS a, 0 AS b, id FROM h UNION ALL SELECT a, b, id FROM near) GROUP BY id) ORDER BY k, id LIMIT 40)
SELECT src, dst, edge_type, weight FROM edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) ORDER BY ord LIMIT 100"""
)
def visualize_subgraph(spark, d):
    score = F.when(~F.isnan("score"), F.col("score"))
    hits = table(spark, d, "search_results").where("query_id = 1").groupBy(F.col("node_id").alias("id")).agg(F.max(score).alias("s")).where("s is not null")
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("s").desc(), "id"))).where("rank <= 18").select("id", "rank")
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    return G.visible_subgraph(hits, G.related(edges, nodes, hits), edges)


# ---- call graph -----------------------------------------------------------------------------

_TARGET = "'mod_' || (4 % 97) || '.fn_4'"


@query(f"WITH {Q.FUNCTIONS} SELECT DISTINCT f.key, f.filepath FROM functions f JOIN calls c ON c.src = f.key WHERE c.dst = {_TARGET} AND f.key <> {_TARGET}")
def direct_callers(spark, d):
    return C.direct_callers(_functions(spark, d), _key(spark, "mod_4.fn_4")).select("key", "filepath")


@query(f"WITH {Q.FUNCTIONS}, t AS (SELECT key FROM functions WHERE starts_with(key, 'mod_4.')) SELECT filepath, list_sort(list_distinct(list(split_part(key, '.', 2)))) AS names FROM functions WHERE key IN (SELECT src FROM calls WHERE dst IN (SELECT key FROM t)) GROUP BY 1")
def dependents_by_file(spark, d):
    f = _functions(spark, d)
    return C.dependents(f, C.module_keys(f, "mod_4"))


@query(f"WITH {Q.FUNCTIONS} SELECT dst, count(*) AS n FROM calls WHERE dst NOT IN (SELECT key FROM functions) GROUP BY 1")
def external_callees(spark, d):
    return C.external_calls(_functions(spark, d)).groupBy("dst").agg(F.count("*").alias("n"))


@query(f"WITH {Q.FUNCTIONS} SELECT DISTINCT key FROM functions WHERE filepath = '/repo/mod_7.py' OR contains(key, '.mod_4.') OR starts_with(key, 'mod_4.') OR suffix(key, '.mod_4')")
def module_keys(spark, d):
    return C.module_keys(_functions(spark, d), "mod_4", "/repo/mod_7.py")


@query(
    f"""WITH RECURSIVE {Q.FUNCTIONS}, up(key, depth) AS (SELECT {_TARGET}, 0 UNION SELECT c.src, depth + 1 FROM up JOIN calls c ON c.dst = up.key WHERE depth < 3 AND c.src <> {_TARGET})
SELECT key, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY 1"""
)
def indirect_callers_d3(spark, d):
    return C.indirect_callers(_functions(spark, d), _key(spark, "mod_4.fn_4"))


@query(f"WITH RECURSIVE {Q.FUNCTIONS}, down(key) AS (SELECT 'mod_1.fn_1' UNION SELECT c.dst FROM down JOIN calls c ON c.src = down.key JOIN functions f ON f.key = c.dst) SELECT key FROM down")
def reachable_callees(spark, d):
    return C.reachable(_functions(spark, d), _key(spark, "mod_1.fn_1")).select("key")


_IMPACT = f"""
near AS (SELECT DISTINCT f.key, f.filepath FROM functions f JOIN calls c ON c.src = f.key WHERE c.dst = {_TARGET} AND f.key <> {_TARGET}),
up(key, depth) AS (SELECT key, 0 FROM near UNION SELECT c.src, depth + 1 FROM up JOIN calls c ON c.dst = up.key WHERE depth < 3 AND c.src NOT IN (SELECT key FROM near)),
far AS (SELECT DISTINCT f.key, f.filepath FROM up JOIN functions f USING (key) WHERE depth > 0)
"""


@query(
    f"""WITH RECURSIVE {Q.FUNCTIONS}, {_IMPACT}
SELECT (SELECT count(*) FROM near) AS direct, (SELECT count(*) FROM far) AS indirect, (SELECT count(DISTINCT filepath) FROM (SELECT * FROM near UNION SELECT * FROM far)) AS files,
(SELECT count(DISTINCT filepath) FROM (SELECT * FROM near UNION SELECT * FROM far) WHERE regexp_matches(filepath, '(?i)test')) AS tests,
CASE WHEN (SELECT count(*) FROM near) + (SELECT count(*) FROM far) > 10 THEN 'High' WHEN (SELECT count(*) FROM near) + (SELECT count(*) FROM far) > 3 THEN 'Medium' ELSE 'Low' END AS level"""
)
def change_impact_summary(spark, d):
    return C.change_impact(_functions(spark, d), _key(spark, "mod_4.fn_4"))


@query(f"WITH {Q.FUNCTIONS} SELECT DISTINCT filepath FROM functions WHERE key IN (SELECT src FROM calls WHERE starts_with(dst, 'mod_4.')) AND regexp_matches(filepath, '(?i)test')")
def affected_tests(spark, d):
    f = _functions(spark, d)
    return C.direct_callers(f, C.module_keys(f, "mod_4").select("key")).unionByName(f.where("key like 'mod_4.%'").limit(0)).where(C.is_test()).select("filepath").distinct()


@query(
    f"""WITH {Q.FUNCTIONS}, s AS (SELECT * FROM functions WHERE starts_with(key, 'mod_4.') OR starts_with(key, 'mod_31.')), c AS (SELECT key AS src, unnest(callees) AS dst FROM s)
SELECT DISTINCT regexp_replace(src, '[^a-zA-Z0-9_]', '_', 'g') AS src, regexp_replace(CASE WHEN dst IN (SELECT key FROM s) THEN dst ELSE 'ext_' || dst END, '[^a-zA-Z0-9_]', '_', 'g') AS dst, split_part(dst, '.', -1) AS label, dst NOT IN (SELECT key FROM s) AS external
FROM c WHERE dst NOT IN (SELECT key FROM s) OR src <> dst"""
)
def flowchart_edges(spark, d):
    f = _functions(spark, d)
    return C.flowchart_edges(f.where("key like 'mod\\\\_4.%' or key like 'mod\\\\_31.%'"))


@query(
    f"""WITH {Q.FUNCTIONS}
SELECT DISTINCT regexp_replace(src, '[^a-zA-Z0-9_]', '_', 'g') AS src, regexp_replace(dst, '[^a-zA-Z0-9_]', '_', 'g') AS dst, split_part(dst, '.', -1) AS message FROM calls WHERE dst IN (SELECT key FROM functions) AND src <> dst"""
)
def sequence_calls(spark, d):
    return C.sequence_calls(_functions(spark, d))


@query(f"WITH {Q.FUNCTIONS} SELECT f.key, c.dst AS callee, coalesce(g.filepath, '(external)') AS location FROM functions f JOIN calls c ON c.src = f.key LEFT JOIN functions g ON g.key = c.dst WHERE starts_with(f.key, 'mod_5.')")
def callee_locations(spark, d):
    f = _functions(spark, d)
    return C.callee_locations(f, f.where("key like 'mod\\\\_5.%'")).select("key", "callee", "location")


@query(
    f"""WITH {Q.FUNCTIONS}, by_ AS (SELECT dst AS key, list_sort(list(DISTINCT src)) AS called_by FROM calls WHERE dst IN (SELECT key FROM functions) AND src <> dst GROUP BY 1)
SELECT f.key, f.callees, coalesce(by_.called_by, []) AS called_by FROM functions f LEFT JOIN by_ USING (key)"""
)
def call_report(spark, d):
    return C.call_report(_functions(spark, d)).select("key", "callees", "called_by")


@query(f"WITH {Q.FUNCTIONS} SELECT count(*) AS functions, count(DISTINCT filepath) AS files, sum(len(callees)) AS calls, (SELECT count(*) FROM calls WHERE dst NOT IN (SELECT key FROM functions)) AS external FROM functions")
def graph_summary(spark, d):
    return C.summary(_functions(spark, d))


@query(
    f"""WITH {Q.FUNCTIONS}
SELECT 'project' AS node_type, 1 AS n UNION ALL SELECT 'file', count(DISTINCT filepath) FROM functions UNION ALL SELECT 'function', count(*) FROM functions
UNION ALL SELECT 'CONTAINS', count(DISTINCT filepath) + count(*) FROM functions UNION ALL SELECT 'CALLS', count(*) FROM (SELECT DISTINCT src, dst FROM calls WHERE dst IN (SELECT key FROM functions) AND src <> dst)"""
)
# keyword nodes and their edges are held against SQL in code_graph_edges
def merge_code_graph(spark, d):
    nodes, edges = G.merge_code_graph(_functions(spark, d), _nodes(spark, d), "/repo")
    counts = G.node_stats(nodes).unionByName(G.edge_stats(edges).withColumnRenamed("edge_type", "node_type"))
    return counts.where(~F.col("node_type").isin("keyword", "TAGGED"))


# ---- vectors and fusion ---------------------------------------------------------------------


@query(
    f"""WITH {Q.NODES}, t AS (SELECT id AS node_id, coalesce(label, '') || chr(10) || coalesce(text, '') AS t FROM nodes WHERE node_type NOT IN ('keyword','recording','project','session','function')),
c AS (SELECT node_id, t, unnest(range(0, greatest(length(t), 1), 1600)) AS s FROM t)
SELECT node_id, (s // 1600)::INT AS chunk_index, length(substr(t, s + 1, 1800)) AS chars, substr(sha256(substr(t, s + 1, 1800)), 1, 32) AS text_hash FROM c WHERE s // 1600 < 120"""
)
def embed_chunks(spark, d):
    return V.node_chunks(_nodes(spark, d)).select("node_id", "chunk_index", F.length("chunk").alias("chars"), "text_hash")


@query(
    """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, v, greatest(list_max(list_transform(v, lambda x: abs(x))), 2.220446049250313e-16) / 127 AS scale FROM m),
q AS (SELECT vec_id, scale, list_transform(v, lambda x: greatest(-127, least(127, floor(x / scale + 0.5)))::INT) AS b FROM s)
SELECT vec_id, round(scale, 9) AS scale, b AS bytes, round(sqrt(list_sum(list_transform(b, lambda x: (x * scale) * (x * scale)))), 6) AS norm FROM q"""
)
def quantize_vectors(spark, d):
    q = table(spark, d, "embeddings").select("vec_id", V.quantize(F.transform("embedding", lambda x: x.cast("double"))).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.col("q.bytes").alias("bytes"), F.round("q.norm", 6).alias("norm"))


_PROBE = [math.sin(i + 1) for i in range(64)]
_HEX = "CASE WHEN ('0x' || substr(hex(vector), 2 * i + 1, 2))::INT > 127 THEN ('0x' || substr(hex(vector), 2 * i + 1, 2))::INT - 256 ELSE ('0x' || substr(hex(vector), 2 * i + 1, 2))::INT END"
_COSINE = f"""
probe AS (SELECT [{", ".join(map(repr, _PROBE))}] AS q),
e AS (SELECT id, node_id, scale, norm, list_transform(range(octet_length(vector)), lambda i: {_HEX}) AS v FROM embedding_entries WHERE vector IS NOT NULL),
scored AS (SELECT id, node_id, coalesce(coalesce(list_sum(list_transform(range(1, least(len(v), 64) + 1), lambda i: q[i] * v[i])), 0) * scale
  / (CASE WHEN coalesce(sqrt(list_sum(list_transform(q[1:least(len(v), 64)], lambda x: x * x))), 0) * norm = 0 THEN 1 ELSE coalesce(sqrt(list_sum(list_transform(q[1:least(len(v), 64)], lambda x: x * x))), 0) * norm END), 0) AS score FROM e, probe)
"""


@query(f"WITH {_COSINE} SELECT id, node_id, round(score, 5) AS score FROM scored")
def cosine_scores(spark, d):
    return V.cosine_scores(table(spark, d, "embedding_entries"), _PROBE).withColumn("score", F.round("score", 5))


@query(f"WITH {_COSINE} SELECT node_id, round(max(score), 5) AS score FROM scored GROUP BY 1 HAVING max(score) > -1")
def best_chunk_per_node(spark, d):
    return V.best_per_node(V.cosine_scores(table(spark, d, "embedding_entries"), _PROBE)).withColumn("score", F.round("score", 5))


_RANKINGS = """
r1 AS (SELECT query_id, node_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM (SELECT query_id, node_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s FROM search_results GROUP BY 1, 2) WHERE s IS NOT NULL),
r2 AS (SELECT query_id, node_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank FROM (SELECT query_id, node_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS s FROM index_hits GROUP BY 1, 2) WHERE s IS NOT NULL)
"""


def _ranking(spark, d, name, query_id=None):
    score = F.when(~F.isnan("score"), F.col("score"))
    t = table(spark, d, name)
    best = (t if query_id is None else t.where(F.col("query_id") == query_id)).groupBy("query_id", "node_id").agg(F.max(score).alias("s")).where("s is not null")
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "node_id")
    return best.select("query_id", F.col("node_id").alias("id"), F.row_number().over(order).alias("rank"))


@query(f"WITH {_RANKINGS} SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1, 2")
def rrf_fusion(spark, d):
    pair = lambda name: _ranking(spark, d, name).select(F.struct("query_id", "id").alias("id"), "rank")
    return V.fuse(pair("search_results"), pair("index_hits")).select("id.query_id", "id.id", F.round("score", 9).alias("score"))


_SPREAD = f"""{_RANKINGS}, fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM r1 WHERE query_id = 1 UNION ALL SELECT * FROM r2 WHERE query_id = 1) GROUP BY 1),
seeds AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 12),
spread AS (SELECT id, max(score) AS score FROM (SELECT * FROM fused UNION ALL SELECT other, max(seeds.score * 0.35) FROM both_ways JOIN seeds USING (id) WHERE edge_type IN {Q.EVIDENCE} AND other IN (SELECT id FROM nodes) GROUP BY 1) GROUP BY 1)"""


def _spread(spark, d):
    one = lambda name: _ranking(spark, d, name, 1).select("id", "rank")
    return V.expand(V.fuse(one("search_results"), one("index_hits")), _edges(spark, d), _nodes(spark, d))


@query(f"WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH}, {_SPREAD} SELECT id, round(score, 9) AS score FROM spread")
def graph_expansion(spark, d):
    return _spread(spark, d).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH}, {_SPREAD},
items AS (SELECT CASE WHEN n.node_type IN {Q.DERIVED} THEN coalesce(json_extract_string(n.metadata, '$.sourceID'), n.id) ELSE n.id END AS id, s.score AS s FROM spread s JOIN nodes n USING (id) WHERE n.node_type NOT IN ('entity', 'keyword')),
sums AS (SELECT id, list_sort(list(s), 'DESC') AS s FROM items GROUP BY 1),
src AS (SELECT sums.id, n.node_type, n.label, s[1] + 0.12 * coalesce(list_sum(s[2:3]), 0) AS score FROM sums JOIN nodes n USING (id)),
late AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY score DESC, label, id) > 4 AS late FROM src)
SELECT id, round(score, 9) AS score FROM late ORDER BY late, score DESC, label, id LIMIT 10"""
)
def evidence_pack(spark, d):
    nodes = _nodes(spark, d)
    kept = _spread(spark, d).join(nodes.where("node_type <> 'keyword'").select("id"), "id", "left_semi")
    return V.pack_evidence(kept, nodes, 10).select("id", F.round("score", 9).alias("score"))


@query()
def hybrid_search(spark, d):
    nodes = _nodes(spark, d)
    return V.hybrid_search(nodes, _edges(spark, d), table(spark, d, "embedding_entries"), lambda q: V.HashingEmbedder(64).embed([q])[0], QUESTION, 10)


@query(
    f"""WITH {Q.NODES}, e AS (SELECT DISTINCT id, node_id, model FROM embedding_entries)
SELECT model, count(*) AS entries, count(*) FILTER (WHERE node_id IN (SELECT id FROM nodes)) AS live FROM e GROUP BY 1"""
)
def live_entries(spark, d):
    e = table(spark, d, "embedding_entries").select("id", "node_id", "model").distinct()
    live = V.live_entries(e, _nodes(spark, d, "node_type")).groupBy("model").agg(F.count("*").alias("live"))
    return e.groupBy("model").agg(F.count("*").alias("entries")).join(live, "model", "left").select("model", "entries", F.coalesce("live", F.lit(0)).alias("live"))


@query(
    f"""WITH {Q.NODES}, t AS (SELECT id AS node_id, coalesce(label, '') || chr(10) || coalesce(text, '') AS t FROM nodes WHERE node_type NOT IN ('keyword','recording','project','session','function')),
c AS (SELECT node_id, s // 1600 AS i, substr(sha256(substr(t, s + 1, 1800)), 1, 32) AS h FROM (SELECT node_id, t, unnest(range(0, greatest(length(t), 1), 1600)) AS s FROM t) WHERE s // 1600 < 120),
made AS (SELECT node_id, substr(sha256(node_id || ':' || i || ':' || h), 1, 32) AS id FROM c), old AS (SELECT id FROM made WHERE node_id IN (SELECT node_id FROM embedding_entries))
SELECT count(*) AS entries, count(*) FILTER (WHERE id IN (SELECT id FROM old)) AS reused, count(*) FILTER (WHERE id NOT IN (SELECT id FROM old)) AS embedded FROM made"""
)
def embedding_reuse(spark, d):
    # the old index holds the chunks of nodes that have entries; what is taken over of it keeps the mark of that index
    nodes, model = _nodes(spark, d, "node_type", "label", "text"), V.HashingEmbedder(8)
    had = nodes.join(table(spark, d, "embedding_entries").select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select(nodes.columns)
    old = V.refresh_entries(had, None, model).withColumn("scale", F.lit(-1.0))
    return V.refresh_entries(nodes, staged(old, "old-entries"), model).agg(F.count("*").alias("entries"), F.count(F.when(F.col("scale") == -1, 1)).alias("reused"), F.count(F.when(F.col("scale") != -1, 1)).alias("embedded"))


# ---- derived facts --------------------------------------------------------------------------


@query(
    f"""WITH {Q.NODES}, f AS (SELECT json_extract_string(metadata, '$.sourceID') AS id, ord FROM nodes WHERE node_type IN {Q.DERIVED}),
done AS (SELECT f.id FROM f JOIN nodes s USING (id) WHERE f.ord % 3 > 0)
SELECT id FROM nodes WHERE node_type IN ('memory','transcript','turn','document','prompt') AND id NOT IN (SELECT id FROM done)"""
)
def pending_extraction(spark, d):
    # the tables' facts don't name a model and a text: two of three are taken as derived from the text as it is, one from another
    nodes = _nodes(spark, d)
    now = nodes.select(F.col("id").alias("source"), S.source_hash().alias("hash"))
    facts = nodes.where(F.col("node_type").isin(G.DERIVED_TYPES)).withColumn("source", F.get_json_object("metadata", "$.sourceID")).join(now, "source", "left")
    about = F.to_json(F.struct(F.col("source").alias("sourceID"), F.when(F.col("ord") % 3 > 0, F.col("hash")).otherwise("old").alias("sourceHash"), F.lit("rules-1").alias("extractionModel")))
    told = facts.withColumn("metadata", about).select(G.NODE_COLUMNS)
    return S.pending(nodes.where(~F.col("node_type").isin(G.DERIVED_TYPES)).unionByName(told), "rules-1").select("id")


@query(
    f"""WITH {Q.NODES}, f AS (SELECT id, json_extract_string(metadata, '$.sourceID') AS source_id FROM nodes WHERE node_type IN {Q.DERIVED})
SELECT f.id, f.source_id, s.node_type AS source_type FROM f JOIN nodes s ON s.id = f.source_id"""
)
def derived_provenance(spark, d):
    return S.provenance(_nodes(spark, d, "node_type", "metadata"))


@query(f"WITH {Q.NODES}, {Q.EDGES} SELECT e.dst AS id, n.label, count(*) AS mentions, round(max(e.weight), 4) AS weight FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.edge_type = 'MENTIONS' GROUP BY 1, 2")
def entity_mentions(spark, d):
    e = _edges(spark, d).where("edge_type = 'MENTIONS'").select(F.col("dst").alias("id"), "weight")
    n = _nodes(spark, d, "label").select("id", "label")
    return e.join(n, "id").groupBy("id", "label").agg(F.count("*").alias("mentions"), F.round(F.max("weight"), 4).alias("weight"))


@query()
def semantic_facts(spark, d):
    nodes = _nodes(spark, d)
    judged = S.judge(S.extract(S.extractable(nodes), S.RuleExtractor()), nodes)
    return judged.groupBy("kind", "accepted").agg(F.count("*").alias("n"))


# ---- retrieval benchmark --------------------------------------------------------------------

_GOLD = f"""WITH {Q.NODES}, {Q.EDGES}, {_RANKINGS},
gold AS (SELECT q.query_id, e.dst FROM search_queries q JOIN edges e ON e.src = q.seed_id AND e.edge_type = 'RELATED' AND e.weight >= 0.5),
sizes AS (SELECT query_id, count(*) AS g FROM gold GROUP BY 1), top AS (SELECT * FROM r1 WHERE rank <= 5 AND id IN (SELECT id FROM nodes)),
hit AS (SELECT t.query_id, count(*) FILTER (WHERE t.rank = 1) AS a1, count(*) AS a5, min(t.rank) AS first FROM top t JOIN gold g ON g.query_id = t.query_id AND g.dst = t.id GROUP BY 1),
cases AS (SELECT s.query_id, 'len' || len(string_split(question, ' ')) % 3 AS tag, coalesce(a1, 0) / g AS recall_at_1, coalesce(a5, 0) / g AS recall_at_5, coalesce(1.0 / first, 0) AS reciprocal_rank, CASE WHEN coalesce(a5, 0) >= 1 THEN 1.0 ELSE 0.0 END AS passes
  FROM sizes s JOIN search_queries USING (query_id) LEFT JOIN hit USING (query_id))
"""


def _cases(spark, d):
    q = table(spark, d, "search_queries")
    gold = _edges(spark, d).where("edge_type = 'RELATED' and weight >= 0.5").select(F.col("src").alias("seed_id"), "dst")
    cases = q.join(gold, "seed_id").groupBy(F.col("query_id").alias("id"), "question").agg(F.collect_set("dst").alias("goldSourceIDs"))
    tag = F.concat(F.lit("len"), (F.size(F.split("question", " ")) % 3).cast("string"))
    none = F.array().cast("array<string>")
    return cases.select("id", "question", none.alias("expectedFacts"), "goldSourceIDs", none.alias("goldSourcePaths"), none.alias("forbiddenClaims"), F.array(tag).alias("tags"), F.lit(1).alias("minimumGoldSources"))


def _report(spark, d):
    # what a node is derived from counts as found too; here only the node itself shall
    nodes = _nodes(spark, d).withColumn("metadata", F.lit("{}"))
    return B.evaluate(_cases(spark, d), _ranking(spark, d, "search_results").where("rank <= 5"), nodes)


@query(f"{_GOLD} SELECT query_id AS id, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(reciprocal_rank, 6) AS reciprocal_rank, passes FROM cases")
def benchmark_case_metrics(spark, d):
    return _report(spark, d).select("id", *(F.round(m, 6).alias(m) for m in ("recall_at_1", "recall_at_5", "reciprocal_rank", "passes")))


@query(f"{_GOLD} SELECT tag, count(*) AS cases, round(avg(recall_at_1), 6) AS recall_at_1, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(passes), 6) AS passes FROM cases GROUP BY 1")
def benchmark_by_tag(spark, d):
    t = B.by_tag(_report(spark, d))
    return t.select("tag", "cases", *(F.round(m, 6).alias(m) for m in ("recall_at_1", "recall_at_5", "reciprocal_rank", "passes")))


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, {_RANKINGS},
asked AS (SELECT DISTINCT query_id, question FROM search_queries q JOIN edges e ON e.src = q.seed_id AND e.edge_type = 'RELATED' AND e.weight >= 0.5),
top AS (SELECT t.query_id, t.rank, n.* FROM r1 t JOIN nodes n USING (id) WHERE t.rank <= 5),
fam AS (SELECT query_id, rank, {Q.phrase("coalesce(label, '') || chr(10) || coalesce(text, '')")} AS said, CASE
  WHEN coalesce(json_extract_string(metadata, '$.sessionID'), json_extract_string(metadata, '$.session_id'), '') <> '' THEN 'session:' || coalesce(json_extract_string(metadata, '$.sessionID'), json_extract_string(metadata, '$.session_id'))
  WHEN regexp_matches(id, '^(recording|transcript):') THEN regexp_replace(id, '^(recording|transcript):', 'dictation:')
  ELSE coalesce(regexp_replace(regexp_replace(path, '/$', ''), '\\.[^./]+$', ''), id) END AS family FROM top),
c AS (SELECT query_id, string_agg(said, ' ' ORDER BY rank) AS said, 1 - count(DISTINCT family) / count(*) AS redundancy FROM fam GROUP BY 1),
f AS (SELECT a.query_id, coalesce(said, '') AS said, coalesce(redundancy, 0) AS redundancy, [{Q.phrase("string_split(question, ' ')[1]")}, {Q.phrase("array_to_string(string_split(question, ' ')[2:3], ' ')")}] AS facts, {Q.phrase("string_split(question, ' ')[-1]")} AS claim FROM asked a LEFT JOIN c USING (query_id))
SELECT query_id AS id, round(len(list_filter(facts, lambda x: contains(said, x))) / 2.0, 6) AS fact_coverage, CASE WHEN contains(said, claim) THEN 1.0 ELSE 0.0 END AS forbidden_rate, round(redundancy, 6) AS redundancy FROM f"""
)
def benchmark_quality(spark, d):
    words = F.split("question", " ")
    facts, claims = F.array(words[0], F.array_join(F.slice(words, 2, 2), " ")), F.array(F.element_at(words, -1))
    cases = _cases(spark, d).withColumn("expectedFacts", facts).withColumn("forbiddenClaims", claims)
    report = B.evaluate(cases, _ranking(spark, d, "search_results").where("rank <= 5"), _nodes(spark, d))
    return report.select("id", *(F.round(m, 6).alias(m) for m in ("fact_coverage", "forbidden_rate", "redundancy")))


# ---- repositories and turns -----------------------------------------------------------------


@query(
    """SELECT slug, coalesce(last_checked_at <= '2026-06-01T00:00:00.000Z', true) AS due, error IS NOT NULL AS failed FROM managed_repos"""
)
def due_repositories(spark, d):
    from lodestrata.operators import repositories as R

    return R.due(table(spark, d, "managed_repos"), "2026-06-02T00:00:00.000Z").select("slug", "due", "failed")


@query("SELECT count(*) AS repositories, sum((error IS NOT NULL)::INT) AS failed, sum(files) AS files, sum(functions) AS functions FROM managed_repos")
def repository_totals(spark, d):
    from lodestrata.operators import repositories as R

    return R.totals(table(spark, d, "managed_repos"))


@query(
    """WITH t AS (SELECT session_id, ord, message_id FROM session_messages WHERE lower(coalesce(role, '')) <> 'system')
SELECT session_id, ord, lag(ord) OVER (PARTITION BY session_id ORDER BY ord) AS previous FROM t"""
)
def turn_next_chain(spark, d):
    from lodestrata.sources import sessions as N

    t = table(spark, d, "session_messages").where("lower(coalesce(role, '')) <> 'system'")
    return N.next_chain(t, ["session_id"], "ord").select("session_id", "ord", "previous")


@query(
    f"""WITH m AS (SELECT session_id, ord, CASE WHEN content LIKE '[%' AND json_valid(content) THEN coalesce(array_to_string(list_filter(list_transform(json_extract(content, '$[*]'), lambda x: coalesce(CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END, x ->> '$.text', x ->> '$.content', CASE WHEN json_type(x) = 'OBJECT' THEN x::VARCHAR END)), lambda x: x <> ''), chr(10)), '') ELSE content END AS t FROM session_messages WHERE session_id IS NOT NULL),
k AS (SELECT * FROM m WHERE regexp_matches(t, '[^\\s\\p{{Z}}\\x0b]')),
l AS (SELECT session_id, count(*) AS turns, list(t ORDER BY ord, t) AS ts FROM k GROUP BY 1)
SELECT session_id, turns, length(list_reduce(ts, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || x END)[1:{300_000}]) AS chars FROM l"""
)
def session_text(spark, d):
    from lodestrata.sources import sessions as N

    t = table(spark, d, "session_messages").select("session_id", "ord", T.message_text("content").alias("content")).where(F.col("session_id").isNotNull() & T.filled("content"))
    s = N.session_texts(t, "session_id", "content", "ord")
    return s.join(t.groupBy("session_id").agg(F.count("*").alias("turns")), "session_id").select("session_id", "turns", F.length("text").alias("chars"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def events_autoingest(spark, d):
    from lodestrata.streaming import ingest as I  # noqa: E741

    return I.replay(table(spark, d, "events"), ["event_type"], "user_id", "value")


from lodestrata.plans import ingestion  # noqa: E402, F401
