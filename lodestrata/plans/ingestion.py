"""Registered queries of sources, replacement, the written index and reports, and the SQL they are held against.

Files are drawn from the tables as ``path, file_no, text``, as a walk would read
them; the SQL says what the sources shall make of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import callgraph as C
from lodestrata.operators import fulltext as X
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical as L
from lodestrata.operators import vectors as V
from lodestrata.plans import catalog as K
from lodestrata.plans import sql as Q
from lodestrata.plans.catalog import query
from lodestrata.session import staged, staging, table
from lodestrata.sources import files as S


def _documents(spark: SparkSession, d: str, kind: str, path: str, text: str = "text") -> DataFrame:
    """Files of the documents of a kind; ``path`` and ``text`` are expressions."""
    t = table(spark, d, "documents").where(F.col("kind") == kind)
    return t.select(F.expr(path).alias("path"), F.col("doc_id").alias("file_no"), F.expr(text).alias("text"))


_SPACE = "[\\s\\p{Z}\\x0b]"
_FILLED = f"regexp_matches(text, '[^\\s\\p{{Z}}\\x0b]')"


def _sid(kind: str, value: str = "path") -> str:
    return f"'{kind}:' || substr(sha256({value}), 1, 20)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _tags(terms: str, source: str, id_: str = "id") -> str:
    """SQL of TAGGED edges: normalised, distinct in order, the first 24."""
    return f"""u AS (SELECT {id_} AS src, unnest({terms}) AS term, generate_subscripts({terms}, 1) AS pos FROM {source}),
v AS (SELECT src, regexp_replace({Q.folded('term')}, '[^a-z0-9]', '', 'g') AS term, pos FROM u),
w AS (SELECT src, term, min(pos) AS pos FROM v WHERE length(term) >= 3 GROUP BY 1, 2),
tags AS (SELECT src, 'keyword:' || term AS dst FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos) <= 24)"""


def _shown(nodes: DataFrame) -> DataFrame:
    """What a node query shows of nodes but keywords (as ``_SHOWN``)."""
    return nodes.where("node_type <> 'keyword'").select("id", "node_type", "label", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"), "path", "metadata")


_SHOWN = "id, node_type, label, length(text) AS chars, sha256(text) AS digest, path, metadata"


# ---- documents, prompts, memories, repositories ----------------------------------------------

_DOCUMENTS = f"""WITH files AS (SELECT '/notes/' || doc_id || '.txt' AS path, text FROM documents WHERE kind = 'document' AND {_FILLED}),
nodes AS (SELECT {_sid('document')} AS id, 'document' AS node_type, regexp_extract(path, '[^/]+$') AS label, substr(text, 1, 300000) AS text, path, '{{"kind":"document","source":"import"}}' AS metadata, text AS whole FROM files)"""


@query(f"{_DOCUMENTS} SELECT {_SHOWN} FROM nodes")
def ingest_documents(spark, d):
    nodes, _ = S.knowledge_nodes(_documents(spark, d, "document", "concat('/notes/', doc_id, '.txt')"))
    return _shown(nodes)


@query(f"{_DOCUMENTS}, {_tags(Q.tokens('whole') + '[1:30]', 'nodes')} SELECT src, dst FROM tags")
def ingest_document_tags(spark, d):
    _, edges = S.knowledge_nodes(_documents(spark, d, "document", "concat('/notes/', doc_id, '.txt')"))
    return edges.where("edge_type = 'TAGGED'").select("src", "dst")


_PROMPTS = f"""WITH files AS (SELECT '/prompts/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.jsonl' ELSE '.png' END AS path, text FROM documents WHERE kind = 'prompt' AND {_FILLED}),
nodes AS (SELECT {_sid('prompt')} AS id, 'prompt' AS node_type, regexp_extract(path, '[^/]+$') AS label, substr(text, 1, 100000) AS text, path, '{{"kind":"prompt"}}' AS metadata, text AS whole FROM files WHERE lower(path) NOT LIKE '%.png')"""


def _prompts(spark, d):
    ending = "CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' WHEN 3 THEN '.jsonl' ELSE '.png' END"
    return S.prompt_nodes(_documents(spark, d, "prompt", f"concat('/prompts/', doc_id, {ending})"))


@query(f"{_PROMPTS} SELECT {_SHOWN} FROM nodes")
def ingest_prompts(spark, d):
    return _shown(_prompts(spark, d)[0])


@query(f"{_PROMPTS}, {_tags(Q.tokens('whole') + '[1:20]', 'nodes')} SELECT src, dst FROM tags")
def ingest_prompt_tags(spark, d):
    return _prompts(spark, d)[1].select("src", "dst")


_MEMORIES = f"""WITH files AS (SELECT '/agents/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '/MEMORY.md' ELSE '/USER.md' END AS path, coalesce(text, '') || chr(10) || '§' || chr(10) || ' ' || coalesce(source, '') || chr(10) || '§' || chr(10) || coalesce(lang, '') AS text FROM documents WHERE kind = 'memory'),
parts AS (SELECT path, list_filter(list_transform(string_split(text, chr(10) || '§' || chr(10)), lambda x: {_trim('x')}), lambda x: x <> '') AS es FROM files),
entries AS (SELECT path, unnest(es) AS text, unnest(range(len(es))) AS pos FROM parts),
nodes AS (SELECT {_sid('memory', "path || ':' || pos || ':' || text")} AS id, 'memory' AS node_type, substr({_trim("string_split_regex(text, '\\r?\\n')[1]")}, 1, 80) AS label, text, path,
  '{{"target":"' || CASE WHEN path LIKE '%USER.md' THEN 'user' ELSE 'memory' END || '","source":"hermes","kind":"curated-memory","index":' || pos || '}}' AS metadata FROM entries)"""


def _memories(spark, d):
    path = "concat('/agents/', doc_id, CASE WHEN doc_id % 2 = 0 THEN '/MEMORY.md' ELSE '/USER.md' END)"
    return S.knowledge_nodes(_documents(spark, d, "memory", path, "concat(coalesce(text, ''), '\\n§\\n ', coalesce(source, ''), '\\n§\\n', coalesce(lang, ''))"))


@query(f"{_MEMORIES} SELECT {_SHOWN} FROM nodes")
def ingest_memories(spark, d):
    return _shown(_memories(spark, d)[0])


@query(f"{_MEMORIES}, {_tags(Q.tokens('text') + '[1:24]', 'nodes')} SELECT DISTINCT src, dst FROM tags")
def ingest_memory_tags(spark, d):
    return _memories(spark, d)[1].select("src", "dst").distinct()


_ENDING = "CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.hpp' WHEN 2 THEN '.MD' ELSE '.sql' END"
_REPOSITORY = f"""WITH files AS (SELECT '/repo/src/' || doc_id || {_ENDING} AS path, text FROM documents WHERE kind = 'source_file' AND {_FILLED} AND doc_id % 4 <> 3),
nodes AS (SELECT {_sid('file')} AS id, 'file' AS node_type, substr(path, 7) AS label, substr(text, 1, 200000) AS text, path, '{{"project": "/repo", "sourceURL": "https://host.example/repo"}}' AS metadata, text AS whole FROM files)"""


def _repository(spark, d):
    return S.repository_nodes(_documents(spark, d, "source_file", f"concat('/repo/src/', doc_id, {_ENDING})"), "/repo", "https://host.example/repo")


@query(f"{_REPOSITORY} SELECT {_SHOWN} FROM nodes UNION ALL SELECT {_sid('project', chr(39) + '/repo' + chr(39))}, 'project', 'repo', 5, sha256('/repo'), '/repo', '{{\"sourceURL\": \"https://host.example/repo\"}}'")
def ingest_repository(spark, d):
    return _shown(_repository(spark, d)[0])


@query(f"{_REPOSITORY}, {_tags(Q.tokens('whole') + '[1:30]', 'nodes')} SELECT src, dst, 'TAGGED' AS edge_type FROM tags UNION ALL SELECT {_sid('project', chr(39) + '/repo' + chr(39))}, id, 'CONTAINS' FROM nodes")
def ingest_repository_edges(spark, d):
    return _repository(spark, d)[1].select("src", "dst", "edge_type")


# ---- recordings -----------------------------------------------------------------------------

_RECORDINGS = f"""WITH t AS (SELECT doc_id, text, '/archive/' || doc_id AS dir FROM documents WHERE kind = 'transcript' AND {_FILLED} AND doc_id % 5 <> 4),
r AS (SELECT doc_id::VARCHAR AS sid, dir, text, CASE WHEN doc_id % 3 = 0 THEN 'Talk ' || doc_id ELSE coalesce(nullif(array_to_string(regexp_split_to_array({_trim("string_split_regex(text, '[.!?]')[1]")}, '{_SPACE}+')[1:8], ' '), ''), doc_id::VARCHAR) END AS label,
  CASE WHEN doc_id % 2 = 0 THEN ['Quiet Archive', 'ab', 'Größe', 'quietarchive'] ELSE {Q.tokens('text')}[1:12] END AS terms, doc_id FROM t),
nodes AS (SELECT 'recording:' || sid AS id, 'recording' AS node_type, label, CASE WHEN doc_id % 3 = 1 THEN 'In short' ELSE text END AS text, dir || '/audio.wav' AS path FROM r
  UNION ALL SELECT 'transcript:' || sid, 'transcript', label || ' transcript', text, dir || '/transcript.txt' FROM r)"""


def _recordings(spark, d):
    t = table(spark, d, "documents").where("kind = 'transcript'")
    about = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("sessionID"), F.when(F.col("doc_id") % 5 == 4, "failed").otherwise("completed").alias("status"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Talk "), "doc_id")).alias("headline"),
            F.when(F.col("doc_id") % 3 == 1, "In short").alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, ("Quiet Archive", "ab", "Größe", "quietarchive")))).alias("keywords"),
        )
    )
    place = lambda name: F.concat(F.lit("/archive/"), "doc_id", F.lit("/" + name)).alias("path")
    said = t.select(place("transcript.txt"), (F.col("doc_id") * 2).alias("file_no"), "text")
    return S.recording_nodes(t.select(place("meta.json"), (F.col("doc_id") * 2 + 1).alias("file_no"), about.alias("text")).unionByName(said))


@query(f"{_RECORDINGS} SELECT id, node_type, label, length(text) AS chars, sha256(text) AS digest, path FROM nodes")
def ingest_recordings(spark, d):
    return _shown(_recordings(spark, d)[0]).drop("metadata")


@query(
    f"""{_RECORDINGS}, both_ AS (SELECT 'recording:' || sid AS id, terms FROM r UNION ALL SELECT 'transcript:' || sid, terms FROM r),
{_tags('terms', 'both_')} SELECT src, dst, 'TAGGED' AS edge_type FROM tags UNION ALL SELECT 'recording:' || sid, 'transcript:' || sid, 'HAS_TRANSCRIPT' FROM r"""
)
def ingest_recording_edges(spark, d):
    return _recordings(spark, d)[1].select("src", "dst", "edge_type")


# ---- sessions -------------------------------------------------------------------------------

_SESSIONS = f"""WITH m AS (SELECT session_id AS s, '/exports/' || session_id || '.jsonl' AS path, role, content AS text, message_id, source, ord, row_number() OVER (PARTITION BY session_id ORDER BY ord) - 1 AS i FROM session_messages WHERE session_id IS NOT NULL),
turns AS (SELECT s, path, i, coalesce(nullif(role, ''), 'unknown') AS role, text, coalesce(message_id::VARCHAR, i::VARCHAR) AS mid FROM m WHERE {_FILLED} AND coalesce(role, '') <> 'system'),
t AS (SELECT *, {_sid('turn', "path || ':' || s || ':' || mid || ':' || role")} AS id FROM turns)"""


def _sessions(spark, d):
    m = table(spark, d, "session_messages").where("session_id is not null")
    one = F.struct("ord", F.struct(F.col("message_id").alias("id"), "role", "content", F.col("msg_timestamp").alias("timestamp")).alias("m"))
    records = m.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["m"]).alias("messages"), F.min("source").alias("source"), F.min("ord").alias("file_no"))
    text = F.to_json(F.struct(F.col("session_id").alias("id"), "source", "messages"))
    return S.knowledge_nodes(records.select(F.concat(F.lit("/exports/"), "session_id", F.lit(".jsonl")).alias("path"), "file_no", text.alias("text")))


@query(f"{_SESSIONS} SELECT id, role || ' ' || (i + 1) AS label, length(text) AS chars, path, s AS session_id, mid AS message_id, i AS turn_index FROM t")
def ingest_turns(spark, d):
    about = lambda name: F.get_json_object("metadata", "$." + name)
    t = _sessions(spark, d)[0].where("node_type = 'turn'")
    return t.select("id", "label", F.length("text").alias("chars"), "path", about("sessionID").alias("session_id"), about("messageID").alias("message_id"), about("index").cast("bigint").alias("turn_index"))


@query(
    f"""{_SESSIONS}, n AS (SELECT lag(id) OVER (PARTITION BY s ORDER BY i) AS src, id AS dst FROM t)
SELECT {_sid('session', "path || ':' || s")} AS src, id AS dst, 'HAS_TURN' AS edge_type FROM t UNION ALL SELECT src, dst, 'NEXT' FROM n WHERE src IS NOT NULL AND src <> dst"""
)
def ingest_turn_edges(spark, d):
    return _sessions(spark, d)[1].where("edge_type <> 'TAGGED'").select("src", "dst", "edge_type")


@query(f"{_SESSIONS} SELECT {_sid('session', "path || ':' || s")} AS id, s AS label, path, coalesce(min(source), 'agent-export') AS source FROM m GROUP BY s, path")
def ingest_sessions(spark, d):
    return _sessions(spark, d)[0].where("node_type = 'session'").select("id", "label", "path", F.get_json_object("metadata", "$.source").alias("source"))


# ---- replacement ----------------------------------------------------------------------------


@query(f"WITH {Q.NODES}, {Q.EDGES}, gone AS (SELECT id FROM nodes WHERE node_type IN ('document', 'memory', 'session', 'turn') AND path IN (SELECT path FROM documents)), left_edges AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) SELECT 'nodes' AS part, count(*) AS n FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edges', count(*) FROM left_edges")
def replace_by_paths(spark, d):
    nodes, edges = G.remove_by_path(K._nodes(spark, d, "node_type", "path"), K._edges(spark, d), table(spark, d, "documents").select("path"), S.REPLACED)
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return part(nodes, "nodes").unionByName(part(edges, "edges"))


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, gone AS (SELECT id FROM nodes WHERE node_type IN ('recording', 'transcript') AND starts_with(path, '/recordings/')),
left_nodes AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone)), left_edges AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))
SELECT node_type, count(*) AS n FROM left_nodes WHERE node_type <> 'keyword' OR id IN (SELECT dst FROM left_edges WHERE edge_type = 'TAGGED') GROUP BY 1"""
)
def replace_archive(spark, d):
    left = G.remove_below(K._nodes(spark, d, "node_type", "path"), K._edges(spark, d), "/recordings", ["recording", "transcript"])
    return G.node_stats(G.without_orphan_keywords(*left)[0])


# ---- code graph -----------------------------------------------------------------------------

_CODE = f"""WITH {Q.NODES}, {Q.FUNCTIONS}, fn AS (SELECT {_sid('function', "'/repo:' || key")} AS id, key, filepath, lineno, end_lineno, {_sid('file', 'filepath')} AS file_id FROM (SELECT *, ord AS lineno, ord + 9 AS end_lineno FROM functions))"""


@query(f"{_CODE} SELECT id, key AS label, key || ' ' || substr(filepath, 7) AS text, filepath AS path, '{{\"lineno\":' || lineno || ',\"end_lineno\":' || end_lineno || ',\"project\":\"/repo\"}}' AS metadata FROM fn UNION ALL SELECT DISTINCT file_id, substr(filepath, 7), filepath, filepath, '{{\"project\":\"/repo\"}}' FROM fn UNION ALL SELECT {_sid('project', chr(39) + '/repo' + chr(39))}, 'repo', '/repo', '/repo', '{{}}'")
def code_graph_nodes(spark, d):
    nodes, _ = G.merge_code_graph(K._functions(spark, d), K._nodes(spark, d), "/repo")
    return nodes.where("node_type <> 'keyword'").select("id", "label", "text", "path", "metadata")


@query(
    f"""{_CODE}, {_tags(Q.tokens('key'), 'fn')} SELECT src, dst, 'TAGGED' AS edge_type FROM tags UNION ALL SELECT DISTINCT {_sid('project', chr(39) + '/repo' + chr(39))}, file_id, 'CONTAINS' FROM fn UNION ALL SELECT file_id, id, 'CONTAINS' FROM fn
UNION ALL SELECT DISTINCT {_sid('function', "'/repo:' || src")}, {_sid('function', "'/repo:' || dst")}, 'CALLS' FROM calls WHERE dst IN (SELECT key FROM functions) AND src <> dst"""
)
def code_graph_edges(spark, d):
    _, edges = G.merge_code_graph(K._functions(spark, d), K._nodes(spark, d), "/repo")
    return edges.select("src", "dst", "edge_type")


@query(
    f"""WITH {Q.NODES}, r AS (SELECT slug, local_path, url FROM managed_repos ORDER BY local_path LIMIT 1), own AS (SELECT nodes.*, r.* FROM nodes, r WHERE nodes.path = local_path OR json_extract_string(metadata, '$.project') = slug)
SELECT id, url AS repository, 'main' AS branch, 'abc' AS "commit", CASE WHEN path <> local_path THEN substr(path, length(local_path) + 2) END AS relative_path, json_extract_string(metadata, '$.project') AS project FROM own"""
)
def attach_provenance(spark, d):
    r = table(spark, d, "managed_repos").orderBy("local_path").select("slug", "local_path", "url").first()
    about = lambda name: F.get_json_object("metadata", "$." + name)
    out = G.attach_provenance(K._nodes(spark, d, "node_type", "path", "metadata"), r["local_path"], r["url"], "main", "abc", r["slug"]).where(about("commit") == "abc")
    return out.select("id", about("repository").alias("repository"), about("branch").alias("branch"), about("commit").alias("commit"), about("relativePath").alias("relative_path"), about("project").alias("project"))


@query(f"WITH {Q.FUNCTIONS} SELECT f.filepath, list({{'name': split_part(f.key, '.', -1), 'lineno': f.ord::INT}} ORDER BY f.ord) AS callers FROM functions f WHERE f.key IN (SELECT src FROM calls WHERE dst = {K._TARGET}) AND f.key <> {K._TARGET} GROUP BY 1")
def impact_by_file(spark, d):
    return C.callers_by_file(K._functions(spark, d), K._key(spark, "mod_4.fn_4"))


@query(
    f"""WITH RECURSIVE {Q.FUNCTIONS}, {K._IMPACT}, least_ AS (SELECT key, min(depth)::INT AS depth FROM up WHERE depth > 0 GROUP BY 1)
SELECT depth, list({{'key': l.key, 'name': split_part(l.key, '.', -1), 'filepath': f.filepath}} ORDER BY l.key COLLATE en) AS callers FROM least_ l JOIN functions f ON f.key = l.key GROUP BY 1"""
)
def impact_by_depth(spark, d):
    return C.callers_by_depth(K._functions(spark, d), K._key(spark, "mod_4.fn_4"))


# ---- ranked search --------------------------------------------------------------------------


def _ranked_sql(question: str, limit: int) -> str:
    """CTEs up to ``lex``: the first ``limit`` nodes by score, date, label as people sort, and order."""
    wanted = list(dict.fromkeys(T.tokens_plain(question)))
    parts = []
    for w in wanted:
        s = T.signature_plain(w)
        for toks, exact, near in (("l", 5, 3), ("b", 2, 1)):
            alike = f"len(list_filter({toks}, lambda t: length(t) >= 5 AND t <> '{w}' AND levenshtein({Q.signature('t')}, '{s}') <= 1)) > 0" if len(w) >= 5 else "false"
            parts.append(f"(CASE WHEN list_contains({toks}, '{w}') THEN {exact} WHEN {alike} THEN {near} ELSE 0 END)")
    return f"""k AS (SELECT id, node_type, label, path, ord, {Q.millis('metadata')} AS millis, list_distinct({Q.tokens('label')}) AS l, list_distinct({Q.tokens('text')}) AS b FROM nodes WHERE node_type <> 'keyword'),
scored_ AS (SELECT id, node_type, label, path, ord, millis, {" + ".join(parts)} AS score FROM k),
lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, millis DESC, label COLLATE en, ord) AS rank FROM scored_ WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, millis DESC, label COLLATE en, ord) <= {limit})"""


K.ORACLE_SQL["lexical_top20"] = f"WITH {Q.NODES}, {_ranked_sql(K.QUESTION, 20)} SELECT id, node_type, label, path, score::INT AS score FROM lex"

_SUITE = [(1, K.QUESTION), (2, K.MISSPELT), (3, K.WORDS), (4, "Which reviewer prefers the quiet archive")]
K.ORACLE_SQL["lexical_many"] = f"WITH {Q.NODES} " + " UNION ALL ".join(
    f"SELECT {n} AS query_id, rank::INT AS rank, id, score::INT AS score FROM (WITH {_ranked_sql(q, 5)} SELECT * FROM lex)" for n, q in _SUITE
)


def _probe(model: V.HashingEmbedder, question: str) -> str:
    return "[" + ", ".join(map(repr, map(float, model.embed([question])[0]))) + "]"


K.ORACLE_SQL["hybrid_search"] = f"""WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH}, {_ranked_sql(K.QUESTION, 40)}, probe AS (SELECT {_probe(V.HashingEmbedder(64), K.QUESTION)} AS q),
e AS (SELECT node_id, scale, norm, list_transform(range(octet_length(vector)), lambda i: {K._HEX}) AS v FROM embedding_entries WHERE vector IS NOT NULL AND node_id IN (SELECT id FROM nodes)),
c AS (SELECT node_id, coalesce(list_sum(list_transform(range(1, least(len(v), 64) + 1), lambda i: q[i] * v[i])), 0) * scale AS dot, coalesce(sqrt(list_sum(list_transform(q[1:least(len(v), 64)], lambda x: x * x))), 0) * norm AS below FROM e, probe),
near AS (SELECT node_id AS id, max(coalesce(dot / CASE WHEN below = 0 THEN 1 ELSE below END, 0)) AS score FROM c GROUP BY 1 HAVING max(coalesce(dot / CASE WHEN below = 0 THEN 1 ELSE below END, 0)) > -1),
vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 40),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT id, rank FROM lex UNION ALL SELECT id, rank FROM vec) GROUP BY 1),
seeds AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 12),
spread AS (SELECT id, max(score) AS score FROM (SELECT * FROM fused UNION ALL SELECT other, max(seeds.score * 0.35) FROM both_ways JOIN seeds USING (id) WHERE edge_type IN {Q.EVIDENCE} AND other IN (SELECT id FROM nodes) GROUP BY 1) GROUP BY 1),
items AS (SELECT CASE WHEN n.node_type IN {Q.DERIVED} THEN coalesce(json_extract_string(n.metadata, '$.sourceID'), n.id) ELSE n.id END AS id, s.score AS s FROM spread s JOIN nodes n USING (id) WHERE n.node_type NOT IN ('entity', 'keyword')),
sums AS (SELECT id, list_sort(list(s), 'DESC') AS s FROM items GROUP BY 1),
src AS (SELECT sums.id, n.node_type, n.label, s[1] + 0.12 * coalesce(list_sum(s[2:3]), 0) AS score FROM sums JOIN nodes n USING (id)),
late AS (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY score DESC, label COLLATE en, id) > 4 AS late FROM src)
SELECT row_number() OVER (ORDER BY late, score DESC, label COLLATE en, id)::INT AS rank, id, round(score, 9) AS score FROM late QUALIFY row_number() OVER (ORDER BY late, score DESC, label COLLATE en, id) <= 10"""


def _index(spark, d) -> X.Index:
    index = X.Index(spark, staging(spark, "index"))
    index.rebuild(K._nodes(spark, d), "1")
    return index


@query(K._bm25_sql(K.WORDS, 20))
def index_search(spark, d):
    return _index(spark, d).search(K.WORDS, 20).withColumn("score", F.round("score", 6))


@query(K.ORACLE_SQL["lexical_top20"])
def index_lexical(spark, d):
    return _index(spark, d).search_lexical(K.QUESTION, 20)


@query(
    f"""WITH {Q.NODES}, {Q.EDGES}, {Q.BOTH}, h AS (SELECT id, score FROM ({K._bm25_sql(K.WORDS, 20)})),
near AS (SELECT id, other, min(ord) AS ord FROM both_ways WHERE id IN (SELECT id FROM h) AND other IN (SELECT id FROM nodes WHERE node_type <> 'keyword') GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord, other) AS r FROM near)
SELECT h.id, h.score, coalesce((SELECT list(other ORDER BY r) FROM best WHERE best.id = h.id AND r <= 5), []) AS related FROM h"""
)
def index_hits(spark, d):
    index = _index(spark, d)
    found = index.hits(index.search(K.WORDS, 20), K.WORDS, K._edges(spark, d))
    return found.select("id", F.round("score", 6).alias("score"), F.transform("related", lambda r: r["id"]).alias("related"))
