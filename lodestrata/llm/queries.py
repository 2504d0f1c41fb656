"""Queries pN_... of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import (
    p01_split,
    p02_personal_data,
    p03_neighbours,
    p04_near_duplicates,
    p05_rank_fusion,
    p06_conversations,
    p07_secrets,
    p08_tokenize,
    p09_packing,
    p10_repetition,
)
from lodestrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_split.oversized_blocks(table(spark, sf_dir, "knowledge_nodes"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01_split.split_nodes(table(spark, sf_dir, "knowledge_nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_personal_data.found_kinds(table(spark, sf_dir, "knowledge_nodes"), table(spark, sf_dir, "given_names"))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02_personal_data.masked(table(spark, sf_dir, "knowledge_nodes"), table(spark, sf_dir, "given_names"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_neighbours.mutual_pairs(table(spark, sf_dir, "embedding_entries"))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_neighbours.nearest(table(spark, sf_dir, "embedding_entries"))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03_neighbours.recall(table(spark, sf_dir, "embedding_entries"))


def p3_recall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the setting that p3_found uses
    return p03_neighbours.recall(table(spark, sf_dir, "embedding_entries"), relax=p03_neighbours.PAIR_RELAX, min_cosine=0.9)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_near_duplicates.similar_pairs(table(spark, sf_dir, "knowledge_nodes"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p04_near_duplicates.groups(table(spark, sf_dir, "knowledge_nodes"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("search_queries", "search_results", "index_hits", "knowledge_edges")
    return p05_rank_fusion.rank_candidates(*(table(spark, sf_dir, n) for n in names))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05_rank_fusion.first_candidates(_ranked(spark, sf_dir))


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_conversations.dropped_sessions(table(spark, sf_dir, "session_messages"))


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_conversations.conversations(table(spark, sf_dir, "session_messages"))


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06_conversations.relinked(table(spark, sf_dir, "session_messages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07_secrets.find_credentials(table(spark, sf_dir, "knowledge_nodes"))


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p07_secrets.redact_files(table(spark, sf_dir, "knowledge_nodes"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08_tokenize.token_ids(table(spark, sf_dir, "documents"))


def p8_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = p08_tokenize.token_counts(docs.select(F.struct("source", "kind").alias("doc_id"), "text"))
    return counts.groupBy(F.col("doc_id.source").alias("source"), F.col("doc_id.kind").alias("kind")).agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum((F.col("n_tokens") == 0).cast("long")).alias("empty")
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_packing.over_capacity(p09_packing.pack_documents(table(spark, sf_dir, "documents")))


def p9_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_packing.pack_documents(table(spark, sf_dir, "documents"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09_packing.fill_report(p09_packing.pack_documents(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p10_repetition.ledger(table(spark, sf_dir, "documents"))
    return p10_repetition.dropped(rows, p10_repetition.POLICIES[0]).select("doc_id").distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition.ledger(table(spark, sf_dir, "documents"))


def p10_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition.ablation(p10_repetition.ledger(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p2_masked, p3_found, p3_neighbours, p3_recall, p3_recall_pairs, p4_found, p4_groups, p5_found, p5_ranking, p6_found, p6_turns, p6_linked, p7_found, p7_redacted, p8_ids, p8_counts_by_source, p9_found, p9_packs, p9_fill, p10_found, p10_shares, p10_ablation)
}

_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant' WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' END"
_STAMP = "trim(msg_timestamp)"
_INSTANT = f"""CASE WHEN regexp_matches({_STAMP}, '^[0-9]{{9,11}}$') THEN {_STAMP}::BIGINT * 1000000 WHEN regexp_matches({_STAMP}, '^[0-9]{{12,14}}$') THEN {_STAMP}::BIGINT * 1000
  WHEN regexp_matches({_STAMP}, '(Z|z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN epoch_us(try_cast({_STAMP} AS TIMESTAMPTZ)) ELSE epoch_us(try_cast({_STAMP} AS TIMESTAMP)) END"""
_TEXT = """CASE WHEN content LIKE '[%' AND json_valid(content) THEN coalesce(array_to_string(list_transform(json_extract(content, '$[*]'), lambda x: coalesce(CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END, x ->> '$.text', '')), chr(10)), '') ELSE coalesce(content, '') END"""

#: The SQL speaks of the rules as TESTDATA states them, not of how the operators work.
ORACLE_SQL: dict[str, str] = {
    "p1_found": """WITH n AS (SELECT id, text FROM knowledge_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1),
l AS (SELECT id, unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), 1) AS i FROM n WHERE length(text) > 1800),
b AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM l WHERE regexp_matches(line, '[^ \\t]')),
k AS (SELECT id, min(i) AS i, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9)) AS block FROM b GROUP BY id, run),
o AS (SELECT id, block, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS no FROM k)
SELECT id AS node_id, no::INT AS block_no FROM o WHERE length(block) > 1800""",
    "p6_found": f"""WITH r AS (SELECT session_id AS s, message_id AS m, {_ROLE} AS who, lower(trim(coalesce(role, ''))) AS spelt, {_INSTANT} AS instant, regexp_matches({_TEXT}, '[^\\s\\p{{Z}}]') AS said, content, received_at, ord FROM session_messages),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY s, m, CASE WHEN m IS NULL THEN coalesce(who, spelt) END, CASE WHEN m IS NULL THEN instant END, CASE WHEN m IS NULL THEN content END ORDER BY received_at DESC NULLS LAST, ord DESC) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY coalesce(m, instant, 9223372036854775807), received_at, ord) AS n FROM c),
t AS (SELECT * FROM o WHERE who IN ('user', 'assistant')),
x AS (SELECT s, who, lead(who) OVER (PARTITION BY s ORDER BY n) AS next FROM t WHERE who = 'user' OR said),
bad AS (
  SELECT s FROM c GROUP BY s HAVING (count(m) > 0 AND (min(m) <> 1 OR max(m) <> count(m))) OR bool_or(who IS NULL) OR NOT coalesce(bool_or(said AND who IN ('user', 'assistant')), false)
  UNION SELECT s FROM t GROUP BY s HAVING arg_min(who, n) <> 'user'
  UNION SELECT s FROM x WHERE who = 'user' AND next IS DISTINCT FROM 'assistant')
SELECT s AS session_id FROM bad""",
    "p5_found": """WITH seeds AS (SELECT query_id, max(seed_id) AS seed_id FROM search_queries GROUP BY 1),
raw AS (SELECT query_id, node_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS a, NULL::DOUBLE AS b FROM search_results UNION ALL SELECT query_id, node_id, NULL, CASE WHEN isnan(score) THEN NULL ELSE score END FROM index_hits),
k AS (SELECT query_id, node_id, max(a) AS a, max(b) AS b FROM raw WHERE query_id IS NOT NULL AND node_id IS NOT NULL GROUP BY 1, 2),
e AS (SELECT src, dst, max(CASE WHEN isnan(weight) THEN NULL ELSE weight END) AS w FROM knowledge_edges WHERE edge_type = 'RELATED' GROUP BY 1, 2),
s AS (SELECT k.*, e.w AS c FROM k JOIN seeds USING (query_id) LEFT JOIN e ON e.src = seeds.seed_id AND e.dst = k.node_id),
l AS (SELECT query_id, node_id, unnest([1, 2, 3]) AS source, unnest([a, b, c]) AS score FROM s),
p AS (SELECT *, count(*) OVER (PARTITION BY query_id, source) AS items, count(score) OVER (PARTITION BY query_id, source) AS n, max(score) OVER (PARTITION BY query_id, source) > min(score) OVER (PARTITION BY query_id, source) AS spread,
  rank() OVER (PARTITION BY query_id, source ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY query_id, source, score) - 1) / 2.0 AS place FROM l),
r AS (SELECT query_id, node_id, CASE WHEN coalesce(spread, false) OR (n > 0 AND n < items) THEN place / items END AS r FROM p),
g AS (SELECT query_id, node_id, list_sort(list(r) FILTER (WHERE r IS NOT NULL)) AS rs FROM r GROUP BY 1, 2),
z AS (SELECT query_id, node_id, coalesce(list_product(rs), 1.0) AS product, least(1.0, CASE coalesce(len(rs), 0) WHEN 0 THEN 1.0 WHEN 1 THEN rs[1] WHEN 2 THEN 2 * least(1 - (1 - rs[1]) ** 2, rs[2] ** 2)
  ELSE 3 * least(1 - (1 - rs[1]) ** 3, 3 * rs[2] ** 2 * (1 - rs[2]) + rs[2] ** 3, rs[3] ** 3) END) AS p FROM g)
SELECT query_id, node_id FROM z QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12), round(product, 12), node_id) = 1""",
    "p10_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, n, i, md5(array_to_string(ws[i:i + 7], ' ')) AS gram FROM g),
again AS (SELECT doc_id, n, i FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
held AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS k FROM again)
SELECT doc_id FROM held GROUP BY doc_id, n HAVING count(*) >= 0.3 * n""",
}
