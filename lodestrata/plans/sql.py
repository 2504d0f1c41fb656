"""Pieces of SQL that the oracle statements share."""

from __future__ import annotations

from lodestrata.functions.text import EXPANSIONS, FOLD_FROM, FOLD_TO, STOP_WORDS

NODES = """
raw_nodes AS (
  SELECT id, node_type, label, text, path, metadata, ord FROM knowledge_nodes
  UNION ALL SELECT id, node_type, label, text, path, metadata, ord FROM shared_nodes),
nodes AS (
  SELECT id, node_type, label, text, path, metadata, first_ord AS ord FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn, min(ord) OVER (PARTITION BY id) AS first_ord FROM raw_nodes) WHERE rn = 1)
"""
EDGES = """
edges AS (
  SELECT src, dst, edge_type, max(weight) AS weight, arg_min({'m': metadata}, ord).m AS metadata, min(ord) AS ord
  FROM knowledge_edges GROUP BY src, dst, edge_type)
"""
BOTH = """
both_ways AS (
  SELECT src AS id, dst AS other, edge_type, weight, ord FROM edges
  UNION ALL SELECT dst, src, edge_type, weight, ord FROM edges WHERE src <> dst)
"""
EVIDENCE = "('CALLS','HAS_TRANSCRIPT','HAS_TURN','NEXT','CONTAINS','DERIVED_FROM','MENTIONS','CONTRADICTS','SUPERSEDES')"
DERIVED = "('claim','decision','preference','task','event')"
FUNCTIONS = """
n AS (SELECT max(p_partkey) AS n FROM part),
functions AS (
  SELECT p_partkey AS ord, 'mod_' || (p_partkey % 97) || '.fn_' || p_partkey AS key,
    CASE WHEN (p_partkey % 97) % 10 = 0 THEN '/repo/tests/mod_' ELSE '/repo/mod_' END || (p_partkey % 97) || '.py' AS filepath,
    list_filter([
      CASE WHEN p_partkey % 4 <> 0 THEN 'mod_' || (((7 * p_partkey + 3) % n + 1) % 97) || '.fn_' || ((7 * p_partkey + 3) % n + 1) END,
      CASE WHEN p_partkey % 5 = 0 THEN 'mod_' || (((13 * p_partkey + 1) % n + 1) % 97) || '.fn_' || ((13 * p_partkey + 1) % n + 1) END,
      CASE WHEN p_partkey % 5 = 0 THEN 'ext_' || (p_partkey % 13) END], lambda x: x IS NOT NULL) AS callees
  FROM part, n),
calls AS (SELECT key AS src, unnest(callees) AS dst FROM functions)
"""


def folded(x: str) -> str:
    s = f"lower({x})"
    for a, b in EXPANSIONS.items():
        s = f"replace({s}, '{a}', '{b}')"
    wide = [(a, b) for a, b in zip(FOLD_FROM, FOLD_TO) if 0xFF00 <= ord(a) <= 0xFF5E]
    return f"translate(strip_accents({s}), '{''.join(a for a, _ in wide)}', '{''.join(b for _, b in wide)}')"


def tokens(x: str) -> str:
    """Search tokens of a text, repeats kept."""
    spaced = f"regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    parts = f"regexp_split_to_array({folded(spaced)}, '[^a-z0-9]+')"
    singular = "CASE WHEN length(t) > 4 AND right(t, 1) = 's' AND NOT regexp_matches(t, '(ss|us|is)$') THEN [t, substr(t, 1, length(t) - 1)] ELSE [t] END"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(flatten(list_transform({parts}, lambda t: {singular})), lambda t: (regexp_full_match(t, '[0-9]+') OR length(t) >= 3) AND t NOT IN ({stop}))"


def signature(x: str) -> str:
    """Phonetic signature of a word; repeats are collapsed letter by letter."""
    s = f"regexp_replace({folded(x)}, '[^a-z0-9]', '', 'g')"
    for a, b in (("ph", "f"), ("ck", "k"), ("qu", "k"), ("ee", "i"), ("[cq]", "k"), ("y", "i")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        s = f"regexp_replace({s}, '{c}{c}+', '{c}', 'g')"
    return s


def phrase(x: str) -> str:
    return f"trim(regexp_replace({folded(x)}, '[^a-z0-9]+', ' ', 'g'))"


def millis(metadata: str) -> str:
    raw = f"coalesce(json_extract_string({metadata}, '$.startedAt'), json_extract_string({metadata}, '$.timestamp'))"
    return f"coalesce(CASE WHEN regexp_matches({raw}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN epoch_ms(try_cast({raw} AS TIMESTAMPTZ)) END, 0)"
