import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import callgraph as C
from lodestrata.operators import fulltext as X
from lodestrata.operators import graphstore as G
from lodestrata.operators import lexical as L
from lodestrata.operators import repositories as R
from lodestrata.plans import catalog

NODE = "id string, node_type string, label string, text string, path string, metadata string, ord bigint"
EDGE = "src string, dst string, edge_type string, weight double, metadata string, ord bigint"
FN = "key string, filepath string, callees array<string>, lineno int, end_lineno int, ord bigint"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [("d", "decision", "Wallet choice", "We use MuSig2 for the wallet.", None, '{"sourceID":"m"}', 1), ("m", "memory", "MuSig2 wallet", "MuSig2 wallet design", "/m.md", "{}", 2), ("t", "transcript", "Talk", "about passkey login", None, '{"startedAt":"2026-02-01T00:00:00Z"}', 3),
             ("f", "function", "sign", "repo.sign", "/repo/a.py", '{"project":"/repo"}', 4), ("keyword:musig2", "keyword", "musig2", "musig2", None, "{}", 5), ("p", "project", "repo", "Repository repo", "/repo", "{}", 6), ("c", "claim", "x", "y", None, '{"sourceID":"f"}', 7)]
    edges = [("d", "m", "DERIVED_FROM", 0.5, None, 1), ("d", "m", "DERIVED_FROM", 0.9, "late", 2), ("f", "keyword:musig2", "TAGGED", 1.0, None, 3), ("m", "m", "NEXT", 1.0, None, 4), ("m", "gone", "NEXT", 1.0, None, 5), ("c", "f", "DERIVED_FROM", 1.0, None, 6)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_merging(graph):
    nodes, edges = graph
    e = {(r["src"], r["dst"]): (r["weight"], r["metadata"], r["ord"]) for r in G.upsert_edges(edges).collect()}
    assert e["d", "m"] == (0.9, None, 1)
    both = nodes.unionByName(nodes.where("id = 'm'").withColumn("label", F.lit("new")).withColumn("ord", F.lit(99).cast("bigint")))
    m = G.upsert_nodes(both).where("id = 'm'").first()
    assert (m["label"], m["ord"]) == ("new", 2)
    assert {(r["src"], r["dst"]) for r in G.valid_edges(edges, nodes).collect()} == {("d", "m"), ("f", "keyword:musig2"), ("c", "f")}


def test_remove_repository(graph):
    nodes, edges = graph
    left, held = G.remove_repository(nodes, edges, "/repo")
    assert {r["id"] for r in left.collect()} == {"d", "m", "t"}
    assert all("f" not in (r["src"], r["dst"]) for r in held.collect())


def test_browse_and_related(graph):
    nodes, edges = graph
    assert [r["id"] for r in G.browse(nodes).collect()][0] == "t"
    assert "keyword" not in {r["node_type"] for r in G.browse(nodes).collect()}
    assert [(r["id"], r["other"]) for r in G.related(edges, nodes, nodes.where("id = 'd'")).collect()] == [("d", "m"), ("d", "m")]


def test_provenance(graph):
    nodes, _ = graph
    out = {r["id"]: r["metadata"] for r in G.attach_provenance(nodes, "/repo", "r", "main", "abc").collect()}
    assert '"relativePath":"a.py"' in out["f"] and out["m"] == "{}"


def test_lexical(graph):
    nodes, _ = graph
    assert L.search(nodes, "pasckey authentication", 5).first()["id"] == "t"
    assert L.search(nodes, "the und", 5).count() == 0
    many = L.search_many(nodes, nodes.sparkSession.createDataFrame([(1, "MuSig2 wallet"), (2, "nothing fits")], "query_id int, question string"), 5)
    one = [(r["id"], r["score"]) for r in L.search(nodes, "MuSig2 wallet", 5).collect()]
    assert [(r["id"], r["score"]) for r in many.orderBy("query_id", "rank").collect()] == one


def test_excerpt(spark):
    df = spark.createDataFrame([("  short ",), ("x" * 300 + " cache " + "y" * 300,), ("z" * 900,), (None,)], "t string")
    got = [r[0] for r in df.select(L.excerpt("t", "the cache", 90)).collect()]
    assert got[0] == "short" and got[1].startswith("…") and "cache" in got[1] and len(got[1]) == 92 and got[2] == "z" * 90 and got[3] == ""


def test_bm25_equals_sqlite(spark):
    try:
        db = sqlite3.connect(":memory:")
        db.execute("create virtual table t using fts5(label, text, path, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer here")
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "aaaa", "caché", "x1", "delta-9"]
    rows = [(f"n{i}", "memory", " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(0, 30))), f"/p/{rng.choice(words)}", "{}", i) for i in range(40)]
    db.executemany("insert into t(rowid, label, text, path) values (?,?,?,?)", [(r[6] + 1, r[2], r[3], r[4]) for r in rows])
    docs = X.indexed(spark.createDataFrame(rows, NODE))
    for q in ("alpha", "aaa", "beta gamma", "delta-9 alpha"):
        terms = [t for t in __import__("lodestrata.functions.text", fromlist=["x"]).query_terms(q) if len(t) >= 3]
        want = {f"n{i - 1}": -s for i, s in db.execute("select rowid, bm25(t) from t where t match ?", (" OR ".join(f'"{t}"' for t in terms),))}
        stats = X.corpus_stats(docs, terms)
        got = {r[0]: r[1] for r in docs.select("id", X.bm25(terms, stats)).collect() if r[1] > 0}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_finds_what_a_scan_finds(graph, spark, tmp_path):
    nodes, _ = graph
    ix = X.Index(spark, f"file://{tmp_path}/ix")
    assert ix.rebuild(nodes, "1") and not ix.rebuild(nodes, "1") and ix.rebuild(nodes, "2")
    for q, types in (("MuSig2 wallet", None), ("passkey", ["transcript"]), ("zz", None)):
        scan = [tuple(r) for r in X.search(X.indexed(nodes), q, types=types).collect()]
        assert [tuple(r) for r in ix.search(q, types=types).collect()] == scan
    assert ix.search("MuSig2 wallet").first()["id"] == "m"


def test_no_vocabulary_is_broadcast(spark, tmp_path):
    rows = [(f"n{i}", "memory", f"word{i} resolver", f"kilo{i} partition", None, "{}", i) for i in range(300)]
    ix = X.Index(spark, f"file://{tmp_path}/ix")
    ix.rebuild(spark.createDataFrame(rows, NODE), "1")
    found = ix.search_lexical("resolvr partiton", 3)
    assert [(r["id"], r["score"]) for r in found.collect()] == [("n0", 4), ("n1", 4), ("n10", 4)]
    # the planner doesn't know the size of rows from Python and would take the vocabulary for the smaller side
    plan = L.matches(ix.read("words"), spark.createDataFrame([("resolvr",)], "term string"))._jdf.queryExecution().sparkPlan()
    joins, rest = [], [plan]
    while rest:
        node = rest.pop()
        rest += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin":
            joins.append(node.right() if node.buildSide().toString() == "BuildRight" else node.left())
    assert len(joins) == 2 and not any("parquet" in j.toString() for j in joins)


def test_matches_equal_all_pairs(spark):
    rng = random.Random(5)
    said = sorted({"".join(rng.choices("abrt", k=rng.randint(3, 9))) for _ in range(400)} | {"kkkkk", "ccccc", "qqqqqa", "wallet", "walet", "12345"})
    tokens = spark.createDataFrame([(w,) for w in said * 2], "token string")
    asked = said[::7] + ["kkkkka", "wallets", "yyyyyy"]
    got = [tuple(r) for r in L.matches(L.vocabulary(tokens), spark.createDataFrame([(w,) for w in asked], "term string")).collect()]
    sounds = {w: T.signature_plain(w) for w in said + asked}

    def near(a, b):
        cut = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
        return a == b or b in cut(a) or a in cut(b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1

    want = {(t, t, True) for t in asked if t in said} | {(t, w, False) for t in asked for w in said if t != w and len(t) >= 5 and len(w) >= 5 and near(sounds[t], sounds[w])}
    assert len(got) == len(set(got)) and set(got) == want


def test_trigrams_of_any_letters_in_several_portions(spark, tmp_path, monkeypatch):
    texts = ["Ab\nÄÖÜ größe", "𐐀𐐁𐐂 İstanbul", "ab", "", None, "aaaa größen", "𐐨𐐩𐐪 aaa"]
    rows = [(f"n{i}", "memory", "x", t, None, "{}", i) for i, t in enumerate(texts)]
    docs = X.indexed(spark.createDataFrame(rows, NODE)).withColumn("no", F.col("ord"))
    monkeypatch.setattr(X, "POSTINGS", 5)
    got = {(r["gram"], n) for r in X.gram_postings(docs).collect() for n in r["held"]}
    folded = {i: t or "" for i, t in docs.select("no", F.lower("text")).collect()}
    assert got == {(t[i : i + 3], n) for n, t in folded.items() for i in range(len(t) - 2)}
    ix = X.Index(spark, f"file://{tmp_path}/ix")
    ix.rebuild(spark.createDataFrame(rows, NODE).repartition(3), "1")
    for q in ("größe", "𐐀𐐁𐐂", "aaa", "äöü ab"):
        assert [tuple(r) for r in ix.search(q).collect()] == [tuple(r) for r in X.search(docs, q).collect()] and ix.search(q).count()


@pytest.fixture(scope="module")
def functions(spark):
    rows = [("m.main", ["m.greet"]), ("m.helper", ["m.greet"]), ("m.greet", ["m.fmt", "m.greet", "print"]), ("m.fmt", ["_hidden", "m.back"]), ("m.back", ["m.greet"]), ("m._hidden", ["m.main"]), ("n.A.greet", [])]
    return spark.createDataFrame([(k, "/r/m.py" if k[0] == "m" else "/r/test_n.py", c, i, i, i) for i, (k, c) in enumerate(rows)], FN)


def keys(df):
    return {r["key"] for r in df.collect()}


def test_call_graph(functions, spark):
    key = lambda k: spark.createDataFrame([(k,)], "key string")
    assert keys(C.enrich(functions, "/r/m.py", "main")) == {"m.main", "m.greet", "m.fmt", "m.back"}
    assert C.enrich(functions, "/r/m.py", "nothing") is None
    with pytest.raises(C.AmbiguousEntry):
        C.enrich(functions.unionByName(functions.where("key = 'm.fmt'").withColumn("key", F.lit("m.B.fmt"))), "/r/m.py", "fmt")
    assert keys(C.direct_callers(functions, key("m.greet"))) == {"m.main", "m.helper", "m.back"}
    assert [list(r["names"]) for r in C.dependents(functions, key("m.greet")).collect()] == [["back", "greet", "helper", "main"]]
    far = {r["key"]: r["depth"] for r in C.indirect_callers(functions, key("m.back")).collect()}
    assert far == {"m.fmt": 1, "m.greet": 2, "m.main": 3, "m.helper": 3}
    assert C.indirect_callers(functions, key("m.helper")).count() == 0
    assert {r["dst"] for r in C.external_calls(functions).collect()} == {"print", "_hidden"}
    text = C.flowchart(C.enrich(functions, "/r/m.py", "main"), "m.main")
    assert "m_main --> m_greet" in text and "ext_print" in text and "m_greet --> m_greet" not in text
    assert "m_main->>+m_greet: greet" in C.sequence(C.enrich(functions, "/r/m.py", "main"), "m.main")


def test_sequence_calls_of_the_whole_graph(spark, tmp_path):
    n = 900
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    name = lambda k: f"mod_{k % 97}_fn_{k}"
    links = [(p, (7 * p + 3) % n + 1) for p in range(1, n + 1) if p % 4] + [(p, (13 * p + 1) % n + 1) for p in range(5, n + 1, 5)]
    want = {(name(a), name(b), f"fn_{b}") for a, b in links if a != b}
    assert {tuple(r) for r in catalog.QUERIES["sequence_calls"](spark, str(tmp_path)).collect()} == want


def test_reachable_equals_search(spark):
    rng = random.Random(6)
    links = {i: [rng.randrange(60) for _ in range(rng.randint(0, 2))] for i in range(60)}
    df = spark.createDataFrame([(f"k.{i}", "/f", [f"k.{j}" for j in v], i, i, i) for i, v in links.items()], FN)
    depth, todo = {0: 0}, [0]
    for x in todo:
        for y in links[x]:
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    got = {r["key"]: r["depth"] for r in C.reachable(df, spark.createDataFrame([("k.0",)], "key string")).collect()}
    assert got == {f"k.{i}": d for i, d in depth.items()}


def test_names_are_made_unique_and_resolved(functions, spark):
    twice = functions.unionByName(functions.where("key = 'm.fmt'").withColumn("ord", F.lit(50).cast("bigint")))
    assert "m.fmt__2" in keys(C.unique_keys(twice))
    bare = spark.createDataFrame([("a.f", "/a", ["g", "x", "g"], 1, 1, 1), ("b.g", "/b", [], 1, 1, 2), ("c.g", "/c", [], 1, 1, 3)], FN)
    assert {r["key"]: r["callees"] for r in C.resolve_names(bare).collect()}["a.f"] == ["b.g", "x"]


def test_repository_state(spark):
    from lodestrata.operators.repositories import STATE

    s = spark.createDataFrame([("a", "u", "/a", "main", None, "c1", 1, 2, "2026-01-01T00:00:00.000Z", None, None), ("b", "u", "/b", "main", None, None, None, None, None, None, "boom")], STATE)
    assert {r["slug"]: (r["due"], r["failed"]) for r in R.due(s, "2026-01-01T12:00:00.000Z").collect()} == {"a": (False, False), "b": (True, True)}
    fresh = s.where("slug = 'a'").withColumn("indexed_commit", F.lit(None).cast("string")).withColumn("error", F.lit("x"))
    merged = {r["slug"]: r["indexed_commit"] for r in R.merge_state(s, fresh).collect()}
    assert merged == {"a": "c1", "b": None}
    assert R.refresh_each(["a", "b"], lambda x: 1 / (x != "b")) == {"a": None, "b": "division by zero"}
