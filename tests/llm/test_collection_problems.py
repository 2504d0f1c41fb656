"""Problems 3, 4, 5, 6 against brute force, with copies, ties, nulls and hot groups."""

import collections
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import components as CC
from lodestrata.llm import p03_neighbours as P3
from lodestrata.llm import p04_near_duplicates as P4
from lodestrata.llm import p05_rank_fusion as P5
from lodestrata.llm import p06_conversations as P6
from lodestrata.llm import slices as SL

ENTRY = "id string, node_id string, chunk_index int, text_hash string, vector binary, scale double, norm double, model string, hits string"
NODES = "id string, node_type string, label string, text string, path string, metadata string, ord bigint, size int"


# ---- 3 -----------------------------------------------------------------------------------------


def entries(spark, rows):
    return spark.createDataFrame([(f"{i:032x}", n, 0, "", bytes(v) if v is not None else None, s, 1.0, m, "x") for i, n, v, s, m in rows], ENTRY)


def brute_neighbours(rows, k):
    best = {}
    for i, n, v, s, m in rows:
        if v is None or not s or len(v) != int(m.rsplit("-")[-1]) or not any(v):
            continue
        best.setdefault(i, (n, np.frombuffer(bytes(v), np.int8).astype(float), m))
    out = {}
    for i, (n, v, m) in best.items():
        near = [(-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), f"{j:032x}") for j, (o, w, p) in best.items() if o != n and p == m]
        out[f"{i:032x}"] = [(round(-c, 6), j) for c, j in sorted((round(c, 9), j) for c, j in near)[:k]]
    return out


def test_neighbours_exact_with_factor_one(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        v = rng.integers(-40, 41, 8).astype(np.int8)
        rows.append((i, f"n{i // 2}", v.tobytes(), 0.1, "toy-8"))
    copy = rng.integers(-40, 41, 8).astype(np.int8).tobytes()
    rows += [(1000 + i, f"c{i}", copy, 0.2, "toy-8") for i in range(60)]  # many copies, many nodes
    rows += [(2000 + i, "one", copy, 0.2, "toy-8") for i in range(30)]  # and many of one node
    rows += [(3000, "z", None, 0.1, "toy-8"), (3001, "z", bytes(8), 0.1, "toy-8"), (3002, "z", bytes([1] * 5), 0.1, "toy-8"), rows[0]]
    got = collections.defaultdict(list)
    for r in P3.nearest(entries(spark, rows), k=5, relax=1.0).orderBy("id", "rank").collect():
        got[r["id"]].append((round(r["cosine"], 6), r["neighbour"]))
    want = brute_neighbours(rows, 5)
    assert set(got) == set(want)
    for i in want:
        assert [c for c, _ in got[i]] == [c for c, _ in want[i]]
    singles = [i for i in want if int(i, 16) < 1000]
    assert sum(got[i] == want[i] for i in singles) / len(singles) > 0.98


def test_neighbours_of_nothing(spark):
    assert P3.nearest(entries(spark, [(1, "a", None, 0.1, "toy-8")])).count() == 0
    assert P3.mutual_pairs(entries(spark, [(1, "a", bytes([1] * 8), 0.1, "toy-8")])).count() == 0


def test_tree_answers_exactly():
    rng = np.random.default_rng(5)
    x = rng.integers(-100, 101, (1500, 12)).astype(np.float32)
    node = np.arange(1500)
    best, who = P3.VantageTree(x, leaf_rows=50).search(x[:40], node, node[:40], 6, 1.0, np.pi)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[:40] @ u.T
    s[np.arange(40), np.arange(40)] = -2
    assert np.allclose(best, -np.sort(-s, axis=1)[:, :6], atol=1e-5)


def test_ties_at_the_cut_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(6)
    rows, k = [], 0
    for _ in range(4):  # all signs of one pattern: many equal cosines, no equal vectors
        base = rng.integers(1, 60, 2)
        for bits in itertools.product((1, -1), repeat=6):
            v = np.r_[base, np.array(bits) * 7].astype(np.int8)
            rows.append((int(rng.integers(0, 1 << 40)) * 1000 + k, f"n{k}", v.tobytes(), 0.1, "toy-8"))
            k += 1
    copy = rng.integers(-40, 41, 8).astype(np.int8).tobytes()
    rows += [(9000 + i, f"c{i}", copy, 0.1, "toy-8") for i in range(40)]
    near = rng.integers(-40, 41, 8).astype(np.int8) // 9 + np.frombuffer(copy, np.int8)
    rows.append((5, "asks", near.astype(np.int8).tobytes(), 0.1, "toy-8"))
    got = collections.defaultdict(list)
    for r in P3.nearest(entries(spark, rows), k=10, relax=1.0).orderBy("id", "rank").collect():
        got[r["id"]].append((round(r["cosine"], 6), r["neighbour"]))
    assert dict(got) == brute_neighbours(rows, 10)
    assert [j for _, j in got[f"{5:032x}"]] == [f"{9000 + i:032x}" for i in range(10)]


def test_factor_one_is_exact_over_several_shards(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(3, 8))
    rows = []
    for i in range(900):  # dense clumps, and a few rows between them whose neighbours lie in several
        a, b = rng.choice(3, 2, replace=False)
        v = centres[a] * 40 + rng.normal(size=8) * 2 if i % 20 else (centres[a] + centres[b]) * 25 + rng.normal(size=8) * 12
        rows.append((i, f"n{i}", np.clip(np.round(v), -127, 127).astype(np.int8).tobytes(), 0.1, "toy-8"))
    df = entries(spark, rows)
    got = collections.defaultdict(list)
    for r in P3.nearest(df, k=10, relax=1.0, cell_rows=100).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    want = brute_neighbours(rows, 10)
    assert dict(got) == {i: [j for _, j in w] for i, w in want.items()}
    x = {f"{i:032x}": np.frombuffer(v, np.int8).astype(float) for i, _, v, _, _ in rows}
    cosine = lambda i, j: x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j])
    best = {i: {j for _, j in w} for i, w in want.items()}
    pairs = {(i, j) for i in want for j in best[i] if i < j and i in best[j] and cosine(i, j) >= 0.9}
    assert {tuple(r) for r in P3.mutual_pairs(df, relax=1.0, cell_rows=100).collect()} == pairs and pairs


def test_cells_are_parted_until_they_fit():
    rng = np.random.default_rng(3)
    x = P3.unit(rng.normal(size=(4000, 12)))  # no sparse shell anywhere
    router = P3.fit_router(x, share=2.0, most=500)
    sizes = np.bincount(router.home(x), minlength=router.leaves)
    assert sizes.sum() == 4000 and sizes.max() * 2 <= 500
    assert P3.fit_router(x, share=0.02, most=500).leaves == 1  # few enough as they are
    assert P3.fit_router(np.tile(x[:1], (3000, 1)), most=500).leaves == 1  # nothing tells them apart


def test_many_models_and_levels(spark):
    rng = np.random.default_rng(13)
    rows = [(i, f"n{i}", rng.integers(-60, 61, 8).astype(np.int8).tobytes(), 0.1, f"m{i % 70}-8") for i in range(1400)]
    rows += [(5000 + i, f"n{i}", rng.integers(-60, 61, 8).astype(np.int8).tobytes(), 0.1, "big-8") for i in range(1200)]
    got = collections.defaultdict(list)
    for r in P3.nearest(entries(spark, rows), k=5, relax=1.0, cell_rows=60).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    assert dict(got) == {i: [j for _, j in w] for i, w in brute_neighbours(rows, 5).items()}


def test_divisible(spark):
    ids = [f"{n:032x}" for n in (0, 50, 51, 50 * 16**20, 50 * 16**20 + 7)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r[0] for r in df.select(P3.divisible("id")).collect()] == [int(i, 16) % 50 == 0 for i in ids]


# ---- 4 -----------------------------------------------------------------------------------------


def near_copies(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(18, 70))]
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), "extra")
            rows.append((f"n{k}", "turn", "", " ".join(words).upper() if rng.random() < 0.2 else ", ".join(words), None, None, k, 0))
            k += 1
    return rows


def test_similar_pairs_equal_brute_force(spark):
    rows = near_copies()
    rows += [("old", "turn", "", rows[0][3], None, None, 900, 0), ("old", "turn", "", "short", None, None, 901, 0), ("nul", "turn", "", None, None, None, 902, 0), ("fil", "file", "", rows[0][3], None, None, 903, 0), ("n0", "turn", "", rows[0][3], None, None, 904, 0)]
    sets = {}
    for r in rows:
        if r[1] == "turn" and r[0] not in ("old", "nul"):
            w = P4.words_of(r[3])
            if len(w) >= 20:
                sets[r[0]] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if 2 * len(sets[p[0]] & sets[p[1]]) >= len(sets[p[0]] | sets[p[1]])}
    df = spark.createDataFrame(rows, NODES)
    got = [tuple(r) for r in P4.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    groups = {r["node_id"]: r["group_id"] for r in P4.groups(df).collect()}
    assert set(groups) == set(sets) and all(groups[a] == groups[b] for a, b in want)


def test_cyclic_texts_share_few_sequences(spark):
    words = [["ha"] * 20, ["ha"] * 25, ["buy", "now"] * 10, ["buy", "now"] * 11 + ["buy"], ["a", "b", "c"] * 7, ["a", "b", "c"] * 8, ["ha"] * 21 + ["no"], ["x", "y", "z", "x"] * 6, ["ha"] * 20 + ["so", "ha", "ha"]]
    rows = [(f"n{i}", "turn", "", " ".join(w), None, None, i, 0) for i, w in enumerate(words)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    want = {(f"n{i}", f"n{j}") for i, j in itertools.combinations(range(len(words)), 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    assert {tuple(r) for r in P4.similar_pairs(spark.createDataFrame(rows, NODES)).collect()} == want and len(want) >= 4


def test_counts_are_exact_and_prefixes_rare_first(spark):
    rng = random.Random(8)
    rows = [(f"n{i}", "turn", "", " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(20, 60))) + f" only{i}", None, None, i, 0) for i in range(120)]
    rows += [(f"m{i}", "turn", "", rows[i][3], None, None, 1000 + i, 0) for i in range(60)]  # copies count once
    sets = {r[3]: {int(h) for h in P4.sequences(P4.words_of(r[3]))} for r in rows}
    times = collections.Counter(h for s in sets.values() for h in s)
    outline = P4.staged(P4._outline(P4._counted_texts(spark.createDataFrame(rows, NODES).repartition(5))), "outline")
    got = P4.prefix_rows(outline).collect()
    shared = {frozenset(int(h) for h in P4._wide(bytes(r["shared"]))) for r in got if r["seq"] is None}
    assert shared == {frozenset(h for h in s if times[h] > 1) for s in sets.values()}
    assert all(times[r["seq"]] > 1 for r in got if r["seq"] is not None)


def test_many_exact_copies_are_listed_with_their_representative(spark):
    text = " ".join(f"t{i}" for i in range(30))
    n = P4.EXPAND + 20
    df = spark.createDataFrame([(f"c{i:03d}", "turn", "", text, None, None, i, 0) for i in range(n)], NODES)
    got = {tuple(r) for r in P4.similar_pairs(df).collect()}
    assert got == {("c000", f"c{i:03d}") for i in range(1, n)}
    assert P4.similar_pairs(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(300, 420)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    got = {r["node"]: r["component"] for r in CC.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == want


# ---- 5 -----------------------------------------------------------------------------------------


def test_rank_aggregation(spark):
    rows = [(1, "a", 9.0, None, 0.1), (1, "b", 8.0, 2.0, 0.9), (1, "c", 8.0, 1.0, None), (1, "d", None, None, 0.8), (2, "x", 1.0, None, None), (2, "y", 1.0, None, None), (3, "only", None, None, None)]
    df = spark.createDataFrame(rows, "query_id bigint, node_id string, result double, hit double, related double")
    out = {(r["query_id"], r["node_id"]): r["significance"] for r in P5.aggregate_ranks(df, "query_id", "node_id", ["result", "hit", "related"]).collect()}
    assert len(out) == len(rows) and out[1, "b"] == min(v for (q, _), v in out.items() if q == 1)
    assert out[2, "x"] == out[2, "y"] == 1.0 and out[3, "only"] == 1.0
    first = {r["query_id"]: r["node_id"] for r in P5.first_candidates(P5.aggregate_ranks(df, "query_id", "node_id", ["result", "hit", "related"])).collect()}
    assert first == {1: "b", 2: "x", 3: "only"}


def test_large_queries_are_ranked_alike_in_slices(spark):
    rng = random.Random(6)
    score = lambda: rng.choice([None, 1.0, 2.5, rng.random()])
    rows = [(q, f"n{i}", score(), score(), score()) for q, n in ((1, 200), (2, 3), (3, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id bigint, node_id string, result double, hit double, related double")
    ranked = lambda hot: {(r[0], r[1]): (round(r[2], 9), round(r[3], 9)) for r in P5.aggregate_ranks(df, "query_id", "node_id", ["result", "hit", "related"], hot).collect()}
    assert ranked(50) == ranked(10**6) and len(ranked(1)) == len(rows)


def test_candidates_take_the_highest_score(spark):
    q = spark.createDataFrame([(1, "s"), (None, "s")], "query_id bigint, seed_id string")
    r = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "b", float("nan")), (1, "c", None), (1, None, 2.0)], "query_id bigint, node_id string, score double")
    h = spark.createDataFrame([(1, "d", 5.0)], "query_id bigint, node_id string, score double")
    e = spark.createDataFrame([("s", "a", "RELATED", 0.2), ("s", "a", "RELATED", 0.7), ("s", "b", "NEXT", 1.0), ("t", "c", "RELATED", 1.0), ("s", "d", "RELATED", None)], "src string, dst string, edge_type string, weight double")
    got = {x["node_id"]: (x["result"], x["hit"], x["related"]) for x in P5.candidate_scores(q, r, h, e).collect()}
    assert got == {"a": (3.0, None, 0.7), "b": (None, None, None), "c": (None, None, None), "d": (None, 5.0, None)}


def test_slices_keep_running_sums(spark):
    rng = random.Random(2)
    rows = [("hot", float(x), 1) for x in rng.sample(range(100_000), 3000)] + [("small", float(x), 2) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, o double, n int")
    cut = SL.with_slices(df, ["g"], "o", hot_rows=500, slices=16)
    assert cut.where("g = 'hot'").select("_slice").distinct().count() > 8
    for down in (False, True):
        got = {(r["g"], r["o"]): r["before"] for r in SL.running_before(cut, ["g"], "o", "n", "before", descending=down).collect()}
        for g in ("hot", "small"):
            mine = sorted(((o, n) for x, o, n in rows if x == g), reverse=down)
            total = 0
            for o, n in mine:
                assert got[g, o] == total
                total += n


# ---- 6 -----------------------------------------------------------------------------------------

MESSAGE = "ord bigint, session_id string, message_id bigint, role string, content string, msg_timestamp string, source string, received_at timestamp, text string"


def talk(spark, rows):
    import datetime as dt

    base = dt.datetime(2026, 1, 1)
    full = [(k, s, m, r, c, t, None, base + dt.timedelta(seconds=k if a is None else a), "clash") for k, (s, m, r, c, t, a) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


def test_sessions_kept_and_dropped(spark):
    iso = "2026-01-01T00:00:{:02d}Z"
    part = json.dumps([{"type": "text", "text": ""}])
    rows = [
        ("ok", 1, "user", "hi", None, None), ("ok", 2, "AI", "hello", None, None), ("ok", 2, "AI", "", None, 0),
        ("late", 1, "user", "hi", None, None), ("late", 2, "assistant", "old", None, 0), ("late", 2, "assistant", " ", None, 90),
        ("hole", 1, "user", "hi", None, None), ("hole", 3, "assistant", "x", None, None),
        ("role", 1, "user", "hi", None, None), ("role", 2, "narrator", "x", None, None),
        ("empty", 1, "system", "be nice", None, None), ("first", 1, "assistant", "x", None, None), ("first", 2, "user", "q", None, None), ("first", 3, "model", "a", None, None),
        ("open", 1, "user", "q", None, None), ("open", 2, "human", "q2", None, None), ("open", 3, "assistant", "a", None, None),
        ("time", None, "assistant", "a", iso.format(9), None), ("time", None, "user", "q", iso.format(5), None), ("time", None, "user", "q", "2026-01-01 00:00:05", None), ("time", None, "User", "q", "1767225605000", None),
        ("blank", 1, "user", "q", None, None), ("blank", 2, "assistant", part, None, None),
    ]
    df = talk(spark, rows)
    assert {r[0] for r in P6.dropped_sessions(df).collect()} == {"late", "hole", "role", "empty", "first", "open", "blank"}
    turns = [(r["session_id"], r["turn_no"], r["speaker"], r["text"]) for r in P6.conversations(df).orderBy("session_id", "turn_no").collect()]
    assert turns == [("ok", 1, "user", "hi"), ("ok", 2, "assistant", "hello"), ("time", 1, "user", "q"), ("time", 2, "assistant", "a")]
    assert P6.dropped_sessions(df.limit(0)).count() == 0


def test_rows_without_session_join_by_quotes_and_replies(spark):
    line = "how do I reset the cache of the parser"
    rows = [(None, None, "user", line, None, None), (None, None, "assistant", f"> {line}\nlike this", None, None), ("s", 1, "user", "what is the weather like in town", None, None), (None, None, "assistant", "> what is the weather like in town\nfine", None, None), (None, None, "user", "alone", None, None)]
    df = talk(spark, rows).withColumn("reply_to", F.lit(None).cast("bigint"))
    got = {r["ord"]: r["session_id"] for r in P6.assign_conversations(df).collect()}
    assert got[0] == got[1] == "conversation-0" and got[3] == "s" and got[4] == "conversation-4"


def test_quotes_lead_to_the_nearest_earlier_row(spark):
    same, own, late = "hello there how are you doing today", "the parser loses its cache after a restart", "a message that was delivered late"
    at = "2026-01-01T00:00:{:02d}Z".format
    rows = [
        (None, None, "user", same, at(1), None), (None, None, "assistant", f"> {same}\nfine", at(2), None),
        (None, None, "user", f"{same}\n{own}", at(3), None), (None, None, "assistant", f"> {same}\n> {own}\nso it does", at(4), None),
        (None, None, "assistant", f"> {late}\nthanks", at(6), None), (None, None, "user", late, at(5), 500),
    ]
    got = {r["ord"]: r["session_id"] for r in P6.assign_conversations(talk(spark, rows)).collect()}
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and len(set(got.values())) == 3


def test_sessions_are_found_again(spark):
    at = lambda n: f"2026-01-{n // 86400 + 1:02d}T{n // 3600 % 24:02d}:{n // 60 % 60:02d}:{n % 60:02d}Z"
    rows = [(f"s{k}", m, "user" if m % 2 else "assistant", f"turn {k} {m}", at(k * 7200 + m * 60), None) for k in range(60) for m in range(1, 6)]
    rows += [("s1", 3, "user", "turn 1 3", at(7200 + 180), 999), ("plain", None, "user", "no number", None, None)]
    out = P6.relinked(talk(spark, rows), every=3).first()
    assert out["sessions"] > 5 and out["precision"] == out["recall"] == 1.0
    assert P6.relinked(talk(spark, rows).limit(0)).first()["rows"] == 0


def test_every_session_is_hidden_once(spark):
    at = lambda n: f"2026-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}Z"
    line = "this is what was said first in talk {}".format
    rows = [(f"s{k}", m, "user" if m % 2 else "assistant", f"turn {k} {m}", at(k * 600 + m * 60), None) for k in range(9) for m in range(1, 4)]
    for k in range(6):  # without numbers; the last row of each quotes the talk before, which it isn't part of
        rows += [(f"p{k}", None, "user", line(k), at(20000 + k * 600), None), (f"p{k}", None, "assistant", f"> {line(k)}\nso it is", at(20060 + k * 600), None)]
        rows += [(f"p{k}", None, "user", f"> {line(k - 1)}\nwhat of that", at(20120 + k * 600), None)]
    rows += [(None, None, "assistant", f"> {line(2)}\nno session", at(30000), None), (None, 2, "assistant", "late", at(30060), None)]
    df = talk(spark, rows)
    part = F.pmod(F.xxhash64("session_id"), F.lit(3))
    where = {r["ord"]: (r["session_id"], r["p"]) for r in df.where("session_id is not null").select("ord", "session_id", part.alias("p")).collect()}
    found = true = hit = wrong_kept = 0
    for p in range(3):
        hidden = df.withColumn("session_id", F.when(part != p, F.col("session_id")))
        got = {r["ord"]: r["session_id"] for r in P6.assign_conversations(hidden, numbered=True).collect()}
        for a, b in itertools.combinations(where, 2):
            if p in (where[a][1], where[b][1]):
                found += got[a] == got[b]
                true += where[a][0] == where[b][0]
                hit += got[a] == got[b] and where[a][0] == where[b][0]
                wrong_kept += got[a] == got[b] and where[a][1] != where[b][1]
    out = P6.relinked(df, every=3).first()
    assert (out["sessions"], out["rows"]) == (15, 45) and wrong_kept > 0
    assert (out["precision"], out["recall"]) == (round(hit / found, 4), round(hit / true, 4)) and hit < min(found, true)


def test_unsettled_components_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(400)], "u int, v int")
    with pytest.raises(RuntimeError):
        CC.connected_components(path, rounds=1)


def test_instants(spark):
    df = spark.createDataFrame([("2026-01-01T01:00:00+01:00",), ("1767225600000",), ("2026-01-01 00:00:00",), ("1767225600",), ("soon",), (None,)], "t string")
    want = 1_767_225_600_000_000
    assert [r[0] for r in df.select(P6.instant_of("t")).collect()] == [want] * 4 + [None] * 2
