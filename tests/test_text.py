import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T

SAMPLES = ["camelCase HTTPServer", "Projects glass status analysis", "Müßiggang ÉCOLE ﬁn 16", "ｆｕｌｌ ½ x", "the und 7 ab abc", "", None, "a_b-c.d", "Ünïcödé 🙂 text"]


def test_tokens_equal_plain(spark):
    rng = random.Random(1)
    texts = SAMPLES + ["".join(rng.choice("abCDé ß1s-ü_") for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (got, t) in df.select(T.tokens("t"), "t").collect():
        assert got == T.tokens_plain(t or "")


def test_signatures_and_matches(spark):
    words = ["passkey", "PASCII", "queen", "phone", "bookkeeper", "cycle", "quickly"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(T.phonetic_signature("w")).collect()] == [T.signature_plain(w) for w in words]
    pair = spark.createDataFrame([("passkey", "paskey"), ("abcd", "abce"), ("same1", "same1"), ("reviewer", "rewiever")], "a string, b string")
    match = T.phonetic_match(F.col("a"), F.col("b"), T.phonetic_signature("a"), T.phonetic_signature("b"))
    assert [r[0] for r in pair.select(match).collect()] == [True, False, False, False]


def distance_within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    return a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))


def test_one_edit(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 4))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(T.within_one_edit(F.col("a"), F.col("b"))).collect()] == [distance_within_one(a, b) for a, b in pairs]


def test_small_functions(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert tuple(one(T.first_line(F.lit(" x \ny")), T.first_line(F.lit("  ")), T.sentence_label(F.lit("One two. Three"), F.lit("id")), T.sentence_label(F.lit(""), F.lit("id")))) == ("x", "Untitled memory", "One two", "id")
    assert tuple(one(T.base_name(F.lit("/a/b.TS")), T.directory(F.lit("/a/b.ts")), T.extension(F.lit("/a/b.TS")), T.extension(F.lit("/a/.env")), T.relative_path(F.lit("/r/x/y"), "/r"), T.clean_path(F.lit("~/a/"), "/home/u"))) == ("b.TS", "/a", ".ts", "", "x/y", "/home/u/a")
    assert tuple(one(T.ratio(F.lit(1.0), F.lit(0)), T.ratio(F.lit(1.0), F.lit(2)), T.percent(F.lit(0.5)))) == (1.0, 0.5, "50.0%")
    assert tuple(one(T.node_millis(F.lit('{"startedAt":"2026-01-01T00:00:00Z"}')), T.node_millis(F.lit('{"timestamp":1723640000000}')), T.node_millis(F.lit(None).cast("string")))) == (1767225600000, 0, 0)
    fam = T.source_family(F.col("i"), F.col("p"), F.col("m"))
    df = spark.createDataFrame([("transcript:9", None, "{}"), ("x", "/a/b.md/", "{}"), ("y", None, None), ("t", "/p", '{"session_id":"s"}')], "i string, p string, m string")
    assert [r[0] for r in df.select(fam).collect()] == ["dictation:9", "/a/b", "y", "session:s"]


def test_message_text(spark):
    values = ['plain', '"quoted"', '["a","","b"]', '[{"type":"text","text":"x"},{"content":"y"}]', '{"text":"t"}', '{"k":1}', None]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert [r[0] for r in df.select(T.message_text("c")).collect()] == ["plain", "quoted", "a\nb", "x\ny", "t", '{"k":1}', ""]


@pytest.mark.parametrize(("q", "want"), [("What should I use", True), ("Was möchte er", True), ("mustard", False)])
def test_intent(q, want):
    assert T.wants_preference(q) is want


def test_query_terms():
    assert T.query_terms("MuSig2 wallet, c++ a #tag x_y musig2") == ["musig2", "wallet", "c++", "#tag", "x_y"]
