"""Text functions as Column expressions, and their plain forms for the driver.

Everything stays inside the JVM. Folding follows "lower, decompose
(compatibility), drop U+0300-036F": one ``translate`` table, built by rule from
the character database, does the single-character cases; the few ligatures and
fractions that expand are replaced first.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search (fixed values, English and German).
STOP_WORDS = (
    "and are das der die ein eine for from have ich ist mit not oder that the this und von was with you"
).split()

#: Characters whose decomposition is several characters (fixed values).
EXPANSIONS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "…": "..."}

#: Words that ask for a preference, and the steps of the phonetic signature in order (fixed values).
_INTENT = r"\b(should|prefer|preference|require|want|soll|sollen|mochte|wunscht)\b"
PHONETIC_STEPS = (("ph", "f"), ("ck", "k"), ("qu", "k"), ("ee", "i"), ("[cq]", "k"), ("y", "i"), (r"(.)\1+", "$1"))


def _fold_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != char and plain.isascii() and (plain.islower() or plain.isdigit()):
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column) -> Column:
    """Whether there is anything but white space; null is not."""
    return F.coalesce(col(c).rlike(r"(?U)\S"), F.lit(False))


def fold(c: str | Column) -> Column:
    """Lower case without marks; null stays null. Plain ASCII only needs the lower case."""
    plain = col(c)
    lowered = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), EXPANSIONS.items(), F.lower(plain))
    whole = F.translate(F.regexp_replace(lowered, "[̀-ͯ]", ""), FOLD_FROM, FOLD_TO)
    return F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(whole)


def normal_token(c: str | Column) -> Column:
    """Folded, with everything but a-z and 0-9 deleted."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def normal_phrase(c: str | Column) -> Column:
    """Folded words separated by single spaces."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def with_singular(token: Column) -> Column:
    """A token, and its singular after it where it looks like a plural."""
    plural = (F.length(token) > 4) & token.endswith("s") & ~token.rlike("(ss|us|is)$")
    return F.when(plural, F.array(token, F.substring(token, F.lit(1), F.length(token) - 1))).otherwise(F.array(token))


def tokens(c: str | Column) -> Column:
    """Search tokens in order, repeats kept; null gives an empty array."""
    spaced = F.regexp_replace(F.coalesce(col(c), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    # a lambda's variable is worked out once, however often folding asks for it
    words = F.flatten(F.transform(F.array(spaced), lambda s: F.split(fold(s), "[^a-z0-9]+")))
    parts = F.flatten(F.transform(words, with_singular))
    return F.filter(parts, lambda t: ((F.length(t) >= 3) | t.rlike("^[0-9]+$")) & ~t.isin(STOP_WORDS))


def phonetic_signature(c: str | Column) -> Column:
    """How a word sounds, roughly."""
    s = normal_token(c)
    for pattern, to in PHONETIC_STEPS:
        s = F.regexp_replace(s, pattern, to)
    return s


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def phonetic_match(a: Column, b: Column, signature_a: Column, signature_b: Column) -> Column:
    """Different words of at least five letters that sound alike."""
    return (a != b) & (F.length(a) >= 5) & (F.length(b) >= 5) & within_one_edit(signature_a, signature_b)


def stable_id(c: str | Column, width: int = 20) -> Column:
    """The first ``width`` hexadecimal digits of a SHA-256 digest."""
    return F.substring(F.sha2(col(c), 256), 1, width)


def first_line(c: str | Column, limit: int = 80, fallback: str = "Untitled memory") -> Column:
    line = F.substring(F.regexp_replace(F.element_at(F.split(col(c), "\r?\n"), 1), r"(?U)^\s+|\s+$", ""), 1, limit)
    return F.coalesce(F.when(line != "", line), F.lit(fallback))


def sentence_label(c: str | Column, fallback: Column, words: int = 8) -> Column:
    """The first words of the first sentence, else ``fallback``."""
    sentence = F.regexp_replace(F.element_at(F.split(col(c), r"[.!?]"), 1), r"(?U)^\s+|\s+$", "")
    label = F.array_join(F.slice(F.split(sentence, r"(?U)\s+"), 1, words), " ")
    return F.when(label != "", label).otherwise(fallback)


def node_millis(metadata: str | Column) -> Column:
    """Milliseconds since 1970 of ``startedAt``, else ``timestamp``, in JSON metadata.

    Text that isn't an ISO time (epoch numbers too) is 0. Needs UTC sessions
    for text without a zone.
    """
    m = col(metadata)
    raw = F.coalesce(F.get_json_object(m, "$.startedAt"), F.get_json_object(m, "$.timestamp"))
    parsed = F.when(raw.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?([T ]|$)"), F.try_to_timestamp(raw))
    return F.coalesce(F.unix_millis(parsed), F.lit(0).cast("bigint"))


def clean_path(c: str | Column, home: str | None = None) -> Column:
    """A leading ``~`` replaced by ``home`` (of the environment, where none is given), without a trailing slash."""
    home = os.environ.get("HOME", "~") if home is None else home
    return F.regexp_replace(F.regexp_replace(col(c), "^~(?=/)", re.sub(r"([\\$])", r"\\\1", home)), "/$", "")


def base_name(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)/*$", 1)


def directory(c: str | Column) -> Column:
    return F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)


def extension(c: str | Column) -> Column:
    """With its dot, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(c), r"[^.](\.[^.]*)$", 1))


def relative_path(c: str | Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(col(c).startswith(root), F.substring(col(c), len(root) + 1, 2**31 - 1)).otherwise(col(c))


def source_family(id_: Column, path: Column, metadata: Column) -> Column:
    """What counts as one source: a session, a dictation, a path without extension, or the id."""
    session = F.coalesce(F.get_json_object(metadata, "$.sessionID"), F.get_json_object(metadata, "$.session_id"))
    return (
        F.when(session != "", F.concat(F.lit("session:"), session))
        .when(id_.rlike("^(recording|transcript):"), F.regexp_replace(id_, "^(recording|transcript):", "dictation:"))
        .otherwise(F.coalesce(F.regexp_replace(clean_path(path), r"\.[^./]+$", ""), id_))
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; 1 where there is nothing to reach."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def percent(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def message_text(c: str | Column) -> Column:
    """Text of a JSON message content: string, array of strings or parts, object with text or content."""
    raw = col(c)
    value = F.try_parse_json(raw)
    parts = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    inner = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.when(p.startswith("{"), p).otherwise(p))
    joined = F.array_join(F.filter(F.transform(parts, inner), lambda t: t != ""), "\n")
    single = F.coalesce(F.get_json_object(raw, "$.text"), F.get_json_object(raw, "$.content"))
    quoted = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(joined, F.when(raw.startswith("{"), F.coalesce(single, raw)), quoted, raw, F.lit(""))


def variant_kind(v: Column) -> Column:
    """STRING, BIGINT, DOUBLE, DECIMAL..., BOOLEAN, OBJECT<...>, ARRAY<...>, VOID; null stays null."""
    return F.schema_of_variant(v)


def variant_at(v: Column, name: str) -> Column:
    """A field of a JSON object, or null."""
    return F.try_variant_get(v, "$." + name, "variant")


def variant_text(v: Column) -> Column:
    """A JSON string, or a number as text; of anything else nothing (null)."""
    told = F.when(variant_kind(v).rlike("^(STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "string"))
    return F.when(told != "", told)


def variant_message(v: Column, depth: int = 4) -> Column:
    """Text of a message content: a string, parts (``depth`` levels of them) one per line, an object's text or content, else its JSON."""
    kind = variant_kind(v)
    value = F.when(v.isNull() | (kind == "VOID"), F.lit("")).when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    if depth:
        parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda p: variant_message(p, depth - 1))
        value = value.when(kind.startswith("ARRAY"), F.array_join(F.filter(parts, lambda t: t != ""), "\n"))
    value = value.when(kind.startswith("OBJECT"), F.coalesce(variant_text(variant_at(v, "text")), variant_text(variant_at(v, "content")), F.to_json(v)))
    return value.otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


# ---- the same, for query strings on the driver ----------------------------------------------


def fold_plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower())
    return "".join(c for c in s if not 0x300 <= ord(c) <= 0x36F)


def tokens_plain(s: str) -> list[str]:
    out = []
    for part in re.split("[^a-z0-9]+", fold_plain(re.sub("([a-z0-9])([A-Z])", r"\1 \2", s))):
        out.append(part)
        if len(part) > 4 and part.endswith("s") and not re.search("(ss|us|is)$", part):
            out.append(part[:-1])
    return [t for t in out if (re.fullmatch("[0-9]+", t) or len(t) >= 3) and t not in STOP_WORDS]


def signature_plain(s: str) -> str:
    s = re.sub("[^a-z0-9]", "", fold_plain(s))
    for pattern, to in PHONETIC_STEPS:
        s = re.sub(pattern, to.replace("$", "\\"), s)
    return s


def query_terms(query: str, cap: int = 12) -> list[str]:
    """Distinct full-text terms: runs of letters, digits and ``+ _ @ . # -`` of two or more characters."""
    import regex

    found = (t.strip() for t in regex.split(r"[^\p{L}\p{N}+_@.#-]+", query.lower()))
    return list(dict.fromkeys(t for t in found if len(t) >= 2))[:cap]


def wants_preference(query: str) -> bool:
    """Whether a question asks what somebody prefers or should do."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", query) if not 0x300 <= ord(c) <= 0x36F)
    return re.search(_INTENT, plain, re.I) is not None
