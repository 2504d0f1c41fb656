"""Problem 7: find and redact credentials in source and configuration files.

A dictionary of the corpus' own words is counted over all files. Every literal
is segmented into dictionary words by Viterbi (the cheapest segmentation under
word frequencies, with a flat price for a character no word explains); what
stays unexplained is its residual. A long residual near an assignment context
is a secret, unless the literal has a known harmless format (hashes, ids,
public keys, embedded images) or is the name in a reference or a tag. In an
assignment that names a credential the whole quoted value counts, whatever signs
break it. Where the context itself names a password, short
residuals (digits, letters among signs) count too; key blocks count by the
residual of their body. A digest's or id's format is harmless unless the name
right before it says credential.

Defined results: a null or empty text has no credential and stays as it is; a
node that was written several times counts as its row of the largest ``ord``;
nodes that aren't files give nothing. Texts are scanned whole. Redaction puts
``REDACTED`` in the place of each value and keeps all other characters.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.latest import latest_by
from lodestrata.session import staged

#: A word must make up this share of all words; so a dictionary has at most 500,000.
LEAST_SHARE = 2e-6
#: Times a word must occur.
LEAST_COUNT = 3
#: Price of a character that no word explains (natural log of 40 characters).
UNKNOWN = math.log(40)
#: Unexplained characters from which a literal is a secret: in a context that
#: names credentials, in any assignment, and elsewhere.
NAMED, ASSIGNED, FREE = 9, 12, 16
PLACEHOLDER = "REDACTED"

_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
_LITERAL = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{10,}={0,2}(?:\.[A-Za-z0-9_\-]{10,}){0,2}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?:.*?-----END \1-----|[A-Za-z0-9+/=\s\\]*)", re.S)
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\Z")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: Lengths of hexadecimal digests in common use (fixed values: 128 to 512 bits).
_DIGESTS = frozenset({7, 8, 12, 16, 32, 40, 56, 64, 96, 128})
_BEFORE_HARMLESS = re.compile(
    r"(?:sha\d*|md5|blake\w*|etag|crc32)[-:=]\s*[\"'`]?\Z|base64,\s*\Z|(?:ssh-\w+|ecdsa-[\w-]+)\s+\Z|\$2[aby]?\$\d+\$\Z|"
    r"(?:digest|integrity|checksum|commit|revision|hash|fingerprint|icon|image|etag|(?:request|trace|span|build|session|user|object)[_.\-]?id|uuid|guid|public[_.\-]?key|host[_.\-]?key)[\"']?\s*(?:\"?\s+value)?\s*(?:=>|:=|=|:|>|,)\s*[\"'`]?\Z",
    re.I,
)
_NAMES = re.compile(
    r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_.\-]?key|apikey|signing|access|auth|credential|private|cookie|dsn|bearer|basic|\bkey|\bsid=|[?&]\w+=|://|hook|licen[cs]e|login", re.I
)
_COMMENT_CUES = re.compile(r"\b(?:key|token|secret|password|pass|pwd|login|use|remove|temporary|old|was|rotate|revoke|legacy)\b", re.I)
_ASSIGN = re.compile(r"[=:>(,?&\[]\s*[\"'`]?\s*(?:Bearer\s+|Basic\s+|-\s+)?[\"'`]?\Z|[\"'`/@]\Z", re.I)
_PASSWORD = re.compile(
    r"(?<![A-Za-z0-9])[\w.\-]*?(?:password|passwd|passphrase|pwd|(?<![a-z])pass|Pass|_pw|(?<![A-Za-z])pw|_PW)(?P<k>[\"'`]?\s*(?:=>|:=|=|:|>|\s+value=|,)\s*|\s+(?=[\"'`]))"
    r"(?:\"(?P<d>[^\"\n]+)\"|'(?P<s>[^'\n]+)'|`(?P<b>[^`\n]+)`|(?P<u>[^\s\"'`;,)}\]<>&]+))",
    re.I,
)
_USERINFO = re.compile(r"[A-Za-z][\w+.\-]*://[^\s:/@\"'`]*:(?P<v>[^\s/\"'`]+)@(?=[\w\[])")
_LOGIN_NOTE = re.compile(r"\blogin\s+\S+\s*/\s*(?P<v>\S+)", re.I)
_ARGUMENT = re.compile(r"(?:\blogin\s*\([^,)\n]*,|\bidentified\s+by|\bsshpass\s+-p|--?pass(?:word)?)\s*[\"'](?P<v>[^\"'\n]+)[\"']", re.I)
_SCHEME = re.compile(r"\b(?:Bearer|Basic)\s+(?P<v>[A-Za-z0-9+/_\-.=]{12,})")
_QUERY = re.compile(r"[?&](?:\w*(?:key|token|sig|signature|secret|password|auth|code))=(?P<v>[^&\s\"'`<>)]{8,})", re.I)
_CREDENTIAL = re.compile(
    r"(?:secret|token|api[_.\-]?key|(?:signing|access|private|encryption|licen[cs]e)[_.\-]?key|auth|credential)[\w.\-]*[\"'`]?\]?(?:\s*:\s*\w+)?\s*(?:=>|:=|=|:)\s*"
    r"(?:\"(?P<d>[^\"\n]{10,})\"|'(?P<s>[^'\n]{10,})'|`(?P<b>[^`\n]{10,})`)",
    re.I,
)
_JOINED = re.compile(r"(?P<q>[\"'`])(?P<a>[A-Za-z0-9+/_\-=]{4,})(?P=q)\s*(?:\+|\.|\\\n)?\s*(?P=q)(?P<b>[A-Za-z0-9+/_\-=]{4,})(?P=q)")
#: What names a credential right before its value, and not its hash or its id.
_NAMED_CREDENTIAL = re.compile(
    r"(?:api[_.\-]?key|apikey|secret(?:[_.\-]?key)?|(?:access|auth|refresh|bearer|api|deploy|session)[_.\-]?token|token|passw(?:or)?d|pwd|(?:signing|private|encryption|access|licen[cs]e|master)[_.\-]?key|credential)s?"
    r"[\"'`]?\]?\s*(?:=>|:=|=|:)\s*[\"'`]?\Z",
    re.I,
)
_SIGNS = re.compile(r"[^\w\s.\-/]")
#: Words of a sentence, not of a passphrase (fixed values).
_SENTENCE_WORDS = frozenset("and are but can enter for forgot have here into must not password please same than that the then this too use was with wrong you your".split())
_REFERENCE = re.compile(
    r"\$\{|\$\(|\$[A-Za-z_]|%\w+%|%\(|\{\{|\{|<|@|(?:os|process|System|var|env|local|data|config|settings|secrets?|module|self|this)[.\[(]|getenv|ENV\[|[a-z][a-z0-9+.\-]*://", re.I
)
#: What stands before the name of a variable or a tag.
_NAMING = re.compile(r"(?:\$[{(]?|\{\{\s*|%\(|</?)\Z")
_DUMMY = re.compile(
    r"(?:[x*.#\-_0]+|change[\-_ ]?me\w*|your[\-_ ].*|.*[\-_ ]here|example\w*|placeholder|todo|tbd|none|null|nil|true|false|redacted\w*|dummy|secret|password|\w+-credentials|<.*>|\d+)\Z", re.I
)


def count_words(files: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``n``: letter runs of all texts, camel case apart, counted per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(_WORDS.findall(t))
            folded: Counter[str] = Counter()
            for w, n in counts.items():
                folded[w.lower()] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(folded), pa.string()), pa.array(list(folded.values()), pa.int64())], names=["word", "n"])

    return files.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_prices(files: DataFrame, text: str = "text") -> dict[str, float]:
    """-log share of each word that is frequent enough to explain a literal.

    The least share bounds the size of what reaches the driver.
    """
    counts = count_words(files, text)
    shared = counts.where(F.col("n") >= LEAST_COUNT)
    shared = staged(shared, "words")
    total = shared.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {}
    rows = shared.where((F.col("n") >= F.lit(total * LEAST_SHARE)) & (-F.log(F.col("n") / F.lit(total)) < F.char_length("word") * F.lit(0.9 * UNKNOWN))).collect()
    return {r["word"]: -math.log(r["n"] / total) for r in rows}


class Segmenter:
    """Viterbi segmentation of literals into priced words."""

    def __init__(self, prices: dict[str, float]) -> None:
        self.prices = prices
        # lengths of the words that end in the same two letters
        ends: dict[str, set[int]] = {}
        for w in prices:
            ends.setdefault(w[-2:], set()).add(len(w))
        self.ends = {e: sorted(sizes) for e, sizes in ends.items()}
        self.memo: dict[str, tuple[int, int]] = {}

    def residual(self, literal: str) -> tuple[int, int]:
        """(characters no word explains, letters among them); signs and short numbers are explained."""
        known = self.memo.get(literal)
        if known is not None:
            return known
        s, n = literal.lower(), len(literal)
        best = [0.0] * (n + 1)
        step = [1] * (n + 1)
        prices, ends = self.prices, self.ends
        for i in range(1, n + 1):
            low, back = best[i - 1] + (UNKNOWN if s[i - 1].isalnum() else 1.0), 1
            for size in ends.get(s[i - 2 : i], ()) if i > 1 else ():
                if size > i:
                    break
                price = prices.get(s[i - size : i])
                if price is not None and best[i - size] + price < low:
                    low, back = best[i - size] + price, size
            best[i], step[i] = low, back
        i, left, letters = n, 0, 0
        while i:
            if step[i] == 1 and s[i - 1].isalnum():
                left += 1
                letters += s[i - 1].isalpha()
            i -= step[i]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[literal] = left, letters
        return left, letters


class Scanner:
    """Finds value spans of credentials in a text."""

    def __init__(self, prices: dict[str, float]) -> None:
        self.segment = Segmenter(prices).residual

    def harmless(self, value: str, before: str) -> bool:
        """Whether a value has a known format that is no credential; a name that says credential overrules digests and ids."""
        if value.startswith(("AAAA", "sha1-", "sha256-", "sha384-", "sha512-")):
            return True
        if _UUID.match(value) or _HEX.match(value) and len(value) in _DIGESTS:
            return not (len(value) >= 16 and _NAMED_CREDENTIAL.search(before))
        return bool(_BEFORE_HARMLESS.search(before))

    def password(self, value: str, quoted: bool = False) -> bool:
        """Whether a value in a context that names a password is one: what no word explains decides.

        Digits, and letters beside signs, are explained by no word; a plain word
        needs a longer residual. A quoted passphrase is four words or more that
        aren't a sentence.
        """
        if len(value) < 4 or _REFERENCE.match(value) or _DUMMY.match(value):
            return False
        if any(c in "([" for c in value) and value.rstrip(")];").endswith(("(", "[")):
            return False
        left, letters = self.segment(value)
        if " " in value:
            words = value.split()
            return quoted and len(words) >= 4 and all(w.isalpha() and w.islower() and len(w) > 2 for w in words) and not _SENTENCE_WORDS.intersection(words)
        if any(c.isalpha() for c in value) and (left > letters or (quoted and _SIGNS.search(value) and letters >= 2)):
            return len(value) >= 5 or bool(_SIGNS.search(value))
        return left >= 6

    def spans(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        closed: list[tuple[int, int]] = []
        if "-----BEGIN" in text:
            for m in _PEM.finditer(text):
                closed.append(m.span())
                if "PRIVATE" in m.group(1) and self.segment(_key_body(m.group()))[0] >= FREE:
                    found.append(m.span())

        def inside(at: int) -> bool:
            return any(a <= at < b for a, b in closed)

        low = text.lower()
        if "pass" in low or "pwd" in low or "pw" in low:
            for m in _PASSWORD.finditer(text):
                name = m.lastgroup if m.lastgroup != "k" else "u"
                value = m.group(name)
                start = m.start(name)
                if "," in m.group("k") and name == "u":
                    continue
                if name == "u":
                    value = value.rstrip(".:")
                elif _QUERY.search(value) or "://" in value:
                    continue
                if not inside(start) and self.password(value, name != "u"):
                    found.append((start, start + len(value)))
        if "://" in text:
            for m in _USERINFO.finditer(text):
                if self.password(m["v"]):
                    found.append(m.span("v"))
        if "?" in text or "&" in text:
            for m in _QUERY.finditer(text):
                if not _REFERENCE.match(m["v"]) and not _DUMMY.match(m["v"]) and self.segment(m["v"])[0] >= 6:
                    found.append(m.span("v"))
        if "login" in low:
            for m in _LOGIN_NOTE.finditer(text):
                if self.password(m["v"]):
                    found.append(m.span("v"))
        if "login" in low or "identified" in low or "-p" in low:
            for m in _ARGUMENT.finditer(text):
                if self.password(m["v"]):
                    found.append(m.span("v"))
        if "bearer" in low or "basic" in low:
            for m in _SCHEME.finditer(text):
                if self.scheme_value(m["v"]):
                    found.append(m.span("v"))
        if "secret" in low or "token" in low or "key" in low or "auth" in low or "credential" in low:
            for m in _CREDENTIAL.finditer(text):
                start, end = m.span(m.lastgroup)
                if not (closed and inside(start)) and self.quoted(text[start:end], text, start):
                    found.append((start, end))
        for m in _JOINED.finditer(text):
            both = m["a"] + m["b"]
            if not inside(m.start()) and self.secret(both, text, m.start("a")):
                found.append((m.start("a"), m.end("b")))
        for m in _LITERAL.finditer(text):
            start = m.start()
            if not (closed and inside(start)) and self.secret(m.group(), text, start):
                found.append(m.span())
        return _disjoint(found)

    def scheme_value(self, value: str) -> bool:
        """A Bearer or Basic value: a long residual, or base64 of user:password."""
        if _DUMMY.match(value):
            return False
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
            if b":" in plain and plain.isascii():
                return self.password(plain.split(b":", 1)[1].decode())
        except (binascii.Error, ValueError):
            pass
        return self.segment(value)[0] >= NAMED

    def quoted(self, value: str, text: str, start: int) -> bool:
        """Whether the whole value of an assignment that names a credential is one; signs may break it anywhere."""
        if _REFERENCE.match(value) or _DUMMY.match(value):
            return False
        left, letters = self.segment(value)
        if left < NAMED or letters < 3 or left * 2 < sum(map(str.isalnum, value)):
            return False
        return not self.harmless(value, text[max(text.rfind("\n", 0, start) + 1, start - 90) : start])

    def secret(self, value: str, text: str, start: int) -> bool:
        """Whether a literal's residual is long enough for the context before it."""
        left, letters = self.segment(value)
        if left < NAMED or letters < 3 or left * 2 < len(value):
            return False
        line = text.rfind("\n", 0, start) + 1
        before = text[max(line, start - 90) : start]
        if self.harmless(value, before) or (_NAMING.search(before) and value.replace("_", "").isalpha()):
            return False
        if _NAMES.search(before[-48:]) or _COMMENT_CUES.search(before):
            return left >= NAMED
        return left >= (ASSIGNED if _ASSIGN.search(before) else FREE)


def _key_body(block: str) -> str:
    """The characters between the first and the last line of a key, without white space and headers."""
    lines = [x.strip() for x in re.split(r"\\n|\n", block)[1:-1] or re.split(r"-----", block)[2:3]]
    return "".join(x for x in lines if ":" not in x)


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SCANNERS: dict[int, Scanner] = {}


def _scanner(prices) -> Scanner:
    """The worker's scanner for a broadcast dictionary."""
    if prices.id not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[prices.id] = Scanner(prices.value)
    return _SCANNERS[prices.id]


class _Shared:
    """A broadcast dictionary under a name that workers can remember it by."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else 0

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def _file_text() -> F.Column:
    return F.when(F.col("node_type") == "file", F.col("text"))


def find_credentials(nodes: DataFrame) -> DataFrame:
    """``node_id``, ``line_no`` of each line on which a credential's value begins.

    Every row is scanned where it lies; only line numbers are shuffled to find
    each node's counting row.
    """
    files = nodes.where("node_type = 'file' and text is not null")
    shared = _Shared(nodes.sparkSession.sparkContext.broadcast(word_prices(files)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                out.append(sorted({t.count("\n", 0, a) + 1 for a, _ in scanner.spans(t)}) if t else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["id", "ord", "lines"])

    scanned = nodes.select("id", "ord", _file_text().alias("text")).mapInArrow(run, "id string, ord bigint, lines array<int>")
    return latest_by(scanned, "id", "ord", "lines").select(F.col("id").alias("node_id"), F.explode("lines").alias("line_no"))


def redact_files(nodes: DataFrame) -> DataFrame:
    """``node_id``, ``text`` (values replaced) and ``redacted`` (how many) of every file."""
    files = nodes.where("node_type = 'file' and text is not null")
    shared = _Shared(nodes.sparkSession.sparkContext.broadcast(word_prices(files)))
    rows = latest_by(nodes.select("id", "ord", "node_type", _file_text().alias("text")), "id", "ord", "node_type", "text").where("node_type = 'file'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                spans = scanner.spans(t) if t else []
                for a, b in reversed(spans):
                    t = t[:a] + PLACEHOLDER + t[b:]
                texts.append(t)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["node_id", "text", "redacted"])

    return rows.select("id", "text").mapInArrow(run, "node_id string, text string, redacted int")
