"""Problem 10: the share of a text that repeats earlier parts of it.

A rule bitmask ledger: every rule is evaluated once per document, its
measurement and one failure bit are stored, and everything after that (which
documents a policy drops, what a rule adds to a policy) is integer arithmetic
on the bits, aggregated per distinct bitmask.

Defined results: null, empty and wordless texts measure 0 under every rule and
fail none. Whole texts are measured, whatever their length. Repeated rows are
measured each on its own.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule name, and the share from which it fails. The bit is the position.
RULES: tuple[tuple[str, float], ...] = (
    ("repeated_8_words", 0.30),
    ("repeated_lines", 0.30),
    ("repeated_paragraphs", 0.30),
    ("repeated_sentences", 0.30),
    ("top_2_words", 0.20),
    ("top_3_words", 0.18),
    ("top_4_words", 0.16),
)


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document that fails any is dropped."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r for r, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES: tuple[Policy, ...] = (
    Policy("found", 1, ("repeated_8_words",)),
    Policy("blocks", 1, ("repeated_lines", "repeated_paragraphs")),
    Policy("blocks", 2, ("repeated_lines", "repeated_paragraphs", "repeated_sentences")),
    Policy("strict", 1, tuple(name for name, _ in RULES)),
)


def _letters() -> str:
    """A class of the letters: word characters without digits, numerals, marks and the underscore."""
    others = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()]
    spans: list[list[int]] = []
    for c in others:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return r"[^\W\d_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]+"


class _Ids(dict):
    """Consecutive numbers for words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _windows(mixed: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n words in a row of one document, and where each begins."""
    if len(mixed) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(mixed) - n + 1
    h = mixed[:k].copy()
    for i in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += mixed[i : i + k]
    start = np.flatnonzero(doc[:k] == doc[n - 1 :])
    return h[start] ^ (doc[start].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), start


def repeated_words(ids: np.ndarray, mixed: np.ndarray, doc: np.ndarray, n: int = 8) -> np.ndarray:
    """Which words lie in n words in a row that began earlier in their document.

    Windows of equal hash are compared word by word with the first of them.
    """
    h, start = _windows(mixed, doc, n)
    marked = np.zeros(len(ids) + 1, np.int64)
    if len(h):
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        again, origin = start[order[~new]], start[order[first[~new]]]
        same = doc[again] == doc[origin]
        for i in range(n):
            same &= ids[again + i] == ids[origin + i]
        again = again[same]
        np.add.at(marked, again, 1)
        np.add.at(marked, again + n, -1)
    return np.cumsum(marked)[:-1] > 0


def top_share(mixed: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int, n: int) -> np.ndarray:
    """Characters in the most frequent n words in a row, if it recurs, by document."""
    h, start = _windows(mixed, doc, n)
    out = np.zeros(docs)
    if len(h):
        span = np.cumsum(np.r_[0, size])
        chars = span[start + n] - span[start]
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        count = np.diff(np.r_[edge, len(order)])
        held = np.where(count > 1, count * chars[order[edge]], 0)
        np.maximum.at(out, doc[start[order[edge]]], held)
    return out


def _again(parts: list[str]) -> tuple[int, int]:
    """Characters of parts that occurred before, and of all parts; blank parts don't count."""
    seen: set[str] = set()
    dup = total = 0
    for p in parts:
        p = p.strip()
        if p:
            total += len(p)
            if p in seen:
                dup += len(p)
            else:
                seen.add(p)
    return dup, total


class Measurer:
    """Measures a batch of texts under all rules."""

    def __init__(self) -> None:
        self.words = re.compile(_letters()).findall
        self.lines = re.compile(r"\r\n|\r|\n").split
        self.paragraphs = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)").split
        self.sentences = re.compile(r"(?<=[.!?])\s+|[\r\n]+").split

    def measure(self, texts: list[str | None]) -> np.ndarray:
        docs = len(texts)
        out = np.zeros((docs, len(RULES)))
        ids, counts, sizes = _Ids(), [], []
        flat: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                counts.append(0)
                continue
            found = self.words(text.lower())
            counts.append(len(found))
            flat.extend(map(ids.__getitem__, found))
            for rule, cut in ((1, self.lines), (2, self.paragraphs), (3, self.sentences)):
                parts = cut(text)
                if len(parts) > 1:
                    dup, total = _again(parts)
                    out[i, rule] = dup / total if total else 0
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        word = np.array(flat, np.int64)
        count = np.array(counts, np.int64)
        doc = np.repeat(np.arange(docs), count)
        if len(word):
            mixed = (word.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            size = sizes[word]
            chars = np.maximum(np.bincount(doc, weights=size, minlength=docs), 1)
            out[:, 0] = np.bincount(doc, weights=repeated_words(word, mixed, doc), minlength=docs) / np.maximum(count, 1)
            for rule, n in ((4, 2), (5, 3), (6, 4)):
                out[:, rule] = np.minimum(1, top_share(mixed, size, doc, docs, n) / chars)
        return out


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, one measurement per rule, ``n`` bits in ``failed``; map-only."""
    kind = dict(docs.select(key).dtypes)[key]
    names = [name for name, _ in RULES]
    limits = np.array([limit for _, limit in RULES])
    bits = 1 << np.arange(len(RULES), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                m = measurer.measure(part.column(1).to_pylist())
                failed = (m >= limits) @ bits
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(m[:, i]) for i in range(len(names))), pa.array(failed.astype(np.int64))], names=[key, *names, "failed"]
                )

    schema = ", ".join([f"`{key}` {kind}", *(f"{n} double" for n in names), "failed bigint"])
    return docs.select(key, text).mapInArrow(run, schema)


def dropped(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows of a ledger that fail any rule of a policy."""
    return rows.where(F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0)


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What each rule adds to each policy, from counts by distinct bitmask.

    Result: ``policy``, ``version``, ``rule``, ``fails`` (documents failing the
    rule), ``dropped`` (by the policy), ``only_here`` (that the policy would
    keep without the rule).
    """
    by_mask = rows.groupBy("failed").agg(F.count("*").alias("n"))
    names = [name for name, _ in RULES]
    entries = F.array(
        *(
            F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(p.mask).alias("mask"), F.lit(1 << names.index(r)).alias("bit"))
            for p in policies
            for r in p.rules
        )
    )
    hit = by_mask.select("failed", "n", F.explode(entries).alias("e")).select("failed", "n", "e.*")
    both = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return hit.groupBy("policy", "version", "rule").agg(
        n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("fails"), n(both != 0).alias("dropped"), n(both == F.col("bit")).alias("only_here")
    )
