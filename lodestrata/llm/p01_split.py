"""Problem 1: cut long texts into overlapping pieces at natural boundaries.

A text is parsed into a tree: sections that headings open, blocks (runs of lines
that aren't blank; a fenced code block is one, blank lines and all), in blocks
list items with what is indented below them, lines, sentences, words. Sibling
subtrees are merged from the bottom up: neighbours whose sum is least go first,
as long as the merged run fits; only a subtree that alone is too large is
descended into. What is left of each level goes up and is merged with its
neighbours there, so a cut lies at the highest level that is in reach. A word
longer than a piece is cut at the limit.

Sizes are code points of the text as it is. Each piece holds at most ``limit``
characters and starts ``overlap`` characters before the end of the one before.

Defined results: null text gives no piece, a text of at most ``limit``
characters one piece. A node that was written several times counts as its row
of the largest ``ord``. Spaces after the last boundary belong to the last piece.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.latest import latest_by

LIMIT, OVERLAP = 1800, 200

_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
_HEADING = re.compile(r"[ \t]*(#{1,6})[ \t]")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+\S")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)")
_WORD = re.compile(r"\S+")


class Block:
    """An unbroken run of lines that aren't blank."""

    __slots__ = ("start", "end", "size", "level", "fences", "lines")

    def __init__(self) -> None:
        self.start = self.end = self.size = self.level = self.fences = 0
        self.lines: list[tuple[int, int]] = []


def parse_blocks(text: str) -> list[Block]:
    """Blocks in order; ``size`` counts a line end as one character and no outer spaces."""
    blocks: list[Block] = []
    current: Block | None = None
    at, n = 0, len(text)
    while at < n:
        m = _LINE.match(text, at)
        line = m.group(1)
        bare = line.strip(" \t")
        if bare:
            if current is None:
                current = Block()
                current.start = at
                blocks.append(current)
                head = _HEADING.match(line)
                current.level = len(head.group(1)) if head else 0
            current.fences += bare.startswith(("```", "~~~"))
            current.lines.append((at, at + len(line)))
            current.end = at + len(line)
        else:
            current = None
        at = m.end()
    for b in blocks:
        (first, first_end), (last_start, last_end) = b.lines[0], b.lines[-1]
        b.start = first_end - len(text[first:first_end].lstrip(" \t"))
        b.end = last_start + len(text[last_start:last_end].rstrip(" \t"))
        inner = sum(e - s for s, e in b.lines) + len(b.lines) - 1
        b.size = inner - (b.start - first) - (last_end - b.end)
    return blocks


class Tree:
    """A subtree: where it ends, at what kind of boundary, and how to get its parts."""

    __slots__ = ("start", "end", "level", "parts", "block")

    def __init__(self, start: int, end: int, level: str, parts: Callable[[], list[Tree]] | None = None, block: Block | None = None) -> None:
        self.start, self.end, self.level, self.parts, self.block = start, end, level, parts, block


class Parser:
    """Builds the tree of one text; parts are only made of what is descended into."""

    def __init__(self, text: str) -> None:
        self.text = text

    def words(self, start: int, end: int) -> list[Tree]:
        return [Tree(m.start(), m.end(), "word") for m in _WORD.finditer(self.text, start, end)]

    def sentences(self, start: int, end: int) -> list[Tree]:
        stops = [m.end() for m in _SENTENCE.finditer(self.text, start, end)]
        if not stops or stops[-1] < end:
            stops.append(end)
        if len(stops) == 1:
            return self.words(start, end)
        starts = [start, *stops[:-1]]
        return [Tree(a, b, "sentence", lambda a=a, b=b: self.words(a, b)) for a, b in zip(starts, stops)]

    def lines(self, lines: list[tuple[int, int]]) -> list[Tree]:
        if len(lines) == 1:
            return self.sentences(*lines[0])
        return [Tree(s, e, "line", lambda s=s, e=e: self.sentences(s, e)) for s, e in lines]

    def items(self, lines: list[tuple[int, int]]) -> list[Tree]:
        """List items of the least indentation, each with the lines below it; without any, the lines."""
        marks = [(i, len(m.group(1).expandtabs(4))) for i, (s, e) in enumerate(lines) if (m := _ITEM.match(self.text, s, e))]
        if not marks:
            return self.lines(lines)
        least = min(depth for _, depth in marks)
        opens = [i for i, depth in marks if depth == least]
        if opens[0]:
            opens.insert(0, 0)
        if len(opens) == 1:
            return self.lines(lines) if len(marks) == 1 else [*self.lines(lines[:1]), *self.items(lines[1:])]
        groups = [lines[i:j] for i, j in zip(opens, [*opens[1:], len(lines)])]
        return [Tree(g[0][0], g[-1][1], "item", lambda g=g: self.items(g) if len(g) > 1 else self.sentences(*g[0])) for g in groups]

    def block(self, b: Block) -> Tree:
        return Tree(b.start, b.end, "block", lambda: self.items(b.lines), b)

    def sections(self, blocks: list[Block]) -> list[Tree]:
        """A heading holds what follows up to a heading of its level; blocks of one fence are a subtree."""
        root: list = []
        open_: list[tuple[int, list]] = [(0, root)]
        fence: list | None = None
        for b in blocks:
            if fence is not None:
                fence.append(b)
            elif b.level:
                while len(open_) > 1 and open_[-1][0] >= b.level:
                    open_.pop()
                section: list = [b]
                open_[-1][1].append(section)
                open_.append((b.level, section))
            elif b.fences % 2:
                fence = [b]
                open_[-1][1].append(fence)
                continue
            else:
                open_[-1][1].append(b)
            if fence is not None and b.fences % 2:
                fence = None

        def tree(item) -> Tree:
            if isinstance(item, Block):
                return self.block(item)
            parts = [tree(x) for x in item]
            return Tree(parts[0].start, parts[-1].end, "section" if isinstance(item[0], Block) and item[0].level else "block", lambda: parts)

        return [tree(x) for x in root]


class Run:
    """A stretch of the text that may become a piece's own part."""

    __slots__ = ("start", "end", "level")

    def __init__(self, start: int, end: int, level: str) -> None:
        self.start, self.end, self.level = start, end, level


def merged(runs: list[Run], room: int) -> list[Run]:
    """Neighbours joined, the least sum first and of equals the first, while they fit into ``room``."""
    n = len(runs)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(runs[i + 1].end - runs[i].start, i, runs[i + 1].end) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        size, i, end = heapq.heappop(heap)
        if size > room:
            break
        j = after[i] if not gone[i] else n
        if j >= n or gone[i] or runs[j].end != end or runs[j].end - runs[i].start != size:
            continue
        runs[i] = Run(runs[i].start, runs[j].end, runs[j].level)
        gone[j] = True
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (runs[after[i]].end - runs[i].start, i, runs[after[i]].end))
        if before[i] >= 0:
            heapq.heappush(heap, (runs[i].end - runs[before[i]].start, before[i], runs[i].end))
    return [r for r, dead in zip(runs, gone) if not dead]


def packed(trees: list[Tree], room: int, opened: list[Block]) -> list[Run]:
    """Runs of at most ``room`` characters that cover sibling subtrees, merged from the bottom up."""
    runs: list[Run] = []
    for t in trees:
        # what lies between subtrees (blank lines, spaces) goes with the one that follows
        start = runs[-1].end if runs else t.start
        if t.end - start <= room:
            runs.append(Run(start, t.end, t.level))
            continue
        if t.block is not None:
            opened.append(t.block)
        parts = t.parts() if t.parts else []
        if len(parts) == 1 and parts[0].end == t.end and parts[0].parts is None or not parts:
            # a word, or white space, longer than a piece
            at = start
            while t.end - at > room:
                runs.append(Run(at, at + room, "hard"))
                at += room
            runs.append(Run(at, t.end, t.level))
            continue
        inner = packed([Tree(start, p.end, p.level, p.parts, p.block) if i == 0 else p for i, p in enumerate(parts)], room, opened)
        if inner and inner[-1].end == t.end:
            inner[-1].level = t.level
        runs += inner
    return merged(runs, room)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, blocks: list[Block] | None = None, opened: list[Block] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece; ``opened`` takes the blocks that were descended into."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    trees = Parser(text).sections(parse_blocks(text) if blocks is None else blocks)
    if trees:
        trees[0] = Tree(0, trees[0].end, trees[0].level, trees[0].parts, trees[0].block)
    runs = packed(trees, limit - overlap, [] if opened is None else opened)
    cuts: list[tuple[int, int, str]] = []
    start = 0
    for r in runs:
        # a piece has its run's text, and the overlap before it
        cuts.append((start, r.end, r.level))
        start = r.end - overlap
    while cuts and n - cuts[-1][0] > limit or not cuts and n - start > limit:
        # white space after the last run
        end = min(n, (cuts[-1][1] if cuts else 0) + limit - overlap)
        cuts.append((max(0, cuts[-1][1] - overlap) if cuts else 0, end, "hard"))
        if end == n:
            break
    last = cuts.pop() if cuts else (0, n, "end")
    return [*cuts, (last[0], n, "end")]


def forced_blocks(blocks: list[Block], cuts: list[tuple[int, int, str]], opened: list[Block], limit: int) -> list[int]:
    """Numbers of blocks that were descended into and cut inside, and that no piece could hold whole."""
    ends = [e for _, e, _ in cuts]
    inside = {id(b) for b in opened if b.size > limit and bisect_right(ends, b.start) < bisect_left(ends, b.end)}
    return [i for i, b in enumerate(blocks) if id(b) in inside]


def split_nodes(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the counting rows whose text is longer than ``limit``.

    Result: ``node_id``, ``chunk_index`` (from 0), ``start``, ``boundary``,
    ``text``. Texts are read once, and only long ones are shuffled to find each
    node's counting row; their pieces are then cut where they lie.
    """
    keep = F.when(F.char_length("text") > limit, F.col("text"))
    rows = latest_by(nodes.select("id", "ord", keep.alias("text")), "id", "ord", "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cuts = split_text(t, limit, overlap)
                columns = ([name] * len(cuts), list(range(len(cuts))), [s for s, _, _ in cuts], [k for _, _, k in cuts], [t[s:e] for s, e, _ in cuts])
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["node_id", "chunk_index", "start", "boundary", "text"])

    return rows.select("id", "text").mapInArrow(run, "node_id string, chunk_index int, start int, boundary string, text string")


def oversized_blocks(nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``node_id``, ``block_no`` of each block that the operator has to cut inside.

    Every row is parsed and packed where it lies; only the numbers of blocks that
    were descended into are shuffled to find each node's counting row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forced: list[list[int]] = []
            for t in batch.column(2).to_pylist():
                if not t:
                    forced.append([])
                    continue
                blocks = parse_blocks(t)
                opened: list[Block] = []
                cuts = split_text(t, limit, overlap, blocks, opened)
                forced.append(forced_blocks(blocks, cuts, opened, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forced, pa.list_(pa.int32()))], names=["id", "ord", "forced"])

    long = F.when(F.char_length("text") > limit, F.col("text"))
    found = nodes.select("id", "ord", long.alias("text")).mapInArrow(run, "id string, ord bigint, forced array<int>")
    return latest_by(found, "id", "ord", "forced").select(F.col("id").alias("node_id"), F.explode("forced").alias("block_no"))
