"""Splitting oversized items at natural boundaries (problem 4): structure-tree packing.

A text is read into a tree: headings by their levels (marked with #, numbered, in capitals, or a title and a colon), blocks
between blank lines, list entries by their indents, lines, sentences, words, and closing marks inside words. A heading is
tied to what comes first under it. A node is a span between two boundaries of its rank, so the tree is kept as ranked
boundaries; the finer ones are only sought inside nodes that are too large.

Packing goes through the tree in order: a node that fits into the piece at hand is taken whole, so siblings merge up to
the limit; one that would fit a piece of its own begins one; only a node too large for any piece is opened. A part that
no boundary opens is cut between characters. Each piece but the first starts with about ``overlap`` characters of the
piece before, from a word's beginning; the overlap is cut to three quarters where that keeps a node whole, and further
where a word would not fit otherwise.

Defined results: texts up to the limit, null and empty texts give one piece or none and no overlap; spans are 0-based
code points; without their overlaps the pieces are the text, white space included; no piece lies inside another;
piece_cut is how a piece ends (end, heading, block, item, line, sentence, space, mark, forced); a text is ``forced`` if
the packer had to cut between characters that are neither white space nor closing marks, which is so if it has a run of
more than ``limit`` of them, else ``natural``; repeated rows come out each; extra columns are ignored.

Scale: only texts above the limit leave the JVM; one narrow pass, no shuffle, linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentences import sentences

LIMIT, OVERLAP = 4000, 200
MARKS = ".!?。！？।؟"
_LIST = re.compile(r"[ \t\xa0]*(?:[-*•‣◦]|\d{1,3}[.)]|\[[ +xX-]\])[ \t\xa0]+\S")
_SHARP = re.compile(r"(#{1,6})[ \t]+\S")
_NUMBERED = re.compile(r"\d{1,2}((?:\.\d{1,2}){1,5})\.?[ \t]+[^\W\d_][^.!?]{0,80}$")
_CAPITALS = re.compile(r"[A-Z][A-Z0-9 /&,'()-]{2,58}:?$")
_TITLE = re.compile(r"[^\W\d_][^\n:.!?]{1,47}[:：]$")
_MARK = re.compile(f"[{MARKS}]+")
_SPACE = re.compile(r"\s+")
_LINE = re.compile(r"[^\n]*\n|[^\n]+$")

#: Ranks of boundaries: headings 1 to 7 by level, then blocks, list entries by depth, lines.
BLOCK, ITEM, LINE = 8, 9, 40


def heading_level(line: str) -> int:
    """The level of a heading line, 0 for any other."""
    if m := _SHARP.match(line):
        return len(m[1])
    if m := _NUMBERED.match(line):
        return 1 + m[1].count(".")
    if _CAPITALS.match(line) and any(c.isalpha() for c in line):
        return 1
    return 2 if _TITLE.match(line) else 0


def boundaries(t: str) -> list[tuple[int, int]]:
    """(place, rank) of the boundaries of a text down to lines, in order; the lower rank parts more."""
    out: list[tuple[int, int]] = []
    levels: list[int] = []  # indents of the open list entries
    blank = tied = False
    for m in _LINE.finditer(t):
        a = m.start()
        line = m.group()
        said = line.strip()
        if not said:
            blank = True  # white lines go with what stands before them
            continue
        level = heading_level(said)
        entry = None if level else _LIST.match(line)
        if entry:
            indent = len(line) - len(line.lstrip())
            while levels and indent < levels[-1]:
                levels.pop()
            if not levels or indent > levels[-1]:
                levels.append(indent)
        elif blank or level or levels and len(line) - len(line.lstrip()) <= levels[0]:
            ended = bool(levels)
            levels.clear()
            blank = blank or ended  # a list that ends is a block that ends
        rank = level or (BLOCK if blank and not (entry and len(levels) > 1) else min(ITEM + len(levels), LINE - 1) if entry else LINE)
        if a and (level or not tied):
            out.append((a, rank))
        tied, blank = bool(level), False
    return out


def _finer(t: str, a: int, z: int, step: int) -> list[int]:
    """Boundaries inside a node without lines: of sentences, words, marks."""
    if step == 0:
        return [a + s for s, _ in sentences(t[a:z])[1:] if s > 0]
    ends = sorted({e for m in (_SPACE if step == 1 else _MARK).finditer(t, a, z) for e in m.span()})
    return [e for e in ends if a < e < z]


_STEPS = ("sentence", "space", "mark")


def _name(rank: int) -> str:
    return "heading" if rank < BLOCK else "block" if rank == BLOCK else "item" if rank < LINE else "line"


class _Packer:
    """The pieces of one text, without their overlaps: (start, end, how it ends)."""

    def __init__(self, t: str, limit: int, overlap: int) -> None:
        self.t, self.limit, self.soft = t, limit, limit - overlap * 3 // 4
        self.room = limit - overlap
        self.done: list[tuple[int, int, str]] = []
        self.start = self.end = 0
        self.forced = False

    def fits(self, z: int, most: int | None = None) -> bool:
        return z - self.start <= (most or (self.soft if self.done else self.limit))

    def close(self, kind: str) -> None:
        if self.end > self.start:
            self.done.append((self.start, self.end, kind))
            self.start = self.end

    def tree(self, a: int, z: int, bounds: list[tuple[int, int]], kind: str) -> None:
        """A node down to lines; kind is the boundary before it."""
        if self.fits(z):
            self.end = z
        elif z - a <= self.room:
            self.close(kind)
            self.end = z
        elif bounds:
            rank = min(r for _, r in bounds)
            at, inner, before = a, [], kind
            for place, r in [*bounds, (z, rank)]:
                if r == rank:
                    self.tree(at, place, inner, before)
                    at, inner, before = place, [], _name(rank)
                else:
                    inner.append((place, r))
        else:
            self.leaf(a, z, 0, kind)

    def leaf(self, a: int, z: int, step: int, kind: str) -> None:
        """A node without lines."""
        if self.fits(z):
            self.end = z
        elif z - a <= self.room or step == len(_STEPS) and z - a <= self.limit:
            self.close(kind)
            self.end = z
        elif step < len(_STEPS):
            at, before = a, kind
            for place in [*_finer(self.t, a, z, step), z]:
                self.leaf(at, place, step + 1, before)
                at, before = place, _STEPS[step]
        else:
            soft = self.t[a].isspace() or self.t[a] in MARKS
            self.forced |= not soft
            while a < z:
                self.close(kind)
                kind = "space" if soft else "forced"
                self.end = a = min(z, a + (self.room if self.done else self.limit))


def packed(t: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], bool]:
    """The parts of a text above the limit, one after another, and whether one had to be cut between characters."""
    packer = _Packer(t, limit, overlap)
    packer.tree(0, len(t), boundaries(t), "end")
    packer.close("end")
    return packer.done, packer.forced


def pieces(t: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, piece_cut) of each piece; a piece is t[start:end]."""
    if not t:
        return []
    if len(t) <= limit:
        return [(0, len(t), "end")]
    return _overlapped(t, packed(t, limit, overlap)[0], limit, overlap)


def _overlapped(t: str, parts: list[tuple[int, int, str]], limit: int, overlap: int) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for i, (a, z, kind) in enumerate(parts):
        start = a
        if i:
            low = max(a - overlap, z - limit, parts[i - 1][0] + 1)
            if low < a:
                m = _SPACE.search(t, low, a)
                start = low if t[low - 1].isspace() else (m.end() if m and m.end() < a else low)
        out.append((start, z, kind))
    return out


def cut_kind(t: str, limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """How the packer had to cut a text above the limit."""
    return "forced" if packed(t, limit, overlap)[1] else "natural"


def _pieces_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ns, starts, ends, kinds, texts, whole = [], [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                parts, forced = packed(t, limit, overlap)
                found = _overlapped(t, parts, limit, overlap)
                name = "forced" if forced else "natural"
                for n, (a, z, kind) in enumerate(found):
                    at.append(i)
                    ns.append(n)
                    starts.append(a)
                    ends.append(z)
                    kinds.append(kind)
                    texts.append(t[a:z])
                    whole.append(name)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(ns, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds), pa.array(texts), pa.array(whole, pa.string())],
                    names=["id", "piece_no", "start_pos", "end_pos", "piece_cut", "piece", "cut_kind"],
                )

    return run


def split_pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, piece_cut, piece, cut_kind) of the texts above the limit."""
    kind = df.schema[key].dataType.simpleString()
    large = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    out = large.mapInArrow(_pieces_batches(limit, overlap), f"id {kind}, piece_no int, start_pos int, end_pos int, piece_cut string, piece string, cut_kind string")
    return out.withColumnRenamed("id", key)


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, cut_kind) of the texts above the limit, whatever number of pieces they give."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array([cut_kind(t, limit, overlap) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds], names=["id", "cut_kind"])

    large = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    return large.mapInArrow(run, f"id {kind}, cut_kind string").withColumnRenamed("id", key)
