"""Keyword-stuffed and link-list pages (problem 9): recurrence gaps and positional autocorrelation in lag windows.

A text is a series of terms: words (digits at their ends cut off), links by the last part of their path (with the markup
and the text they stand in), hashtags.
Equal terms at a lag of 1 to LAGS are the autocorrelation of the series; summed over the lags it counts, for each place,
how often its term recurs nearby. Keywords recur unnaturally often and at regular gaps; the words of prose, of lists
that inform (references, medications, results) and of glossaries do not, as most of their characters are in terms that
vary. Gaps of any length count where they are regular: CYCLE terms in a row that all come again after the same gap, in a
stretch without function words and numbers, are a cycle of keywords. Hashtags and links count by their kind as well: a
run of them is a list whose items need not repeat. Lists of distinct words are told by what they lack: ITEMS items of few
words parted by list marks in one line, or WORDS words parted by spaces, without a function word, number, label or
sentence mark among them. These two rules need words of Latin script, of which BINDING knows the function words; a list
of one item a line is not told by what it lacks, as that is the form of lists that inform. A window of terms is stuffed if the terms that
recur hold most of its characters; a page is a case if its stuffed stretches hold more than half of its characters.

Defined results: null, empty and blank texts and texts without a term are no cases, and a lone link or hashtag repeats
nothing; no other length is asked for: the share is over the whole text, however short or long; repeated rows come out
each; extra columns are ignored.

Scale: one narrow pass; a batch is one array of terms, so the lags are vector operations.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAGS = 30
OTHERS = 2
RUN = 3
ITEMS = 8
WORDS = 24
CYCLE = 5
FEW = 0.1
HALF = 12
DENSE = 0.45
SHARE = 0.5

CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
TERM = re.compile(rf"(?<!\w)\w(?:[. ]\w){{4,}}(?!\w)|[{CJK}][{CJK}0-9]*|(?:https?://|www\.)[^\s|,;()<>\[\]]+|[\w-]+(?:\.[\w-]+)+/[^\s|,;()<>\[\]]*|#\w[\w-]*|\$?[^\W{CJK}]+|<a\s[^<>]*>[^<>]*</a>|\[[^\[\]\n]*\]\((?:https?://|www\.)[^\s()]+\)")
# Words that bind sentences.
BINDING = frozenset(
    "a an the of to in on at by for from with without and or but nor as than then that this these those is are was were be been has have had do does did will would can could may might "
    "not no if when while because since after before over under into per he she it they we you i his her its their our your who which there here all any some more most "
    "el la los las un una de del al y o en con sin por para que se su es fue no le les des du et ou à au aux dans sur pour par avec sans est une un depuis der die das den dem des ein eine "
    "und oder mit von vom zu zum zur bei nach seit unter für im am auf aus ist war hat hatte wurde kein keine nicht".split()
)
_HREF = re.compile(r"href=[\"']?([^\"'\s>]+)|\]\(([^\s()]+)")


def _term(t: str) -> str:
    """What a term is compared by."""
    if t[0] in "<[":  # an anchor is compared by where it leads
        m = _HREF.search(t)
        t = (m[1] or m[2]) if m else t
    if "/" in t:
        path = t.split("?")[0].rstrip("/").split("/")
        return re.sub(r"html?$|[\W_\d]", "", path[-1].lower())
    if t[0] == "#":
        return t.lower()
    cut = t.rstrip("0123456789")
    return (cut or t).lower() if not t.isdigit() else t


_ANSWER = re.compile(r"(?m)^[^\n:/#]{2,48}:[ \t]*[^\s/:#]{1,14}[ \t\r]*$")


def _looped(t: str) -> bool:
    """Whether a long run of a script without spaces goes over the same few strings of three characters."""
    if not t[0] > "\u3000":
        return False
    u = _DIGITS.sub("", t)
    n = len(u) - 2
    return n > 8 and len({u[i : i + 3] for i in range(n)}) < 0.55 * n


def _spelled(t: str) -> bool:
    """Whether a term is written letter by letter, to be read by people only."""
    return len(t) > 8 and t[1] in ". " and t[3] in ". "


_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Za-z\u00c0-\u024f]+")
_BETWEEN = re.compile(r"[ \t\xa0]*([,;|/·•★*~+&–—-]?)[ \t\xa0]*")


def _link(between: str) -> int:
    """What parts two terms: 1 spaces, 2 a list mark, 0 anything else."""
    m = _BETWEEN.fullmatch(between)
    return 0 if not m else 2 if m[1] else 1


def _series(texts: list[str | None]):
    at, starts, keys, begin, end, kinds, sizes, words, links = [], [], [], [], [], [], [], [], []
    ids: dict[str, int] = {}
    parted: dict[str, int] = {}
    plain: dict[str, bool] = {}
    n = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        found = list(TERM.finditer(text))
        if not found:
            continue
        at.append(i)
        starts.append(n)
        sizes.append(len(text.strip()))
        z = 0
        for m in found:
            t = m.group()
            b = text[z : m.start()] if m.start() - z < 8 else "\n"
            if b not in parted:
                parted[b] = _link(b)
            links.append(parted[b])
            if t not in plain:
                plain[t] = _WORD.fullmatch(t) is not None
            words.append(plain[t])
            z = m.end()
            keys.append(ids.setdefault(_term(t), len(ids)))
            begin.append(m.start())
            end.append(m.end())
            kinds.append(1 if t[0] == "#" else 2 if "/" in t else 3 if t.isdigit() or t.lower() in BINDING else 4 if _spelled(t) or len(t) > 12 and _looped(t) else 0)
        for m in _ANSWER.finditer(text):  # "label: value" lines inform
            k = bisect_left(begin, m.start(), n)
            while k < len(begin) and begin[k] < m.end():
                kinds[k] = 3
                k += 1
        n = len(keys)
    return at, starts, keys, begin, end, kinds, sizes, words, links


def _listed(word: np.ndarray, links: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each term is of a list without function words: runs of words with nothing but spaces and list marks between."""
    on = word & (links > 0)
    on[1:] &= word[:-1]
    on[first] = False
    run = np.cumsum(~on) - 1
    size = np.bincount(run)
    items = 1 + np.bincount(run, weights=on & (links == 2))
    return word & ((size >= WORDS) | ((items >= ITEMS) & (size <= 4 * items)))[run]


def _cyclic(key: np.ndarray) -> np.ndarray:
    """Whether each term comes three times or more and stands in a row of CYCLE terms that all come again after one gap."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = np.zeros(n, np.int64)
    gap[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    often = (times >= OTHERS + 1)[place]
    run = np.cumsum(np.r_[True, (gap[1:] != gap[:-1]) | (gap[1:] == 0)]) - 1
    long = (gap > 0) & (np.bincount(run) >= CYCLE)[run]
    back = np.flatnonzero(long)
    out = long.copy()
    out[back - gap[back]] = True  # the first round as well
    return out & often


def stuffed_shares(texts: list[str | None]) -> tuple[list[int], np.ndarray]:
    """Places of the texts with terms, and the share of each one's characters in stuffed stretches."""
    at, starts, keys, begin, end, kinds, sizes, words, links = _series(texts)
    if not at:
        return at, np.zeros(0)
    n = len(keys)
    first = np.asarray(starts)
    doc = np.repeat(np.arange(len(at)), np.diff(np.r_[first, n]))
    key = np.asarray(keys, np.int64) * len(at) + doc  # terms of other texts never agree
    a, z, kind = np.asarray(begin), np.asarray(end), np.asarray(kinds, np.int8)
    near, runs = np.zeros(n, np.int16), np.zeros(n, np.int16)
    marked = (kind == 1) | (kind == 2)
    for lag in range(1, min(LAGS, n - 1) + 1):
        same = key[lag:] == key[:-lag]
        near[lag:] += same
        near[:-lag] += same
        if lag <= 10:
            both = marked[lag:] & marked[:-lag] & (doc[lag:] == doc[:-lag])
            runs[lag:] += both
            runs[:-lag] += both
    others = np.clip(np.bincount(doc, weights=marked, minlength=len(at)) - 1, 1, RUN)[doc]  # a text of few links has no more beside each
    last = np.r_[first[1:], n] - 1
    low = np.maximum(np.arange(n) - HALF, first[doc])
    high = np.minimum(np.arange(n) + HALF + 1, last[doc] + 1)
    word = np.asarray(words) & (kind == 0)
    other = np.r_[0, np.cumsum(~word)]
    bare = (other[high] - other[low]) <= FEW * (high - low)
    listed = _listed(word, np.asarray(links, np.int8), first) | (_cyclic(key) & word & bare)
    recurs = ((near >= OTHERS) & (kind != 3)) | (marked & (runs >= others)) | (kind == 4) | listed
    # what a term holds: its characters and what parts it from the next term
    width = np.r_[a[1:], 0] - a
    width[last] = (z - a)[last]
    total = np.r_[0, np.cumsum(width)]
    good = np.r_[0, np.cumsum(width * recurs)]
    dense = (good[high] - good[low]) >= DENSE * (total[high] - total[low])
    chars = np.bincount(doc, weights=width * dense, minlength=len(at))
    return at, chars / np.maximum(1, np.asarray(sizes))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, share = stuffed_shares(batch.column(1).to_pylist())
        if at:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(share)], names=["id", "share"])


def stuffing(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, share): the share of a text's characters in stuffed stretches."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    return narrow.mapInArrow(_batches, f"id {kind}, share double").withColumnRenamed("id", key)


def stuffed(df: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """(key) of the cases."""
    return stuffing(df, key, text).where(F.col("share") > share).select(key)
