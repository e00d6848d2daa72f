"""Sentence boundaries across languages and scripts (problem 5): a pushdown automaton over marks, quotes and lines.

Lines are read first: blank lines part, a heading on its own line, a list entry and a line of machine output are units
of their own, and the lines between them form blocks of running text. List entries are kept on a stack of their indents;
a line further in than the mark of the entry above it goes on with that entry. In a block the automaton visits only its
events (marks, line ends, quotes and brackets; in Thai also spaces). Quotes and brackets are matched on a stack
beforehand, whatever its depth, so that one left open hides nothing; while the stack is not empty no sentence ends, so a
quotation stays with the sentence around it. A full stop is held against a trie of abbreviations read backwards from it
(never final; final only before a beginning; months), initials, decimals, ordinals and addresses; the marks of Chinese, Japanese, Hindi and Arabic end a sentence without looking on.
A line end without a mark ends a sentence if what follows looks like a beginning and what stands before is not left
hanging. Thai sentences end at spaces, but not between the digit groups of a number.

Defined results: null, empty and blank texts have no units; very long texts are scanned once, in time linear in their
length; a text that is one sentence gives one span; repeated rows come out each with their spans; spans are 0-based
code points without outer white space; extra columns are ignored.

Scale: one narrow pass over Arrow batches, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, and those that do only before a capital.
NEVER = frozenset(
    "dr dres dra drs attn mr mrs ms mx prof st ste sr sra srta mme mlle hr hrn fr med gen col sgt rev hon pt pts pat vs approx esp cf ref réf ca bzw "
    "inkl fig figs tab vol vers nr nos tel tél i.e e.g z.b d.h u.a p.ej c.f viz al resp incl ggf vgl abs art str avda no.s डॉ श्री मि.ग्रा मि.ली कि.ग्रा د".split()
)
FINAL = frozenset(
    "b.i.d t.i.d q.i.d q.d q.h.s p.r.n q.o.d p.o a.m p.m o.d i.v lb lbs oz wk wks hr hrs yr yrs mo mos env assoc inc ltd co corp dept univ "
    "etc usw tgl tägl ext apt ave rd blvd jr ph.d m.d r.n u.s n.b no".split()
)
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec".split())
UNITS = frozenset("h g l m C F s".split())
ORDINAL = frozenset("dem den der des am vom zum bis ab im".split())
HANGING = frozenset(
    "a an the of to in on at by for with from and or but nor as per than then into onto over under after before since until while because due via about re "
    "no not is was were are be been has have had will would can could should may might do does did it its his her their my our your this that these those "
    "which who whom whose when where if so pt dr mr mrs ms miss prof fig cf vs approx and/or "
    "der die das den dem des ein eine einen einem einer und oder mit von vom zu zum zur bei nach seit unter für in im an am auf aus hatte wurde frau herr pat "
    "el la los las un una unos unas y o e de del al con sin por para en desde hasta que se su sra sr dra le les l' et ou du des au aux à par pour sur sous dans "
    "avec sans depuis un une d' @ > < = + / & - – re: cc".split()
)
OPENERS = frozenset(
    "The A An He She It They We I You This That These Those There Here Was Were Is Are Am Did Does Do Has Had Have Will Would Can Could Should May No Not Since Per After Before When While If "
    "As At In On For From With Without His Her Its Their Our My Your One Two Three Some Any All Each Both Who What Why How Which Please See Patient Pt. Dr. Mr. Ms. Mrs. "
    "Die Das Der Ein Eine Keine Kein Es Er Sie Wir Ich Ist Hat War Wird Wurde Seit Im Am Bei Nach Vor Mit Frau Herr Pat. "
    "El La Los Las Un Una Se No Es Fue Ha Su Sus Con Sin Por Para En Al Del Desde Hasta Niega Tiene "
    "Le Les La Il Elle Ils Elles On Une Un Pas Est A Sans Avec Depuis Pour Par Dans Faut-il M. Mme "
    "डॉ. क्या यह वह वे हम मैं आप उस इस لا هل هو هي لم لن ما قد إن كان كانت هذا هذه في من على د.".split()
)
#: Finite verbs and auxiliaries with which a Hindi sentence ends.
HINDI_END = frozenset("है हैं हूँ हो हुआ हुई हुए था थी थे की किया करें लें दें बुलाएँ गया गई गए रहा रही रहे चाहिए होगा होगी दिया लिया".split())
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
THAI = re.compile("[฀-๿]")
_CJK = re.compile(f"[{CJK}]")
_UNCASED = re.compile(f"[{CJK}\u0e00-\u0e7f\u0600-\u06ff]")
_LIST = re.compile(r"[ \t\xa0]*(?:[-*•‣◦–]|\d{1,3}[.)]|\[[ +xX-]\])[ \t\xa0]+\S")
_HEAD = re.compile(r"[^\W\d_][\w/&,'’()-]*(?: [\w/&,'’()-]+){0,4} ?[:：]$")
_CAPS = re.compile(r"[A-Z][A-Z/&-]{2,}(?: [A-Z/&-]+){0,3}$")
_MACHINE = re.compile(r"[!-~]{40,}$")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_PAIR = re.compile("[\"“”„‟«»‹›「」『』()（）\\[\\]]")
_EVENT = re.compile("[.。！？।؟!?…]+|[\n\r\x0b\x0c\x85  ]+")
_THAI_EVENT = re.compile("[.。！？।؟!?…]+|\\s+")
_TOKEN = re.compile(r"[^\s(«„“\"「\[]+$")
_BREAK = re.compile(r"[\s(«„“\"「\[]+")
_WORD = re.compile(r"\S+")
_LABEL = re.compile(r"[^\W\d_]+(?:\s[^\W\d_]+){0,4}:(?=\s)")
_CODE = re.compile(r"[A-Z]{0,3}-?\d|\d")
_NAME_GAP = re.compile("(?:担当は|家族の|患者は?)[一-鿿々]{1,3}$")
class Trie:
    """Abbreviations read backwards from their full stop; a node's class stands under the empty text."""

    def __init__(self, classes: dict[str, frozenset[str]]) -> None:
        self.root: dict = {}
        for name, words in classes.items():
            for w in words:
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node.setdefault("", set()).add(name)
        self.root.setdefault("", set())

    def classes(self, t: str, start: int, p: int) -> set[str]:
        """The classes of the abbreviation that stands between a break, or the beginning, and p, in whatever case."""
        node, k = self.root, p
        while k > start:
            c = t[k - 1]
            if c.isspace() or c in _BREAKS:
                break
            below = node.get(c) or node.get(c.lower())
            if below is None:
                return node.get("", _NONE) if c in _LEADS else _NONE
            node, k = below, k - 1
        return node.get("", _NONE)


_NONE: set[str] = set()
_BREAKS, _LEADS = "(«„“\"「[", "'‘-–/"
ABBREVIATIONS = Trie({"never": NEVER, "final": FINAL, "month": MONTHS})


def _word_start(t: str, start: int, p: int) -> int:
    """Where the token that ends at p begins, however long it is."""
    m = _TOKEN.search(t, max(start, p - 24), p)
    k = m.start() if m else p
    if m and k == p - 24:
        while k > start and not t[k - 1].isspace() and t[k - 1] not in _BREAKS:
            k -= 1
    return k


CLOSER = {"”": "“„\"", "“": "„", "»": "«", "«": "»", "›": "‹", "」": "「", "』": "『", ")": "(（", "）": "(（", "]": "["}
TRAIL = "\"”“»›」』)）]’'"
HARD = "。！？।"


def _covers(t: str, a: int, z: int) -> list[tuple[int, int]]:
    """The outermost matched quotes and brackets of a block."""
    stack: list[tuple[str, int]] = []
    open_at: dict[str, list[int]] = {}  # where in the stack each opener lies, so that a search costs no more than a look
    found: list[tuple[int, int]] = []

    def push(c: str, p: int) -> None:
        open_at.setdefault(c, []).append(len(stack))
        stack.append((c, p))

    for m in _PAIR.finditer(t, a, z):
        c, p = m.group(), m.start()
        if c == '"':
            before = t[p - 1] if p > a else " "
            after = t[p + 1] if p + 1 < z else " "
            opens = not after.isspace() and (before.isspace() or before in "([（「")
            if opens and not (stack and stack[-1][0] == '"'):
                push(c, p)
                continue
            want = '"'
        elif c in "“«":
            if stack and stack[-1][0] in CLOSER[c]:
                want = CLOSER[c]
            else:
                push(c, p)
                continue
        elif c in CLOSER:
            want = CLOSER[c]
        else:
            push(c, p)
            continue
        k = max((open_at[w][-1] for w in want if open_at.get(w)), default=-1)
        if k >= 0:
            found.append((stack[k][1], p))
            while len(stack) > k:
                open_at[stack.pop()[0]].pop()
    if len(found) > 1:
        found.sort()
        outer, end = [], -1
        for q, p in found:
            if q > end:
                outer.append((q, p))
                end = p
        return outer
    return found


def _starts_new(t: str, q: int, z: int) -> bool:
    """Whether a capital, or a quote or bracket before one, stands at q."""
    for k in range(q, min(z, q + 3)):
        c = t[k]
        if c.isalpha():
            return c.isupper() or not c.islower()
        if c in "¿¡":
            return True
        if c not in "\"“„«‹(「『' \xa0*#":
            return False
    return False


#: Words that may go on after an abbreviation though they can begin a sentence.
_GOES_ON = frozenset(
    "a an the no not is are was were am be has had have that this these those it we i you do since per as at in on for from with without after before when while if his her its their our my your "
    "one some any all each both who what which per der die das ein eine el la los las le les un une se su sus es fue ha er sie wir ist hat war wird im am bei nach vor mit on est a con sin por "
    "para en al del desde hasta sans avec depuis pour par dans "
    "pas".split()
)


def _small_start(t: str, q: int, z: int) -> bool:
    """Whether words in lower case at q begin a sentence all the same: one of the openers, a label with its colon, or a
    subject and was or were."""
    w = _WORD.match(t, q).group()
    if w.capitalize() in OPENERS and w not in _GOES_ON:
        return True
    if _LABEL.match(t, q, z):
        return True
    k = q + len(w)
    while k < z and t[k].isspace():
        k += 1
    w2 = _WORD.match(t, k)
    return bool(w2) and w2.group() in ("was", "were") and w.isalpha() and w not in HANGING


def _stop(t: str, start: int, token_at: int, p: int, e: int, z: int) -> bool:
    """Whether the full stop at p (marks to e), behind the token begun at token_at, ends the sentence begun at start."""
    if e >= z:
        return True
    n1 = t[e]
    at = max(start, token_at)
    token = t[at:p]
    low = token.lower().lstrip(_LEADS) if p - at < 24 else token
    known = ABBREVIATIONS.classes(t, at, p)
    if not n1.isspace():
        if "@" in token or not token:
            return False
        prev = t[p - 1]
        if _UNCASED.match(n1):  # a script without capitals follows at once
            return not prev.isdigit() and "never" not in known and len(token) > 1
        if n1.isupper() and (prev.islower() or prev.isdigit() or prev in ")%") and e + 1 < z and (t[e + 1].islower() or t[e + 1] == " "):
            if "never" in known or (len(token) == 1 and not token.isdigit()):
                return False
            tail = t[e : e + 40].split(None, 1)[0]
            return "@" not in tail and "." not in tail[:-1]
        return n1 in "¿¡«„「(" and "never" not in known and (prev.islower() or prev.isdigit())
    q = e
    while q < z and t[q].isspace():
        q += 1
    if q >= z:
        return True
    if not token:
        return True
    if "never" in known:
        return False
    if len(token) == 1 and token.isalpha():
        if token not in UNITS:
            return False
        before = t[max(start, at - 2) : at]
        return bool(before.strip()[-1:].isdigit()) and before[-1:].isspace()
    n2 = t[q]
    if "month" in known:
        return not n2.isdigit() and _starts_new(t, q, z)
    if low == "no":
        return not _CODE.match(t, q)
    if "final" in known:
        if n2.isdigit():
            return False
        if not _starts_new(t, q, z):
            return n2.islower() and _small_start(t, q, z)
        if token.isupper() and len(token) > 3:  # in capitals throughout, only a beginning tells
            w = _WORD.match(t, q)
            return bool(w) and w.group().capitalize() in OPENERS
        return True
    if "." in low and low.replace(".", "").isalpha() and len(low) <= 5 and all(len(x) == 1 for x in low.split(".")):
        return _starts_new(t, q, z)
    if token.isdigit() and len(token) <= 2 and n2.isupper():
        w = t[max(start, at - 6) : at].split()
        return not (w and w[-1].lower() in ORDINAL)
    return True


def _line_end(t: str, start: int, p: int, e: int, z: int) -> bool:
    """Whether the line end at p, after no mark, ends the sentence begun at start."""
    k = p
    while k > start and t[k - 1].isspace():
        k -= 1
    while e < z and t[e].isspace():
        e += 1
    if k <= start or e >= z:
        return True
    prev, nxt = t[k - 1], t[e]
    if prev in ",;:，、；：(（-–—/@&+=<>،؛«„¿¡":
        return False
    if _CJK.match(prev) or _CJK.match(nxt):
        return not _NAME_GAP.search(t, max(start, k - 8), k)
    w = _WORD.match(t, e).group()
    token = t[_word_start(t, start, k) : k] or prev
    low = token.lower().rstrip(".")
    if nxt in "¿¡":
        return True
    if low in HANGING or (token.endswith(".") and (low in NEVER or (len(low) == 1 and low not in UNITS))):
        return False
    if nxt in "\"“„«「(":
        return _starts_new(t, e, z)
    if nxt.islower() or nxt.isdigit():
        return False
    if "ऀ" <= nxt <= "ॿ" or "ऀ" <= prev <= "ॿ":
        return low in HINDI_END and (w in OPENERS or nxt.isupper() or w not in HINDI_END)
    if "؀" <= nxt <= "ۿ":
        return w in OPENERS
    return nxt.isupper()


def _block(t: str, a: int, z: int, thai: bool, out: list[tuple[int, int]]) -> None:
    start = long_at = scanned = a
    covers = _covers(t, a, z)
    at, n = 0, len(covers)

    def emit(end: int) -> None:
        nonlocal start
        s, e = start, end
        while s < e and t[s].isspace():
            s += 1
        while e > s and t[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        start = end

    def closed(q: int, p: int) -> None:
        """A quote or bracket from q to p is over; a mark before its end may end the sentence around it."""
        k = p
        while k > q + 1 and t[k - 1].isspace():
            k -= 1
        last = t[k - 1]
        if last not in ".!?…。！？।؟":
            return
        e = p + 1
        if e >= z:
            emit(e)
            return
        whole = not t[start:q].strip()
        if not t[e].isspace():
            return
        j = e
        while j < z and t[j].isspace():
            j += 1
        if j >= z or _starts_new(t, j, z) and (last != "." or whole or t[q] not in "([") or whole and t[q] in "(（":
            if last == "." and not whole and t[q] in "(（":
                return
            emit(e)

    for m in (_THAI_EVENT if thai else _EVENT).finditer(t, a, z):
        p, e = m.span()
        while at < n and covers[at][1] < p:
            closed(*covers[at])
            at += 1
        if at < n and covers[at][0] < p:
            continue
        if p < start:
            continue
        c = t[p]
        if c.isspace():
            if thai and "\n" not in m.group():
                k = p - 1
                while k >= start and not t[k].isspace():
                    k -= 1
                if THAI.search(t, k + 1, p) and e < z and not ((t[p - 1].isdigit() or t[p - 1] in ")）") and (t[e].isdigit() or t[e] in "(（")):
                    emit(p)
                elif THAI.match(t, e) and not t[p - 1].isdigit():
                    emit(p)
            elif p > start and (thai and (THAI.match(t[p - 1]) or THAI.search(t, max(start, p - 40), p)) or _line_end(t, start, p, e, z)):
                emit(p)
            continue
        run = m.group()
        if any(x in HARD for x in run):
            while e < z and t[e] in TRAIL and t[e] not in "“\"'":
                e += 1
            emit(e)
        elif run.strip(".…"):
            while e < z and t[e] in TRAIL and not (t[e] in "\"“" and e + 1 < z and not t[e + 1].isspace()):
                e += 1
            if e >= z or t[e].isspace() or _starts_new(t, e, z) and "=" not in t[e : e + 6]:
                emit(e)
        else:
            k = e
            while k < z and t[k] in TRAIL and not (t[k] in "\"“" and k + 1 < z and not t[k + 1].isspace()):
                k += 1
            if run == "…" or len(run) > 1:
                q = k
                while q < z and t[q].isspace():
                    q += 1
                if k < z and (not t[k].isspace() or not _starts_new(t, q, z)):
                    continue
                emit(k)
            else:
                token = _TOKEN.search(t, max(start, p - 24), p)
                token_at = token.start() if token else p
                if token and token_at == p - 24:  # a long token: once over the block, so that it costs no more than others
                    for b in _BREAK.finditer(t, scanned, p):
                        long_at = b.end()
                    scanned, token_at = p, max(start, long_at)
                if _stop(t, start, token_at, p, k, z):
                    emit(k)
    while at < n:
        if covers[at][0] >= start:
            closed(*covers[at])
        at += 1
    emit(z)


def sentences(t: str | None) -> list[tuple[int, int]]:
    """The spans of a text's sentence units."""
    out: list[tuple[int, int]] = []
    if not t:
        return out
    thai = bool(THAI.search(t))
    begin = end = -1
    lines = [(m.start(), m.end()) for m in _LINE.finditer(t)]
    last = -1
    levels: list[int] = []  # the indents of the list entries that are open, outermost first
    for i, (a, z) in enumerate(lines):
        line = t[a:z].strip()
        gap = last >= 0 and t.count("\n", last, a) > 1 or last >= 0 and t.count("\r", last, a) > 1
        last = z
        entry = _LIST.match(t, a, z) if line else None
        if line and levels or entry:
            indent = len(t[a:z]) - len(t[a:z].lstrip())
            if entry:
                while levels and indent < levels[-1]:
                    levels.pop()
                if not levels or indent > levels[-1]:
                    levels.append(indent)
            elif not gap and indent > levels[-1]:  # a line further in than the entry's mark goes on with it
                out[-1] = (out[-1][0], z - len(t[a:z]) + len(t[a:z].rstrip()))
                continue
            else:
                levels.clear()
        own = bool(line) and (
            entry
            or (line[-1] in ":：" and len(line) < 60 and _HEAD.match(line))
            or (_MACHINE.match(line) and " " not in line)
            or (line[0].isupper() and line[-1].isupper() and _CAPS.match(line) and not _caps_around(t, lines, i))
        )
        if not line or own or gap:
            if begin >= 0:
                _block(t, begin, end, thai, out)
                begin = -1
        if own:
            s, e = a, z
            while t[s].isspace():
                s += 1
            while t[e - 1].isspace():
                e -= 1
            out.append((s, e))
        elif line:
            if begin < 0:
                begin = a
            end = z
    if begin >= 0:
        _block(t, begin, end, thai, out)
    return out


def _caps_around(t: str, lines: list[tuple[int, int]], i: int) -> bool:
    """Whether a neighbouring line of running text is in capitals too."""
    for k in (i - 1, i + 1):
        if 0 <= k < len(lines):
            s = t[lines[k][0] : lines[k][1]]
            if len(s) > 25 and s.isupper():
                return True
    return False


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, spans = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            found = sentences(text)
            at.append(len(found))
            spans += found
        if spans:
            both = np.asarray(spans, np.int32)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(at)), at)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "start_pos", "end_pos"])


def sentence_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos): one row for each sentence unit of each text."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    return narrow.mapInArrow(_batches, f"id {kind}, start_pos int, end_pos int").withColumnRenamed("id", key)
