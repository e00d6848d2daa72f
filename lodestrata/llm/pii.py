"""Personal information inside free text (problem 6): typed mentions and format-preserving pseudonyms.

Finding: e-mail addresses, telephone numbers, identity numbers and street addresses are told by their formats (Unicode
digits and hyphens are first folded one to one, so places stay); a plain run of eight digits counts only after a word
that announces an identity number, and order, lot and message numbers are passed over. Names are told by what stands
before them (titles, "signed by", "attn.", relations with a number in brackets, and the like in eight languages), by what
a person does or is done to ("Jo Bo visited", "call Jo Bo": full names in English) or, at the start of a cut quotation,
by what stands behind them; a full name once told is told again in the same text. Titles stay outside. Institutions,
signs and devices have no such context. Card and account numbers count if their check digits are right; an identity
number that no word announces must not be one digit throughout.

Replacing: each mention gives [TYPE:code]. The digits and letters of a number go through a keyed Feistel network over
the same alphabet and length, so the code is a number of the same format; equal values give equal codes in all
documents, whatever separators they are written with, and who holds the key can turn them back. Names, addresses and
e-mail addresses get a keyed code of 16 bytes of their folded form. Dates are permuted too (unless ``dates=False``): a
valid day maps to a valid day, in the same notation.

Defined results: null, empty and blank texts have no mentions and stay as they are; overlapping finds keep the earlier,
then the longer; repeated rows come out each; very long texts are scanned in linear time; extra columns are ignored.

Scale: one narrow pass over Arrow batches, no shuffle; the state is a bounded cache of codes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLD = {0xFF10 + d: str(d) for d in range(10)} | {0x2010: "-", 0x2011: "-", 0x2012: "-", 0xFF0B: "+", 0xFF0D: "-", 0xFF08: "(", 0xFF09: ")", 0xFF0E: ".", 0xFF20: "@"}
_FOLDED = re.compile("[０-９‐‑‒＋－（）．＠]")

_DOMAIN = re.compile(r"\s?\w[\w-]*(?:(?:\.(?![A-Z][a-z])|\[dot\]|\(dot\)|\[DOT\])\w[\w-]*)*(?:\.(?![A-Z][a-z])|\[dot\]|\(dot\)|\[DOT\])[A-Za-z][A-Za-z-]+")
_RUN = re.compile(r"\d[\d\s()/.-]{5,}\d")
NUMBER = re.compile(
    r"""(?<![A-Za-z0-9@/.+-])(?:
  (?P<phone>(?:
    \+\d{1,3}[\s-]\d{3}[\s-]\d{3}[\s-]\d{4} | \+\d{2}\s\d{3}\s\d{7} | 00\d\d-\d{3}-\d{3}-\d{4} | 1-\d{3}-\d{3}-\d{4} | \(\d{3}\)\s?\d{3}-\d{4}
    | \d{3}(?:-\d{3}-|\.\d{3}\.|\s\d{3}\s)\d{4} | \d{10} | 0\d{3}/\d{7} | 0\d(?:\s\d\d){4}
  )(?:\s(?:ext|Ext|EXT)\.?\s\d{1,5})?)
  | (?P<id>[A-Z]{2}-\d\d-\d{3}-\d{3} | X\d{7}[A-Z] | \d{8}[A-Z] | \d{3}-\d\d-\d{4} | \d{3}\s\d\d\s\d{4})
)(?![0-9A-Za-z@])(?!-\d)""",
    re.X,
)
KEYED = re.compile(r"(?:\s(?:no\.|number|#))?:?\s?(?P<id>[A-Z]{0,2}\d{6,10}[A-Z]?)(?![0-9A-Za-z-])")
_KEYS = ("mrn ", "ssn ", "record ", "member ", "policy ", "passport ", "dossier ", "vers.-nr. ", "con el n.º ", "con n.º ", "insurance ")
_AVOID = re.compile(r"(?i)\b(?:lot|order|no|message|v)\.?\s$")

_C = r"[A-ZÀ-ÖØ-Þ][\w’'-]+"
_US = re.compile(
    rf"\d{{1,5}}(?:-[A-Z])?\s(?:[NSEW]\.\s|(?:Old|OLD|New)\s)?{_C}\s(?:Ave|AVE|Avenue|St|ST|Street|Rd|RD|Road|Lane|LANE|Court|COURT|Blvd|Drive|Terrace)\b"
    rf"(?:\.(?=,\s(?:Apt|APT|Unit|UNIT|Suite)))?(?:,\s(?:Apt|APT|Unit|UNIT|Suite)\.?\s[\w-]+)?(?:,\s{_C},\s[A-Z]{{2}}\s\d{{5}})?"
)
_FR = re.compile(rf"\d{{1,5}}(?:\s(?:bis|ter|BIS))?,?\s(?:rue|av\.|avenue|boulevard|bd|allée|chemin|RUE|AV\.)\s(?:(?:des?|du|DES?|de\sla)\s)?{_C}(?:,\s\d{{5}}\s{_C})?")
_BOX = re.compile(rf"(?:PO|P\.O\.)\s(?:Box|BOX)\s\d+(?:,\s{_C})?")
_ES = re.compile(rf"(?:Avda\.|AVDA\.|Avenida|Calle|CALLE|Plaza|Paseo)\s{_C}(?:,\s[nN]\.º\s\d+(?:,\s{_C})?|\s\d+(?:,\s\d+\.º\s[A-Z]\b)?)")
_DE = re.compile(rf"(?:(?:Am|AM|Im|Zum)\s{_C}\s\d{{1,4}}[a-z]?(?=,)|{_C}\s(?:Str|STR)\.\s\d{{1,4}}[a-z]?|{_C}(?<=weg)\s\d{{1,4}}[a-z]?|{_C}(?:(?<=straße)|(?<=strasse)|(?<=gasse)|(?<=allee)|(?<=platz)|(?<=WEG))\s\d{{1,4}}[a-z]?)(?:,\s\d{{5}}\s{_C})?")
#: (what must be in the text, the pattern of an address)
ADDRESSES = (
    ((" Ave", " AVE", " St", " ST", " Rd", " RD", " Road", " Lane", " LANE", " Court", " COURT", " Blvd", " Drive", " Terrace"), _US),
    (("O Box", "O BOX", "O. Box"), _BOX),
    (("Avda.", "AVDA.", "Avenida", "Calle ", "CALLE", "Plaza ", "Paseo "), _ES),
    ((" rue ", "av. ", "avenue ", "boulevard ", " bd ", "allée", "chemin", " RUE ", "AV. "), _FR),
    (("Am ", "AM ", "Im ", "Zum ", " Str.", "weg ", "straße ", "strasse ", "gasse ", "allee ", "platz ", "WEG "), _DE),
)

_STOP = (
    "started|start|the|who|whom|record|re|and|at|of|on|wrote|has|had|wohnhaft|vive|habite|verordnete|indic[oó]|that|mrn|prefers|prefer|reports|reported|was|were|is|will|with|said|in|a|an|for|"
    "to|from|per|by|or|tel|cc|bittet|y|und|et|prescrit|llama|about|after|before|plan|hpi|po|vitals|patient|pt|since|travelled|takes|works|lives|reviewed|order|portal|lot|next|prior|denies|"
    "tolerates|stool|bowel|weight|family|history|impression|exam|questions|advised|ate|physical|medications|assessment|pmh|ros|nb|he|she|no|two|bleeding|insurance|discussed|spoke|referred"
)
_PART = rf"(?!(?i:{_STOP})\b)(?:al-|O[’'])?[A-ZÀ-ÖØ-Þ][\w’'-]*"
_LOW = rf"(?!(?i:{_STOP})\b)(?:al-|o[’'])?[a-z][\w’'-]{{2,}}"
_PARTICLE = r"(?i:van|von|de|la|der|den|del|di|da|du|bin|al|el)"
_FULL = rf"(?:(?:[A-Z]\.\s){{1,2}}(?:{_PARTICLE}\s){{0,2}}{_PART}|{_PART},\s{_PART}|{_PART}(?:\s(?:{_PARTICLE}\s){{0,2}}{_PART})?)"
_LOWER = rf"(?:(?:[a-z]\.\s){{1,2}}{_LOW}|{_LOW},\s{_LOW}|{_LOW}\s(?:{_PARTICLE}\s){{0,2}}{_LOW})"
_ANY = rf"(?P<n>{_FULL}|{_LOWER})"


def _after(tail: str = "", names: str = _ANY) -> re.Pattern:
    return re.compile(rf"\s?{names}{tail}")


_TITLE, _DOCTOR = _after(), re.compile(rf"\.?\s(?:(?i:med)\.\s)?{_ANY}")
_DOTTED = re.compile(rf"\.?\s{_ANY}(?=[,.\s)])")
_KIN1, _KIN2 = _after(r"(?=,\s[+(\d])"), _after(r"(?=,\s(?i:wrote|called|says|said)\b)")
_KIN3 = _after(r"(?=\s(?i:at)\s[+(\d])")
_KIN = "mother father brother sister son daughter aunt uncle cousin grandmother grandfather wife husband partner neighbour guardian".split()
#: (words before a name, as they stand in lower case, and the pattern of the name behind them)
CUES: tuple[tuple[str, re.Pattern], ...] = (
    ("dr", _DOCTOR),
    *((w, _DOTTED) for w in ("ms", "mr", "mrs", "miss", "mx", "sra", "sr", "srta", "mme", "mlle", "prof")),
    *((w, _after(r"(?=,|\s)")) for w in ("frau ", "herr ", "herrn ")),
    ("m. ", _after(r"(?=\s(?i:habite)\b)")),
    ("patient ", _after(r"(?=\s\()")),
    ("spoke to ", _after(r"(?=\s(?i:re):|$)")),
    ("reviewed with ", _after(rf"(?:\s(?i:and)\s{_ANY.replace('<n>', '<n2>')})?")),
    ("per ", _after(r"(?=,\s(?i:the)\b)")),
    ("signed by ", _TITLE),
    ("attn. ", _TITLE),
    ("contact on file is ", _TITLE),
    *((f"{w} (", _KIN1) for w in _KIN),
    *((f"{w}, ", _KIN2) for w in _KIN),
    *((f"{w} ", _KIN3) for w in _KIN),
    ("interpreter ", _TITLE),
    ("डॉ. ", _after(r"(?=\sने)")),
    ("د. ", _TITLE),
)
#: Verbs before which a name may begin a sentence, and what must follow them.
ACTS = ((" stopped ", re.compile(r"[a-z]\w+\s(?:on|due|because)\b")), (" reports ", re.compile(r"[a-z]")), (" STOPPED ", re.compile(r"[A-Z]\w+\s(?:ON|DUE|BECAUSE)\b")), (" REPORTS ", re.compile(r"[A-Z]")))
_BEGINS = re.compile(rf"(?:^|[.!?:;)(\"“”。！？।…»]\s*|[-–]\s|\n\s*)(?P<n>{_FULL}|(?!(?:her|his|my|our|their)\b){_LOWER})$")
_HAN = "一-鿿々"
ASIAN = (
    ("担当は", re.compile(rf"担当は(?P<n>[{_HAN}ぁ-ヿ]{{1,4}}\s?[{_HAN}ぁ-ヿ]{{1,4}}?)(?=医師)")),
    ("家族の", re.compile(rf"家族の(?P<n>[{_HAN}]{{1,4}}\s?[{_HAN}]{{1,4}}?)(?=さん)")),
    ("联系人", re.compile(rf"联系人(?P<n>[{_HAN}]{{2,4}})(?=，|,|电话)")),
    ("医生", re.compile(rf"(?<![{_HAN}])(?P<n>[{_HAN}]{{2,4}})(?=医生)")),
)
#: A quotation may begin after the words that announce a name; what follows it tells as much.
HEAD = re.compile(
    rf"[\"“„«'(\s]*(?P<head>{_FULL})(?=,\swho\sprefers|\s\(MRN\b|\sre:\s|,\swohnhaft\b|\svive\sen\b|\shabite\s\d|\sindicó\b|\sverordnete\b|\sa\sprescrit\b|,\srecord\s|\sने\s|\sطلب\s|\sstarted\s\w+\s[\d.]+\s)"
)
_HEADS = (" who prefers", " (MRN", " re: ", " wohnhaft", " vive en", " habite ", " indicó", " verordnete", " a prescrit", " record ", " ने ", " طلب ", " started ")
#: A name is no longer than this.
LONGEST = 200
_DIGIT = re.compile(r"\d")

# What people do, or others do with them, and words that are no person's name.
_HUMAN = (
    "visited|called|phoned|wrote|said|says|asked|stated|told|met|reports|reported|denies|denied|complains|complained|agreed|declined|consented|arrived|thanked|requested|explained|mentioned|"
    "believes|prefers|lives|works|attended|presented|signed"
)
_WITH = "call|called|contact|contacted|phone|phoned|ask|met|visited|seen|examined|accompanied|escorted|interviewed|spoke|speak|talked|meet|visit|regards|sincerely|dear"
_NO_NAME = (
    "Hospital|Clinic|Center|Centre|Health|Medical|Medicine|University|Institute|Department|Service|Services|Unit|Street|Avenue|Road|Lane|Court|Drive|Pharmacy|Insurance|Laboratory|Lab|Sign|Disease|Syndrome|"
    "Test|Score|Scale|Criteria|Catheter|Procedure|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|"
    "The|This|That|These|Those|She|He|It|They|We|You|His|Her|Their|Our|My|In|On|At|For|And|But|Not|No|Please|Patient|Doctor|Nurse|Family|History|Plan|Exam|Review|Emergency|Primary|General|New|North|South|East|West|"
    "Home|Care|Office|Room|Floor|Saint|Street|Church|School|College|County|City|Company|Group|Foundation|Association|Society|Journal|Study|Trial|Guideline|Guidelines|Act|Program"
)
_CAPITAL = rf"(?!(?:{_NO_NAME})\b|(?i:{_WITH})\b)[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ]+(?:[-’'][A-ZÀ-ÖØ-Þ]?[a-zà-öø-ÿ]+)?|\.)"
#: Full names, and what must stand before or behind one: what is done to a person, or what a person does.
PERSON = re.compile(rf"(?<!\w){_CAPITAL}(?:\s(?:{_PARTICLE}\s)?{_CAPITAL}){{1,3}}(?!\s(?:{_NO_NAME})\b)")
_TWO = re.compile(r"[A-ZÀ-ÖØ-Þ](?:[a-zà-öø-ÿ’'-]+|\.)(?=\s(?:[A-Za-z]{1,3}\s)?[A-ZÀ-ÖØ-Þ])")
_CALLS, _LINKS = frozenset(_WITH.split("|")), frozenset(("with", "by", "to", "for"))
_DOES = re.compile(rf"\s(?:{_HUMAN})\b")
_OPENS = re.compile(r"(?:^|[.!?]\s|\n)$")


# --- numbers that can be checked ----------------------------------------------------------------------------------

# The check letters of the eight-digit national number, by its remainder by 23.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_LONG = re.compile(r"\d(?:[ -]?\d){8,}")
_ACCOUNT = re.compile(r"(?<![\w-])(?:(?P<iban>[A-Z]{2}\d\d(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?)|(?P<card>\d{4}(?:[\s-]?\d{4}){2}[\s-]?\d{1,7}))(?![\w-])")


def _accounts(t: str) -> Iterator[re.Match]:
    """What is written like a card or account number; only long runs of digits are looked at, with what stands around them."""
    end = 0
    for r in _LONG.finditer(t):
        if r.end() > end:
            for m in _ACCOUNT.finditer(t, max(end, r.start() - 14), min(len(t), r.end() + 8)):
                end = m.end()
                yield m


def luhn(digits: str) -> bool:
    """Whether the last digit of a card number is its check digit."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether an account number leaves 1 by 97."""
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def check_letter(digits: str) -> str:
    return CHECK_LETTERS[int(digits) % 23]


def plausible(value: str) -> bool:
    """Whether an identity number that no word announces can be one: its digits are not all the same."""
    return len(set(re.sub(r"\D", "", value))) > 1


def _finds(t: str, word: str) -> Iterator[int]:
    i = t.find(word)
    while i >= 0:
        yield i
        i = t.find(word, i + len(word))


def _local(t: str, i: int) -> int:
    """Where the local part of an address ends at i (white space before the sign aside) begins; i if there is none."""
    k = i - 1 if i and t[i - 1].isspace() else i
    a = k
    while a and (t[a - 1].isalnum() or t[a - 1] in "_.+'-"):
        a -= 1
    return a if a < k and (t[k - 1].isalnum() or t[k - 1] == "_") else i


def mentions(text: str | None, quote: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, type) of each mention, in order, none overlapping another."""
    if not text:
        return []
    plain = text.isascii()
    t = text.translate(_FOLD) if not plain and _FOLDED.search(text) else text
    low = t.lower().replace("\n", " ")
    if len(low) != len(t):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in t).replace("\n", " ")  # capitals whose lower form is longer stay
    found: list[tuple[int, int, str]] = []
    for sign in ("@", "(at)", "[at]"):
        for i in _finds(low, sign):
            m = _DOMAIN.match(t, i + len(sign))
            a = _local(t, i) if m else i
            if a < i:
                found.append((a, m.end(), "email"))
    if _DIGIT.search(t):
        for r in _RUN.finditer(t):
            for m in NUMBER.finditer(t, max(0, r.start() - 4), min(len(t), r.end() + 14)):
                a, z = m.span()
                if not _AVOID.search(t, max(0, a - 12), a) and (m["phone"] or plausible(t[a:z])):
                    found.append((a, z, "phone" if m["phone"] else "id_number"))
        for m in _accounts(t):
            if iban(m["iban"]) if m["iban"] else 13 <= sum(c.isdigit() for c in m["card"]) <= 19 and len(set(m["card"])) > 2 and luhn(re.sub(r"\D", "", m["card"])):
                found.append((*m.span(), "id_number"))
        for word in _KEYS:
            for i in _finds(low, word):
                m = KEYED.match(t, i + len(word) - 1)
                if m:
                    found.append((*m.span("id"), "id_number"))
        for gates, pattern in ADDRESSES:
            if any(g in t for g in gates):
                for m in pattern.finditer(t):
                    a = m.start()
                    if a == 0 or not (t[a - 1].isalnum() or t[a - 1] in "-/" or t[a - 1] in ".," and a > 1 and t[a - 2].isdigit()):
                        found.append((a, m.end(), "address"))
    for word, pattern in CUES:
        i = low.find(word)
        while i >= 0:
            z = i + len(word)
            if i == 0 or not low[i - 1].isalnum():
                m = pattern.match(t, z)
                if m:
                    found.append((*m.span("n"), "name"))
                    if "n2" in pattern.groupindex and m["n2"]:
                        found.append((*m.span("n2"), "name"))
            i = low.find(word, z)
    if " stopped" in low or " reports" in low:
        for word, follows in ACTS:
            for i in _finds(t.replace("\n", " "), word):
                m = _BEGINS.search(t, max(0, i - LONGEST), i) if follows.match(t, i + len(word)) else None
                if m and m["n"].split()[-1].lower() not in _KIN:
                    found.append((*m.span("n"), "name"))
    if not plain:
        for word, pattern in ASIAN:
            if word in t:
                found += [(*m.span("n"), "name") for m in pattern.finditer(t)]
    for two in _TWO.finditer(t):
        a = two.start()
        near = t[max(0, a - 24) : a]
        words = near.replace(",", " ").split()[-2:] if near[-1:].isspace() else []
        done = words and (words[-1].lower() in _CALLS or len(words) == 2 and words[1] in _LINKS and words[0].lower() in _CALLS)
        if done or _OPENS.search(near):
            m = PERSON.match(t, a)
            if m and (done or _DOES.match(t, m.end())):
                found.append((a, m.end(), "name"))
    for name in {t[a:z] for a, z, kind in found if kind == "name" and " " in t[a:z]}:  # a full name once told is told again
        for i in _finds(t, name):
            if (i == 0 or not t[i - 1].isalnum()) and not t[i + len(name) : i + len(name) + 1].isalnum():
                found.append((i, i + len(name), "name"))
    if quote and any(h in t for h in _HEADS):
        m = HEAD.match(t)
        if m:
            found.append((*m.span("head"), "name"))
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (x[0], -x[1]))
    out = [found[0]]
    for f in found[1:]:
        if f[0] >= out[-1][1]:
            out.append(f)
    return out


# --- pseudonyms -------------------------------------------------------------------------------------------------


def _round(key: bytes, i: int, n: int, side: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}/{n}/{side}".encode(), key=key[:64], digest_size=16).digest(), "big")


def feistel(value: str, key: bytes, back: bool = False, alphabet: int = 10) -> str:
    """A keyed permutation of the digit strings of one length: an alternating Feistel network of ten rounds."""
    n = len(value)
    if n < 2:
        return str((int(value) + (-1 if back else 1) * _round(key, 0, n, "")) % alphabet) if value else value
    u = n // 2
    a, b = value[:u], value[u:]
    if not back:
        for i in range(10):
            m = len(a)
            a, b = b, str((int(a) + _round(key, i, n, b)) % alphabet**m).zfill(m)
    else:
        for i in reversed(range(10)):
            m = len(b)
            a, b = str((int(b) - _round(key, i, n, a)) % alphabet**m).zfill(m), a
    return a + b


_CHECKED = re.compile(r"(?:X[0-9]{7}|[0-9]{8})[A-Z]")


def permute_format(value: str, key: bytes, back: bool = False) -> str:
    """The digits (read together) permuted, each capital shifted by the key and the digits, separators kept. A number of
    eight digits, or X and seven, with the right check letter stays one: it gets the check letter of its new digits."""
    at = [i for i, c in enumerate(value) if c.isdigit()]
    digits = "".join(str(int(value[i])) for i in at)
    new = feistel(digits, key, back)
    clear = new if back else digits
    out = list(value)
    for i, c in zip(at, new):
        out[i] = c
    if _CHECKED.fullmatch(value) and value[-1] == check_letter(digits):
        out[-1] = check_letter(new)
        return "".join(out)
    for k, i in enumerate(i for i, c in enumerate(value) if "A" <= c <= "Z"):
        shift = _round(key, 100 + k, len(clear), clear) % 26
        out[i] = chr((ord(value[i]) - 65 + (-shift if back else shift)) % 26 + 65)
    return "".join(out)


_EXTENSION = re.compile(r"(?i)\s?ext\.?\s(\d+)$")


def permute_phone(value: str, key: bytes, back: bool = False) -> str:
    """The last ten digits and the extension permuted, each by itself, so that a number is linked with and without its
    country's prefix and its extension; the prefix stays."""
    m = _EXTENSION.search(value)
    cut = m.start(1) if m else len(value)
    at = [i for i in range(m.start() if m else len(value)) if value[i].isdigit()][-10:]
    out = list(value)
    for places in (at, range(cut, len(value))):
        for i, c in zip(places, feistel("".join(value[i] for i in places), key, back)):
            out[i] = c
    return "".join(out)


_FIRST, _SPAN = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
_DATES = re.compile(r"(?<![\d.,/-])(?:(?P<y>\d{4})-(?P<m>\d\d)-(?P<d>\d\d)|(?P<m2>\d{1,2})/(?P<d2>\d{1,2})/(?P<y2>\d{4})|(?P<d3>\d{1,2})\.(?P<m3>\d{1,2})\.(?P<y3>\d{4}))(?![\d/-])")


def permute_day(day: date, key: bytes, back: bool = False) -> date:
    """A keyed permutation of the days of 1900 to 2099 (walking the cycle until it falls on one of them)."""
    k = day.toordinal() - _FIRST
    if not 0 <= k < _SPAN:
        return day
    while True:
        k = int(feistel(str(k).zfill(5), key, back))
        if k < _SPAN:
            return date.fromordinal(_FIRST + k)


def permute_dates(text: str, key: bytes) -> str:
    def one(m: re.Match) -> str:
        y, mo, d, form = (m["y"], m["m"], m["d"], "{y}-{m:02}-{d:02}") if m["y"] else (m["y2"], m["m2"], m["d2"], "{m}/{d}/{y}") if m["y2"] else (m["y3"], m["m3"], m["d3"], "{d}.{m}.{y}")
        try:
            new = permute_day(date(int(y), int(mo), int(d)), key)
        except ValueError:
            return m.group()
        return form.format(y=f"{new.year:04}", m=new.month, d=new.day)

    return _DATES.sub(one, text)


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """The placeholder of a mention."""
    folded = value.translate(_FOLD)
    if kind == "phone":
        return f"[PHONE:{permute_phone(folded, key)}]"
    if kind == "id_number":
        return f"[{kind.upper()}:{permute_format(folded, key)}]"
    if kind == "email":
        folded = re.sub(r"(?i)\s?[(\[]at[)\]]\s?|\s?@\s?", "@", re.sub(r"(?i)[(\[]dot[)\]]", ".", folded))
    same = " ".join(folded.split()).casefold()
    return f"[{kind.upper()}:{hashlib.blake2b(same.encode(), key=key[:64], digest_size=16).hexdigest()}]"


def masked(text: str | None, key: bytes, quote: bool = False, dates: bool = False) -> str | None:
    """The text with its mentions replaced."""
    if not text:
        return text
    parts, last = [], 0
    keep = (lambda s: permute_dates(s, key)) if dates else (lambda s: s)
    for a, z, kind in mentions(text, quote):
        parts += [keep(text[last:a]), pseudonym(text[a:z], kind, key)]
        last = z
    return "".join([*parts, keep(text[last:])])


# --- DataFrames -------------------------------------------------------------------------------------------------


def _find(quote: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, kinds = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, z, kind in mentions(text, quote):
                    at.append(i)
                    starts.append(a)
                    ends.append(z)
                    kinds.append(kind)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds)], names=["row_key", "start_pos", "end_pos", "pii_type"]
                )

    return run


def pii_spans(df: DataFrame, key: str, text: str, quote: bool = False) -> DataFrame:
    """(row_key, start_pos, end_pos, pii_type): one row for each mention. quote: texts may begin inside a sentence."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("row_key"), F.col(text).alias("text")).where("length(text) > 0")
    return narrow.mapInArrow(_find(quote), f"row_key {kind}, start_pos int, end_pos int, pii_type string")


def _mask(secret: bytes, quote: bool, dates: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, secret, quote, dates) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row_key", "masked"])

    return run


def pii_masked(df: DataFrame, key: str, text: str, secret: bytes, quote: bool = False, dates: bool = True) -> DataFrame:
    """(row_key, masked): every row with its text, mentions replaced and dates permuted."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    return narrow.mapInArrow(_mask(secret, quote, dates), f"row_key {kind}, masked string")
