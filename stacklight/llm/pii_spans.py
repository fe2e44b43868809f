"""Candidate spans of personal information and the features that judge them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

KINDS = ["email", "phone", "id_number", "address", "name"]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    form: int  # number of the pattern that proposed it


# Number words of spelled-out numbers, kinds of streets, parts of place names.
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple"
STREETS = "street|st|road|rd|avenue|ave|lane|ln|walk|row|boulevard|blvd|drive|dr|court|ct|way|place|pl|close|terrace|crescent|square|sq|highway|hwy|alley|parkway|pkwy"
PLACE_PARTS = "east|west|north|south|upper|lower|saint|st\\.?|new|old|great|little|port|mount|fort|san|santa|el|la|los|bad|sankt"

_AT = r"(?:\s*@\s*|\s*[\(\[\{]\s*at\s*[\)\]\}]\s*)"
_DOT = r"(?:\.|\s*[\(\[\{]\s*dot\s*[\)\]\}]\s*)"
_EMAILS = [
    re.compile(rf"[\w+-]+(?:{_DOT}[\w+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I),
    re.compile(r"(?<![\w.])[\w+-]+(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+", re.I),
]
_D = r"[-.‐-― ]"
_PHONES = [
    re.compile(rf"(?<![\w+])\+\d{{1,3}}{_D}?(?:\(0\) ?)?(?:\(?\d{{1,5}}\)?{_D}?){{1,5}}\d{{2,4}}(?!\w)"),
    re.compile(rf"(?<![\w+/.-])(?:1{_D})?\(\d{{2,5}}\) ?\d{{3,4}}{_D}?\d{{3,4}}(?!\w)"),
    re.compile(rf"(?<![\w+/.-])(?:1{_D})?\d{{3}}{_D}\d{{3}}{_D}\d{{4}}(?![\w/])"),
    re.compile(r"(?<![\w+/.-])0\d{2,4} \d{3,4} \d{3,4}(?![\w/])|(?<![\w+/.-])0\d(?: \d\d){4}(?![\w/])"),
    re.compile(r"(?<![\w+/.-])\d{10,11}(?![\w/.-])"),
    re.compile(r"(?<![\w+/.-])\d{3}[-.‐-― ]\d{4}(?![\w/-])"),
    re.compile(rf"\b(?:(?:{DIGIT_WORDS})[\s,-]+){{6,14}}(?:{DIGIT_WORDS})\b", re.I),
    # proposed for the sake of recall, seldom kept
    re.compile(rf"(?<![\w+/.-])\d{{2,5}}(?:{_D}\d{{2,5}}){{1,4}}(?![\w/])"),
]
_IDS = [
    re.compile(r"(?<![\w/-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w/-])"),
    re.compile(r"(?<![\w/.-])\d{9}(?![\w/.-])"),
    re.compile(r"(?<![\w-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.I),
    re.compile(r"(?<![\w-])[A-Z]{1,2}[ -]?\d{3}[ -]?\d{4}(?![\w-])", re.I),
    re.compile(r"(?<![\w-])[A-Z]{1,2}-\d{3,4}-\d{2}-\d{4}(?![\w-])", re.I),
    re.compile(r"(?<![\w/])\d{2,3}/\d{3}/\d{4,5}(?![\w/])"),
    re.compile(r"(?<![\w/.-])[A-Z]{0,2}\d[\d/ -]{4,14}\d[A-Z]?(?![\w/-])", re.I),
]
_W = r"[^\W\d_][\w'’-]*"
_TOWN = rf"(?:(?:{PLACE_PARTS})[ ]+)?{_W}(?:[ ]+{_W})?"
_CODE = r"(?:[A-Z]{2},? )?\d{4,5}|[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}"
_STREET = rf"\d{{1,5}}[A-Za-z]?,?[ ]+(?:{_W}[ ]+){{1,3}}?(?:st\b\.?|(?:{STREETS})\b)"
_APT = r"(?:,[ ]*(?:apt|apartment|unit|suite|ste|flat|no|#)\.?[ ]*#?\d\w{0,4})?"
_ADDRESSES = [
    re.compile(rf"(?<![\w-])(?:(?:flat|apt|unit|apartment|suite)\.?[ ]+\w{{1,4}},?[ ]+)?{_STREET}{_APT}", re.I),
    re.compile(rf"(?<![\w-])(?:rue|via|calle|rua|avenue|place)[ ]+(?:{_W}[ ]+){{1,2}}?\d{{1,4}}(?!\w)", re.I),
    re.compile(r"(?<![\w-])[^\W\d_]{3,}(?:weg|stra(?:ss|ß)e|gasse|allee|platz|straat|laan)[ ]+\d{1,4}(?!\w)", re.I),
    re.compile(r"(?<!\w)P\.? ?O\.? ?Box[ ]+\d{1,6}(?!\w)", re.I),
]
_TAIL = re.compile(r"(?P<sep>,[ ]*|[ ]*\n[ ]*|[ ]+)(?P<rest>[^\n]*)")
_POST_FIRST = re.compile(r"(?:,[ ]*|[ ]*\n[ ]*|[ ]+)(\d{4,5})[ ]+")
_CODE_NEXT = re.compile(rf"(?:,[ ]*|[ ]*\n[ ]*|[ ]+)(?:{_CODE})(?!\w)", re.I)
_PLACE_PART = re.compile(rf"(?:{PLACE_PARTS})$", re.I)

_T = r"[^\W\d_]++(?:['’\-‐‑][^\W\d_]++)*+"
_TOKEN = re.compile(_T)
_GAP = re.compile(r"(\.?)(,?)([  ]{1,2})$|^(\.?)(,)[  ]{0,2}$")

# Words around spans that speak for or against a kind.
CUES = {
    "phone": "call ring phone phoned tel telephone fax whatsapp number reach mobile cell text dial sms contact",
    "id_number": "ssn social security passport licence license driving tax id insurance national ni number",
    "address": "send ship shipped moved live lives parcel address delivered left went to at from replacement",
    "name": "signed regards thanks ask tailor gave mr mrs ms dr miss sir madam dear by named called colleague neighbour neighbor landlady landlord boss coach friend",
    "email": "mail email mailto write contact answer reach sent goes to at",
    "other": "order sku tracking model style tag size label version article lot ratio bought fits code width item serial batch page number no care",
}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
_NAME_AFTER = frozenset("liked next fixed".split())
_AFTER = frozenset("liked next fixed from at in if works thanks soon after and".split())
# Function words, number words, days and months, titles, and the labels of documents and addresses. What else
# is ordinary is counted in the collection.
ORDINARY = frozenset(
    "the a an and or but if of in on at to for with from by as is it its this that these those was were be been are am i you he she we they me my your his her our "
    "their not no yes so too very just only even all any some each every more most much many few little one two three four five six seven eight nine ten zero first "
    "last next other another same such own than then there here when where while who whom whose which what why how up down out off over under again once after before "
    "between near against because until unless about around into through during without within mostly rather quite really still also already never always often maybe "
    "do does did done has have had having will would can could should may might must shall "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december mr mrs ms dr miss sir "
    "social security national insurance driving licence license passport tax flat apt apartment unit suite rue via calle regards signed thanks dear".split()
)


# Particles that belong to the family name after them.
_PARTICLES = frozenset("von van der den de del della di da dos du la le ten ter zu zur bin ibn al".split())
_PLAIN_FIXED = frozenset(w for w in ORDINARY | frozenset(STREETS.split("|")) if len(w) > 1) - _PARTICLES


_NAME_GAP = re.compile(r"(\.?)(,?)[ \xa0]{1,2}")
_DASHES = frozenset("(-–—")
_FIXED = ORDINARY | frozenset(STREETS.split("|"))


# What a word may be to a name: part of it, an initial, one that is uncommon, begins large, is large at the start alone; a
# particle; a word that speaks for a name before or after it.
_PART, _INITIAL, _UNCOMMON, _UP, _CAPITAL, _PARTICLE, _CUE, _NEXT = (1 << k for k in range(8))
_OF_NAME = _PART | _INITIAL | _UNCOMMON | _UP | _CAPITAL


def _having(bits: int) -> str:
    """A class of the codes that have all of the bits."""
    return "[" + "".join(chr(0x100 + c) for c in range(256) if c & bits == bits) + "]"


#: Word codes without which no neighbouring words are a candidate, unless a bracket, dash or line end speaks for them.
_SPOKEN_FOR = re.compile(
    f"{_having(_PART | _UNCOMMON)}{{2}}|{_having(_PART | _CAPITAL)}{{2}}|{_having(_CUE)}{_having(_PART)}{{2}}|{_having(_PART)}{{2,3}}{_having(_NEXT)}"
)
_ANY_PARTICLE = re.compile(_having(_PARTICLE))
_TWO_PARTS, _PARTS = re.compile(f"{_having(_PART)}{{2}}"), re.compile(f"{_having(_PART)}{{2,}}")
_BLANK = r"[ \xa0]"
_AFTER_DASH = re.compile(rf"[(\-–—](?:(?![^\W\d_])|(?<![^\W\d_]-)){_BLANK}{{0,3}}{_T}\.?,?{_BLANK}{{1,2}}{_T}")
_LINE = rf"{_T}(?:\.?,?{_BLANK}{{1,2}}{_T}){{1,2}}(?=\n|\Z)"
_FIRST_LINE, _NEXT_LINE, _INDENTED = re.compile(rf"{_BLANK}{{0,3}}{_LINE}"), re.compile(rf"\n{_BLANK}{{0,3}}{_LINE}"), re.compile(rf"{_BLANK}{{4}}{_LINE}")
_SHAPES = {"ww": 0, "iw": 1, "wiw": 2, "w,w": 3, "w,i": 4, "w,wi": 5, "iiw": 6, "w,ii": 7, "www": 8}


class Codes(dict):
    """Code of every word met, a character each; forgotten when there are too many. A code may promise more than its place in a text keeps."""

    MOST = 1 << 17

    def __init__(self, common: frozenset[str] | set[str]):
        self.common = common

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        low, code = word.lower(), 0
        if len(word) == 1:
            code = _PART | _INITIAL | _UNCOMMON | _CAPITAL | _UP * word.isupper()
        elif low not in _FIXED:
            up = word[0].isupper()
            code = _PART | _UNCOMMON * (low not in self.common) | _UP * up | _CAPITAL * (up and not word.isupper())
        code |= _PARTICLE * (low in _PARTICLES) | _CUE * (low in _CUES["name"]) | _NEXT * (low in _NAME_AFTER)
        self[word] = out = chr(0x100 + code)
        return out

    def of(self, text: str) -> str:
        return "".join(map(self.__getitem__, _TOKEN.findall(text)))


class Words:
    """Which words are ordinary: the fixed ones and those that many records of the collection use.

    ``proper`` are the common ones that are mostly capitalised: brands, places, names that recur.
    """

    def __init__(self, common: frozenset[str] | set[str] = frozenset(), proper: frozenset[str] | set[str] = frozenset()):
        self.common = common - _FIXED
        self.ordinary = _FIXED | common
        self.plain = self.ordinary - (proper - _FIXED)
        self.codes = Codes(self.common)

    def rare(self, word: str) -> bool:
        return len(word) > 1 and word.lower() not in self.ordinary


def _address_ends(text: str, end: int, first: int, words: Words) -> list[int]:
    """Ends an address may have that reaches at least to ``end``: street, then town, then code."""
    ends = [end]
    if m := _POST_FIRST.match(text, end):
        at, need = m.end(), True
    else:
        m = re.compile(r"(,[ ]*|[ ]*\n[ ]*|[ ]+)").match(text, end)
        at, need = (m.end(), False) if m else (end, False)
    town, count, after_part = at, 0, False
    title = text[first:end] != text[first:end].lower()
    # a town in small letters has no sign of where it ends but the next ordinary word: three words at most
    while at > end and (title or count < 3) and (t := _TOKEN.match(text, town if count == 0 else town + 1)):
        if count and text[town] != " ":
            break
        part = bool(_PLACE_PART.match(t[0]))
        known = t[0].lower() in (ORDINARY if title or after_part else words.ordinary)
        if known and not part or title and not t[0][0].isupper() or text[t.end() : t.end() + 1].isdigit():
            break
        after_part = part
        town, count = t.end(), count + 1
        if text[town : town + 1] != " ":
            break
    if count:
        ends.append(town)
        if not need and (c := _CODE_NEXT.match(text, town)):
            ends.append(c.end())
    elif not need and (c := _CODE_NEXT.match(text, end)):
        ends.append(c.end())
    return ends


def _stand_out(text: str, codes: Codes) -> bool:
    """Whether two words that could be a name follow a bracket or dash, or fill a line. Particles aside."""
    found = list(_AFTER_DASH.finditer(text))
    if m := _FIRST_LINE.match(text):
        found.append(m)
    if "\n" in text:
        found += _NEXT_LINE.finditer(text)
    if "    " in text or "\xa0" in text:
        found += _INDENTED.finditer(text)
    return any(_TWO_PARTS.search(codes.of(m[0])) for m in found)


def names(text: str, words: Words) -> list[Span]:
    """Neighbouring words that could be a person's name, with initials, in either order.

    Words the collection uses often count too where they are capitalised or a cue stands
    beside them; how ordinary they are is left to the trees. Most texts hold no candidate,
    which the codes of their words tell without a look at each.
    """
    known = words.codes.of(text)
    particles = _ANY_PARTICLE.search(known) is not None
    apart = particles or _stand_out(text, words.codes)
    if not apart and not _SPOKEN_FOR.search(known):
        return []
    found = [m.span() for m in _TOKEN.finditer(text)]
    if particles:
        return _names_among(text, found, known, True)
    out: list[Span] = []
    for m in _PARTS.finditer(known):  # with the word before and the word after, which may speak for a name
        at, end = max(0, m.start() - 1), m.end() + 1
        if apart or _SPOKEN_FOR.search(known, at, end):
            out += _names_among(text, found[at:end], known[at:end], apart)
    return out


def _names_among(text: str, found: list[tuple[int, int]], known: str, apart: bool) -> list[Span]:
    """Names among neighbouring words and their codes; ``apart`` if a bracket, dash or line may speak for one."""
    out: list[Span] = []
    tokens: list[tuple[int, int]] = []
    codes: list[int] = []
    particle = -1  # start of the particles before the next word
    for (a, e), code in zip(found, known):
        code = ord(code) - 0x100
        if code & (_PART | _PARTICLE):
            follows = text[e : e + 1]
            if code & _PARTICLE and follows == " ":
                particle = a if particle < 0 else particle
                continue
            if code & _INITIAL and follows != "." or follows.isdigit() or text[a - 1 : a].isdigit():
                code &= ~_OF_NAME
            elif particle >= 0 and code & _PART and not code & _INITIAL:
                a = particle
        tokens.append((a, e))
        codes.append(code)
        particle = -1
    n = len(tokens)

    # the last word of the unbroken run of capitalised name words from each word on
    ends = list(range(n))
    for i in range(n - 2, -1, -1):
        gap = codes[i] & codes[i + 1] & _UP and _NAME_GAP.fullmatch(text[tokens[i][1] : tokens[i + 1][0]])
        if gap and (codes[i] & _INITIAL or not gap[1]):
            ends[i] = ends[i + 1]
    for i in range(n - 1):
        both = codes[i] & codes[i + 1]
        if not both & _PART:
            continue
        # names of more than three words: a whole run of capitalised ones
        if ends[i] - i > 2 and (not i or ends[i - 1] != ends[i]) and all(c & _CAPITAL for c in codes[i : ends[i] + 1]):
            out.append(Span("name", tokens[i][0], tokens[ends[i]][1], 9))
        left = ""  # what stands before the first word, looked at only if it must be
        for length in (2, 3):
            j = i + length
            if j > n or not codes[j - 1] & _PART:
                break
            if not both & codes[j - 1] & (_UNCOMMON | _CAPITAL):
                # common words: only if a word beside them speaks for a name, or they follow a bracket or dash or fill a line
                if not (i and codes[i - 1] & _CUE or j < n and codes[j] & _NEXT):
                    if not apart:
                        continue
                    left = left or text[max(0, tokens[i][0] - 4) : tokens[i][0]].rstrip(" \xa0")[-1:] or "\n"
                    if left not in _DASHES and (left != "\n" or text[tokens[j - 1][1] : tokens[j - 1][1] + 1] not in ("", "\n")):
                        continue
            gaps = [text[tokens[k][1] : tokens[k + 1][0]] for k in range(i, j - 1)]
            if any(g != " " and (not (m := _NAME_GAP.fullmatch(g)) or (m[1] == "." and not codes[i + k] & _INITIAL)) for k, g in enumerate(gaps)):
                break
            kinds = ["i" if c & _INITIAL else "w" for c in codes[i:j]]
            shape = "".join(k + ("," if "," in g else "") for k, g in zip(kinds, gaps)) + kinds[-1]
            form = _SHAPES.get(shape)
            if form is not None:
                out.append(Span("name", tokens[i][0], tokens[j - 1][1] + (shape[-1] == "i"), form))
    return out


def propose(text: str, words: Words) -> list[Span]:
    """All candidate spans of a text, overlapping ones included. High recall is the aim."""
    out: list[Span] = []
    low = text.lower()
    if "@" in text or "at" in low and ("dot" in low or "(at" in low or "[at" in low or "{at" in low):
        for k, p in enumerate(_EMAILS):
            out += [Span("email", *m.span(), k) for m in p.finditer(text)]
    digit = _DIGIT.search(text) is not None
    if digit and _DENSE.search(text):
        for k, p in enumerate(_PHONES):
            if k != 6:
                out += [Span("phone", *m.span(), k) for m in p.finditer(text)]
        for k, p in enumerate(_IDS):
            out += [Span("id_number", *m.span(), k) for m in p.finditer(text)]
    if sum(map(low.count, _DIGIT_WORDS)) > 6 and len(_DIGIT_WORD.findall(low)) > 6:
        out += [Span("phone", *m.span(), 6) for m in _PHONES[6].finditer(text)]
    for k, hints in enumerate(_HINTS):
        if digit and (_SPACED if k else _NUMBERED).search(text) and any(h in low for h in hints):
            for m in _ADDRESSES[k].finditer(text):
                out += [Span("address", m.start(), e, k) for e in _address_ends(text, m.end(), m.start(), words)]
    return out + names(text, words)


#: Six digits close together: without them there is no number to judge.
_DENSE = re.compile(r"\d(?:[-. ()/‐-―]{0,2}\d){5}")
_DIGIT_WORD = re.compile(rf"\b(?:{DIGIT_WORDS})\b")
_DIGIT_WORDS = DIGIT_WORDS.split("|")
#: Every phone number in digits, id number and address has a digit: the first kind of address before its street, the others after a blank.
_DIGIT = re.compile(r"\d")
_NUMBERED = re.compile(rf"\d(?i:[A-Za-z]?,?[ ]+(?:{_W}[ ]+){{1,3}}?(?:{STREETS})\b)")
_SPACED = re.compile(r" \d")
#: What a text must hold for each address pattern to be tried; the kinds of streets follow a word.
_HINTS = [[f" {w}" for w in STREETS.split("|")], ["rue ", "via ", "calle ", "rua ", "avenue ", "place "], ["weg ", "strasse ", "straße ", "gasse ", "allee ", "platz ", "straat ", "laan "], [" box "]]

_BEFORE = re.compile(r"[\w']+")


#: Spans beyond this length are looked at from everywhere; there can't be many.
_LONG = 400


def around(spans: list[Span]) -> list[list[Span]]:
    """For every span the others that may hold it: those that start shortly before or where it starts."""
    order = sorted(range(len(spans)), key=lambda i: spans[i].start)
    starts = [spans[i].start for i in order]
    long = [s for s in spans if s.end - s.start > _LONG]
    out = []
    for s in spans:
        a, b = bisect_left(starts, s.start - _LONG), bisect_right(starts, s.start)
        out.append([o for o in (spans[i] for i in order[a:b]) if s.end <= o.end <= o.start + _LONG] + long)
    return out


# a full stop after "no", an initial or a title ends no sentence
_BREAK = re.compile(r"(?<!\bno)(?<!\b\w)(?<!\bmr)(?<!\bms)(?<!\bdr)(?<!\bst)(?<!\bmrs)(?<!\bprof)[.!?…][\s\xa0]+|\n|<br ?/?>|…")


def features(text: str, span: Span, others: list[Span], words: Words) -> list[float]:
    """Format and context of one candidate."""
    body = text[span.start : span.end]
    left = _BREAK.split(text[max(0, span.start - 60) : span.start].lower())[-1]
    right = text[span.end : span.end + 24].lower()
    before = _BEFORE.findall(left)[-4:]
    after = _BEFORE.findall(right)[:2]
    near = set(before)
    last = before[-1] if before else ""
    n_digits = sum(c.isdigit() for c in body)
    n_letters = sum(c.isalpha() for c in body)
    tokens = _TOKEN.findall(body)
    groups = [len(g) for g in re.findall(r"\d+", body)]
    caps = sum(t[0].isupper() for t in tokens)
    inside = longer = same_start = 0
    for o in others:
        if o is not span and o.start <= span.start and o.end >= span.end and (o.end - o.start) > (span.end - span.start):
            longer += o.kind == span.kind
            inside += o.kind != span.kind
            same_start += o.kind == span.kind and o.start == span.start
    one_hot = [float(span.kind == k) for k in KINDS]
    return one_hot + [
        float(span.form), float(len(body)), float(n_digits), float(n_letters), float(len(tokens)), float(len(groups)), float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
        float(caps), float(caps == len(tokens) > 0), float(body.isupper()), float(body.islower()), float("555" in body), float(body[:1] in "+(0"),
        float("\n" in body), float("," in body), float("@" in body), float("." in body),
        *[float(bool(near & c)) for c in _CUES.values()],
        *[float(last in c) for c in _CUES.values()],
        float(bool(after) and after[0] in _AFTER), float(any(w in _CUES["other"] for w in before[-2:])),
        float(left[-1:] in "(<:-"), float(not left.strip()), float(right[:1] in ")>.,!;\n" or not right), float(right[:2] == " -" or right[:2] == " \n"),
        float(longer), float(inside), float(same_start), float(sum(words.rare(t) for t in tokens)), float(sum(len(t) == 1 for t in tokens)),
        float(bool(re.search(r"\d{4}-\d\d-\d\d", body))), float(last in ("the", "a", "an", "this")),
        float(sum(t.lower() in words.plain for t in tokens)),
    ]
