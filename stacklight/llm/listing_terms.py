"""What a listing says: measures in common units, stated phrases, and the words of its title.

Nothing here knows a brand, a kind of garment, a colour, a material or a slogan. The syntax of statements is
general (list items, ``label: value``, ``value (label)``, values divided by semicolons); the only vocabulary is that
of numbers, units, counting words and standard size codes. Which wordings mean the same is learned in ``products``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Standard size codes and the ways they are written.
SIZES = {
    "xs": ["xs", "x-small", "extra small"],
    "s": ["s", "small"],
    "m": ["m", "medium"],
    "l": ["l", "large"],
    "xl": ["xl", "x-large", "extra large"],
    "2xl": ["2xl", "xxl", "xx-large"],
    "3xl": ["3xl", "xxxl", "xxx-large"],
    "4xl": ["4xl", "xxxxl", "xxxx-large"],
    "one size": ["one size", "one size fits most", "one size fits all", "os"],
}
# Numerals, and millimetres per unit of length.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4}

_NUMERAL = "|".join(NUMBERS)
_TAG = re.compile(r"<[^<>]*>")
_SPACE = re.compile(r"\s+")
_LENGTH = re.compile(r"(?<![\w.])(\d+(?:\.\d+)?)\s*-?\s*(cm|mm|m|inches|inch|in|\")(?![\w])")
#: A numeral hyphenated to "piece" says how a garment is cut ("two-piece suit"), not how many there are.
_CUT = re.compile(rf"\b({_NUMERAL})-piece(?=\s+\w)")
_PIECES = re.compile(
    rf"(?<![\w.])(?:(?:pack|set)(?:\s+of)?\s+(\d+|{_NUMERAL})(?:\s*-?\s*(?:pack|packs|pk|pcs|pc|pieces|piece|count|ct))?"
    rf"|(\d+|{_NUMERAL})\s*-?\s*(?:pack|packs|pk|pcs|pc|pieces|piece|count|ct)|x\s?(\d+)|(\d+)\s?x|(single))(?![\w])"
)
_SIZE_NUMBER = re.compile(r"(?<![\w.])(?:size:?\s*)*(?:eu\s*(\d{2})|(\d{2})\s*eu|size:?\s*(\d{2}))(?![\w])")
_SIZE_OF = {re.sub(r"[- ]", " ", w): code for code, written in SIZES.items() for w in written}
_SIZE = re.compile(rf"(?<![\w&-])(?:size:?\s*)*({'|'.join(w.replace(' ', '[- ]') for w in sorted(_SIZE_OF, key=len, reverse=True))})(?![\w&-])")
_CODE = re.compile(r"(?:\b(?:style|model)\s+)*#?(?<![\w])[a-z]{1,3}[- ]?\d{3,}(?![\w])")
_RUN = re.compile(r"[^\w\s%&-]+|_|\s-+\s|\|")
_WORD = re.compile(r"[^\W_]+%?|&")
_ITEM = re.compile(r"<li[^<>]*>(.*?)</li>", re.I | re.S)
_LABELLED = re.compile(r"^([^:;.!?]{1,60}):\s*(.+)$", re.S)
_BACK = re.compile(r"^([^()!?]{1,80})\(([^()]{1,30})\)$", re.S)


def clean(text: str | None) -> str:
    """Lower case, entities resolved, tags and odd blanks as single blanks, apostrophes dropped."""
    text = html.unescape(html.unescape(text or ""))
    text = _TAG.sub(" ", text).replace("’", "").replace("‘", "").replace("'", "").replace("“", " | ").replace("”", " | ")
    return _SPACE.sub(" ", text).strip().lower()


def _count(text: str) -> int:
    return NUMBERS.index(text) + 1 if text in NUMBERS else 1 if text == "single" else int(text)


class Measures:
    """Length in millimetres, number of pieces and size: the first that is told of each."""

    def __init__(self) -> None:
        self.length: float | None = None
        self.pieces: int | None = None
        self.size: str | None = None

    def take(self, text: str) -> str:
        """Note the measures in a cleaned text; the text with bars in their place, model codes taken out."""

        def length(m: re.Match) -> str:
            if self.length is None:
                self.length = round(float(m[1]) * UNITS[m[2]], 2)
            return " | "

        def pieces(m: re.Match) -> str:
            if self.pieces is None:
                self.pieces = min(_count(next(g for g in m.groups() if g)), 2**31 - 1)
            return " | "

        def size(m: re.Match) -> str:
            if self.size is None:
                told = next(g for g in m.groups() if g)
                self.size = _SIZE_OF.get(re.sub(r"[- ]", " ", told), told)
            return " | "

        text = _LENGTH.sub(length, text)
        text = _SIZE_NUMBER.sub(size, text)
        text = _CODE.sub(" | ", text)
        text = _CUT.sub(r"\1cut", text)
        text = _PIECES.sub(pieces, text)
        return _SIZE.sub(size, text)


def runs(text: str) -> list[str]:
    """The stretches of words between punctuation, words parted by one blank."""
    found = (" ".join("and" if w == "&" else w for w in _WORD.findall(part)) for part in _RUN.split(text))
    return [r for r in found if r]


def statements(paragraph: str | None) -> Iterator[tuple[str, str]]:
    """(label or '', value) of every statement in a description paragraph; plain sentences state nothing."""
    items = _ITEM.findall(html.unescape(html.unescape(paragraph or "")))
    if items:
        for item in items:
            label, _, value = clean(item).partition(" ")
            if value:
                yield label.rstrip(":"), value
        return
    text = clean(paragraph)
    if m := _LABELLED.match(text):
        label, value = m[1], m[2].rstrip(". ")
    elif m := _BACK.match(text):
        label, value = m[2], m[1]
    elif ";" in text:
        label, value = "", text.rstrip(". ")
    else:
        return
    for part in value.split(";"):
        inner = _LABELLED.match(part.strip()) if ";" in value else None
        yield (inner[1], inner[2]) if inner else (label if ";" not in value else "", part.strip())


def listing(title: str | None, description: list[str | None] | None) -> tuple[Measures, list[str], list[str]]:
    """(measures, runs of the title, phrases stated in the description). Nothing told means one piece."""
    told = Measures()
    title_runs = runs(told.take(clean(title)))
    said: list[str] = []
    for paragraph in description or []:
        for label, value in statements(paragraph):
            said.extend(runs(told.take(f"{label} {value}" if value.isdigit() else value)))
    if told.pieces is None:
        told.pieces = 1
    return told, title_runs, said


class Phrases:
    """A vocabulary of phrases: splits a run of words into the longest phrases it knows, single words otherwise."""

    def __init__(self, known: set[str]) -> None:
        self.known = known
        self.longest: dict[str, int] = {}
        for phrase in known:
            words = phrase.split(" ")
            self.longest[words[0]] = max(self.longest.get(words[0], 1), len(words))

    def split(self, run: str) -> list[tuple[str, bool]]:
        """(phrase, whether it is known) from left to right."""
        words, out, i = run.split(" "), [], 0
        while i < len(words):
            for n in range(min(self.longest.get(words[i], 0), len(words) - i), 0, -1):
                phrase = " ".join(words[i : i + n])
                if phrase in self.known:
                    out.append((phrase, True))
                    i += n
                    break
            else:
                out.append((words[i], False))
                i += 1
        return out

    def rest(self, run: str) -> list[str]:
        """The stretches that known phrases leave of a run."""
        out: list[list[str]] = [[]]
        for phrase, known in self.split(run):
            if known:
                out.append([])
            else:
                out[-1].append(phrase)
        return [" ".join(words) for words in out if words]


def ngrams(run: str, longest: int = 4) -> Iterator[str]:
    """All sequences of up to ``longest`` words of a run."""
    words = run.split(" ")
    for n in range(1, longest + 1):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i : i + n])


def whole_phrases(counts: dict[str, int], share: float) -> set[str]:
    """The sequences of several words that belong together: wherever one is cut, the rarer of the
    two sides occurs within it in at least ``share`` of its occurrences."""
    kept = set()
    for phrase, n in counts.items():
        words = phrase.split(" ")
        cuts = ((" ".join(words[:i]), " ".join(words[i:])) for i in range(1, len(words)))
        if len(words) > 1 and all(n >= share * min(counts.get(x, n), counts.get(y, n)) for x, y in cuts):
            kept.add(phrase)
    return kept
