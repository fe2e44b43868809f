"""Labelled training texts for the span classifier, generated from templates with invented content."""

from __future__ import annotations

from collections import Counter

import numpy as np

from .pii_spans import _TOKEN, DIGIT_WORDS, Span, Words, around, features, propose

# Building blocks of invented names and places, and sentence frames.
_HEADS = "mar bel tor ran sel vik dor lin har kas ber fen gal hol jor kel lam mor nor pel quin ros stan tam ulf ver wes yor zan al ed os ir".split()
_TAILS = "a en ia us ette o in ar el is ova man ski dottir berg field sen etti stad ley ingham court wood son well quist".split()
_STREET_TYPES = "Street St. Road Rd Avenue Ave Lane Walk Row Blvd Drive Court".split()
# Every frame is worded for this purpose: none stands in the collections the classifier is applied to (a test checks that).
_TITLES = ["Mr.", "Mrs.", "Ms.", "Miss", "Dr.", "Prof.", "Mr", "Mrs", "Dr", "Sir", "Madam"]
_NAME_FRAMES = [
    "Yours truly, {}", "cheers, {}", "~ {}", "xoxo {}", "Kindest regards {}", "Much obliged to {} in returns.", "Speak to {} at counter four.", "My seamstress {} altered it.", "I lent mine to {} afterwards.",
    "{} adored the pockets.", "{} down the hall ordered two.", "Mr. {} down the hall ordered two.", "Ms {} adored the pockets.", "Prof. {} raised an eyebrow.", "Behind the back of my roommate {}, I wore it twice.",
    "My brother-in-law {} called it years ago.", "Had a chat with {} over lunch.", "Each time aunt {} drops by, I hide it.", "[{}]", "(from {})", "warmly {}", "Written by {}", "It was a present for {} originally.", "my stylist {} swears by it",
    "Big shout-out to {}!", "{} recommended this", "according to {} it shrinks", "Dear {}, your parcel never came.", "{} signed for it.", "manager {} was rude", "Sincerely\n{}", "I saw it on {} last week.", "This one is for {} in billing.", "Check with {} first.", "Looked after by {} from the branch.", "Waiting for {} since May.", "It came with a note for {} inside.", "A parcel for {} again.", "Enquire with {} upstairs.", "- {} -", "Bye, {}", "The tag carries my friend {}'s initials.",
]
_PHONE_FRAMES = [
    "Give me a buzz at {} in the evening.", "Dial {} if the refund stalls.", "Nobody ever answers {}.", "Fax number {}, extension 40", "tel. {}", "Tel: {}", "ping me @ {}", "sms @ {}", "Our number: {}", "my cell is {}, no voicemail please",
    "viber:{}", "[{}]", "(phone {})", "{} --", "{}!", "Texting {} works at all hours", "cell {}", "phone: {}", "hotline {} hung up on me", "They list {} as their helpline.", "Contact number {}", "I left a message on {} twice", "you may ring me: {}", "sold by someone at {}",
]
_ID_FRAMES = [
    ("The driver scribbled down {} {}.", 0), ("What does a boutique want with {} {}?", 0), ("Customer care insisted on my {} {} before paying me back.", 0), ("[{} {}]", 0), ("Printed on the receipt: {} {}", 0), ("At pickup I gave {} {}", 0),
    ("{} {}", 0), ("here it is, {} {}", 0), ("Somebody stole my {} {} from their site", 0), ("verification needed {} {}, really", 0), ("{} {} is what they stored about me.", 0), ("mine is {} {}.", 0),
]
_ADDRESS_FRAMES = [
    "deliver to: {}", "Please post the new one to {}.", "UPS dropped it at {} by mistake.", "We relocated from {} last spring.", "Our place is {}, ring twice.", "Someone at {} took my box.", "[{}]", "(address: {})", "{}!", "{} --", "mailing address {}", "home: {}",
    "I am at {} all week.", "Pick it up from {}.", "their showroom, {}, is closed", "return it to {}", "The shop on {} had it cheaper.", "resident of {}", "Sender: {}", "found it lying outside {} in the rain",
]
_EMAIL_FRAMES = [
    "Drop a line to {} for pictures.", "e-mail {}", "my address is {}, cheers", "mailto:{} bounced", "paypal me via {}!", "Respond to <{}> today.", "They wanted photos so I used {}.", "[{}]", "({} preferred)", "{}!", "questions: {}", "Email me: {}", "reachable under {}", "I never got a reply from {}",
    "forwarded everything to {} already", "cc {}",
]
_DECOYS = [
    "Invoice {d3}-{d7}-{d2} got lost.", "Barcode {d10} peeled away.", "Parcel id {d4} {d3} {d4} {d4} {d2} is stuck.", "Ordered 20{t2}-0{d1}-1{d1}.", "Revision {d1}.{d1}.{d2} of the cut.", "It says {d3}-{d3}-{d1} inside the collar.", "Wash code RT-{d2} and symbol {d2} {d2}.",
    "My measurements are {d2}-{d2}-{d2} roughly.", "A blend of {d2}:{d2}.", "I take {d2}.5, width 3E, last {d3}-{d4}.", "Listing B0{d2}QT{d2} vanished.", "Style RB-{d4} is gone.", "What is {d2} supposed to be?", "style {d4} beats style {d4}", "run {d4} was stiff, run {d4} was fine",
    "after {d4} kilometres on foot", "saved {d2} percent", "We were @ the lake when it tore.", "Wrote to them thrice, silence.", "On hold for {d2} minutes.", "article {d9} missing", "release {d3}-{d4} withdrawn", "component {d3}-{d3}-{d4} snapped", "stitched at {d1} by the dot", "engraved {d11} underneath",
    "My {w} {w} parka is warmer.", "some {w} {w} knit", "Picked the {w} {w} boots", "that {w} {w} blouse pinches", "paid {d2} euros and {d2} cents", "{d2} out of {d2} wears", "Just {d1} minutes along the coast road", "near {d2} shops on the high street", "voucher {d4} {d4}",
    "Love the {w} {w} range", "the {w} {w} factory", "made in {w} {w}", 
]
# of words that many texts of a collection use; put only in texts that are given such words
_COMMON_DECOYS = [
    "My cousin {l} {l} it, no idea why.", "as my manager {l}, {l} it over dinner", "seen on {l} {l} folks", "try {l} {l} beforehand", "{w} {l} the {l} fell off", "out of my {l}, {l} with a {l} lining", "was {l} - {l} {l} by then",
    "{w} {w} {l} looks finer.", "{w} {w} {l} {l} wider", "{w} {w} label zips", "mine is {l}, {l} plus {l} rather {l}", "my trainer {l} {l} with the {l}", "so my uncle {l}, {l} and all", "my seamstress {l}, {l} batch {d4}",
    "{l} {l} {l}", "{w} {l} {l}, {l} {l}.", "as my niece {l}, {l} through the rain", "my butler {l}, {l}", "what my dentist {l}, {l}, {l}.", "my grandpa {l}. {w} {l} it", "when my pal {l}, {l} with me", "all that my florist {l}, {l} early", "{l} {l} my {l} {l}", "({l} {l})", "{l} - {l}", "{w} {l} {l} {l} {l}!",
]
_FILLER = [
    "Postage was {d2} days late but the parka survived.", "Sizing is generous, order down.", "Ten out of ten.", "The seam had {d2} dangling threads.", "Mine is teal, hers is plum.", "tiny", "superb", "Each weekend I hike in it and {d2} strangers comment.", "Their table claims {d2}, my ruler claims {d2}.",
    "Charming nurbel cloth.", "feels quorl yet tesk", "pretty zelbo gleam", "Pairs with Velbrun Linen.", "belle coupe", "bonita tela", "schöner stoff", "Keeps its shape after many washes, I must say.", "meh",
]


# Frames the classifier never sees in training, for measuring it: of other wording again.
HELD_OUT = {
    "name": ["Love from {}", "{} said no thanks.", "Meet {}, our tester.", "the couple next to us, {} and son, agreed", "It belongs to {} now", "hand it to {} please", "nurse {} wears one too", "{} - verified owner", "as told by {}", "credit goes to {}"],
    "phone": ["Best reached on {}", "WhatsApp {} for details", "office line {}", "try {} before noon", "My husband's phone, {}, was on the form", "{} (mornings)", "voicemail at {}", "number {} is dead"],
    "address": ["Warehouse at {}", "I'm living at {} now", "bring it round to {}", "the courier insisted on {}", "billing: {}", "{} is where it ended up", "neighbours of {} complained", "Visit us at {}"],
    "email": ["invoice sent to {}", "Please use {} instead", "seller's mail {} is fake", "send proof to {}.", "{} is my work account", "login {}"],
    "id_number": ["Form asked for {} {}.", "leaked: {} {}", "I typed {} {} by accident", "They photographed my card, {} {}"],
}


class _Maker:
    def __init__(self, seed: int, held_out: bool = False):
        self.g = np.random.default_rng(seed)
        self.held_out = held_out
        self.starters: set[str] = set()  # capitalised ordinary words put before names

    def pick(self, xs):
        return xs[int(self.g.integers(len(xs)))]

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.pick(first) + "".join(self.pick("0123456789") for _ in range(n - 1))

    def word(self) -> str:
        return (self.pick(_HEADS) + (self.pick(_HEADS) if self.g.random() < 0.4 else "") + self.pick(_TAILS)).capitalize()

    def fill(self, frame: str) -> str:
        out, i = [], 0
        while i < len(frame):
            if frame[i] == "{":
                j = frame.index("}", i)
                out.append(self.word() if frame[i + 1] == "w" else self.word().lower() if frame[i + 1] == "l" else self.digits(int(frame[i + 2 : j])))
                i = j + 1
            else:
                out.append(frame[i])
                i += 1
        return "".join(out)

    def name(self) -> str:
        given, family = self.word(), self.word()
        if self.g.random() < 0.12:
            family += "-" + self.word()
        if self.g.random() < 0.05:
            family = "O'" + family
        if self.g.random() < 0.08:
            family = self.pick(["von ", "de la ", "van der ", "de "]) + family
        if self.g.random() < 0.04:  # several given or family names
            given += " " + self.word()
        if self.g.random() < 0.03:
            family += " " + self.word()
        initial = chr(65 + int(self.g.integers(26))) + "."
        gap = "  " if self.g.random() < 0.1 else " "
        kind = self.g.random()
        text = f"{given}{gap}{family}" if kind < 0.5 else f"{initial} {family}" if kind < 0.65 else f"{given} {initial} {family}" if kind < 0.78 else f"{family}, {given}" if kind < 0.92 else f"{family}, {initial}"
        return text.lower() if self.g.random() < 0.12 else text.upper() if self.g.random() < 0.03 else text

    def phone(self) -> str:
        a, b, c = self.digits(3, "23456789"), self.digits(3, "23456789"), self.digits(4, "0123456789")
        dash = self.pick(["-", ".", " ", "‑", "–"])
        if self.g.random() < 0.5:
            b = "555"
        words = DIGIT_WORDS.split("|")[0:1] + DIGIT_WORDS.split("|")[2:11]
        return self.pick([
            f"({a}) {b}-{c}", f"({a}){b} {c}", f"{a}{dash}{b}{dash}{c}", f"1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"{a}{b}{c}", f"{b}-{c}", f"{b}-{c}", f"+44 (0)7{self.digits(3)} {self.digits(6)}", f"020 {self.digits(4)} {self.digits(4)}",
            "0" + " ".join([self.digits(1)] + [self.digits(2, "0123456789") for _ in range(4)]), f"+61-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}", f"+49 {self.digits(2)} {self.digits(5)} {self.digits(3)}",
            " ".join(words[int(d)] for d in b + c), f"{a}{b}{c}",
        ])

    def ident(self) -> tuple[str, str]:
        d = self.digits
        return self.pick([
            (self.pick(["SSN", "social security number:", "my social is", "ssn"]), self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9)])),
            (self.pick(["passport", "passport no."]), self.pick([f"XN{d(7)}", f"X {d(3)} {d(4)}", f"{chr(65 + int(self.g.integers(26)))}{d(7)}"])),
            (self.pick(["driving licence", "driver license"]), f"K-{d(4)}-{d(2)}-{d(4)}"),
            (self.pick(["tax ID", "tax number"]), f"0{d(1)}/{d(3)}/{d(5)}"),
            (self.pick(["NI number", "national insurance"]), self.pick([f"QQ{d(6)}A", f"QQ {d(2)} {d(2)} {d(2)} C"])),
        ])

    def address(self) -> str:
        street = " ".join(self.word() for _ in range(int(self.g.integers(1, 3))))
        street = self.pick(["", "", "", "Old ", "North ", "Cooper's "]) + street
        town = self.pick(["", "", "", "East ", "Saint ", "Lower "]) + self.word() + self.pick(["", "", "", " Bay"])
        line = f"{int(self.g.integers(1, 999))} {street} {self.pick(_STREET_TYPES)}"
        apt = f", Apt {self.digits(2)}{self.pick('ABCD')}" if self.g.random() < 0.35 else ""
        kind = self.g.random()
        if kind < 0.12:
            text = line
        elif kind < 0.5:
            text = f"{line}{apt}{self.pick([', ', ', ', chr(10)])}{town}{self.pick(['', ' 00' + self.digits(3), ', QD 00' + self.digits(3)])}"
        elif kind < 0.65:
            text = f"Flat {self.digits(1)}, {line}, {town} QX{self.digits(1)} {self.digits(1)}ZZ"
        elif kind < 0.75:
            text = f"rue {self.word()} {self.digits(2)}, 00{self.digits(3)} {town}"
        elif kind < 0.85:
            text = f"{self.word()}weg {self.digits(2)}, 00{self.digits(3)} {town}"
        else:
            text = f"P.O. Box {self.digits(3)}, {town}"
        return text.lower() if self.g.random() < 0.12 else text

    def email(self) -> str:
        a, b, host = self.word().lower(), self.word().lower(), self.pick(["mailbox", "post", "letters", "uni." + self.word().lower()])
        top = self.pick(["example", "test", "invalid", "com", "org", "net"])
        local = self.pick([f"{a}.{b}", f"{a}-{b}", f"{a}{self.digits(2)}", f"{a[0]}{b}", f"{b}_{self.digits(2)}", f"{a}.{b}+shop"])
        text = self.pick([f"{local}@{host}.{top}"] * 4 + [f"{local} @ {host}.{top}", f"{local} (at) {host}.{top}", f"{local}[at]{host.replace('.', '[dot]')}[dot]{top}", f"{a} dot {b} at {host.replace('.', ' dot ')} dot {top}"])
        return text.upper() if self.g.random() < 0.08 else text

    def text(self, mixed: bool = False) -> tuple[str, set[tuple[str, int, int]]]:
        """(text, true spans); if ``mixed``, some names stand beside a capitalised ordinary word."""
        self.starters = set()
        parts, spans, at = [], set(), 0
        for _ in range(int(self.g.integers(2, 6))):
            kind = self.g.random()
            got: tuple[str, str] | None = None
            if kind < 0.25:
                s = self.fill(self.pick(_FILLER))
            elif kind < 0.45:
                s = self.fill(self.pick(_COMMON_DECOYS if mixed and self.g.random() < 0.6 else _DECOYS))
            else:
                which = self.pick(["name", "name", "phone", "id_number", "address", "email"])
                frame = {"name": _NAME_FRAMES, "phone": _PHONE_FRAMES, "address": _ADDRESS_FRAMES, "email": _EMAIL_FRAMES}.get(which)
                frame = HELD_OUT[which] if self.held_out and frame else frame
                if frame:
                    frame, value = self.pick(frame), getattr(self, which)()
                else:
                    label, value = self.ident()
                    frame = (self.pick(HELD_OUT["id_number"]) if self.held_out else self.pick(_ID_FRAMES)[0]).replace("{}", label, 1)
                s = frame.replace("{}", value, 1)
                if mixed and which == "name" and self.g.random() < 0.15:
                    starter = self.word()
                    self.starters.add(starter.lower())
                    s = f"{starter} {s}" if self.g.random() < 0.6 else f"{s} {starter} all along"
                if which == "name" and not self.held_out and s.startswith(value) and self.g.random() < 0.3:
                    s = f"{self.pick(_TITLES)} {s}"
                got = (which, value)
            if got:
                k = s.index(got[1])
                spans.add((got[0], at + k, at + k + len(got[1])))
            sep = self.pick([" ", " ", "\n", ". ", " … ", "  "])
            parts.append(s + sep)
            at += len(parts[-1])
        return "".join(parts), spans


def _usage(text: str, true: set[tuple[str, int, int]], maker: _Maker) -> Words:
    """Words of a made-up collection the text belongs to: most words outside the spans are common, a few names too."""
    common, proper = set(maker.starters), set()
    chance = maker.g.random
    spans = {(a, b): (kind, chance()) for kind, a, b in sorted(true)}
    for m in _TOKEN.finditer(text):
        low = m[0].lower()
        kind, own = next((v for (a, b), v in spans.items() if a <= m.start() < b), ("", 0.0))
        if low in maker.starters:
            if chance() < 0.5:
                proper.add(low)
            continue
        if kind == "name":  # a name that recurs, or one word of it
            if own < 0.15 or own < 0.25 and chance() < 0.5:
                common.add(low)
                if chance() < 0.9:
                    proper.add(low)
        elif kind:
            if chance() < 0.1:
                common.add(low)
                proper.add(low)
        elif chance() < 0.97:
            common.add(low)
            if m[0][0].isupper() and chance() < 0.5:
                proper.add(low)
    return Words(common, proper)


def collection_words(texts: list[str], common: frozenset[str] = frozenset(), share: float = 0.0015) -> Words:
    """Common and mostly capitalised words of a collection: those that ``share`` of its texts use, and five."""
    n: Counter[str] = Counter()
    low: Counter[str] = Counter()
    for text in texts:
        found = {m[0] for m in _TOKEN.finditer(text)}
        n.update({w.lower() for w in found})
        low.update({w for w in found if w == w.lower()})
    many = {w for w, k in n.items() if k >= max(5, share * len(texts))}
    return Words(frozenset(many | common), frozenset(w for w in many if 2 * low[w] < n[w]))


def labelled(n_texts: int, seed: int, common: frozenset[str], mixed: bool = False, held_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, kind numbers) of the candidates of ``n_texts`` generated texts.

    If ``mixed``, seven texts of ten come from collections with common words of their own. With ``held_out`` the
    sentences are those no classifier is trained on.
    """
    from .pii_spans import KINDS

    maker = _Maker(seed, held_out)
    x, y, kinds = [], [], []
    made = []
    for _ in range(n_texts):
        drawn = mixed and maker.g.random() < 0.7
        text, true = maker.text(drawn)
        words = _usage(text, true, maker) if drawn else None
        if drawn and maker.g.random() < 0.08 and len(text.upper()) == len(text):
            text = text.upper()
        made.append((text, true, words))
    plain = Words(common)
    for text, true, words in made:
        words = words or plain
        spans = propose(text, words)
        for s, near in zip(spans, around(spans)):
            x.append(features(text, s, near, words))
            y.append(float((s.kind, s.start, s.end) in true))
            kinds.append(KINDS.index(s.kind))
    return np.array(x), np.array(y), np.array(kinds)


def frames() -> list[str]:
    """All training sentences, with their gaps."""
    return [*_NAME_FRAMES, *_PHONE_FRAMES, *(f for f, _ in _ID_FRAMES), *_ADDRESS_FRAMES, *_EMAIL_FRAMES, *_DECOYS, *_COMMON_DECOYS, *_FILLER]


def recall_of_candidates(n_texts: int, seed: int) -> float:
    """Share of the planted spans that the generators propose."""
    maker, words, hit, total = _Maker(seed), Words(), 0, 0
    for _ in range(n_texts):
        text, true = maker.text()
        found = {(s.kind, s.start, s.end) for s in propose(text, words)}
        hit += len(true & found)
        total += len(true)
    return hit / max(total, 1)


__all__ = ["Span", "labelled", "recall_of_candidates"]
