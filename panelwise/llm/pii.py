"""Personal data: fixed patterns, and a semi-Markov conditional random field for what is written otherwise.

The patterns give the base spans, which always stay. In the gaps between them stand
candidate segments: runs of digit groups, and addresses with written-out at-signs
and dots. A semi-Markov conditional random field scores whole segments: checksum,
octets, grouping of the digits, separators, dates and book numbers, the characters
on both sides and words before. A dynamic program over each cluster of overlapping
candidates chooses boundaries and types together; everything else is outside.

Digit groups that stand without a blank between them are one unit, which is never
cut, and a run is units with one or two blanks or signs between them. Candidates are
all parts of a run, however long it is, that hold as many digits as a phone or card
may have; so a unit begins at most some tens of them. When spans are looked for, parts
whose shape and sides cannot reach a score above 0, whatever the digits and the words
before, are passed over: the dynamic program never takes such a segment. Local parts of more than 64 characters and addresses of more than 400 are no
candidates. The weights are learned by maximising the conditional likelihood on
seeded sentences that are made up by rule, as there are no labelled rows for it.

Null and empty texts have no spans. Whole texts are read; time is linear in their
length, number tables included. Each row stands for itself, repeated or not, with or without an id.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import merge
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from panelwise.llm.common import bounded, col, slices, strings

KINDS = ("email", "ip", "card", "phone")
LONGEST, LONGEST_LOCAL = 400, 64
FEW_UNITS, MOST_SHAPES = 8, 200_000  # units of a short run in training, bounds of shapes known at a time
SENTENCES, EPOCHS, RATE, DECAY = 2000, 6, 0.3, 1e-3
Span = tuple[int, int, int]  # kind, start, end
Candidate = tuple[int, int, int, bool]  # start, end, kind, whether it is a whole run
Weights = dict[str, float]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) <= 255)


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at-sign, so that long runs of letters cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((0, start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out = _emails(text)
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if len(digits) <= 19 and len(digits) >= 16 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """Stretches that spans of any kind cover, in order and apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


# --- candidate segments

LEAST_DIGITS, MOST_DIGITS, WORD_SPAN = 7, 20, 16
_AT, _DOT = r"\s?[(\[{]\s?at\s?[)\]}]\s?", r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\s?[(\[]dot[)\]]\s?)[0-9]{1,3}){3}(?![0-9])", re.I)
_NUMBERS = re.compile(r"(?:\+\(|\+|\()?[0-9]++(?:[ ()./-]{1,3}+[0-9]++)*+\)?")
_UNIT = re.compile(r"[^ ]+")
_CARD_SHAPE = re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){12,18}")
_PHONE_SHAPE = re.compile(r"(?:\+|00)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}")
_AT_SIGN = re.compile(_AT, re.I)
_DOMAIN_PART = re.compile(rf"([A-Za-z0-9-]+)({_DOT}(?=[A-Za-z0-9-]))?", re.I)
_MORE = re.compile(_DOT + "[A-Za-z0-9-]", re.I)
_ALIKE = str.maketrans("123456789", "000000000")
_OF_DIGITS = (" date", " book", " zero", " luhn", " same")
_WORDS = re.compile(r"(tel|phone|call|fon|mobil|fax|card|visa|karte|carte|tarjeta|mail|host|server|ip|isbn|version|order|page)\w*\W{0,3}$", re.I)


def _side(text: str, place: int) -> str:
    if not 0 <= place < len(text):
        return "edge"
    c = text[place]
    return "blank" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else "stop" if c in ",;!?." else c


def _date(groups: list[str]) -> bool:
    """Whether three groups in a row are a day of the years 1900 to 2099."""
    for a, b, c in zip(groups, groups[1:], groups[2:]):
        for y, m, d in ((a, b, c), (c, b, a), (c, a, b)):
            if len(y) == 4 and 1900 <= int(y) <= 2099 and len(m) <= 2 and 1 <= int(m) <= 12 and len(d) <= 2 and 1 <= int(d) <= 31:
                return True
    return False


def _book(digits: str) -> bool:
    """Whether the check digit is that of a book number."""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(d) * (1 + 2 * (i % 2)) for i, d in enumerate(digits)) % 10 == 0
    return len(digits) == 10 and sum(int(d) * (10 - i) for i, d in enumerate(digits)) % 11 == 0


def features(text: str, candidate: Candidate) -> list[str]:
    """Features of a whole candidate segment; every one names the kind."""
    start, end, kind, whole = candidate
    span = text[start:end]
    groups = [g for g in _NOT_DIGIT.split(span) if g]
    digits = "".join(groups)
    between = "".join(sorted(set(_NOT_DIGIT.findall(span)))) if kind else ""
    out = ["bias", f"left {_side(text, start - 1)}", f"right {_side(text, end)}"]
    if kind == 0:
        out += [f"dots {min(len(re.findall(_DOT, span, re.I)), 3)}", f"wide {len(span) > 64}", f"more {bool(_MORE.match(text, end))}"]
    else:
        shape = "-".join(str(len(g)) for g in groups)
        out += [f"shape {shape}", f"between {between[:8]}", f"digits {min(len(digits), 20)}", f"groups {min(len(groups), 6)}"]
        out += [f"whole {whole}", f"date {_date(groups)}", f"book {_book(digits)}", f"zero {span[:1] == '0'} {len(digits) > 8}"]
    if kind == 1:
        out += [f"octets {all(map(_octet, groups))}"]
    if kind == 2:
        out += [f"luhn {luhn(digits)} {16 <= len(digits) <= 19}", f"same {len(set(digits)) == 1}"]
    if kind == 3:
        out += [f"paren {'(' in span and ')' in span}", f"open {span.count('(') - span.count(')')}"]
    word = _WORDS.search(text, max(0, start - WORD_SPAN), start)
    out.append(f"word {word.group(1).lower() if word else '-'}")
    return [f"{KINDS[kind]} {f}" for f in out]


@lru_cache(MOST_SHAPES)
def _shapes(part: str) -> tuple[tuple[int, int, int], ...]:
    """(start, end, kind) of what a part of a run may be, from its shape: digits stand as zeros."""
    end = len(part.rstrip(" ()./-"))
    start = len(part) - len(part.lstrip(" )./-"))
    if not LEAST_DIGITS <= part.count("0", start, end) <= MOST_DIGITS:
        return ()
    first = start + (part[start] == "(")
    card = ((first, end, 2),) if _CARD_SHAPE.fullmatch(part, first, end) else ()
    return (*card, (start, end, 3)) if _PHONE_SHAPE.fullmatch(part, start, end) else card


class Hopeful:
    """Which shapes may score above 0 under some weights, whatever the digits are.

    Features that the shape and its sides fix count as they are, others with the
    greatest weight that they can have.
    """

    def __init__(self, weights: Weights):
        self.weights = weights
        self.most: dict[str, float] = {}
        for f, w in weights.items():
            name = " ".join(f.split(" ", 2)[:2])
            self.most[name] = max(w, self.most.get(name, 0.0))
        self.inside: dict[str, tuple[tuple[int, int, int], ...]] = {}

    def shapes(self, sketch: str, start: int, end: int, whole: bool, inside: bool) -> tuple[tuple[int, int, int], ...]:
        """The shapes of sketch[start:end] that may score above 0. `inside`: no word stands close before it."""
        out = []
        for x, y, kind in _shapes(sketch[start:end]):
            score = 0.0
            for f in features(sketch, (start + x, start + y, kind, whole)):
                name = " ".join(f.split(" ", 2)[:2])
                free = name.endswith(_OF_DIGITS) or name.endswith(" word") and not inside
                score += self.most.get(name, 0.0) if free else self.weights.get(f, 0.0)
            if score > -1e-6:
                out.append((x, y, kind))
        if inside and not whole:
            if len(self.inside) >= MOST_SHAPES:
                self.inside.clear()
            self.inside[sketch] = tuple(out)
        return tuple(out)


def _number_candidates(text: str, low: int, high: int, hopeful: Hopeful | None = None) -> Iterator[Candidate]:
    """Parts of the runs of digit groups in a gap, without those that `hopeful` rules out."""
    known = hopeful.inside if hopeful else {}
    for run in _NUMBERS.finditer(text, low, high):
        a, b = run.span()
        if b - a < LEAST_DIGITS:
            continue
        units = [m.span() for m in _UNIT.finditer(text, a, b)] if text.find(" ", a, b) >= 0 else [(a, b)]
        n = len(units)
        # the run and a character on both sides, digits alike
        edge = max(a - 1, 0)
        sketch = text[edge : b + 1].translate(_ALIKE)
        reached = [0, *accumulate(sketch.count("0", x - edge, y - edge) for x, y in units)]
        nearest = 0
        for i, (x, _) in enumerate(units):
            while nearest < n and reached[nearest + 1] - reached[i] < LEAST_DIGITS:
                nearest += 1
            left, inside = max(x - 1, edge), x - a >= WORD_SPAN
            for j in range(nearest, n):
                if reached[j + 1] - reached[i] > MOST_DIGITS:
                    break
                y, whole = units[j][1], i == 0 and j == n - 1
                part = sketch[left - edge : y - edge + 1]
                shapes = known.get(part) if inside else None
                if shapes is None:
                    shapes = hopeful.shapes(part, x - left, y - left, whole, inside) if hopeful else _shapes(part[x - left : y - left])
                for start, end, kind in shapes:
                    # two zeros ahead of a phone number are no digits of it, two other digits are
                    if kind == 2 or _PHONE_SHAPE.fullmatch(text, x + start, x + end):
                        yield x + start, x + end, kind, whole


def _address_candidates(text: str, low: int, high: int) -> Iterator[Candidate]:
    """Addresses around written-out at-signs: from each part of the local name to each part of the domain."""
    for at in _AT_SIGN.finditer(text, low, high):
        begin, least = at.start(), max(low, at.start() - LONGEST_LOCAL)
        while begin > least and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin > low and text[begin - 1] in _LOCAL:
            continue
        starts = [i for i in range(begin, at.start()) if text[i].isalnum() and (i == begin or not text[i - 1].isalnum())]
        ends, place, parts = [], at.end(), 0
        while place < high and place - begin <= LONGEST and (part := _DOMAIN_PART.match(text, place, high)):
            parts += 1
            if parts > 1 and part.end(1) - begin <= LONGEST:
                ends.append(part.end(1))
            if not part.group(2):
                break
            place = part.end()
        yield from ((i, j, 0, False) for i in starts for j in ends)


def _gaps(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    return zip([0, *(b for _, b in taken)], [*(a for a, _ in taken), len(text)])


def candidates(
    text: str, taken: list[tuple[int, int]], hopeful: Hopeful | None = None, chosen: Callable[[Candidate], bool] | None = None
) -> Iterator[list[Candidate]]:
    """Clusters of overlapping candidates in the gaps between base spans, in order; of all, or of chosen ones."""
    for low, high in _gaps(text, taken):
        kinds = [_number_candidates(text, low, high, hopeful)]
        if _AT_SIGN.search(text, low, high):
            kinds.append(_address_candidates(text, low, high))
        if "[" in text or "(" in text or "." in text:
            kinds.append((m.start(), m.end(), 1, True) for m in _QUAD.finditer(text, low, high))
        found = merge(*kinds) if len(kinds) > 1 else kinds[0]
        cluster: list[Candidate] = []
        end = 0
        for candidate in filter(chosen, found) if chosen else found:
            if cluster and candidate[0] >= end:
                yield cluster
                cluster = []
            cluster.append(candidate)
            end = max(end, candidate[1]) if len(cluster) > 1 else candidate[1]
        if cluster:
            yield cluster


# --- the model


def _lattice(text: str, cluster: list[Candidate]) -> tuple[list[int], dict[int, list]]:
    """Bounds of the candidates, and the candidates by the bound they end at: (first bound, kind, features)."""
    bounds = sorted({x for a, b, _, _ in cluster for x in (a, b)})
    place = {x: i for i, x in enumerate(bounds)}
    by_end: dict[int, list] = {}
    for candidate in cluster:
        a, b, kind, _ = candidate
        by_end.setdefault(place[b], []).append((place[a], kind, features(text, candidate)))
    return bounds, by_end


def decode(weights: Weights, text: str, cluster: list[Candidate]) -> list[Span]:
    """Best segmentation of a cluster: spans of the chosen segments."""
    bounds, by_end = _lattice(text, cluster)
    best, back = [0.0], [None]
    for j in range(1, len(bounds)):
        top, how = best[j - 1], None
        for i, kind, fs in by_end.get(j, ()):
            s = best[i] + sum(weights.get(f, 0.0) for f in fs)
            if s > top:
                top, how = s, (i, kind)
        best.append(top)
        back.append(how)
    out, j = [], len(bounds) - 1
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((kind, bounds[i], bounds[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def gradient(weights: Weights, bounds: list[int], by_end: dict, gold: set[Span]) -> dict[str, float]:
    """Observed minus expected features of one stretch (forward and backward sums over segmentations)."""
    n = len(bounds) - 1
    scored = {j: [(i, k, fs, sum(weights.get(f, 0.0) for f in fs)) for i, k, fs in xs] for j, xs in by_end.items()}
    forward = [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = forward[j - 1]
        for i, _, _, s in scored.get(j, ()):
            forward[j] = _sum(forward[j], forward[i] + s)
    backward = [-math.inf] * n + [0.0]
    for j in range(n, 0, -1):
        backward[j - 1] = _sum(backward[j - 1], backward[j])
        for i, _, _, s in scored.get(j, ()):
            backward[i] = _sum(backward[i], backward[j] + s)
    out: dict[str, float] = {}
    for j, xs in scored.items():
        for i, kind, fs, s in xs:
            d = float((kind, bounds[i], bounds[j]) in gold) - math.exp(forward[i] + s + backward[j] - forward[n])
            for f in fs:
                out[f] = out.get(f, 0.0) + d
    return out


def sentence(r: random.Random) -> tuple[str, list[Span]]:
    """A made-up sentence with at most one thing in it, and its span if it is personal data."""

    def word() -> str:
        return "".join(r.choice("aeiounrstlmdéü") for _ in range(r.randint(2, 9)))

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def checked(n: int, good: bool) -> str:
        while True:
            d = r.choice("3456") + digits(n - 1)
            if luhn(d) == good:
                return d

    def host(dot: str) -> str:
        names = [word().replace("é", "e").replace("ü", "u") for _ in range(r.choice([1, 1, 2, 3]))]
        return dot.join([*names, r.choice(["com", "org", "net", "example.com"])])

    def day(sep: str) -> str:
        y, m, d = str(r.randint(1900, 2099)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"
        return sep.join(r.choice([(y, m, d), (d, m, y), (m, d, y)]))

    def clock() -> str:
        return f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}" + r.choice(["", f":{r.randint(0, 59):02d}"])

    def book() -> str:
        while True:
            d = r.choice(["978", "979"]) + digits(10) if r.random() < 0.6 else digits(10)
            if _book(d):
                cut = sorted(r.sample(range(len(d) - 9, len(d) - 1), 2))
                parts = [d[: len(d) - 10], d[len(d) - 10 : cut[0]], d[cut[0] : cut[1]], d[cut[1] : -1], d[-1]]
                return r.choice("--- ").join(p for p in parts if p)

    at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("{at}", "."), ("[at]", ".")])
    octet = lambda: str(r.randint(0, 255))
    quad = r.choice(["[.]", "(.)", "[dot]"])
    sep = r.choice([" ", "-", "."])
    number = checked(16, True)
    made = {
        "email": lambda: f"{r.choice(['jo', 'ann', 'max'])}.{digits(2)}{at}{host(dot)}",
        "ip": lambda: quad.join(octet() for _ in range(4)),
        "card": lambda: r.choice(["  ", ".", " - "[:2]]).join(number[i : i + 4] for i in range(0, 16, 4)),
        "phone": lambda: r.choice([
            f"({digits(3)}) {digits(3)}-{digits(4)}",
            f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}",
            f"001 ({digits(3)}) {digits(3)}-{digits(4)}",
            f"0{r.randint(10, 999)}{r.choice(['-', '/', ' ', ' - '[1:]])}{digits(r.randint(5, 8))}",
            f"(0{r.randint(10, 999)}) {digits(r.randint(5, 8))}",
            f"0{r.randint(10, 999)} {digits(3)} {digits(r.randint(2, 4))}",
            sep.join([f"0{r.randint(1, 9)}", *(digits(2) for _ in range(4))]),
            f"00{r.randint(20, 99)} {r.randint(10, 999)} {digits(r.randint(5, 8))}",
            f"9{digits(2)} {digits(3)} {digits(3)}",
        ]),
    }
    decoys = [
        lambda: digits(r.randint(7, 22)),
        lambda: checked(16, False),
        lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
        lambda: " ".join((d := checked(16, False))[i : i + 4] for i in range(0, 16, 4)),
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: f"{r.randint(1, 99)}.{digits(8)}",
        lambda: f"{digits(3)}-{digits(4)}",
        lambda: f"{digits(r.randint(2, 5))} {digits(r.randint(3, 6))} {digits(r.randint(2, 5))}",
        lambda: quad.join(str(r.randint(256, 999)) for _ in range(4)),
        lambda: f"({r.choice(['at', 'AT'])}) {word()}",
        lambda: f'"{digits(3)}{word()}{digits(8)}{word()}"',
        lambda: f"{day(r.choice('-./'))}{r.choice([' ', 'T'])}{clock()}",
        lambda: f"{day(r.choice('-./ '))}",
        lambda: f"{day(r.choice('-./'))}{r.choice(['-', ' - ', ' '])}{day(r.choice('-./'))}",
        lambda: f"{day('.')}.{r.randint(10, 99)}",
        lambda: f"{r.randint(1900, 2030)}{r.choice(['-', '/'])}{r.randint(1900, 2030)}",
        book,
        book,
        lambda: ".".join(str(r.randint(0, 40)) for _ in range(r.randint(3, 6))) + r.choice(["", "-1", ".20210304"]),
        lambda: " ".join(str(r.randint(0, 999)) for _ in range(r.randint(4, 30))),
        lambda: " ".join(digits(n) for n in [r.randint(1, 6)] * r.randint(3, 12)),
        lambda: f"{digits(2)}.{digits(r.randint(4, 6))} {digits(1)}.{digits(r.randint(4, 6))}",
        lambda: f"{r.randint(1, 9)}.{digits(3)}.{digits(3)}{r.choice(['', '.' + digits(3)])}",
        lambda: f"{r.randint(1, 9)} {digits(3)} {digits(3)}",
        lambda: f"{r.randint(1, 400)}-{r.randint(401, 999)} {r.randint(1900, 2030)}",
        lambda: f"{digits(5)}-{digits(5)}-{digits(5)}",
    ]
    kind = r.choice(KINDS) if r.random() < 0.45 else None
    if kind == "phone" and r.random() < 0.25:  # with more digits behind it than the pattern for phones allows
        start, thing = word() + " ", f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"
        return f"{start}{thing} {digits(3)}.{digits(3)}", [(3, len(start), len(start) + len(thing))]
    thing = made[kind]() if kind else r.choice(decoys)()
    before = " ".join(word() for _ in range(r.randint(0, 4)))
    if kind and r.random() < 0.2:
        before += " " + {"email": "mail", "ip": "host", "card": "card", "phone": "tel"}[kind] + r.choice([":", "", "."])
    elif not kind and r.random() < 0.2:
        before += " " + r.choice(["ISBN", "version", "order", "page", "from"]) + r.choice([":", ""])
    lead = before + " " if before else ""
    tail = r.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
    span = [(KINDS.index(kind), len(lead), len(lead) + len(thing))] if kind else []
    return lead + thing + tail, span


def _example(text: str, taken: list[tuple[int, int]]) -> Callable[[Candidate], bool]:
    """Which candidates of a made-up sentence the weights are learned from.

    All but the inner parts of long runs: hundreds of them from one table would
    outweigh the sentences with a few numbers.
    """
    inner = []
    for low, high in _gaps(text, taken):
        for run in _NUMBERS.finditer(text, low, high):
            units = [m.span() for m in _UNIT.finditer(text, *run.span())]
            if len(units) > FEW_UNITS:
                inner.append((*run.span(), units))

    def chosen(candidate: Candidate) -> bool:
        start, end, kind, whole = candidate
        for a, b, units in inner:
            if kind > 1 and a <= start and end <= b:
                return whole and len(units) < MOST_DIGITS or any(x <= start and end <= y for x, y in units)
        return True

    return chosen


@lru_cache(1)
def train(seed: int = 1) -> tuple[tuple[str, float], ...]:
    """Weights that maximise the conditional likelihood of made-up sentences (adaptive gradient steps)."""
    r = random.Random(seed)
    data = []
    for _ in range(SENTENCES):
        text, gold = sentence(r)
        base = merged(base_spans(text))
        for cluster in candidates(text, base, chosen=_example(text, base)):
            data.append((*_lattice(text, cluster), set(gold)))
    weights: Weights = {}
    squares: dict[str, float] = {}
    for _ in range(EPOCHS):
        r.shuffle(data)
        for bounds, by_end, gold in data:
            for f, g in gradient(weights, bounds, by_end, gold).items():
                g -= DECAY * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + RATE * g / math.sqrt(squares[f])
    return tuple(sorted((f, round(w, 6)) for f, w in weights.items()))


def find(text: str, weights: Weights, hopeful: Hopeful | None = None) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that the model adds. `hopeful` keeps what it knows of shapes from text to text."""
    base = base_spans(text)
    taken = merged(base)
    added = [s for cluster in candidates(text, taken, hopeful or Hopeful(weights)) for s in decode(weights, text, cluster)]
    return base, added


def notation(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _run(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hopeful = Hopeful(weights)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), strings(part.column("text")).to_pylist()):
                    base, added = find(text, weights, hopeful)
                    counts = [sum(s[0] == k for s in base) for k in range(len(KINDS))]
                    digest = hashlib.sha256(notation(base).encode()).hexdigest()
                    rows.append((doc, *counts, digest, notation(base + added), len(added)))
                types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)

    return run


_NAMES = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]


def find_personal_data(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row: doc_id, base spans by kind, their digest, all spans, and how many the model added."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    rows = bounded(docs).select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    return rows.mapInArrow(_run(dict(train(seed))), schema)
