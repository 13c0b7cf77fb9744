"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns find e-mail addresses, IP addresses, card and phone numbers in the whole
text.  The random field scores whole candidate spans (digit count, grouping, check digit,
separators, neighbours) and a bounded-entity dynamic programme jointly chooses boundaries
and kinds, so that numbers written in other ways are found too.  Its weights are trained
here, on labelled examples generated from a seed.  A candidate holds a digit or an ``@``,
so texts are only cut into symbols around those.  A span's score depends on its shape,
so shapes are scored once and kept in a bounded trie, and those that cannot be part of a
best segmentation are left out there.  Work is per row: no shuffle.

Defined cases: a null text is the empty text, which has no spans; time is linear in the
length of a text, digit runs of any length included; repeated rows give repeated results;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, product

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


#: The value of each digit's byte, and what it counts where it is doubled.
ONCE, TWICE = (bytes(48) + bytes(v) + bytes(198) for v in (range(10), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))


def luhn(span: str) -> bool:
    """Whether the digits of a number, separators left out, pass the check."""
    d = span.encode().translate(None, b" ().+-/")[::-1]
    return (sum(d[::2].translate(ONCE)) + sum(d[1::2].translate(TWICE))) % 10 == 0


def small_parts(text: str) -> bool:
    """Whether all four parts of a dotted number are at most 255."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[Span]:
    """From each ``@``: the run of local characters before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end(), "email"
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap others of the kind; failing ones are dropped."""
    found = list(emails(text))
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if 14 <= len(m[0]) and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the random field -------------------------------------------------------------------

SYMBOL = re.compile(r"[0-9]+|[^\W\d_]+|\S")
TRIGGER = re.compile(r"[0-9@]")
#: Symbols in a span at most, and characters of a text that are looked at around a trigger.
LONGEST, MARGIN = 24, 48
BETWEEN = frozenset("+().-/")
#: Digits of a number's span, at least and at most; symbols that are read ahead at a time; shapes that are remembered.
LEAST_DIGITS, MOST_DIGITS, AHEAD, SHAPES = 4, 19, 4096, 100_000
#: A symbol of a text: its start, its end and its characters.
Symbol = tuple[int, int, str]


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around triggers; what lies outside has no candidates.  A stretch is as long as its triggers are near."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        at = m.start()
        if start >= 0 and at - MARGIN > end:
            yield start, end
            start = -1
        if start < 0:
            start = max(0, end, at - MARGIN)
        end = min(len(text), m.end() + MARGIN)
    if start >= 0:
        yield start, end


def number_features(span: str, check: bool, octets: bool, goes_on: bool) -> list[str]:
    """Features of a number's span, which depend on its shape only; of its digits none but how many there are."""
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    seps = re.sub("[0-9]+", "", span)
    return [
        "bias",
        f"digits{sum(groups)}",
        f"groups{min(len(groups), 7)}",
        f"octets{octets}",
        f"luhn{check}",
        f"plus{span[0] == '+'}",
        f"seps{''.join(sorted(set(seps)))}",
        f"tail{'-'.join(str(min(g, 5)) for g in groups[-3:])}|{bool(seps.strip())}",
        f"even{len(set(groups[:-1])) <= 1}",
        f"on{goes_on}",
    ]


class Shape:
    """A node of the trie of shapes: a number's span without its digits' values.

    ``scored`` keeps, for each (check digit right, octets, goes on), the kinds that can be
    part of a best segmentation, with their scores.
    """

    __slots__ = ("span", "digits", "dotted", "next", "scored", "live")

    def __init__(self, span: str):
        self.span, self.digits = span, sum(map(str.isdigit, span))
        self.dotted = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span) is not None
        self.next: dict[str, Shape] = {}
        self.scored: dict[tuple[bool, bool, bool], list] = {}
        self.live = False


def address(text: str, symbols: list[Symbol], i: int) -> Iterator[tuple[int, int, list[str]]]:
    """Candidates (start, end, features) around the ``@`` that is symbol i."""
    a = i
    while a and i - a < LONGEST // 2 and symbols[a - 1][1] == symbols[a][0]:
        s = symbols[a - 1][2]
        if not (s[0].isalnum() or s in "._%+-"):
            break
        a -= 1
    if a == i:
        return
    dots = 0
    for j in range(i + 1, min(len(symbols), i + LONGEST // 2)):
        s = symbols[j][2]
        if symbols[j][0] != symbols[j - 1][1] or not (s[0].isalnum() or s in ".-"):
            break
        dots += s == "."
        after = symbols[j + 1] if j + 1 < len(symbols) else None
        on = after is not None and after[0] == symbols[j][1] and (after[2][0].isalnum() or after[2] == "-")
        if s[0].isalnum() and not on:
            more = after is not None and after[0] == symbols[j][1] and after[2] == "." and j + 2 < len(symbols) and symbols[j + 2][0] == after[1]
            yield a, j + 1, ["email|bias", f"email|dots{min(dots, 3)}", f"email|more{more}", f"email|top{s.isalpha() and 2 <= len(s) <= 10}"]


def gap(text: str, before: Symbol, own: Symbol) -> str | None:
    """"" or one space between two symbols; None for more, a line's end too."""
    between = text[before[1] : own[0]]
    return between if between in ("", " ") else None


def begins_number(text: str, symbols: list[Symbol], i: int) -> bool:
    first = symbols[i][2]
    if not (first.isascii() and first.isdigit()) and first not in "+(":
        return False
    return not i or gap(text, symbols[i - 1], symbols[i]) != "" or not (symbols[i - 1][2][-1].isalnum() or symbols[i - 1][2] in "+_")


def shaped(s: str) -> str | None:
    """A symbol as it stands in a number's shape; None if it cannot."""
    if s.isascii() and s.isdigit():
        return "0" * len(s) if len(s) <= MOST_DIGITS else None
    return s if s in BETWEEN else None


def glue(text: str, symbols: list[Symbol], j: int) -> str | None:
    """What symbol j adds to the shape of a number that goes on from the symbol before; None if it cannot."""
    if (own := shaped(symbols[j][2])) is None or (between := gap(text, symbols[j - 1], symbols[j]) if j else "") is None:
        return None
    return between + own


def ends_number(symbols: list[Symbol], j: int) -> bool:
    after = symbols[j + 1] if j + 1 < len(symbols) else None
    return not (after and after[0] == symbols[j][1] and after[2][0].isalnum())


def continues(symbols: list[Symbol], j: int) -> bool:
    after = symbols[j + 1] if j + 1 < len(symbols) else None
    return after is not None and after[0] == symbols[j][1] and after[2] in ".-/:"


class Region:
    """All symbols of a short text and all its candidate spans with their features, to train on and to test against."""

    def __init__(self, text: str, start: int = 0, end: int | None = None):
        self.symbols: list[Symbol] = [(m.start(), m.end(), m[0]) for m in SYMBOL.finditer(text, start, len(text) if end is None else end)]
        self.by_end: dict[int, list[tuple[int, str, list[str]]]] = defaultdict(list)
        for i, (a, _, s) in enumerate(self.symbols):
            if begins_number(text, self.symbols, i):
                self._numbers(text, i, a)
            if s == "@":
                for first, e, features in address(text, self.symbols, i):
                    self.by_end[e].append((first, "email", features))

    def _numbers(self, text: str, i: int, a: int) -> None:
        digits = ""
        for j in range(i, min(len(self.symbols), i + LONGEST)):
            s = self.symbols[j][2]
            if shaped(s) is None or j > i and gap(text, self.symbols[j - 1], self.symbols[j]) is None:
                break
            digits += s if s.isdigit() else ""
            if len(digits) > MOST_DIGITS:
                break
            if s.isdigit() and len(digits) >= LEAST_DIGITS and ends_number(self.symbols, j):
                span = text[a : self.symbols[j][1]]
                check = 14 <= len(digits) and luhn(digits)
                octets = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span) is not None and small_parts(span)
                shape = number_features(span, check, octets, continues(self.symbols, j))
                for kind in ("ip", "card", "phone"):
                    self.by_end[j + 1].append((i, kind, [f"{kind}|{x}" for x in shape]))


LABELS = ("-", *KINDS)


class SemiMarkovField:
    """Weights of span features and of label transitions; ``-`` is a symbol outside of spans."""

    def __init__(self):
        self.w: dict[str, float] = defaultdict(float)

    def _edges(self, region: Region, end: int) -> list[tuple[int, str, list[str], float]]:
        spans = [(end - 1, "-", [], 0.0)]
        return spans + [(i, y, f, sum(self.w.get(x, 0.0) for x in f)) for i, y, f in region.by_end.get(end, ())]

    def ready(self) -> SemiMarkovField:
        """Sets up what decoding looks up: transitions, and an empty trie of shapes."""
        self.step = {(p, y): self.w.get(f"{p}>{y}", 0.0) for p in LABELS for y in LABELS}
        self.shapes, self.known = Shape(""), 0
        return self

    def _worth(self, kind: str, score: float, symbols: int) -> bool:
        """Whether a span can be part of a best segmentation: not if the same symbols are worth more outside of spans, whatever stands around."""
        inside = max(self.step[p, kind] - self.step[p, "-"] for p in LABELS) + score + max(self.step[kind, q] - self.step["-", q] for q in LABELS)
        return inside >= (symbols - 1) * self.step["-", "-"]

    def _score(self, shape: Shape, symbols: int) -> Shape:
        """Scores a new shape; ``live`` says whether any of its variants has a kind that can be used."""
        if shape.span[-1:].isdigit() and LEAST_DIGITS <= shape.digits <= MOST_DIGITS:
            for check, octets, on in product((False, True)[: 1 + (shape.digits >= 14)], (False, True)[: 1 + shape.dotted], (False, True)):
                features = number_features(shape.span, check, octets, on)
                all_kinds = [(k, sum(self.w.get(f"{k}|{x}", 0.0) for x in features)) for k in ("ip", "card", "phone")]
                shape.scored[check, octets, on] = [(k, v) for k, v in all_kinds if self._worth(k, v, symbols)]
        shape.live = any(shape.scored.values())
        return shape

    def _candidates(self, text: str, symbols: list[Symbol], glued: list[str | None], i: int) -> Iterator[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the spans that begin at symbol i, or lie around it if it is an ``@``."""
        if symbols[i][2] == "@":
            for a, e, features in address(text, symbols, i):
                yield a, e, "email", sum(self.w.get(x, 0.0) for x in features)
        if not begins_number(text, symbols, i):
            return
        if self.known > SHAPES:  # memory stays bounded, whatever the text
            self.shapes, self.known = Shape(""), 0
        node, start = self.shapes, symbols[i][0]
        for j in range(i, min(len(symbols), i + LONGEST)):
            adds = glued[j]
            if adds is None:
                if j > i or (adds := shaped(symbols[i][2])) is None:
                    return
            elif j == i:
                adds = adds.lstrip(" ")
            below = node.next.get(adds)
            if below is None:
                below = node.next[adds] = self._score(Shape(node.span + adds), j + 1 - i)
                self.known += 1
            node = below
            if node.digits > MOST_DIGITS:
                return
            if not node.live or not ends_number(symbols, j):
                continue
            on, span = continues(symbols, j), text[start : symbols[j][1]]
            octets = node.dotted and small_parts(span)
            found = node.scored[False, octets, on]
            if node.digits >= 14 and found != (checked := node.scored[True, octets, on]) and luhn(span):
                found = checked
            for kind, score in found:
                yield i, j + 1, kind, score

    def decode(self, text: str, start: int = 0, end: int | None = None) -> list[Span]:
        """The best segmentation of the symbols between two places of the text, which count as followed by one outside of spans.

        It runs as a stream: symbols are read ahead a few thousand at a time, of best
        scores only the last few positions are kept, and paths share their spans, so
        memory is that of the spans found.
        """
        source = SYMBOL.finditer(text, start, len(text) if end is None else end)
        symbols: list[Symbol] = []
        glued: list[str | None] = []
        done = False
        # by position: of each label the best score and its spans, the last first; a position without an entry lies in a run outside of spans
        best: dict[int, dict[str, tuple[float, tuple | None]]] = {0: {"-": (0.0, None)}}
        pending: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
        runs, at, last = [(0.0, None, 0)], 0, 0  # score and spans at the positions where the last runs outside of spans began
        out_step, kept = self.step["-", "-"], LONGEST + 2
        while True:
            if not done and at + 2 * kept > len(symbols):
                if at > 4 * AHEAD:  # positions count from the first symbol kept
                    drop = at - 2 * kept
                    del symbols[:drop], glued[:drop]
                    best = {k - drop: v for k, v in best.items() if k >= drop}
                    pending = defaultdict(list, {k - drop: [(a - drop, kind, v) for a, kind, v in x] for k, x in pending.items()})
                    runs, at, last = [(v, path, k - drop) for v, path, k in runs], at - drop, last - drop
                more = [(m.start(), m.end(), m[0]) for m in islice(source, AHEAD)]
                symbols += more
                glued += [glue(text, symbols, j) for j in range(len(glued), len(symbols))]
                done = len(more) < AHEAD

            def state(p: int) -> dict[str, tuple[float, tuple | None]]:
                if p in best:  # noqa: B023
                    return best[p]  # noqa: B023
                score, path, began = next((r for r in reversed(runs) if r[2] <= p), runs[0])  # noqa: B023
                return {"-": (score + out_step * (p - began), path)}

            if at > len(symbols) or at == len(symbols) and done:
                break
            found = self._candidates(text, symbols, glued, at) if symbols[at][2] in "+(@" or symbols[at][2].isdigit() else ()
            for a, e, kind, score in found:
                pending[e].append((a, kind, score))
                last = max(last, e)
            at += 1
            if at > last and not pending:
                if at - 1 in best:  # the first symbol outside after spans: the best of all labels goes on
                    total, path = max(((v + self.step[y, "-"], path) for y, (v, path) in best[at - 1].items()), key=lambda x: x[0])
                    runs = [*runs[-kept:], (total, path, at)]
                    if at - 1 > 4 * kept:
                        best = {k: v for k, v in best.items() if k > at - kept}
                continue
            total, path = max(((v + self.step[y, "-"], path) for y, (v, path) in state(at - 1).items()), key=lambda x: x[0])
            now = {"-": (total, path)}
            for a, kind, score in pending.pop(at, ()):
                for y, (v, path) in state(a).items():
                    total = v + score + self.step[y, kind]
                    if kind not in now or total > now[kind][0]:
                        now[kind] = (total, ((symbols[a][0], symbols[at - 1][1], kind), path))
            best[at] = now
            if len(best) > 8 * kept:
                best = {k: v for k, v in best.items() if k > at - kept}
        final = state(len(symbols))
        _, path = max(((v + self.step[y, "-"], path) for y, (v, path) in final.items()), key=lambda x: x[0])
        spans = []
        while path is not None:
            span, path = path
            spans.append(span)
        return spans[::-1]

    def _gradient(self, region: Region, gold: set[Span], rate: float) -> None:
        """One step up the log-likelihood: features of the gold segmentation less those expected."""
        n = len(region.symbols)
        edges = [[], *(self._edges(region, e) for e in range(1, n + 1))]
        add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        forward: list[dict[str, float]] = [{"-": 0.0}]
        for e in range(1, n + 1):
            into = defaultdict(list)
            for i, y, _, s in edges[e]:
                into[y] += [a + s + self.w[f"{p}>{y}"] for p, a in forward[i].items()]
            forward.append({y: add(xs) for y, xs in into.items()})
        backward: list[dict[str, float]] = [defaultdict(lambda: -math.inf) for _ in range(n + 1)]
        backward[n] = dict.fromkeys(forward[n], 0.0)
        out: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
        change: dict[str, float] = defaultdict(float)
        z = add(list(forward[n].values()))
        for e in range(n, 0, -1):
            if e < n:
                backward[e] = {y: add(xs) for y, xs in out[e].items()}
            for i, y, f, s in edges[e]:
                if y not in backward[e]:
                    continue
                for p, a in forward[i].items():
                    t = s + self.w[f"{p}>{y}"] + backward[e][y]
                    out[i][p].append(t)
                    chance = math.exp(a + t - z)
                    change[f"{p}>{y}"] -= chance
                    for x in f:
                        change[x] -= chance
        e, right = n, {(b, k): a for a, b, k in gold}
        path = []
        while e > 0:
            end = region.symbols[e - 1][1]
            span = next(((i, y, f) for i, y, f, _ in edges[e] if y != "-" and right.get((end, y)) == region.symbols[i][0]), (e - 1, "-", []))
            path.append(span)
            e = span[0]
        previous = "-"
        for _, y, f in reversed(path):
            change[f"{previous}>{y}"] += 1
            for x in f:
                change[x] += 1
            previous = y
        change.pop("->-", None)  # the level that others are learnt against: a symbol outside of spans after another counts nothing
        for x, v in change.items():
            self.w[x] += rate * (v - 0.002 * self.w[x])

    def fit(self, examples: list[tuple[str, set[Span]]], rounds: int = 4) -> SemiMarkovField:
        ready = [(Region(text), gold) for text, gold in examples]
        for k in range(rounds):
            for region, gold in ready:
                self._gradient(region, gold, 0.3 / (1 + k))
        return self.ready()


def examples(n: int, seed: int = 11) -> list[tuple[str, set[Span]]]:
    """Generated texts with labelled spans: each kind in several spellings among words, dates and other numbers."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioubcdfghlmnprst") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = num(r.choice([13, 14, 15, 15, 15, 18]))
        d = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice(["", "", " ", "-", "."]).join(d[i : i + 4] for i in range(0, len(d), 4))

    def no_card() -> str:
        body = num(15)
        return body + next(c for c in "0123456789" if not luhn(body + c))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        local = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
        return r.choice(["", f"+{r.randint(1, 99)} ", f"+{r.randint(1, 99)} "]) + local

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def email() -> str:
        return f"{word()}{r.choice(['.', '_', ''])}{num(2)}@{word()}{r.choice(['', num(1)])}.{word()}.{r.choice(['com', 'org', 'net'])}"

    def other() -> str:
        y, m, d = r.randint(1900, 2030), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
        return r.choice([f"{y}", f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(3)},{num(3)}.{num(2)}", num(r.randint(4, 13)), no_card(), f"{num(1)}.{num(9)}", f"{y} {num(4)}", f"{y}-{y + 3}", ".".join(["999", num(3), "512", num(2)]), f"{num(4)} {num(4)}", f"{word()}@{word()}", f"{num(5)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(2)}-{num(6)}-{num(5)}"])

    out = []
    for _ in range(n):
        text, gold = word(), set()
        for _ in range(r.randint(1, 3)):
            kind = r.choice(["email", "ip", "card", "phone", "-", "-", "-"])
            span = {"email": email, "ip": ip, "card": card, "phone": phone, "-": other}[kind]()
            text += " " + r.choice(["", word() + " "]) + r.choice(["", "", "("] if kind != "phone" else [""])
            if kind != "-":
                gold.add((len(text), len(text) + len(span), kind))
            text += span + r.choice(["", ",", ".", ""]) + " " + word() + r.choice(["", "."])
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def field(n: int = 500) -> SemiMarkovField:
    """The trained field: the driver trains it once, in about a second, and it travels with the tasks."""
    return SemiMarkovField().fit(examples(n))


def all_spans(text: str, base: list[Span], own: SemiMarkovField) -> list[Span]:
    """Base spans, and those of the field that touch none of them."""
    more = []
    for start, end in regions(text):
        more += own.decode(text, start, end)
    taken = sorted(base)
    fresh, k, reach = [], 0, 0
    for s in more:
        while k < len(taken) and taken[k][0] < s[1]:
            reach = max(reach, taken[k][1])
            k += 1
        if s[0] >= reach:
            fresh.append(s)
    return sorted([*base, *fresh], key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to counts and a digest of the base spans, and all spans with their places."""
    own = field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text.as_py() or ""
                base = base_spans(text)
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(text, base, own))))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def mask(text: str, own: SemiMarkovField) -> str:
    """The text with each span, overlapping ones taken together, replaced by its first kind's name."""
    out, end = [], 0
    for a, b, kind in all_spans(text, base_spans(text), own):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def masked(docs: DataFrame) -> DataFrame:
    """The rows with personal data in ``text`` replaced; a null text stays null, all other columns stay."""
    own = field()

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, own), na_action="ignore")

    return docs.withColumn("text", hide(F.col("text").cast("string")))
