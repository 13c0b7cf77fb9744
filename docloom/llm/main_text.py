"""Main text of web pages: the maximum-scoring contiguous region of words and tags.

A page is a sequence of tags and runs of words.  A run's words score what its block looks
like: the element that holds it, its length and its neighbours', the share of links, how it ends, and
whether names or elements around it hint at boilerplate.  Tags score negative.  The weights
are a logistic regression, learnt from pages that mark their own article; each is learnt
from twice, once as it is and once bare, without its marks, names and attributes, so that the
scores hold on pages that have none.  One linear scan finds the contiguous region of
greatest sum, and its blocks are the text.  Inside the region, what stands in elements that are never
part of an article (forms, menus, asides) is left out, and what has a name of boilerplate if
its score is negative too.  An ``article`` or ``main`` element, and what holds one, is never taken
for boilerplate.  Work is per page; learning sums counts on Spark over a bounded sample.

Defined cases: a null or empty html, or one without a region of positive sum, has an
empty text; markup that never ends is taken as markup up to the end; very long pages
take linear time; repeated rows give repeated results; without marked pages, default
weights serve; a table without a url has null urls; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import by_hash

#: Pages that weights are learnt from, at most: the marked ones among those of smallest id hash.
SAMPLE = 3000
#: Elements by what their content is.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
ASIDE = frozenset("nav footer aside form select button menu dialog".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: Elements that end where one of these begins in them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that features know by name; others are alike.
KNOWN = frozenset("p li td div section blockquote pre dd".split())
#: Elements that are bare ``div`` elements where a page is learnt from without its marks.
MARKED = ASIDE | MAIN | {"header", "section"}
#: Words of class and id names, and roles, of boilerplate elements; weak ones stand in articles too.
ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent alert alerts announcement toast gdpr popup modal overlay newsletter subscribe subscription signup hidden sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead toolbar share sharing comment comments commentlist disqus respond login pagination pager copyright disclaimer skip".split())
ASIDE_ENDS = ("menu", "nav", "navbar", "sidebar", "footer", "comments", "banner", "popup")
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar".split())

#: Names of containers: inside an article, a name of several words hints at boilerplate if it ends in a word of boilerplate, or begins with one and ends in one of these.
CONTAINERS = frozenset("area bar block box button buttons container form panel placeholder slot unit widget wrap wrapper zone".split())
WEAK_NAMES = frozenset("discussion notice notices related recommended recommendations search social feedback reply replies".split())
#: Names joined to these say what an element has, not what it is.
JOINED = frozenset("has no with without is show hide".split())
#: How strongly elements hint at boilerplate: a weak name, a name, an element or role; or are never shown.
WEAK, NAMED, BUILT, UNSEEN = 1, 2, 3, 4

MARKUP = re.compile(r"""<!--|<([/]?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s/]|=|$)(?!["']?false)""")


def _hint(name: str, attributes: str, in_main: bool) -> int:
    """How strongly an element hints at boilerplate by itself; an article never does."""
    if name == "head" or HIDDEN.search(attributes):
        return UNSEEN
    found = BUILT if name in ASIDE or name == "header" and not in_main else 0
    for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return UNSEEN
        if name in MAIN or name in ("body", "html"):
            continue
        if key in ("class", "id"):
            for token in value.split():
                words = set(NAME.findall(token))
                if words & JOINED:
                    continue
                words -= {"header"} if in_main else set()  # a header inside the article is its own
                if in_main and len(words) > 1:  # hidden-gem, share-price: the last word says what it is
                    ordered = NAME.findall(token)
                    words = {ordered[-1]} if ordered[-1] not in CONTAINERS else {ordered[0], ordered[-1]}
                if words & ASIDE_NAMES or any(w.endswith(ASIDE_ENDS) for w in words):
                    found = max(found, NAMED)
                elif words & WEAK_NAMES:
                    found = max(found, WEAK)
        elif key == "role" and value in ASIDE_ROLES:
            found = BUILT
    return found


#: A tag (``<name`` or ``</name``), or a run of words (""), with its text, its block's number, whether it is linked, its hint, and whether it stands in the page's own article (1; 0 if not; -1 if a name casts doubt on it).
Item = tuple[str, str, int, bool, int, int]


def items(page: str, bare: bool = False) -> tuple[list[Item], list[str]]:
    """The page's tags and runs of words, and the element that holds each block; bare: as if it had no marks, names or attributes."""
    out: list[Item] = []
    holders: list[str] = [""]
    at, end, links = 0, len(page), 0
    open_now: list[tuple[str, int, int]] = []  # name, hint with what it inherits, and articles around
    count: Counter = Counter()

    def state() -> tuple[int, int]:
        return open_now[-1][1:] if open_now else (0, 0)

    def words(a: int, b: int) -> None:
        hint, mains = state()
        if a < b and hint != UNSEEN:
            inside = 0 if not mains or hint == BUILT else -1 if hint else 1
            out.append(("", page[a:b], len(holders) - 1, links > 0, 0 if bare else hint, inside))

    def close_last() -> None:
        count[open_now.pop()[0]] -= 1

    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            break
        words(at, m.start())
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
        if m[2] is None:
            continue
        name, closing, attributes = m[2].lower(), m[1] == "/", m[3]
        if name == "br" and state()[0] != UNSEEN:
            out.append(("", " ", len(holders) - 1, False, 0, 0))
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        hint = 0
        if name not in INLINE:
            if closing:
                if count[name]:
                    while open_now[-1][0] != name:
                        close_last()
                    close_last()
            else:
                if open_now and open_now[-1][0] == "p":
                    close_last()
                while open_now and open_now[-1][0] in ENDS.get(name, ()):
                    close_last()
                around, mains = state()
                hint = _hint(name, attributes, mains > 0)
                if name in MAIN:
                    around = 0 if around < UNSEEN else around  # what holds an article is no boilerplate
                if name not in VOID and name not in RAW:
                    open_now.append((name, max(around, hint), mains + (name in MAIN)))
                    count[name] += 1
            shown = "div" if bare and name in MARKED else name
            out.append((f"{'</' if closing else '<'}{shown}", "", len(holders) - 1, False, state()[0], int(state()[1] > 0)))
            holder = open_now[-1][0] if open_now else ""
            holders.append("div" if bare and holder in MARKED else holder)
        elif not closing and name not in VOID and name != "a" and attributes and _hint(name, attributes, True) in (NAMED, UNSEEN):
            # a hidden or named inline element: its words are found up to its end tag
            open_now.append((name, max(state()[0], _hint(name, attributes, True)), state()[1]))
            count[name] += 1
        elif closing and count[name] and open_now[-1][0] == name:
            close_last()
        if name in RAW and not closing and not attributes.endswith("/"):
            close = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(page, at)
            at = close.start() if close else end
    words(at, end)
    return out, holders


def _size(n: int) -> int:
    return sum(n > x for x in (2, 5, 10, 20, 40))


SIZES, SHARES = 6, 4


def blocks(found: list[Item], holders: list[str]) -> dict[int, tuple[str, ...]]:
    """The features of each block that has words."""
    n, linked, hints, last = Counter(), Counter(), {}, {}
    for tag, text, block, link, hint, _ in found:
        if not tag and (words := len(text.split())):
            n[block] += words
            linked[block] += words * link
            hints[block] = max(hints.get(block, 0), hint)
            last[block] = text.rstrip()[-1:]
    order, out = sorted(n), {}
    for k, block in enumerate(order):
        share = linked[block] / n[block]
        around = max([n[order[i]] for i in (k - 1, k + 1) if 0 <= i < len(order)], default=0)
        holder = holders[block]
        out[block] = (
            "bias", f"in:{'h' if holder in HEADINGS else holder if holder in KNOWN else ''}", f"size:{_size(n[block])}", f"around:{_size(around)}",
            f"links:{(share > 0) + (share > 1 / 3) + (share > 2 / 3)}", f"stop:{last[block] in '.!?'}", f"hint:{hints[block]}",
        )
    return out


#: Weights before anything is learnt.
DEFAULTS = {
    "bias": 1.0, "in:": 0.0, "in:p": 1.5, "in:h": 1.0, "in:li": 0.0, "in:td": 0.0, "in:dd": 0.0, "in:div": 0.0, "in:section": 0.0, "in:blockquote": 1.0, "in:pre": 1.0,
    "size:0": -1.0, "size:1": -0.5, "size:2": 0.0, "size:3": 0.7, "size:4": 1.2, "size:5": 2.0,
    "around:0": 0.0, "around:1": 0.0, "around:2": 0.0, "around:3": 0.2, "around:4": 0.3, "around:5": 0.4,
    "links:0": 0.5, "links:1": 0.0, "links:2": -1.5, "links:3": -3.0, "stop:True": 0.5, "stop:False": 0.0, "hint:0": 0.0, "hint:1": -3.0, "hint:2": -6.0, "hint:3": -8.0,
}
NAMES = list(DEFAULTS)
LEAST_TAG, MOST_TAG, MOST_WORD, LEFT_OUT = 0.01, 1.0, 6.0, 0.3
#: How much the defaults count against the pages, and how many blocks the pages count as.
HOLD, AS_BLOCKS = 1.0, 2000.0


def counts(page: str) -> Counter:
    """How often each tag, and each block of like features, occurs inside (1) and outside (0) of the page's own article."""
    seen: Counter = Counter()
    for bare in (False, True):
        found, holders = items(page, bare)
        if not bare and not any(tag in ("<article", "<main") for tag, *_ in found):
            return seen
        of_block = blocks(found, holders)
        inside = {block: own for tag, text, block, _, _, own in found if not tag and text.strip()}
        for block, features in of_block.items():
            if inside[block] >= 0:
                seen["|".join(features), inside[block]] += 1
        for tag, _, _, _, _, own in found:
            if tag and not bare and (tag.lstrip("</") in KNOWN or tag.lstrip("</") in HEADINGS or tag.lstrip("</") in MARKED):
                seen[tag, own] += 1
    return seen


def fitted(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights of (features, blocks inside, blocks outside): the logistic regression that the defaults hold back."""
    own = [r for r in rows if r[0][0] != "<"]
    x = np.array([[f in set(k.split("|")) for f in NAMES] for k, _, _ in own], float)
    inner, outer = np.array([r[1] for r in own], float), np.array([r[2] for r in own], float)
    scale = min(1.0, AS_BLOCKS / max(1.0, (inner + outer).sum()))
    inner, n = inner * scale, (inner + outer) * scale
    before = np.array([DEFAULTS[f] for f in NAMES])
    w = before.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (inner - n * p) - HOLD * (w - before)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w)), slope)
        w += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(NAMES, map(float, w)))


def learn(pages: DataFrame, bound: int = SAMPLE) -> dict[str, float]:
    """Weights from the marked pages of a bounded sample."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    chosen = by_hash(own, "page_id", bound, pages.count()).select("html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for f in frames:
            for page in f["html"].dropna():
                total += counts(page)
        yield pd.DataFrame([(k, inside, n) for (k, inside), n in total.items()], columns=["feature", "inside", "n"])

    # a row for each tag and each combination of features: bounded by their numbers
    inside = lambda k: F.sum(F.when(F.col("inside") == k, F.col("n")).otherwise(0))
    sums = chosen.mapInPandas(run, "feature string, inside int, n long").groupBy("feature").agg(inside(1).alias("inner"), inside(0).alias("outer"))
    rows = sorted((r["feature"], r["inner"], r["outer"]) for r in sums.collect())
    if not rows:
        return dict(DEFAULTS)
    weights = fitted(rows)
    for tag, inner, outer in rows:
        if tag[0] == "<":  # tags never speak for content
            weights[tag] = -min(MOST_TAG, max(LEAST_TAG, LEAST_TAG - float(np.log((inner + 1) / (outer + 1))) / 4))
    return weights


def scores(found: list[Item], holders: list[str], weights: dict[str, float]) -> list[float]:
    """What each item counts: a tag its weight, a run its block's weight for each word.

    Words that are left out in any case, even inside the region, are little in its way.
    """
    of_block = {}
    for b, features in blocks(found, holders).items():
        least = -MOST_WORD if features[-1] == "hint:0" else -LEFT_OUT
        of_block[b] = max(least, min(MOST_WORD, sum(weights[f] for f in features)))
    return [weights.get(tag, -LEAST_TAG) if tag else of_block.get(block, 0.0) * len(text.split()) for tag, text, block, *_ in found]


def region(values: list[float]) -> tuple[int, int]:
    """The contiguous items of greatest sum, the first and longest such; (0, 0) if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, value in enumerate(values):
        total += value
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, span = total, (start, k + 1)
    return span


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The page's main text: blocks of the best region, white space and references resolved."""
    found, holders = items(page or "")
    values = scores(found, holders, weights)
    a, b = region(values)
    parts: dict[int, list[str]] = {}
    for (tag, text, block, _, hint, _), value in zip(found[a:b], values[a:b]):
        if not tag and hint < BUILT and (not hint or value >= 0):
            parts.setdefault(block, []).append(text)
    return " ".join(filter(None, (" ".join(html.unescape("".join(p)).split()) for p in parts.values())))


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars); weights are learnt from the pages if not given."""
    known = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), known) for p in batch["html"]]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in {c.lower() for c in pages.columns} else F.lit(None).cast("string").alias("url")
    own = pages.select(F.col("page_id").cast("long"), url, F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
