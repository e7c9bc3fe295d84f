"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand (positive where article text stands), tags
score negative, and one linear scan finds the contiguous region with the largest sum. The weights are log odds, learned
from labelled pages: those that mark their article themselves. Names of classes and ids are features like others: what
stands in an element whose name speaks of adverts or comments scores less, and such an element inside the region goes
only if its own words sum to nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are learned from at most (about, by a hash of page_id); and weights kept.
SAMPLE_PAGES = 2000
MOST_WEIGHTS = 4000

#: Fixed element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas"
#: Elements and roles whose content is no part of an article, and words of class or id names that speak of such content.
ASIDE = frozenset("aside button dialog footer form head menu nav select textarea title".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form login "
    "menu menus nav navbar navigation newsletter notice notices pagination popup popular promo promoted recommended related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar widget".split()
)
MAIN = frozenset(("article", "main"))

#: What is never closed ends with the page, so that each byte is looked at a fixed number of times.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b(?:[^>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*+/>|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Token:
    """A tag (words 0) or a stretch of text; where is its feature, apart says that an element or role keeps it out of any
    article, hinted is the innermost element around it whose name is a hint (-1: none)."""

    where: str
    words: int
    text: str
    apart: bool
    marked: bool
    breaks: bool
    hinted: int


@dataclass
class Zone:
    """An element that stands apart, or an article inside one: the zone around it, what it is, and the words of text that
    it holds outside links."""

    up: int
    kind: str
    words: int = 0


def _apart(zones: list[Zone], text: int) -> list[bool]:
    """Which zones are left out. A form, or an article inside what stands apart, that holds over half of the words of the
    page isn't, whatever is around it for its own sake."""
    out: list[bool] = []
    for z in zones:
        around, most = z.up >= 0 and out[z.up], 2 * z.words > text
        out.append(around and not most if z.kind == "main" else around if z.kind == "form" and most else True)
    return out


@dataclass
class Hinted:
    """An element whose class or id holds a hint: the one around it, its names, if it stands in an article, and the
    words of text that it holds outside links and what is apart."""

    up: int
    names: tuple[str, ...]
    marked: bool
    words: int = 0


def _names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The class and id names that hold a hint, and whether the role keeps the element out of an article."""
    names, apart = [], False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = max(values, key=len).lower()
        if kind.lower() == "role":
            apart |= value in ROLES
        else:
            names += [name for name in value.split() if not HINTS.isdisjoint(_PART.findall(name))]
    return tuple(dict.fromkeys(names)), apart


def read(html: str) -> tuple[list[Token], list[Hinted]]:
    """The tags and texts of a page in order, and its hinted elements, outer ones first. Unclosed elements end with the
    element around them."""
    out: list[Token] = []
    hints: list[Hinted] = []
    zones: list[Zone] = []
    of: list[int] = []  # the zone of each token
    # name, feature of words in it, its zone, if it or one not far around is a link, its hinted element
    stack: list[tuple[str, str, int, int, int]] = [("", "page", -1, 0, -1)]
    open_: Counter[str] = Counter()
    marked = 0
    for m in _TOKEN.finditer(html):
        text, (_, feature, zone, link, inside) = m[8], stack[-1]
        if text is not None:
            n = len(text.split())
            if zone >= 0 and not link:
                zones[zone].words += n
            out.append(Token(f"word {feature}{' link' if link else ''}", n, text, False, marked > 0, False, inside))
            of.append(zone)
            continue
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing, attributes = (m[2], m[4]) if m[3] else (m[5], m[7])
        breaks = name in BLOCK
        if closing:
            before, gone = marked > 0, ""
            while open_[name] and gone != name:
                gone = stack.pop()[0]
                open_[gone] -= 1
                marked -= gone in MAIN
            out.append(Token(f"tag /{name}", 0, "", False, before and marked > 0, breaks, stack[-1][4]))
            of.append(stack[-1][2])
            continue
        names, away = _names(attributes) if attributes else ((), False)
        away = (away or name in ASIDE) and name not in ("h1", "h2", "h3", "article", "main", "body", "html")
        if breaks and stack[-1][0] == "p":
            open_["p"] -= 1
            stack.pop()
            _, feature, zone, link, inside = stack[-1]
        if names and name not in VOID:
            hints.append(Hinted(inside, names, marked > 0))
            inside = len(hints) - 1
        outer = zone
        if away or name in MAIN and zone >= 0:
            zones.append(Zone(zone, "main" if name in MAIN else "form" if name == "form" else "apart"))
            zone = len(zones) - 1
        out.append(Token(f"tag {name}", 0, "", False, marked > 0, breaks, inside))
        of.append(outer)
        if name in VOID or attributes.endswith("/"):
            continue
        stack.append((name, name if breaks or away else feature, zone, 4 if name == "a" else max(0, link - 1), inside))
        open_[name] += 1
        marked += name in MAIN
    for z in reversed(zones):
        if z.up >= 0:
            zones[z.up].words += z.words
    apart = _apart(zones, sum(t.words for t in out if not t.where.endswith(" link")))
    for t, zone in zip(out, of, strict=True):
        t.apart = zone >= 0 and apart[zone]
        if t.words and t.hinted >= 0 and not t.apart and not t.where.endswith(" link"):
            hints[t.hinted].words += t.words
    for h in reversed(hints):
        if h.up >= 0:
            hints[h.up].words += h.words
    return out, hints


#: Weights where nothing is learned: words for, words of links and all tags against; little against tags that an article
#: has many of for few words each, those of table cells and within a line.
DEFAULT_WORD, DEFAULT_LINK, DEFAULT_TAG, DEFAULT_SMALL = 0.5, -0.2, -0.2, -0.05
SMALL = frozenset(f"tag {end}{name}" for name in "a abbr b br code em i small span strong sub sup tbody td th tr u".split() for end in ("", "/"))
#: What stands apart is left out of the text anyway, so that it costs little to pass over it inside an article.
APART_WORD, APART_TEXT, APART_TAG = -0.1, -1.0, -0.05
#: A word's loss in an element named by hints alone, by a hint before other words, and by a hint after them (as names of
#: what surrounds an article often are); and its gain where the element holds over half of the page's text.
HINT_ALONE, HINT_FIRST, HINT_LAST, HINT_LARGE = -2.5, -1.2, -0.3, 0.9
#: The share of a page's text from which on an element's name says nothing against it.
HINT_WHOLE = 0.9
#: Words or tags that a feature is seen with before what is learned of it counts as much as what holds without.
PRIOR = 50.0


def _default_hint(name: str) -> float:
    parts = _PART.findall(name)
    if HINTS.issuperset(parts):
        return HINT_ALONE
    return HINT_FIRST if parts[0] in HINTS else HINT_LAST


def _default(feature: str) -> float:
    """The weight of a word or tag of which nothing is known."""
    if feature.startswith("tag "):
        return DEFAULT_SMALL if feature in SMALL else DEFAULT_TAG
    return DEFAULT_LINK if feature.endswith(" link") else DEFAULT_WORD


def learn(pages: DataFrame, most: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of standing inside the article, by feature, from pages that mark one (article or main).

    A hint counts by the words of its elements: inside where it surrounds an article, outside where no article is. One
    that stands in an article isn't labelled by the page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: Counter[str] = Counter()
        outside: Counter[str] = Counter()
        for batch in batches:
            for html in batch.column(0):
                found, hints = read(html.as_py())
                for t in found:
                    h = t.hinted
                    if t.marked and h >= 0 and hints[h].marked:
                        continue
                    at = inside if t.marked and not t.apart else outside
                    at[t.where] += t.words or 1
                    while h >= 0 and t.words and not t.apart:
                        for name in hints[h].names:
                            at[f"hint {name}"] += t.words
                        h = hints[h].up
        keys = list(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["feature", "inside", "outside"])

    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id", "url", "html")
    n = marked.count()
    part = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 11) / F.lit(float(1 << 53))
    sample = marked.filter(part < most / n if n > most else F.lit(True)).select("html")
    counts = sample.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "feature").limit(MOST_WEIGHTS).collect()
    total = {k: [sum(r[k] for r in rows if r["feature"].startswith(kind)) + 1 for kind in ("word", "tag")] for k in ("inside", "outside")}
    out = {}
    for r in rows:
        kind = r["feature"].split(" ", 1)[0]
        which = int(kind == "tag")
        odds = math.log((r["inside"] + 0.5) / total["inside"][which]) - math.log((r["outside"] + 0.5) / total["outside"][which])
        # words weigh by their odds; a tag is a small cost inside an article and a large one outside
        learned = max(-3.0, min(1.0, odds)) if kind == "hint" else max(-4.0, min(-0.05, odds - 1.0)) if which else max(-4.0, min(2.0, odds))
        seen, before = r["inside"] + r["outside"], _default_hint(r["feature"][5:]) if kind == "hint" else _default(r["feature"])
        out[r["feature"]] = (learned * seen + before * PRIOR) / (seen + PRIOR)
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """First and last index (end exclusive) of the contiguous part with the largest sum, 0 and 0 if none is above zero. Of
    equals the first, and of those that start together the longest."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores.tolist()):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best or s > 0 and run == best and start == best_at[0]:
            best, best_at = run, (start, i + 1)
    return best_at


def judge(found: list[Token], hints: list[Hinted], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """The score of every token, and whether it is left out: what is apart, and hinted elements whose words sum to nothing."""
    text = sum(t.words for t in found if not t.apart and not t.where.endswith(" link"))
    shift: list[float] = []
    for h in hints:
        own = min(weights.get(f"hint {name}", _default_hint(name)) for name in h.names) + (HINT_LARGE if 2 * h.words > text else 0.0)
        shift.append((0.0 if h.words >= HINT_WHOLE * text else min(own, 0.0)) + (shift[h.up] if h.up >= 0 else 0.0))
    scores, sums = np.zeros(len(found)), [0.0] * len(hints)
    for i, t in enumerate(found):
        if t.words and not t.apart:
            weight = weights[t.where] if t.where in weights else _default(t.where)
            scores[i] = weight * t.words
            if t.hinted >= 0:
                sums[t.hinted] += (weight + shift[t.hinted]) * t.words
    for k in range(len(hints) - 1, -1, -1):
        if hints[k].up >= 0 and sums[k] > 0:
            sums[hints[k].up] += sums[k]
    away: list[bool] = []
    for h, total in zip(hints, sums, strict=True):
        away.append(total <= 0 or (h.up >= 0 and away[h.up]))
    out = np.array([t.apart or (t.hinted >= 0 and away[t.hinted]) for t in found], bool)
    for i, t in enumerate(found):
        if out[i]:
            scores[i] = max(APART_TEXT, APART_WORD * t.words) if t.words else 0.0 if t.text else APART_TAG
        elif not t.words:
            scores[i] = 0.0 if t.text else weights[t.where] if t.where in weights else _default(t.where)
    return scores, out


def extract(html: str, weights: dict[str, float]) -> str:
    """The blocks of the best region, less what is left out in it."""
    found, hints = read(html)
    scores, away = judge(found, hints, weights)
    start, end = best_region(scores)
    blocks, parts = [], []
    for t, gone in zip(found[start:end], away[start:end].tolist(), strict=True):
        if t.breaks:
            blocks.append(parts)
            parts = []
        elif t.words and not gone:
            parts.append(unescape(t.text))
        elif not gone:
            parts.append(t.text or (" " if t.where in ("tag br", "tag wbr") else ""))
    blocks.append(parts)
    lines = (_SPACE.sub(" ", "".join(p)).strip() for p in blocks)
    return "\n".join(x for x in lines if x)


def html_extraction(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (its code points) for every row of page_id, url, html.

    Weights are learned from the same table if none are given, with defaults where it marks no article. Null and empty
    pages have empty text, and very long ones are read whole, in time that grows with their length. Repeated rows give
    the same text each; null ids and urls stay null. Equal regions: the first wins. Empty tables give empty tables; other columns are ignored.
    """
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    known = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", known) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
