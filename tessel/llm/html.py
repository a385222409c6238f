"""Operator 7: HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens, tags and words. Words score positive, the more the likelier
content stands where they do, or nothing at places where it's less likely than not; tags
score negative. One linear scan (Kadane's) finds the contiguous stretch of the highest sum:
the article's region. What stands in it at unlikely places (an advert amid an article)
neither ends it, however long, nor is it content: it is left out, and the rest is put
together block by block.

Weights come from labelled pages (fitted()): a place is described by features, the
elements around it, each with whether it stands in an article or main element, the words
of their class, id and role, the kind of the nearest block and whether in a link. A logistic
regression of "belongs to the main text" on these gives each feature its weight; a word's
score is its place's log odds, if positive. A tag's score is the log odds of tags of its name, in an
article or main element or not, to stand between the main text's first word and its last, but LEAST at the most, so that tags are
never gain. The tables here have no labels, so the query's weights come from pages made by
construction (labelled.py); other labelled pages can be given instead.

Blocks: block-level tags, open or close, and <br> end a block. White space inside a block
becomes one space, blocks without text are dropped, blocks are joined by one newline.
Character references are decoded.

Null and empty html give an empty text, a page without any word, or none of positive
score, too. An unclosed element ends with its parent; an unclosed tag, comment, <script>
or <style> runs to the page's end, as in browsers. A page is worked through whole, in time
in proportion to its length however its tags are nested or broken. Of equal stretches the
first counts. Repeated rows get the same text each; page_id and url may be null. An empty
table gives an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import labelled
from tessel.llm.common import table

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset("article main".split())
#: Closed by the start of another of these, if it stands in none of the scopes below.
CLOSES = {"p": "p h1 h2 h3 h4 h5 h6 div ul ol table section article pre blockquote form header footer nav aside hr dl figure main address".split(), "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "option": ["option"]}
SCOPES = frozenset("table ul ol dl article section main body div nav aside footer header blockquote td th form".split())
CLOSED_BY = {tag: [t for t, by in CLOSES.items() if tag in by] for by in CLOSES.values() for tag in by}

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NONE = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[a-z]{2,}")


def tags(source: str) -> Iterator[tuple[str, str, str]]:
    """Text, and tags with name and attributes, in their order: (text, "", ""), or ("", name or /name, attributes). Nothing is looked at twice."""
    at, n, raw = 0, len(source), ""
    while at < n:
        if raw:
            end = re.compile(f"</{re.escape(raw)}(?=[\\s/>])", re.I).search(source, at)
            raw = ""
            if not end:
                return
            at = end.start()
        start = source.find("<", at)
        start = n if start < 0 else start
        name = NAME.match(source, start + 1) if start < n else None
        markup = source[start + 1 : start + 2]
        if start < n and not name and markup not in ("!", "?"):  # a plain <
            yield source[at : start + 1], "", ""
            at = start + 1
            continue
        if start > at:
            yield source[at:start], "", ""
        if start == n:
            return
        if not name:
            close, skip = ("-->", 4) if source.startswith("<!--", start) else ("]]>", 9) if source.startswith("<![CDATA[", start) else (">", 2)
            if close == "-->" and source.startswith((">", "->"), start + 4):  # an empty comment
                at = source.find(">", start) + 1
                continue
            end = source.find(close, start + skip)
            if end < 0:
                return
            at = end + len(close)
            continue
        at = name.end()
        while True:
            stop = STOP.search(source, at)
            if not stop:
                return
            at = stop.end()
            if not stop[1]:
                break
            at = source.find(stop[1], at) + 1
            if not at:
                return
        tag = name[1].lower()
        closing = source[start + 1] == "/"
        attributes = "" if closing else source[name.end() : at - 1]
        yield "", "/" + tag if closing else tag, attributes
        if not closing and tag in RAW and not (tag in ("svg", "math") and attributes.endswith("/")):
            raw = tag


class Place:
    """Where words stand: the features of the elements around."""

    __slots__ = ("block", "features", "hidden", "inside", "link", "main")

    def __init__(self, features: frozenset[str], main: bool, block: str, link: bool, hidden: bool):
        self.features, self.main, self.block, self.link, self.hidden = features, main, block, link, hidden
        self.inside: dict[tuple[str, str], Place] = {}

    def within(self, tag: str, attributes: str, known: frozenset[str] | None) -> Place:
        """The place inside an element that stands here."""
        found = self.inside.get((tag, attributes))
        if found is None:
            here = "in" if self.main else "out"
            features, hidden = [f"{here}:<{tag}>"], self.hidden
            for name, one, two, three in ATTRIBUTE.findall(attributes) if attributes else ():
                name, value = name.lower(), one or two or three
                if name in ("class", "id", "role"):
                    features += PART.findall(value.lower())
                hidden |= name == "hidden" or name == "style" and bool(NONE.search(value))
            if known is not None:
                features = [f for f in features if f in known]
            block = self.block if tag in INLINE else tag
            found = self.inside[tag, attributes] = Place(self.features | frozenset(features), self.main or tag in MAIN, block, self.link or tag == "a", hidden)
        return found


class Page:
    """The tokens of a page with what they stand in. known: the features that matter (None: all)."""

    def __init__(self, source: str, known: frozenset[str] | None = None):
        #: Of each token: text (none for a tag), the tag, the place, and whether it ends a block.
        self.tokens: list[tuple[str, str, Place, bool]] = []
        here = Place(frozenset(), False, "", False, False)
        stack: list[tuple[str, Place]] = []  # open elements with the place around them
        open_at: dict[str, list[int]] = {}
        scopes: list[int] = [-1]
        blocks: list[int] = [-1]
        for text, tag, attributes in tags(source):
            if text:
                self.tokens.append((text, "", here, False))
                continue
            closing = tag[0] == "/"
            tag = tag.lstrip("/")
            down = len(stack)
            if closing:
                if open_at.get(tag) and not (tag in INLINE and blocks[-1] > open_at[tag][-1]):
                    down = open_at[tag][-1]
            else:
                down = max([down if not open_at.get(t) or open_at[t][-1] < scopes[-1] else open_at[t][-1] for t in CLOSED_BY.get(tag, ())] or [down], key=lambda d: (d < len(stack), d))
            while len(stack) > down:
                gone, here = stack.pop()
                open_at[gone].pop()
                for places in (scopes, blocks):
                    if places[-1] == len(stack):
                        places.pop()
            if not closing and tag not in VOID and tag not in RAW:
                open_at.setdefault(tag, []).append(len(stack))
                if tag in SCOPES:
                    scopes.append(len(stack))
                if tag not in INLINE:
                    blocks.append(len(stack))
                stack.append((tag, here))
                here = here.within(tag, attributes, known)
            self.tokens.append(("", tag, here, tag not in INLINE))
        #: Whether an article or main element has any word.
        self.marked = any(p.main and text.strip() for text, _, p, _ in self.tokens)

    def features(self, place: Place) -> frozenset[str]:
        """All features of a place on this page."""
        more = {f"{'in' if place.main else 'out'}:{'link' if place.link else 'text'} in <{place.block}>", "<link>" if place.link else "<text>"}
        if self.marked:
            more.add("<in it>" if place.main else "<not in it>")
        return place.features | more

    def text(self, begin: int, end: int, keep) -> str:
        """The blocks of a stretch, of places that keep() says."""
        blocks: list[str] = []
        piece: list[str] = []

        def close() -> None:
            joined = " ".join(references.unescape("".join(piece)).split())
            if joined:
                blocks.append(joined)
            piece.clear()

        for text, _, place, breaks in self.tokens[begin:end]:
            if text:
                if keep(place):
                    piece.append(text)
            elif breaks:
                close()
        close()
        return "\n".join(blocks)


#: A tag's score at the most; steps, pull to zero, and rate of the regression.
LEAST, STEPS, PULL, RATE = -0.1, 200, 0.002, 0.5


def sort(tag: str, place: Place) -> str:
    return f"{'in' if place.main else 'out'}:{tag}"


class Weights:
    """Weights of features, and scores of tags by sort; a tag of another name scores as all tags there together."""

    def __init__(self, base: float, features: dict[str, float], tag: dict[str, float]):
        self.base, self.features, self.tag = base, features, tag
        self.known = frozenset(features)

    def of_tag(self, tag: str, place: Place) -> float:
        found = self.tag.get(sort(tag, place))
        return self.tag.get(sort("", place), LEAST) if found is None else found

    def of(self, page: Page):
        """A function that gives the score of a word at a place of page."""
        scores: dict[Place, float] = {}

        def score(place: Place) -> float:
            found = scores.get(place)
            if found is None:
                found = scores[place] = -math.inf if place.hidden else self.base + sum(self.features.get(f, 0.0) for f in page.features(place))
            return found

        return score


def fitted(pages: list[tuple[str, str]]) -> Weights:
    """Weights from pages and their main texts: a block that is a line of the text belongs to it."""
    inside: dict[frozenset[str], list[int]] = {}
    tag: dict[str, list[int]] = {}
    for source, text in pages:
        page, lines = Page(source), set(text.split("\n"))
        good, piece = [False] * len(page.tokens), []
        for i, (words, _, _, breaks) in enumerate([*page.tokens, ("", "", None, True)]):
            if words:
                piece.append(i)
            elif breaks:
                block = " ".join(references.unescape("".join(page.tokens[j][0] for j in piece)).split())
                for j in piece:
                    good[j] = block in lines
                piece = []
        places = [i for i, g in enumerate(good) if g]
        for i, (words, name, place, _) in enumerate(page.tokens):
            if words.strip():
                seen = inside.setdefault(page.features(place), [0, 0])
                seen[good[i]] += 1
            elif name:
                seen = tag.setdefault(sort(name, place), [0, 0])
                seen[bool(places) and places[0] < i < places[-1]] += 1
    rows = sorted(inside, key=sorted)
    names = sorted({f for r in rows for f in r})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, r in enumerate(rows):
        x[i, [index[f] for f in r]] = 1
    x[:, -1] = 1
    counts = np.array([inside[r] for r in rows], np.float64).reshape(-1, 2)
    n = counts.sum(1)
    goal, weight = (counts[:, 1] + 0.01) / (n + 0.02), np.sqrt(n) / np.sqrt(n).sum() if len(n) else n
    w, moment, second = np.zeros(len(names) + 1), 0.0, 0.0
    for step in range(1, STEPS + 1):
        slope = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - goal)) + PULL * w / max(1, len(names))
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w - RATE / math.sqrt(step) * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    for where in ("in:", "out:"):
        mine = [counts for t, counts in tag.items() if t.startswith(where)]
        tag[where] = [sum(x) for x in zip(*mine, strict=True)] if mine else [0, 0]
    return Weights(float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True)), {t: min(LEAST, math.log((a + 0.5) / (b + 0.5))) for t, (b, a) in tag.items()})


@cache
def standard() -> Weights:
    """The weights of the pages made by construction."""
    return fitted(labelled.pages())


def region(page: Page, weights: Weights) -> tuple[int, int]:
    """The contiguous stretch of tokens with the highest positive sum, end exclusive; of equal ones the first."""
    score = weights.of(page)
    return stretch([max(0.0, score(place)) * len(text.split()) if text else weights.of_tag(tag, place) for text, tag, place, _ in page.tokens])


def stretch(scores: list[float]) -> tuple[int, int]:
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def extracted(source: str | None, weights: Weights | None = None) -> str:
    weights = weights or standard()
    page = Page(source or "", weights.known)
    score = weights.of(page)
    return page.text(*region(page, weights), lambda place: score(place) > 0)


def main_texts(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    slim = pages.select("page_id", "url", "html")
    weights = weights or standard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extracted(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
