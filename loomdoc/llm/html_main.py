"""Main text of HTML pages by a maximum-scoring run of tokens.

A page is a row of words and tags. A tag costs at least TAG_COST, and more the
more it stands outside the articles of labelled pages. A word scores what the
elements around it say, from the outermost to the innermost: every element adds
the log-odds of its features (its name, and each whole token of its class, id
and role). A good opinion is cut to START before a bad one is added, so a menu in
an article is a menu, while a bad one is kept, so an article in the comments is a
comment; a form's is so small that the content of a page-wide form outweighs it.
The class of an <article> or <main> can't make that element itself a bad sign.
One linear scan finds the run of largest sum; the text is what the run holds,
without words that score nothing or less. Such words inside a favoured region
gain nothing, elsewhere they cost their score.

Weights: log-odds of words inside and outside the <article> or <main> of pages
that have one, over prior counts by role, so an unlabelled corpus has a model,
too. Only what no enclosing element explains yet counts for a feature, and names
that say nothing by themselves (div, p, li and the like) have no weight as
elements. On a page whose markup says where the article is, words without such a
sign around them score PAGE_MARKED less.

Character references are decoded, white space in a block becomes one space,
blocks are joined in page order by one space; elements that are no blocks (b, a,
math, unknown names) don't break a word. A null or empty page, or one without a
positive run, gives the empty text. Of equal runs the first wins. Repeated rows
get equal texts, an empty table gives no rows, other columns of the pages are
ignored, and a page is read whole whatever its length, in time linear in it.
Unclosed and stray tags are taken as browsers mostly do: an end tag closes up to
its element, and is ignored where there is none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import bounded_sample, map_rows

#: Most labelled pages that the weights are fitted on.
LABELLED_PAGES = 2_000
#: A tag scores at most minus this, and at least minus TAG_MOST.
TAG_COST, TAG_MOST = 0.05, 1.0
#: Score of a word that nothing speaks for or against, and what it loses on a page that marks its article.
START, PAGE_MARKED = 1.0, 2.0
#: Bounds of a word's score, and of an element's weight.
HIGHEST, LOWEST, CLIP = 4.0, -40.0, 8.0
#: Prior words of a feature on either side; times 10 on the side of its role; log-odds of a role strongly against.
PRIOR, STRONG = 20.0, -8.0

# Element and class names by their usual role.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "object", "canvas", "select", "option", "annotation", "annotation-xml")
AGAINST = ("nav", "header", "footer", "aside", "menu", "dialog")
WEAK_AGAINST = ("form", "fieldset")
IN_FAVOUR = ("article", "main")
HINTS_AGAINST = ("ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "comment-list", "commentlist", "comments-area", "cookie", "cookies", "cookie-banner", "consent", "disqus", "disqus_thread", "footer", "site-footer", "header", "site-header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "outbrain", "pagination", "popup", "promo", "recommended", "related", "related-posts", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "widget", "alert", "hidden", "skip", "search", "login", "legal", "copyright", "complementary", "contentinfo", "dialog")
HINTS_FOR = ("article", "articlebody", "article-body", "post", "post-content", "entry", "entry-content", "story", "content", "main", "main-content")
NEUTRAL = ("html", "body", "div", "span", "section", "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "center", "font", "a", "b", "i", "u", "s", "em", "strong", "small", "big", "mark", "code", "kbd", "samp", "var", "sub", "sup", "q", "cite", "abbr", "time", "del", "ins", "label", "button", "math", "svg")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = ("address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW, _VOID, _BLOCK, _NEUTRAL, _FAVOUR = map(frozenset, (RAW, VOID, BLOCK, NEUTRAL, IN_FAVOUR))
_CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
_ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th"))
#: A list, table or block ends the search for an open item or paragraph.
_WALLS = frozenset(("ul", "ol", "dl", "table", "article", "main", "div", "section", "body", "nav", "aside", "form", "blockquote"))

Around = tuple[tuple[str, tuple[str, ...]], ...]


def features(name: str, attributes: str) -> tuple[str, ...]:
    """What an element says of its words: its name, unless neutral, and the whole tokens of its class, id and role."""
    found = [] if name in _NEUTRAL else [f"<{name}>"]
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "style":
            found += [".hidden"] * ("display:none" in value.replace(" ", ""))
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            found.append(".hidden")
        elif key != "aria-hidden":
            found += [f".{w}" for w in value.split()]
    return tuple(dict.fromkeys(found))


def stream(html: str) -> Iterator[tuple[str, str, Around]]:
    """("text", text, elements around it), ("break", name, elements) and ("tag", name, elements) in page order."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    around: Around = ()
    at, end, low = 0, len(html), None
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            yield "text", html[at:], around
            return
        if m.start() > at:
            yield "text", html[at : m.start()], around
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                del stack[k:]
        elif name in _RAW and not m[3].endswith("/"):
            low = low or html.lower()
            stop = low.find(f"</{name}", at)
            at = end if stop < 0 else stop
            stack.append((name, ()))
        elif name not in _VOID:
            if name in _CLOSES_P or name in _ITEMS:
                ends = ("p",) if name in _CLOSES_P else ("p", "dt", "dd") if name in ("dt", "dd") else ("p", "td", "th", "tr") if name == "tr" else ("p", "td", "th") if name in ("td", "th") else ("p", name)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                    elif stack[k][0] in _WALLS:
                        break
            if not m[3].endswith("/"):
                stack.append((name, features(name, m[3])))
        around = tuple(stack)
        yield ("break" if name in _BLOCK else "tag"), name, around


def priors() -> dict[str, float]:
    """The role of a feature: 1 in favour, -1 against, -2 strongly against."""
    return {f"<{n}>": -1.0 for n in WEAK_AGAINST} | {f"<{n}>": -2.0 for n in AGAINST} | {f".{n}": -2.0 for n in HINTS_AGAINST} | {f"<{n}>": 1.0 for n in IN_FAVOUR} | {f".{n}": 1.0 for n in HINTS_FOR}


_PRIORS = priors()


def learned(counts: dict[tuple[str, bool], float]) -> dict[str, float]:
    """Weights from (feature, in main text) counts of words, and of tags by their bare names, over the priors by role."""
    weights = {}
    for f in {k for k, _ in counts} | set(_PRIORS):
        role = _PRIORS.get(f, 0)
        inside = counts.get((f, True), 0) + PRIOR * (10 if role > 0 else 1)
        outside = counts.get((f, False), 0) + PRIOR * (10 if role == -1 else 1)
        odds = math.log(inside / outside) + (STRONG if role == -2 else 0)
        weights[f] = max(-CLIP, min(CLIP, odds))
    return weights


def word_weight(around: Around, weights: dict[str, float], start: float = START) -> tuple[float, bool]:
    """The score of a word inside these elements, from the outermost inward, and whether one of them is a favoured region."""
    score, favoured = start, False
    for name, found in around:
        if name in _RAW:
            return LOWEST, favoured
        if found and name not in ("html", "body"):
            e = max(-CLIP, min(CLIP, sum(weights.get(f, 0.0) for f in found)))
            if name in _FAVOUR:
                e = max(e, 0.0)
            if e > 0:
                score = min(HIGHEST, score + e)
            elif e < 0:
                score = max(LOWEST, min(score, START) + e)
            favoured = favoured or score > START
    return score, favoured


def tag_weight(name: str, weights: dict[str, float]) -> float:
    return -max(TAG_COST, min(TAG_MOST, -weights.get(name, 0.0) / 4))


def best_run(gains: list[float]) -> tuple[int, int]:
    """First and after-last place of the first run of largest sum; (0, 0) without a positive one."""
    total = low = best = 0.0
    start, span = 0, (0, 0)
    for k, gain in enumerate(gains):
        total += gain
        if total <= low:
            low, start = total, k + 1
        elif total - low > best:
            best, span = total - low, (start, k + 1)
    return span


def scored(html: str, weights: dict[str, float]) -> list[tuple[str, str, float, float]]:
    """kind, text or name, score of a word and gain of every token of a page.

    What is left out of a favoured region doesn't end the run: its words gain
    nothing, its tags cost the least.
    """
    events = [(kind, unescape(value) if kind == "text" else value, around) for kind, value, around in stream(html)]
    by = {around: word_weight(around, weights) for _, _, around in events}
    marked = {around for around, (s, _) in by.items() if s > 0 and any(n in _FAVOUR for n, _ in around)}
    if any(kind == "text" and around in marked and not value.isspace() for kind, value, around in events):
        by |= {around: word_weight(around, weights, START - PAGE_MARKED) for around in by if around not in marked}
    out = []
    for kind, value, around in events:
        score, favoured = by[around]
        if kind == "text":
            gain = 0.0 if favoured and score <= 0 else max(-HIGHEST, score) * len(value.split())
        else:
            gain = -TAG_COST if favoured else tag_weight(value, weights)
        out.append((kind, value, score, gain))
    return out


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The text of the run of largest sum."""
    if not html:
        return ""
    events = scored(html, weights)
    parts: list[list[str]] = [[]]
    for kind, value, score, _ in events[slice(*best_run([e[3] for e in events]))]:
        if kind == "text":
            if score > 0:
                parts[-1].append(value)
        elif kind == "break":
            parts.append([])
    return " ".join(x for p in parts if (x := " ".join("".join(p).split())))


def label_counts(html: str) -> Counter[tuple[str, bool]]:
    """Words by feature, and tags by name, inside and outside the page's own <article> or <main>.

    Inside means in it, but not in an element whose role is against it within.
    Only features count that no element around theirs explains: those of the
    elements down to the first that has a role.
    """
    counts: Counter[tuple[str, bool]] = Counter()
    memo: dict[Around, tuple[frozenset[str], bool]] = {}
    for kind, value, around in stream(html):
        if around not in memo:
            inside, found, explained = False, set(), False
            for name, own in around:
                role = min((_PRIORS[f] for f in own if f in _PRIORS), default=0)
                inside = name in _FAVOUR or inside and role >= 0
                if not explained and name not in ("html", "body"):
                    found.update(own)
                explained = explained or any(f in _PRIORS for f in own)
            memo[around] = frozenset(found), inside
        found, inside = memo[around]
        if kind != "text":
            counts[value, inside] += 1
        elif n := len(value.split()):
            for f in found:
                counts[f, inside] += n
    return counts


def fit(pages: DataFrame, html_col: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most `most` pages that mark their article, chosen by a hash of the page."""
    labelled = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
    labelled = bounded_sample(labelled, ["html"], most)

    def start():
        def step(columns: list[list]) -> Iterator[tuple]:
            counts: Counter[tuple[str, bool]] = Counter()
            for html in columns[0]:
                counts.update(label_counts(html))
            yield from ((f, inside, float(n)) for (f, inside), n in counts.items())

        return step

    rows = map_rows(labelled, "feature string, inside boolean, n double", start).groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    return learned({(r.feature, r.inside): r.n for r in rows})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page row; no shuffle."""
    if weights is None:
        weights = fit(pages, html_col)
    types = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def start():
        def step(columns: list[list]) -> Iterator[tuple]:
            for page_id, url, html in zip(*columns):
                text = main_text(html, weights)
                yield page_id, url, text, len(text)

        return step

    return map_rows(pages.select(id_col, url_col, html_col), f"page_id {types[id_col]}, url {types[url_col]}, text string, n_chars long", start, block=500)
