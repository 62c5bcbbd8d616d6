"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page is a sequence of text runs and tags. Each word scores by the log-odds of its context (block tag, inside a
link, inside an element that is furniture by tag, class or id), each tag scores below zero by how often it stands
outside content. The weights are counted on labelled pages: those with exactly one article element say which tokens
are content. A linear scan then finds the contiguous region with the best sum. Furniture is left out and scores 0 in the
scan, words and tags, so it neither joins nor splits a region. Inside the article element with most plain words
nothing costs, so lists of links there do not cut it. All steps are linear in the page.
Only the fit is bounded: at most ``TRAIN_PAGES`` pages, those with the smallest hash of page_id.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 2000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|svg|iframe|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<(?:[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))|[^<]+|<", re.S | re.I)
_END = re.compile("[\"'>]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
                   "tfoot th thead tr ul".split())
_FURNITURE = frozenset("nav aside footer form menu dialog button label".split())
_HINT = re.compile(r"(?:^|[\s_-])(?!related[_-]works?\b|tag[_-]lines?\b|side[_-]effects?\b|share[_-]prices?\b)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|footer|"
                   r"cookies?|consent|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|"
                   r"comments?|disqus|repl(?:y|ies)|respond|login|signup|skip|pagination|pager|widget|toolbar|tags?)(?:$|[\s_-])", re.I)
# of a site, not of an article
_HEADER = re.compile(r"(?:^|[\s_-])(?<!entry.)(?<!post.)(?<!article.)(?:header|masthead)(?:$|[\s_-])", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACES = re.compile(r"\s+")
_ZEROS = re.compile(r"&#0+(?=\d)")
_NO_CHARACTER = re.compile(r"&#\d{8,};?")  # above all code points
# least score of a word of the page's article: less than any plain word, more than nothing
ARTICLE_WORD = 0.05
_ZEROS = re.compile(r"&#0+(?=\d)")
_NO_CHARACTER = re.compile(r"&#\d{8,};?")  # above all code points
# least score of a word of the page's article: less than any plain word, more than nothing
ARTICLE_WORD = 0.05


class Run(NamedTuple):
    """A text run or a tag of a page."""

    tag: str  # empty for text
    text: str
    block: str
    link: bool
    furniture: bool
    content: bool  # inside an article element
    article: int = 0  # number of the outermost article element around it, 0 outside


class _TagEnds:
    """Where tags of a page end: the first > outside quotes or, if a quote stays open, the first > at all.

    All calls together take linear time if the tag at each place is skipped before the next call.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.places: list[int] = []
        self.ends: list[int] | None = None

    def after(self, at: int) -> int:
        """Place of the > of the tag whose name ends at ``at``, or -1."""
        if at > self.last:
            return -1
        first = self.page.find(">", at)
        if not self.page.count("'", at, first) and not self.page.count('"', at, first) % 2:
            return first
        if self.ends is None:
            self._scan()
        end = self.ends[bisect_left(self.places, at)]
        return first if end < 0 else end

    def _scan(self) -> None:
        """From the back, the end reached outside quotes from each quote and each >."""
        self.places = [m.start() for m in _END.finditer(self.page)]
        self.ends = [-1] * (len(self.places) + 1)
        behind = {"'": -1, '"': -1}  # index of the next quote of each kind
        for i in range(len(self.places) - 1, -1, -1):
            mark = self.page[self.places[i]]
            if mark == ">":
                self.ends[i] = self.places[i]
            else:
                self.ends[i] = self.ends[behind[mark] + 1] if behind[mark] >= 0 else -1
                behind[mark] = i


class _Mark(NamedTuple):
    """Start of an element that looks like furniture: the mark around it, whether it may wrap a page, and where it stands."""

    outer: int
    wraps: bool  # marked by its attributes, a header or a form
    within: dict[str, int]  # open elements
    before: dict[str, int]  # words up to here: "" all, "article" and "main" those inside


def _hinted(attributes: str, content: bool) -> bool:
    """Whether class, id or role hint at furniture, or the element is hidden."""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role") and (_HINT.search(value) or not content and _HEADER.search(value)):
            return True
        if key == "hidden" and value.lower() != "false" or key == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def runs(page: str) -> list[Run]:
    """Text runs and tags of a page in order.

    An article or main element ends the furniture that encloses it, unless it is an article in an article. A wrapper of
    most words of the page is no furniture by its hints, unless the page's article stands elsewhere.
    """
    found: list[tuple[Run, int]] = []  # with the innermost mark around it, or -1
    marks: list[_Mark] = []
    ends: dict[int, dict[str, int]] = {}
    open_: list[tuple[str, int, int]] = []  # name, mark around it, own mark or -1
    names: Counter[str] = Counter()  # of open elements
    blocks = [""]  # open block elements
    mark, links, articles = -1, 0, 0
    depth, words = {"article": 0, "main": 0}, {"": 0, "article": 0, "main": 0}
    tag_ends = _TagEnds(page)

    def close() -> tuple[str, int]:
        nonlocal mark, links
        n, mark, own = open_.pop()
        names[n] -= 1
        links -= n == "a"
        if n in _BLOCK:
            blocks.pop()
        if n in depth:
            depth[n] -= 1
        if own >= 0:
            ends[own] = dict(words)
        return n, own

    def add(run: Run, around: int) -> None:
        found.append((run._replace(article=articles) if depth["article"] else run, around))

    at = 0
    while m := _TOKEN.match(page, at):
        start, at = at, m.end()
        closing, name = m[2], m[3]
        content = any(depth.values())
        attributes = ""
        if name or m[0] in ("<!", "<?"):
            end = tag_ends.after(at)
            if end >= 0:
                attributes, at = page[at:end], end + 1
            else:  # no tag without its end: the sign and what follows are text
                name, at = None, start + 1
        if not name:
            if m[0][0] != "<" or at == start + 1:
                add(Run("", page[start:at], blocks[-1], links > 0, False, content), mark)
                n_words = len(page[start:at].split())
                for kind in words:
                    words[kind] += n_words if not kind or depth[kind] else 0
            continue
        name, own = name.lower(), -1
        if closing:
            if names[name] > 0:
                n = ""
                while n != name:
                    n, own = close()
        elif name not in _VOID:
            if name in ("p", "li", "tr", "td", "dt", "dd", "option") and open_ and open_[-1][0] == name:
                close()
            outer = mark
            if name in depth:
                if name == "main" or not depth["article"]:
                    mark = -1
                articles += name == "article" and not depth["article"]
                depth[name] += 1
            elif name in _FURNITURE or name == "header" and not content or name not in ("html", "body") and attributes and _hinted(
                    attributes, content):
                marks.append(_Mark(mark, name == "form" or name not in _FURNITURE, dict(depth), dict(words)))
                mark = own = len(marks) - 1
            open_.append((name, outer, own))
            names[name] += 1
            if name in _BLOCK:
                blocks.append(name)
            links += name == "a"
        # the tag that closes furniture is part of it
        add(Run(("/" if closing else "") + name, "", "", False, False, any(depth.values())), own if own >= 0 else mark)
    kind = "article" if words["article"] else "main"
    furniture = []
    for i, k in enumerate(marks):
        own_words = {w: ends.get(i, words)[w] - n for w, n in k.before.items()}
        wrapper = k.wraps and 2 * own_words[""] > words[""] and (k.within[kind] or own_words[kind] == words[kind])
        furniture.append(not wrapper or k.outer >= 0 and furniture[k.outer])
    return [r._replace(furniture=True) if k >= 0 and furniture[k] else r for r, k in found]


class Weights(NamedTuple):
    prior: float
    parts: dict[str, float]
    tags: dict[str, float]

    def of(self, run: Run) -> float:
        if run.furniture:
            return 0.0
        if run.tag:
            return self.tags.get(run.tag.lstrip("/"), -0.5)
        words = len(run.text.split())
        if not words:
            return 0.0
        return words * max(-4.0, min(1.0, self.prior + sum(self.parts.get(p, 0.0) for p in _parts(run))))

    def within(self, run: Run) -> float:
        """Score of a run of the page's article."""
        return 0.0 if run.tag or run.furniture else max(self.of(run), ARTICLE_WORD * len(run.text.split()))

    def within(self, run: Run) -> float:
        """Score of a run of the page's article."""
        return 0.0 if run.tag or run.furniture else max(self.of(run), ARTICLE_WORD * len(run.text.split()))


def _parts(run: Run) -> tuple[str, str, str]:
    return f"block {run.block}", f"link {run.link}", f"furniture {run.furniture}"


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of labelled pages, how often each part of a context and each tag stands inside and outside content."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.html:
            found = runs(page)
            if sum(r.tag == "article" for r in found) != 1:
                continue
            for r in found:
                seen = inside if r.content else outside
                if r.tag:
                    seen["tag " + r.tag.lstrip("/")] += 1
                elif words := len(r.text.split()):
                    seen["words"] += words
                    for part in _parts(r):
                        seen[part] += words
    keys = sorted(inside.keys() | outside.keys())
    if keys:  # an empty frame has no column types
        yield pd.DataFrame({"key": keys, "inside": [inside[k] for k in keys], "outside": [outside[k] for k in keys]})


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from at most ``train_pages`` pages; the keys are tag names and contexts, so few reach the driver.

    Without a labelled page words outside furniture and links score 1, others below 0.
    """
    ids = pages.filter("html is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).distinct()
    train = pages.filter("html is not null").select("page_id", "html").join(F.broadcast(ids), "page_id").select("html")
    rows = (train.mapInPandas(_counts, "key string, inside long, outside long").groupBy("key")
            .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    found = {r.key: (r.inside, r.outside) for r in rows}
    n_in, n_out = found.pop("words", (0, 0))
    if not n_in or not n_out:
        return Weights(1.0, {"link True": -2.0, "furniture True": -5.0}, {})

    def odds(a: int, b: int) -> float:
        return math.log((a + 1) / (n_in + 2)) - math.log((b + 1) / (n_out + 2))

    parts = {k: odds(*c) for k, c in found.items() if not k.startswith("tag ")}
    # a tag's share outside content, from almost nothing to one
    tags = {k[4:]: -0.01 - (b / (a + b)) for k, (a, b) in found.items() if k.startswith("tag ")}
    return Weights(math.log(n_in / n_out), parts, tags)


def _decoded(text: str) -> str:
    """Text with its character references decoded, those of thousands of digits too."""
    if "&#" in text:
        text = _NO_CHARACTER.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def _decoded(text: str) -> str:
    """Text with its character references decoded, those of thousands of digits too."""
    if "&#" in text:
        text = _NO_CHARACTER.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region: blocks in page order, one line each.

    In the page's article, that with most words outside links, tags cost nothing and words at least score
    ``ARTICLE_WORD``, so that its lists of links and tables neither split it nor fall off its ends.
    """
    found = runs(page or "")
    sizes: Counter[int] = Counter()
    for r in found:
        if r.article and not r.tag and not r.link and not r.furniture:
            sizes[r.article] += len(r.text.split())
    article = min(sizes, key=lambda k: (-sizes[k], k), default=-1)
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, r in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        total += weights.within(r) if r.article == article else weights.of(r)
        if total > best:
            best, begin, end = total, start, i + 1
    blocks: list[list[str]] = [[]]
    for r in found[begin:end]:
        if r.tag:
            if r.tag.lstrip("/") in _BLOCK:
                blocks.append([])
        elif not r.furniture:
            blocks[-1].append(r.text)
    lines = (_SPACES.sub(" ", _decoded("".join(b))).strip() for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page. pages: page_id, url, html; other columns are not read.

    Null and empty html, and pages without a word that scores above zero: empty text. Text outside any tag is text.
    Equal rows give equal rows. An empty table gives an empty result.
    """
    weights = fit(pages, train_pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": [main_text(h, weights) for h in batch.html]})

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long")))
