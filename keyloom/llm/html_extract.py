"""Main text of web pages.

The standard library's parser streams events, which become lines: one for each
run of text between block tags. A line's text-to-tag ratio, smoothed by a
Gaussian along the page, is split into two clusters by a threshold. The upper
cluster selects the content region: the container that holds it, or, where pages
mark articles, the article that holds it. All lines of the region are kept, short
ones too, as a ratio alone drops short paragraphs and keeps long adverts.

Containers that cannot be the article's text (menus, footers, sidebars, adverts,
forms, comments, ...) are told by their tag or role, or by a class or id that
says nothing else. Such a mark is lifted where it wraps the whole article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common as C

SIGMA = 1.5
#: Share of the upper cluster that a content region holds at least.
SHARE = 0.8
#: Tags that end a line.
BLOCK = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose text is not shown, or is a form's.
SILENT = frozenset("script style noscript template title iframe object canvas audio video select datalist textarea".split())
#: Containers that are tracked; those of REGION may be content regions.
REGION = frozenset("article main section div body html td center".split())
BOXES = REGION | frozenset("nav header footer aside form ul ol dl table figure details dialog fieldset menu blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags, roles and words of a class or id that tell that a container is not the article; those of FIRM even if it holds an article.
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
FIRM = frozenset(
    "footer aside dialog complementary contentinfo alertdialog comment comments commentlist disqus respond replies reply ad ads advert adverts advertisement sponsor sponsored promo sidebar cookie cookies consent notice notices popup modal newsletter related share sharing social breadcrumb breadcrumbs pagination".split()
)
HINTS = FIRM | frozenset("nav navbar navigation menu menubar masthead toolbar topbar banner subscribe signup login".split())
#: The same, of containers outside of an article alone.
LOOSE = HINTS | frozenset("header advertising promotion search alert overlay recommended widget pager copyright side".split())
#: Words that may stand beside these in a name of the same meaning.
BESIDE = frozenset("area article bar block blog body bottom box button buttons cell col column container content feed footer form global group header heading holder inner item items js left link links list main message outer page panel post primary region right row secondary section site slot text thread title top unit widget wrap wrapper zone".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[^\s/>]*")
_PART = re.compile(r"[a-z]+")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")


def named(value: str | None, words: frozenset[str]) -> str | None:
    """The word that a class or id of these names consists of, but for words that may stand beside it."""
    for token in (value or "").split():
        parts = _PART.findall(_CAMEL.sub("-", token).lower())
        found = [x for x in parts if x in words]
        if found and all(x in words or x in BESIDE for x in parts):
            return found[0]
    return None


class _Lines(HTMLParser):
    """Collects lines and the tree of containers. Never fails, in time linear in the page: what is not closed ends with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Of each line: text, tags, characters within links, container.
        self.lines: list[tuple[str, int, int, int]] = []
        #: Of each container, the page being the first: parent, tag, the word that marks it, whether an article is around it.
        self.parent, self.tag, self.mark, self.within = [0], ["html"], [""], [False]
        self.parts: list[str] = []
        self.tags = self.linked = self.link = self.silent = 0
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag and container; of a silent tag, the container around it
        self.open: Counter[str] = Counter()
        self.in_tag = self.junk = False

    # The library leaves broken markup in the text, or raises; here it goes.
    def parse_comment(self, i: int, report: bool = True) -> int:
        raw = self.rawdata
        if raw.startswith((">", "->"), i + 4):
            return raw.index(">", i) + 1
        end = raw.find("-->", i + 4)
        return len(raw) if end < 0 else end + 3

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.parse_bogus_comment(i)

    def parse_bogus_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find(">", i + 2)
        return len(self.rawdata) if end < 0 else end + 1

    parse_pi = parse_bogus_comment

    def parse_starttag(self, i: int) -> int:
        end = self.check_for_whole_start_tag(i)
        if end > i and self.rawdata[end - 1] == ">":
            self.in_tag, self.junk = True, False
            end = super().parse_starttag(i)
            self.in_tag = False
            if not self.junk:
                return end
        else:
            end = self.rawdata.find(">", i) + 1
        if end > 0:
            self.handle_starttag(_NAME.match(self.rawdata, i + 1)[0].lower(), [])
        return end or len(self.rawdata)

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return len(self.rawdata) if end < 0 else end

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.stack[-1][1]))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and tag != "title":
            if self.open["title"]:  # it was left open
                self.pop("title")
            if not self.silent:
                self.end_line()
        self.tags += not self.silent
        if tag == "a":
            self.link = 1
        if tag in SILENT:
            self.push(tag, self.stack[-1][1])
            self.silent += 1
        elif tag in BOXES:
            top = self.stack[-1][1]
            article = self.within[top] or self.tag[top] in ("article", "main")
            self.parent.append(top)
            self.tag.append(tag)
            self.within.append(article)
            self.mark.append(self.marked(tag, attrs, article))
            self.push(tag, len(self.parent) - 1)

    @staticmethod
    def marked(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> str:
        """The word that marks a container as none of the article's."""
        if tag in OUTSIDE and not (tag == "header" and article):
            return tag
        if tag in ("body", "html", "main"):
            return ""
        for name, value in attrs:
            if name == "role" and (value or "").strip().lower() in ROLES:
                return value.strip().lower()
            if name in ("class", "id"):
                found = named(value, HINTS if article or tag == "article" else LOOSE)
                if found:
                    return found
        return ""

    def push(self, tag: str, box: int) -> None:
        self.stack.append((tag, box))
        self.open[tag] += 1

    def pop(self, tag: str) -> None:
        while True:
            last, _ = self.stack.pop()
            self.open[last] -= 1
            self.silent -= last in SILENT
            if last == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK and not self.silent:
            self.end_line()
        self.tags += not self.silent
        if tag == "a":
            self.link = 0
        if self.open[tag]:
            if tag in BOXES:
                self.end_line()
            self.pop(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_data(self, data: str) -> None:
        if self.in_tag:
            self.junk = True
        elif not self.silent:
            self.parts.append(data)
            self.linked += self.link * len(data)

    def close(self) -> None:
        super().close()
        self.end_line()


def parsed(html: str) -> _Lines:
    """The lines and containers of a page."""
    out = _Lines()
    out.feed(_HUGE.sub("�", _ZEROS.sub("&#", html)))
    out.close()
    return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the page; ends are renormalised."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray, rounds: int = 30) -> float:
    """Bound between two clusters of values: the middle of their means, until it stays."""
    at = float(values.mean())
    for _ in range(rounds):
        low, high = values[values < at], values[values >= at]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def upper_cluster(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each line is in the upper cluster of smoothed text-to-tag ratios."""
    ratios = smoothed(sizes / np.maximum(1, tags))
    return ratios >= threshold(ratios)


class _Page:
    """Which lines of a page make up its content."""

    def __init__(self, p: _Lines):
        self.p, self.n = p, len(p.parent)
        self.home = [x[3] for x in p.lines]
        self.size = np.array([len(x[0]) for x in p.lines], dtype=np.float64)
        self.high = upper_cluster(self.size, np.array([x[1] for x in p.lines], dtype=np.float64))
        self.lifted: set[int] = set()

    def below(self, flags: list[bool]) -> list[bool]:
        """Whether a container or one around it is flagged."""
        out = list(flags)
        for k in range(1, self.n):
            out[k] = out[k] or out[self.p.parent[k]]
        return out

    def sums(self, weight: np.ndarray) -> list[float]:
        """Of each container, the weight of its lines and of those of containers within it."""
        out = [0.0] * self.n
        for k, w in zip(self.home, weight.tolist()):
            out[k] += w
        for k in range(self.n - 1, 0, -1):
            out[self.p.parent[k]] += out[k]
        return out

    def outside(self) -> list[bool]:
        return self.below([bool(m) and k not in self.lifted for k, m in enumerate(self.p.mark)])

    def lift(self, box: int) -> None:
        """Take marks that are not firm from the containers around a box."""
        while box:
            if self.p.mark[box] not in FIRM:
                self.lifted.add(box)
            box = self.p.parent[box]

    def content(self) -> np.ndarray:
        tag = self.p.tag
        articles = [k for k in range(self.n) if tag[k] in ("article", "main")]
        out = self.outside()
        every, upper = self.sums(self.size), self.sums(self.size * self.high)
        if articles and all(out[k] or not every[k] for k in articles):  # a menu that was left open, or a form around the page
            self.lift(max(articles, key=lambda k: (upper[k], every[k], -k)))
        elif not articles and not (self.high & self.live(out)).any():  # a wrapper that is named like a menu
            self.lift(self.smallest(upper, [False] * self.n))
        out = self.outside()
        live = self.live(out)
        if not live.any():
            return live
        high = self.high & live
        every, upper = self.sums(self.size * live), self.sums(self.size * (high if high.any() else live))
        regions = self.articles([k for k in articles if not out[k] and every[k]], every, upper)
        if regions:
            return live & self.lines_of(regions)
        return self.trimmed(live & self.lines_of([self.common(upper, high if high.any() else live, out)]), high)

    def live(self, out: list[bool]) -> np.ndarray:
        return np.array([not out[k] for k in self.home], dtype=bool)

    def lines_of(self, regions: list[int]) -> np.ndarray:
        flags = [False] * self.n
        for k in regions:
            flags[k] = True
        inside = self.below(flags)
        return np.array([inside[k] for k in self.home], dtype=bool)

    def articles(self, found: list[int], every: list[float], upper: list[float]) -> list[int]:
        """The marked article with the most of the upper cluster; all that hold some where none holds half of it; none where several hold but a small part of it."""
        if not found:
            return []
        score = {k: upper[k] + 0.01 * every[k] for k in found}
        within = self.below([t == "article" for t in self.p.tag])
        own = [k for k in found if self.p.tag[k] == "article" and not within[self.p.parent[k]]]
        main = max((k for k in found if self.p.tag[k] == "main"), key=lambda k: (score[k], -k), default=None)
        if not own:
            return [main] if main is not None else [max(found, key=lambda k: (score[k], -k))]
        total = sum(score[k] for k in own)
        if len(own) > 1 and main is not None and score[main] > 2 * total:
            return [main]
        if len(own) > 1 and main is None and upper[0] > 3 * sum(upper[k] for k in own):
            return []
        best = max(own, key=lambda k: (score[k], -k))
        return [best] if 2 * score[best] >= total else [k for k in own if upper[k] > 0] or [best]

    def smallest(self, upper: list[float], out: list[bool]) -> int:
        """The innermost region with most of the upper cluster."""
        best = 0
        for k in range(1, self.n):
            if self.p.tag[k] in REGION and not out[k] and upper[k] >= SHARE * upper[0]:
                best = k
        return best

    def common(self, upper: list[float], high: np.ndarray, out: list[bool]) -> int:
        """That region, or the outermost around it with a part of the upper cluster in no region within it."""
        region = [0] * self.n  # of each container, the nearest region that it is or is in
        for k in range(1, self.n):
            region[k] = k if self.p.tag[k] in REGION else region[self.p.parent[k]]
        own = [0.0] * self.n
        for k, s, h in zip(self.home, self.size.tolist(), high.tolist()):
            own[region[k]] += s * h
        best = at = self.smallest(upper, out)
        while at:
            at = self.p.parent[at]
            if own[at] >= 0.05 * upper[0] > 0:
                best = at
        return best

    def trimmed(self, chosen: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Without lines of links before the first and after the last line of the upper cluster."""
        at = np.flatnonzero(chosen & high)
        if not len(at):
            return chosen
        links = np.array([x[2] for x in self.p.lines]) > 0.5 * self.size
        place = np.arange(len(chosen))
        return chosen & ~(links & ((place < at[0]) | (place > at[-1])))


def main_text(html: str | None) -> str:
    """Main text; empty for null, empty or text-less pages. Broken and truncated markup is dropped, and never fails."""
    p = parsed(html or "")
    if not p.lines:
        return ""
    return " ".join(x[0] for x, own in zip(p.lines, _Page(p).content().tolist()) if own)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, its html replaced by text and n_chars (columns of those names are replaced).

    A null or empty page gives an empty text; equal pages give equal texts; a
    page is worked on whole, however long, in time linear in its length; a table
    without rows gives none.
    """
    names = [x for x in pages.columns if x not in ("text", "n_chars") and x != html]
    rows = pages.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{html}`").alias(C.unused("_kl_html", names)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(names))
            for lo, hi in C.chunks(C.text_bytes(column)[1]):
                texts = [main_text(column[k].as_py()) for k in range(lo, hi)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(names))] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*names, "text", "n_chars"])

    schema = T.StructType([rows.schema[x] for x in names] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(work, schema)
