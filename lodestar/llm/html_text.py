"""Main text of web pages by line-block distribution (operator 6).

Markup is stripped to lines, one for each block of the page. A line weighs as many characters as
it has outside links, and a surge more where the page marks it as part of an article. Sums over
sliding windows of lines give the distribution: it surges where main text begins and dives
where it ends, and every line between is kept, short ones and links too. A page that never
surges is kept whole.

Names don't delete anything by themselves. An element whose name, class, id or role says menu,
advert, comments, form or the like is marked, and marked lines weigh nothing as long as the rest
of the page has text of its own. Where it has none that surges, or a fifth of what a kind of
marked elements holds, those elements wrap the main text: they lose their mark, and the
distribution is taken again. Copyright lines, and runs of short list items before the first or
after the last line of text outside an article, weigh nothing either.

Null html is empty. A page without text gives an empty string; an empty table gives no rows. Rows
that repeat are each answered, alike; columns besides page_id, url and html aren't looked at.
There are no ties: lines keep the page's order. Nothing is capped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window; least sum at which the distribution surges; sum below which it has dived.
WINDOW, SURGE, DIVE = 3, 80, 40
#: Marked elements wrap the main text if they hold so many times the text that the rest of the page has.
WRAPS = 5
#: Characters up to which a list item outside articles may belong to a menu, and how many such stand in a row.
ITEM, RUN = 25, 3

# fixed values: element names and words in class or id
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe noscript template svg math".split())
SKIPPED = frozenset("nav footer aside form button select dialog menu object canvas audio video".split())
NEVER = frozenset("html body article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
OUTER = frozenset("header head top".split())
#: Readers' talk, and what stands around pages: these wrap main text only with a heading of it.
TALK = frozenset("comment comments disqus replies respond".split())
EDGE = frozenset("nav footer menu navbar navigation breadcrumb breadcrumbs consent cookie cookies gdpr masthead toolbar topbar contentinfo".split())
#: Words that tell an element's state, as in has-sidebar or comments-open: such names say nothing of what it is.
STATES = frozenset("has no with without is are open opened closed enabled disabled on off active hide hidden left right above below".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())

_START = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""["'>]""")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True, slots=True)
class Mark:
    """A kind of marked elements: element, class, words that mark it, whether it's readers' talk or stands around pages, within an article."""

    name: str
    said_by: str
    words: frozenset[str]
    talk: bool
    edge: bool
    inside: bool


def _mark(name: str, attributes: str, inside: bool) -> Mark | None:
    """What an element's name, class, id or role says it is, if not main text."""
    if name in NEVER:
        return None
    own = {}
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            own.setdefault(key.lower(), "".join(values).lower())
    words: set[str] = set()
    for token in f"{own.get('class', '')} {own.get('id', '')}".split():
        parts = set(_WORD.findall(token))
        if not parts & STATES:
            words |= parts
    said = words & WORDS or (set() if inside else words & OUTER)
    role = own.get("role", "") if own.get("role") in ROLES else ""
    unseen = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
    if not (said or role or unseen or name in SKIPPED or name == "header" and not inside):
        return None
    return Mark(name, own.get("class") or own.get("id", ""), frozenset(said), bool(said & TALK), name in EDGE or role in EDGE or bool(said & EDGE), inside)


class Tags:
    """The tags of a page in order, in time linear in its length whatever stands in it."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.sections = True
        #: Quotes from which no tag's end is reached.
        self.dead: set[int] = set()

    def _end(self, at: int) -> int:
        """Where a tag whose attributes begin at ``at`` ends (its >): the first one outside quotes, or if there is none the first."""
        seen = []
        stop = _STOP.search(self.html, at)
        while stop and stop[0] != ">":
            quote = stop.start()
            if quote in self.dead:
                break
            seen.append(quote)
            close = self.html.find(stop[0], quote + 1)
            stop = _STOP.search(self.html, close + 1) if close >= 0 else None
        if stop and stop[0] == ">":
            return stop.start()
        self.dead.update(seen)
        return self.html.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """The next tag from ``at`` on: start, end, name (empty: none, as of a comment), attributes, whether it closes."""
        html = self.html
        found = _START.search(html, at)
        if not found or found.start() > self.last and not found[1]:
            return None
        start, at = found.span()
        if found[1]:
            end = html.find("-->", at)
            return start, (end + 3 if end >= 0 else len(html)), "", "", False
        if found[2] and self.sections:
            end = html.find("]]>", at)
            if end >= 0:
                return start, end + 3, "", "", False
            self.sections = False
        if found[2] or found[3]:
            return start, html.find(">", at) + 1, "", "", False
        end = self._end(at)
        if end < 0:
            return None
        return start, end + 1, found[5].lower(), html[at:end], bool(found[4])


@dataclass(slots=True)
class Line:
    text: str
    #: Characters in links.
    linked: int
    #: Within an article.
    inside: bool
    #: The marked elements around it, by what they say, the outermost first.
    marks: tuple[Mark, ...]
    #: Element of its block.
    block: str


_COPYRIGHT = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)|.*\ball rights reserved\b", re.I | re.S)


def lines_of(html: str) -> list[Line]:
    """The lines of a page, of its blocks in order.

    A link is an <a> with href, up to its </a>; one that isn't closed before the next <a> ends with its line.
    """
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    link, closed, block = False, True, ""
    #: Marked elements that are open: name, elements of that name open within, mark, and for one within a line what came before it there.
    marks: list[list] = []
    #: For each open article, how many marked elements were open before.
    articles: list[int] = []
    at, size = 0, len(html)
    tags, raw_end = Tags(html), {}

    def close() -> None:
        nonlocal linked, link
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, min(linked, len(text)), bool(articles), tuple(m[2] for m in marks), block))
        parts.clear()
        linked = 0
        link = link and closed

    def leave(k: int) -> None:
        """Marked elements from the k-th on end; a line goes on after one that stood within it."""
        nonlocal linked
        while len(marks) > k:
            before = marks[-1][3]
            if before is not None:
                close()
            marks.pop()
            if before is not None:
                parts[:], linked = before

    while at < size:
        tag = tags.after(at)
        if not tag:
            break
        start, after, name, attributes, end = tag
        if start > at:
            text = html[at:start]
            parts.append(text)
            if link:
                linked += len(text.strip())
        at = after
        if not name:
            continue
        if not end and name in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at) if raw_end.get(name, 0) >= 0 else None
            if not stop:
                raw_end[name] = -1
            at = stop.end() if stop else size
            continue
        if name in BLOCKS:
            close()
            block = "" if end else name
            # these end with the next block, whether closed or not
            while marks and marks[-1][0] in ("p", "li") and (name != marks[-1][0] or not end):
                leave(len(marks) - 1)
        elif name in ("br", "td", "th"):
            parts.append(" ")
        elif name == "a":
            link = not end and any(key.lower() == "href" for key, *_ in _ATTRIBUTE.findall(attributes))
            if link:
                following = _ANCHOR.search(html, at)
                closed = bool(following and following[1])
        if name in ("article", "main"):
            if end:
                if articles:
                    leave(articles.pop())
            else:
                if not articles:
                    leave(0)
                    close()
                articles.append(len(marks))
                mark = _mark("div", attributes, len(articles) > 1)
                if mark:
                    marks.append([name, 1, mark, None])
            continue
        if end and name in ("body", "html"):
            leave(0)
            close()
            continue
        of = next((k for k in range(len(marks) - 1, -1, -1) if marks[k][0] == name), None)
        mark = None if end or name in VOID or attributes.endswith("/") else _mark(name, attributes, bool(articles))
        if mark:
            before = None if name in BLOCKS else (parts[:], linked)
            if before is not None:
                parts.clear()
                linked = 0
            marks.append([name, 1, mark, before])
        elif of is not None and name not in VOID and not attributes.endswith("/"):
            marks[of][1] += -1 if end else 1
            if not marks[of][1]:
                leave(of)
    if at < size:
        parts.append(html[at:])
        if link:
            linked += len(html[at:].strip())
    leave(0)
    close()
    return lines


def regions_of(lines: list[Line]) -> tuple[list[tuple[int, int]], bool]:
    """Where the distribution of the lines' weights is between surge and dive, and whether any weighs something."""
    n = len(lines)
    weight = np.array([max(0, len(x.text) - x.linked) + (SURGE if x.inside else 0) for x in lines], np.int64)
    solid = [k for k, x in enumerate(lines) if x.block != "li" and weight[k] >= SURGE]
    first, last = (solid[0], solid[-1]) if solid else (n, n)
    k = 0
    while k < n:
        j = k
        while j < n and lines[j].block == "li" and not lines[j].inside and len(lines[j].text) <= ITEM and lines[j].text[-1] not in ".!?:;":
            j += 1
        if j - k >= RUN and solid and (j <= first or k > last):
            weight[k:j] = 0
        k = max(j, k + 1)
    for k, x in enumerate(lines):
        if weight[k] and not x.inside and len(x.text) < 3 * SURGE and _COPYRIGHT.match(x.text):
            weight[k] = 0
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :] if n else weight  # sums[i]: lines i to i + WINDOW - 1
    regions, i = [], 0
    while i < n:
        if sums[i] < SURGE or not weight[i]:
            i += 1
            continue
        j = i + 1
        while j < n and sums[j] >= DIVE:
            j += 1
        regions.append((i, j))
        i = j
    return regions, bool(weight.any())


def main_text(html: str) -> str:
    lines = lines_of(html)
    void: set[Mark] = set()
    # what a word marks within an article is alike: a builder's widgets hold its title and its text
    words: set[str] = set()
    while True:
        live, marked = [], []
        for x in lines:
            left = next((m for m in x.marks if m not in void and not (m.inside and m.words and m.words <= words)), None)
            (marked if left else live).append((x, left))
        own = [x for x, _ in live]
        regions, any_weight = regions_of(own)
        rest = sum(len(own[k].text) - own[k].linked for i, j in regions for k in range(i, j))
        held: dict[Mark, int] = defaultdict(int)
        headed, text = set(), set()
        for x, mark in marked:
            size = len(x.text) - x.linked
            held[mark] += size
            if x.block in ("h1", "h2"):
                headed.add(mark)
            elif size >= SURGE:
                text.add(mark)
        total = sum(held.values())
        # the marked elements that hold most: do they wrap the main text?
        wraps = [m for m in held if (m in headed or m in text and not m.talk and not m.edge) and held[m] and held[m] >= max(WRAPS * rest, total // 10)]
        if not wraps:
            break
        most = max(wraps, key=lambda m: held[m])
        void.add(most)
        words |= most.words if most.inside else set()
    if not regions:
        return "\n\n".join(x.text for x in own) if any_weight else ""
    return "\n\n".join(own[k].text for i, j in regions for k in range(i, j))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
