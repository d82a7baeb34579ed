"""Main text of HTML pages from the text-to-tag ratio of their lines.

The standard library's parser sends a stream of events. They make *lines* (blocks), each with its text length and the
tags met since the line before. Text in menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments, and text of links, counts as no text: that is all that tags and names decide. The ratio of text to
tags is smoothed with a Gaussian kernel, and lines over a threshold from the ratios' spread are the clusters of content.
They select the regions: the container that holds their text (articles only where they hold most of it), the stretch of
it from its first to its last cluster with what adjoins, and not the blocks of links in it that no cluster touches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts_of

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is never text of the page.
SILENT = frozenset("script style noscript template svg iframe object canvas audio video head title textarea select button datalist map applet noembed noframes".split())
#: Elements around the main text, not of it.
AROUND = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id attributes.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot adunit adsense adbox adbanner adcontainer banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus fineprint foot footer gdpr hidden legal login mainnav masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager paging pagination popup promo promos promotion rail recommended related replies respond responses search share sharing sidebar sidenav signin signup sitenav skip social sponsor sponsored sponsors subnav subscribe subscription teaser teasers toc toolbar tooltip topbar topnav widget widgets".split()
)
#: Words that may stand beside those: a name of these and those only is sure.
BESIDE = frozenset("left right top bottom inner outer main site page post posts entry article articles story content section block box bar list lists item items area wrapper wrap container holder unit units slot links link buttons button icons text inline module component region row col column primary secondary global fixed sticky form thread user reader".split())
#: Words that make "header" a part of the article.
OWN = frozenset("article entry post story content page main".split())
#: Elements that hold running text; names count for them only where they are sure.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre table td th tr dl dd dt figure figcaption span a b i em strong code math".split())
#: An opening one of these ends an open element of the second set.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select article section div main aside nav footer form body td th".split())
#: Blocks that can be menus by themselves, outside of articles also lists.
PARTS, LISTS = frozenset("div section header table center".split()), frozenset("ul ol dl dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TALK = re.compile(r"(?:(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|kommentare?|commentaires?|comentarios?)|\d+\s+(?:responses?|replies|antworten|respuestas|r\u00e9ponses)|leave a (?:reply|comment)|join the (?:discussion|conversation))[\s:.!()\d]*$", re.IGNORECASE)
#: Characters outside of links that a line of a cluster has for each of its tags, at least, whatever stands beside it.
LEAST_RATIO = 1.0
NO, TAG, NAMED = 0, 1, 2  # why an element's text doesn't count: not at all, by its tag, by its attributes


def named_around(attrs: list[tuple[str, str | None]], sure_only: bool) -> bool:
    """Whether an element's attributes say that it stands around the main text; ``sure_only``: a name with other words in it,
    such as "legal-basis", says nothing."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
        if name in ("class", "id") and value:
            for part in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", value).lower().split():
                words = [w for w in re.split(r"[^a-z0-9]+", part) if w and not w.isdigit()]
                if words[:1] and words[0] in ("has", "with", "no", "without"):
                    continue
                if not WORDS.isdisjoint(words) and (not sure_only or all(w in WORDS or w in BESIDE for w in words)):
                    return True
                if "header" in words and OWN.isdisjoint(words) and (not sure_only or all(w == "header" or w in BESIDE for w in words)):
                    return True
    return False


class _Element:
    __slots__ = ("id", "tag", "why", "parent", "rest", "block", "scope", "in_article")

    def __init__(self, id: int, tag: str, why: int, parent: _Element | None, scope: int):
        self.id, self.tag, self.why, self.parent, self.scope = id, tag, why, parent, scope
        self.rest = False  # what is still to come in it is the readers' talk
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.in_article = tag == "article" or parent is not None and parent.in_article


class LineReader(HTMLParser):
    """Parser events to lines: text, characters in links, tags, element, whether it counts. Open elements are found by their
    tag, not by a walk through the stack, so broken markup takes no more time than other."""

    def __init__(self, around: frozenset[str] = AROUND, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.around, self.by_name = around, by_name
        root = _Element(0, "", NO, None, 0)
        self.open, self.elements = [root], [root]
        self.places: dict[str, list[int]] = {}  # of the open elements of a tag
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0
        self.lines: list[tuple[str, int, int, _Element, bool]] = []

    # events
    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if self.silent and (tag == "body" or tag in BLOCKS) and self.places.get("head") and self.silent == 1:
            while self._pop().tag != "head":  # a head without its end
                pass
        if self.silent:
            if tag not in VOID:
                self._push(tag, self.open[-1].why)
                self.silent += tag in SILENT
            return
        if tag in SILENT:
            self._push(tag, self.open[-1].why)
            self.silent += 1
            return
        if tag in BLOCKS:
            self.flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        top = self.open[-1]
        why = TAG if top.rest else top.why
        if tag == "main":
            why = why if why == TAG else NO
        elif why == NO:
            if tag in self.around:
                why = TAG
            elif tag == "header" and not self.places.get("article") and not self.places.get("main"):
                why = TAG
            elif attrs and self.by_name and tag not in ("html", "body", "article", "h1") and named_around(attrs, tag in RUNNING or top.in_article):
                why = NAMED
        self._push(tag, why)
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS and not self.silent:
            self.flush()

    def handle_endtag(self, tag):
        self.tags += 1
        places = self.places.get(tag)
        if not places:
            return
        at = places[-1]
        if tag not in BLOCKS and not self.silent and at < self.open[-1].scope:
            return  # an inline end tag without its start in this scope
        if tag in BLOCKS and not self.silent:
            self.flush()
        while len(self.open) > at:
            self._pop()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    # the stack
    def _push(self, tag, why):
        place = len(self.open)
        e = _Element(len(self.elements), tag, why, self.open[-1], place if tag in SCOPES else self.open[-1].scope)
        self.elements.append(e)
        self.open.append(e)
        self.places.setdefault(tag, []).append(place)

    def _pop(self):
        e = self.open.pop()
        self.places[e.tag].pop()
        self.silent -= e.tag in SILENT
        self.links -= e.tag == "a"
        return e

    def _close_implied(self, tag):
        """What an opening ``tag`` ends: an open paragraph, and for list items and cells their like, within the scope."""
        while True:
            # a scope ends the search, but a cell or an item may itself be one
            found = [(places[-1], t) for t in ("p", *CLOSES.get(tag, ())) if (places := self.places.get(t)) and places[-1] >= self.open[-1].scope]
            if not found:
                return
            at, ended = max(found)
            while len(self.open) > at:
                self._pop()
            if ended == "p" and tag not in CLOSES:
                return

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                e = self.open[-1].block
                if e.tag in ("h2", "h3", "h4", "h5", "p", "div", "summary") and len(text) < 60 and e.parent is not None and TALK.match(text):
                    e.why = TAG
                    e.parent.rest = e.parent.tag not in ("body", "html", "")
                counts = e.why == NO and not e.rest
                self.lines.append((text, min(self.linked, len(text)), self.tags, e, counts))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def read(self, html: str):
        self.feed(html)
        self.close()
        self.flush()
        return self.lines


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel of three deviations, weights renewed at the ends."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma * sigma))
    full = lambda x: np.convolve(x, kernel)[len(kernel) // 2 : len(kernel) // 2 + len(x)]
    return full(ratio) / full(np.ones(len(ratio)))


def link_lists(lines) -> set[int]:
    """Lists outside of articles whose items are all links, three or more: menus without the name of one."""
    items: dict[int, list[bool]] = {}
    for text, linked, _, e, _ in lines:
        if e.tag == "li" and e.parent is not None and not e.in_article:
            items.setdefault(e.parent.id, []).append(linked >= 0.9 * len(text))
    return {k for k, v in items.items() if len(v) >= 3 and all(v)}


def main_text(html: str, sigma: float = 1.0, spread: float = 0.5) -> str:
    """The main text: lines joined by one space. ``spread``: a line of a cluster has a smoothed ratio of at least so many
    standard deviations; smaller keeps more."""
    if not html:
        return ""
    reader = LineReader()
    lines = reader.read(html)
    if not any(c for *_, c in lines):  # a page with a title inside one form, or inside an element with an unlucky name
        prose = lambda x: any(len(t) >= 60 and e.tag in ("p", "article", "main", "section", "div") for t, _, _, e, _ in x) and any(e.tag in ("h1", "article", "main") for _, _, _, e, _ in x)
        for around, by_name in ((AROUND - {"form"}, True), (AROUND - {"form"}, False)):
            again = LineReader(around, by_name)
            found = again.read(html)
            if prose([x for x in found if x[4]]):
                reader, lines = again, found
                break
    menus = link_lists(lines)
    counts = np.array([c and not (e.tag == "li" and e.parent.id in menus) for _, _, _, e, c in lines], dtype=bool)
    if not counts.any():
        return ""
    length = np.array([len(t) for t, *_ in lines], dtype=float)
    linked = np.array([x[1] for x in lines], dtype=float)
    tags = np.array([x[2] for x in lines], dtype=float)
    ratio = np.where(counts, length - linked, 0.0) / np.maximum(tags, 1.0)
    smooth = smoothed(ratio, sigma)
    clusters = counts & (ratio >= LEAST_RATIO) & (smooth >= spread * smooth.std())
    if not clusters.any():
        clusters = counts & (smooth >= smooth.max())
    if not clusters.any():
        clusters = counts
    kept = selected(reader.elements, [x[3] for x in lines], counts, clusters, ratio, length, linked)
    return " ".join(lines[k][0] for k in np.flatnonzero(kept))


def _below(elements: list[_Element], per_element: np.ndarray) -> np.ndarray:
    """Sums over each element and all below it."""
    out = per_element.astype(float)
    for e in reversed(elements[1:]):  # children come after their parents
        out[e.parent.id] += out[e.id]
    return out


def selected(elements: list[_Element], of_line: list[_Element], counts: np.ndarray, clusters: np.ndarray, ratio: np.ndarray, length: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which lines the clusters select. ``of_line``: the element of each line."""
    where = np.array([e.id for e in of_line])
    add = lambda x: _below(elements, np.bincount(where, x, len(elements)))
    mass, text, links, lines, seeds = add(clusters * length), add(counts * length), add(counts * linked), add(counts * 1.0), add(clusters * 1.0)
    chosen, explicit = elected(elements, mass)
    inside, dropped = np.zeros(len(elements), np.int64), np.zeros(len(elements), bool)
    for e in elements:
        up = e.parent.id if e.parent is not None else 0
        inside[e.id] = e.id if e.id in chosen else inside[up] if e.parent is not None else (0 if 0 in chosen else -1)
        if e.parent is not None and e.id not in chosen and inside[e.id] >= 0:
            # a block of links that no cluster touches
            part = e.tag in PARTS or e.tag in LISTS and not explicit and lines[e.id] >= 3
            dropped[e.id] = dropped[up] or part and not seeds[e.id] and text[e.id] > 0 and links[e.id] >= 0.5 * text[e.id]
    container = inside[where]
    kept = counts & (container >= 0) & ~dropped[where]
    if not explicit:
        for c in chosen:
            mine = np.flatnonzero(kept & (container == c))
            hit = np.flatnonzero(clusters[mine])
            if not len(hit):
                continue
            first, last = hit[0], hit[-1]
            near = {of_line[mine[k]].parent for k in hit}
            adjoins = lambda k: (of_line[mine[k]].parent in near or of_line[mine[k]].tag in HEADINGS) and ratio[mine[k]] >= LEAST_RATIO  # noqa: E731, B023
            while first > 0 and adjoins(first - 1):
                first -= 1
            while last < len(mine) - 1 and adjoins(last + 1):
                last += 1
            kept[mine[:first]] = False
            kept[mine[last + 1 :]] = False
    return kept


def elected(elements: list[_Element], mass: np.ndarray) -> tuple[set[int], bool]:
    """Ids of the containers that hold the clusters' text, and whether the page itself marks them as such.

    Articles, or else the main element, are taken where they hold most of that text: all that have some, and those between
    them. Else the search goes down from the root while one block holds most of it."""
    for tag in ("article", "main"):
        outer = [e for e in elements if e.tag == tag and e.why == NO and not (tag == "article" and e.parent.in_article)]
        hit = [k for k, e in enumerate(outer) if mass[e.id] > 0]
        if hit and sum(mass[outer[k].id] for k in hit) >= 0.5 * mass[0]:
            return {e.id for e in outer[hit[0] : hit[-1] + 1]}, True
    children: dict[int, list[_Element]] = {}
    for e in elements[1:]:
        children.setdefault(e.parent.id, []).append(e)
    at = elements[0]
    while kids := [e for e in children.get(at.id, ()) if mass[e.id] > 0]:
        best = max(kids, key=lambda e: mass[e.id])
        if best.tag in RUNNING or mass[best.id] < 0.8 * mass[at.id]:
            break
        at = best
    return {at.block.id}, False


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0, spread: float = 0.5) -> DataFrame:
    """Per row of ``pages``: the ``keep`` columns, ``text`` (main text of the whole page) and ``n_chars``.

    Null, empty and textless pages give the empty text; nulls in kept columns stay; broken markup is read as far as it
    goes, like a browser does; repeated rows are read each; an empty table gives no rows; further columns are ignored.
    """
    kept = [pages.schema[c] for c in keep]

    def extract(batch):
        texts = [main_text(h, sigma, spread) for h in texts_of(batch.column(len(kept)))]
        return {f"k{i}": batch.column(i) for i in range(len(kept))} | {"text": texts, "n_chars": [len(t) for t in texts]}

    schema = ", ".join([f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)] + ["text string", "n_chars bigint"])
    out = map_rows(pages.select(*[F.col(f.name).alias(f"k{i}") for i, f in enumerate(kept)], F.col(html_col).alias("html")), extract, schema)
    return out.toDF(*keep, "text", "n_chars")
