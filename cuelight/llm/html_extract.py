"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text of the blocks in them, less what
is linked. A container's path of tags and classes, with digits made alike, is its
page's vote; votes are summed per host in Spark, and each page is then extracted
again from the containers at the paths that won its host. A page that has none
of them falls back on its own best container, and without one on its body.

Menus, headers, footers, sidebars and controls go by their tags. Names of classes
and ids are evidence that is weighed: a box goes by a name that says nothing but
what it is ('sidebar', 'ad-slot', 'user-comments'), unless it holds what the page
is about; where a name says other things too, or may mean much, only if the box
is a list of links, or a line. Headings and quotations never go by name, nor does
a title in a box named header; what stands within a line goes by an advert's name
only. A path is a 64-bit hash chained from step to step, so its size doesn't grow
with its depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import scratch, small, staged

#: A path wins a host with at least this part of its best path's score.
NEAR_BEST = 0.5
#: And at least this part of all votes of the host, so a host has 1 / LEAST paths at most.
LEAST = 0.05
#: Votes a page casts: its best containers.
VOTES = 3
#: Rows of a host and its paths (a name, and 8 bytes a path) that may be broadcast: 45 MB at most.
BROADCAST_HOSTS = 100_000
#: An element that its name speaks against stays when it holds at least this part of its page's text.
MOST_TEXT = 0.5
#: Part of a box's text in links from which it is a list of them, and characters below which a box of a soft name is a line.
LINKED, LINE = 0.5, 300

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"  # a quote that is never closed: the tag ends where it can
    r"|<[!?][^>]*+>|</?[a-zA-Z][^>]*+\Z|[^<]++|<",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg object canvas noembed noframes".split())
INLINE_SKIP = frozenset("button select audio video".split())
SKIP = RAW | INLINE_SKIP | frozenset("nav header footer aside menu dialog head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end is implied when one of these starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Those an implied end doesn't reach over, and those an end tag doesn't: what is outside of them stays open.
WITHIN = {"li": {"ul", "ol", "menu", "dir", "dl", "table", "td", "th"}, "dt": {"dl", "table", "td", "th", "ul", "ol"}, "dd": {"dl", "table", "td", "th", "ul", "ol"}} | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), {"table"})
SCOPE = frozenset("button caption td th table".split())
#: Block elements that don't end an open paragraph when they start.
IN_P = frozenset("body caption html legend tbody td tfoot th thead tr".split())
CONTAINERS = frozenset("article main section div td blockquote form body".split())
LIKELY = {"article": 1.5, "main": 1.3, "section": 1.0, "div": 1.0, "form": 1.0, "td": 0.9, "blockquote": 0.8, "body": 0.5}
#: Words in class or id names, and roles, of what isn't main text.
NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner banners cookie cookies consent notice notices popup modal overlay sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments disqus reply replies respond newsletter subscribe pagination pager widget toolbar disclaimer hidden".split())
#: Of what holds a title, beside what isn't main text.
TITLED = frozenset("header masthead".split())
#: Words that mean as much beside.
SOFT_WORDS = frozenset("related recommended share sharing social signup login search side foot copyright legal".split())
#: Words that say nothing of what an element holds.
NEUTRAL = frozenset("area article bar block body bottom box button buttons col column component container content desktop entry fixed form global group holder icon icons inner item items left lg link links list main md mobile module outer page panel post posts primary reader readers region right row secondary section site slot sm sticky thread top unit user users wrap wrapper xl xs js ui".split())
#: Words that speak of the layout around: the next word isn't what this element is.
ABOUT = frozenset("has no non not with without show hide is in".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar".split())

#: Those by which what stands within a line goes as well.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo".split())

FORM, STRONG, TITLE, SOFT, WEAK = "form", "strong", "title", "soft", "weak"
#: Elements that can go by name.
NAMED = BLOCKS - HEADINGS - frozenset("main body html head hgroup blockquote pre figcaption caption legend summary hr thead tbody tfoot".split())


class Zone:
    """An element that its name or tag speaks against: it stays or goes as a whole."""

    __slots__ = ("kind", "parent", "size", "linked", "main", "kept")

    def __init__(self, kind: str, parent: int):
        self.kind, self.parent, self.size, self.linked, self.main, self.kept = kind, parent, 0, 0.0, False, False

    def stays(self, total: int) -> bool:
        links = self.linked >= LINKED * self.size
        if self.kind == WEAK:
            return not links
        if self.kind == SOFT:
            return not links and self.size >= LINE
        return self.main and self.size >= MOST_TEXT * total


class Node:
    """An open or closed element that can hold blocks."""

    __slots__ = ("tag", "key", "parent", "holder", "score", "first", "last", "zone", "dropped", "article", "paragraph")

    def __init__(self, tag: str, parent: Node | None, first: int = 0):
        self.tag, self.parent, self.score, self.first, self.last = tag, parent, 0.0, first, first
        self.key = 0
        self.holder = None if parent is None else parent if parent.tag in CONTAINERS else parent.holder
        self.zone = -1 if parent is None else parent.zone
        self.dropped = None if parent is None else parent.dropped  # the skipped element it is in
        self.article = tag == "article" or parent is not None and parent.article
        self.paragraph = -1  # place of the open paragraph that a block would end


class Page:
    def __init__(self):
        self.nodes: list[Node] = []
        self.blocks: list[str] = []


def name_kind(attrs: dict[str, str]) -> str | None:
    """What class and id names say: STRONG where a name is of noise words and
    neutral ones, TITLE and SOFT where its other words are of those sets, WEAK
    where it has words beside that say other things."""
    kinds = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        found, other, skipped = set(), False, False
        for word in map(str.lower, NAMES.findall(name)):
            if word in ABOUT:
                skipped = True
            elif skipped:
                skipped = False
            elif word in NOISE or word in TITLED or word in SOFT_WORDS:
                found.add(STRONG if word in NOISE else TITLE if word in TITLED else SOFT)
            elif word not in NEUTRAL:
                other = True
        if found:
            kinds.add(WEAK if other else next(k for k in (STRONG, TITLE, SOFT) if k in found))
    return next((k for k in (STRONG, TITLE, SOFT, WEAK) if k in kinds), None)


def advert(attrs: dict[str, str]) -> bool:
    names = [[w.lower() for w in NAMES.findall(name)] for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split()]
    return any(ADVERTS.intersection(words) and ADVERTS.union(NEUTRAL).issuperset(words) for words in names)


def unseen(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or HIDDEN.search(attrs.get("style", "")) is not None


class Reader:
    """Reads a page's markup as browsers do in the main: blocks end an open
    paragraph, strange end tags are passed over, ends are implied where a parent
    ends or another element starts. It collects blocks with the zone they are
    in; which zones stay is known once the whole page was read."""

    def __init__(self):
        self.stack = [Node("", None)]
        self.open: Counter = Counter()
        self.zones: list[Zone] = []
        self.nodes: list[Node] = []
        self.found: list[tuple[str, int, Node | None, float]] = []  # block, zone, holder, part that isn't linked
        self.titles: list[tuple[int, bool, bool]] = []  # headings in boxes of TITLE: place in found, is it first, is it an article's
        self.first_heading = False  # is there a first heading outside of such boxes?
        self.words: list[str] = []
        self.chars = self.linked = self.links = 0

    def flush(self) -> None:
        if self.words:
            block = SPACE.sub(" ", html.unescape("".join(self.words))).strip()
            self.words.clear()
            if block:
                top = self.stack[-1]
                if top.tag in HEADINGS:
                    if top.zone >= 0 and self.zones[top.zone].kind == TITLE:
                        self.titles.append((len(self.found), top.tag == "h1", top.article))
                    else:
                        self.first_heading |= top.tag == "h1"
                self.found.append((block, top.zone, top if top.tag in CONTAINERS else top.holder, 1 - self.linked / self.chars if self.chars else 1.0))
        self.chars = self.linked = 0

    def close(self, k: int) -> None:
        """Ends the open elements from place k on."""
        if any(n.tag in BLOCKS for n in self.stack[k:]):
            self.flush()
        for node in self.stack[k:]:
            node.last = len(self.found)
            self.open[node.tag] -= 1
        del self.stack[k:]

    def implied(self, tag: str) -> int:
        """Place of the outermost open element whose end is implied by a start of tag; 0 where there is none."""
        place = 0
        ends = CLOSES.get(tag, set()) | ({"tr", "td", "th"} if tag in ("tbody", "thead", "tfoot") else set())
        if any(self.open[x] > 0 for x in ends):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in ends:
                    place = i
                elif self.stack[i].tag in WITHIN.get(tag, ()):
                    break
        if tag not in IN_P and self.stack[-1].paragraph >= 0:
            place = min(place, self.stack[-1].paragraph) if place else self.stack[-1].paragraph
        if not place and tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            place = len(self.stack) - 1
        return place

    def ended(self, tag: str) -> int:
        """Place of the open element that an end tag ends; 0 where it is a strange one."""
        if self.open[tag] > 0:
            within = {"table"} if tag in WITHIN and tag not in ("li", "dt", "dd") else SCOPE | WITHIN.get(tag, frozenset())
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    return i
                if self.stack[i].tag in within and tag not in SKIP and tag not in ("table", "body", "html"):
                    break
        return 0

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.stack[-1]
        node = Node(tag, parent, len(self.found))
        kind = name_kind(attrs) if tag in NAMED else None
        if tag == "form":
            kind = kind or FORM
        if tag in SKIP or unseen(attrs) or tag not in BLOCKS and advert(attrs):
            node.dropped = node.dropped or node
        elif tag in HEADINGS and node.dropped is not None and node.dropped is self.header() and node.dropped.article:
            node.dropped = None  # the heading of an article's own header
        elif kind and node.dropped is None:
            self.zones.append(Zone(kind, node.zone))
            node.zone = len(self.zones) - 1
        if node.zone >= 0 and (tag in HEADINGS and tag == "h1" or tag in ("article", "main") and not kind or self.zones[node.zone].kind == FORM and tag in ("p", *HEADINGS)):
            self.zones[node.zone].main = True
        self.open[tag] += 1
        node.paragraph = len(self.stack) if tag == "p" else -1 if tag in SCOPE else parent.paragraph
        if tag in BLOCKS:
            classes = ".".join(sorted(DIGITS.sub("#", c) for c in attrs.get("class", "").lower().split()))
            node.key = xxhash.xxh3_64_intdigest(f"{tag}.{classes}", seed=parent.key) >> 1
        else:
            node.key = parent.key
        self.stack.append(node)
        if tag in CONTAINERS:
            self.nodes.append(node)

    def header(self) -> Node | None:
        """The skipped header whose heading an element right in it would be."""
        for n in reversed(self.stack):
            if n.tag in SKIP:
                return n if n.tag == "header" else None
        return None

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        blank = raw.isspace()
        if top.tag == "head" and not blank:
            self.close(len(self.stack) - 1)
            top = self.stack[-1]
        if top.dropped is None:
            self.words.append(raw)
            if not blank:
                self.chars += len(raw)
                self.linked += len(raw) if self.links else 0

    def start(self, tag: str, rest: str) -> None:
        if self.stack[-1].tag == "head" and tag not in ("base", "link", "meta"):
            self.close(len(self.stack) - 1)
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and self.stack[-1].dropped is None:
                self.words.append(" ")
            return
        attrs = {a[1].lower(): next((v for v in a.groups()[1:] if v is not None), "") for a in ATTR.finditer(rest)} if rest else {}
        if tag not in BLOCKS and tag not in SKIP and not (attrs and (unseen(attrs) or advert(attrs))):
            self.links += tag == "a"
            return
        if tag in BLOCKS:
            self.flush()
            self.links = self.links if tag not in ("p", "div", "article", "section") else 0
            if place := self.implied(tag):
                self.close(place)
        if not rest.endswith("/") or tag in BLOCKS:
            self.push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in BLOCKS and self.stack[-1].dropped is None:
            self.flush()
        if place := self.ended(tag):
            self.close(place)
        elif tag == "a":
            self.links = max(0, self.links - 1)

    def settled(self) -> Page:
        """The blocks that stay, and the containers with their scores."""
        self.flush()
        self.close(1)
        total = sum(len(b) for b, *_ in self.found)
        for k, first, article in self.titles:
            if article or first and not self.first_heading:
                block, zone, holder, own = self.found[k]
                self.found[k] = (block, self.zones[zone].parent, holder, own)
        for block, zone, _, own in self.found:
            if zone >= 0:
                self.zones[zone].size += len(block)
                self.zones[zone].linked += len(block) * (1 - own)
        for z in reversed(self.zones):
            if z.parent >= 0:
                self.zones[z.parent].size += z.size
                self.zones[z.parent].linked += z.linked
                self.zones[z.parent].main |= z.main
        for z in self.zones:
            z.kept = z.stays(total) and (z.parent < 0 or self.zones[z.parent].kept)
        page, before = Page(), [0]
        for block, zone, holder, own in self.found:
            if zone < 0 or self.zones[zone].kept:
                page.blocks.append(block)
                # longer and unlinked text counts; a parent gets it whole, those above by halves
                gain, part = (len(block) ** 0.5 + len(block) / 25) * own, 1.0
                while holder is not None and part > 0.1:
                    holder.score += gain * part
                    part /= 2
                    holder = holder.holder
            before.append(len(page.blocks))
        for node in self.nodes:
            node.first, node.last = before[node.first], before[node.last]
        page.nodes = [n for n in self.nodes if n.last > n.first]
        return page


def parse(text: str) -> Page:
    """Blocks of text outside of noise, in page order, and the containers with
    their scores."""
    reader, at, end = Reader(), 0, len(text)
    while at < end:
        m = TOKEN.match(text, at)
        at = m.end()
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            reader.text(raw)
            continue
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            reader.end(tag)
        elif tag in RAW:
            if not rest.endswith("/"):
                done = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(text, at)
                at = done.end() if done[0] else end
        else:
            reader.start(tag, rest)
    return reader.settled()


def votes(page: Page, most: int = VOTES) -> list[tuple[int, float]]:
    """The page's best paths and their shares of the sum of their scores."""
    by: dict[int, float] = {}
    for n in page.nodes:
        if n.score > 0:
            by[n.key] = by.get(n.key, 0.0) + n.score * LIKELY[n.tag]
    best = sorted(by.items(), key=lambda x: (-x[1], x[0]))[:most]
    total = sum(s for _, s in best)
    return [(p, s / total) for p, s in best]


def extract(page: Page, paths: list[int]) -> str:
    """Blocks of the outermost containers at the first of the paths that the
    page has; else of its own best path; else all its blocks."""
    for path in [*paths, *(p for p, _ in votes(page, 1))]:
        spans = [(n.first, n.last) for n in page.nodes if n.key == path]
        if spans:
            out, done = [], 0
            for first, last in sorted(spans):
                out += page.blocks[max(first, done) : last]
                done = max(done, last)
            return "\n\n".join(out)
    return "\n\n".join(page.blocks)


def host(url) -> F.Column:
    """Lower-case host of a url, its port and user dropped; '' where there is none."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")), F.lit("")))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], []]
        for h, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            for path, share in votes(parse(text or "")):
                for c, v in zip(cols, (h, path, share)):
                    c.append(v)
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["host", "path", "share"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(parse(t or ""), p or []) for t, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the paths that win it, best first. A page casts VOTES shares
    at most, and they are summed before the shuffle. Only paths with a fair part
    of the host's votes are gathered, which bounds their number."""
    cast = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path long, share double")
    # shares are summed as integers, so the order of the sum doesn't show
    sums = staged(cast.groupBy("host", "path").agg(F.sum((F.col("share") * 1_000_000).cast("long")).alias("s")), "path-votes")
    top = staged(sums.groupBy("host").agg(F.max("s").alias("_top"), F.sum("s").alias("_all")).withColumnRenamed("host", "_h"), "host-votes")
    won = sums.join(small(top, BROADCAST_HOSTS), F.col("host") == F.col("_h")).where((F.col("s") >= NEAR_BEST * F.col("_top")) & (F.col("s") >= LEAST * F.col("_all")))
    paths = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "path")))
    return won.groupBy("host").agg(paths.alias("v")).select(F.col("host").alias("_host"), F.transform("v", lambda x: x["path"]).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html: empty text. Null urls, and urls without a host, share
    the host ''. Repeated rows are extracted alike. Very long pages and very deep
    nesting take memory in proportion to their length. Empty table: no rows.
    Other columns of pages are not read.

    Hosts' paths are joined to the pages where they are read while the table of
    hosts is of a checked size; beyond, by a shuffled join whose hot hosts
    adaptive execution splits.
    """
    with scratch() as keep:
        won = keep(staged(host_paths(pages), "host-paths"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    return rows.join(small(won, BROADCAST_HOSTS), F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "paths").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
