"""HTML main-text extraction by consensus host paths.

First pass: every page is parsed leniently, its containers (article, main, section, div, td, body
and the like) are scored by the text they hold, and the page votes for the best one's path, the
tags and generalised classes (numbers left out) from the root to it, and against the paths of the containers that
stand beside it. In Spark the votes are summed by host and path; paths with at least `SHARE` of a host's votes win,
best first, and paths that do not, but have as many against them, are the host's furniture. Second pass: every
page is extracted again from all containers at its host's first winning path, in page order (without
numbers, the parts of an article have one path), if together they score at least `KEEP` of the
page's own best container and, where they stand inside it, leave no more of it than furniture: of its
prose (blocks of `PROSE` characters or more, few of them links, not in the host's furniture) at least `NEARLY_ALL` is
theirs; else from
all at that best container's path, and from it too where it stands around them and holds more text.
Headlines and paragraphs that stand in the body itself go with containers that do so. A class name speaks for an
element against others beside it, not against the plain container around both.

Text of menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments is never text of a container: such elements are known by tag, role or class words. The
header of an article or main is its headline and stays. What an element holds can overrule a mere name: a form
around most of the page's prose is the page's frame; and inside an article or main an element of such a name
(or a fieldset or label) that holds `STORY` characters of prose, half of its text or more, is a part of the story, unless
its name is one of reader comments or links, or it is a list of entries.
Character references are decoded, white space inside a block becomes one space, blocks are joined
by a blank line.

Null or empty html gives an empty text; a null or hostless url votes as host ""; truncated pages,
unclosed and stray tags are read as browsers do, roughly, and elements beyond `DEEPEST` open ones
stand side by side; a page takes time in proportion to its length; equal scores go to the deeper, then the
earlier container, equal votes to the longer, then the lesser path. Repeated rows vote and are
extracted each; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

SHARE = 0.1
KEEP = 0.5
NEARLY_ALL = 0.9
#: Characters of a block of prose, share of links in it, and prose that overrules an element's name in a story.
PROSE, PROSE_LINKS, STORY = 80, 0.2, 600
#: Winning paths are broadcast up to this many hosts and characters, else joined by salted host.
BROADCAST_PATHS = 100_000
BROADCAST_CHARS = 32 << 20
SALTS = 64

#: Element names of HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote", "dd", "li", "figure", "details"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "audio", "video", "label", "fieldset", "input"} | RAW
#: Of these the ones whose text may overrule them, as it may a name.
DOUBTED = {"form", "label", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Class and id words of what is not the article.
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " copyright disclaimer disqus feedback footer footnav form gdpr header hidden legal login masthead menu menubar modal nav navbar navigation"
    " newsletter notice notices notification overlay pager paginate pagination paywall popup privacy promo promos promoted promotion rail recommended"
    " recommendations related replies reply respond response responses search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors"
    " subscribe subscription tags toc toolbar topbar bottombar trending widget widgets".split()
)
MAIN_WORDS = {"article", "body", "content", "entry", "main", "post", "story", "text", "page"}
#: Names that say what an element has around it, not what it is: "no-sidebar", "has-menu".
ABOUT_WORDS = {"no", "has", "with", "without"}
#: Names of what readers say, which no text overrules.
SAID_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "reply"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "responses", "related", "recommended", "recommendations", "feedback"}
#: Opening one of these ends an open element of the second set, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = {"table", "td", "th", "caption", "html", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BOOST = {"article": 1.5, "main": 1.3, "body": 0.8, "li": 0.5, "dd": 0.5, "blockquote": 0.6, "figure": 0.4, "details": 0.6}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in RAW}
#: Elements open at a time; deeper ones stand beside the last, as browsers have it.
DEEPEST = 512


def tokens(html: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """(name, whether an end tag, attributes, begin, end) of the tags and, under the name "", of comments and
    declarations, each looked for behind what the consumer sends back (or the token's end). In time
    linear in the page: what is found missing once is not looked for again, and once quotes
    that do not pair have cost as much as reading the page, tags end at their first ">"."""
    n, at, wasted, comments = len(html), 0, 0, True
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= n:
            return
        c = html[at + 1]
        if html.startswith("<!--", at):
            end = -1
            if html.startswith((">", "->"), at + 4):
                end = html.find(">", at + 4) + 1
            elif comments:
                ends = [x + 3 + k for k, mark in ((0, "-->"), (1, "--!>")) if (x := html.find(mark, at + 4)) >= 0]
                comments = bool(ends)
                end = min(ends, default=-1)
            if end < 0:
                end = html.find(">", at) + 1 or n
            at = (yield "", False, "", at, end) or end
        elif c in "!?" or c == "/" and not html[at + 2 : at + 3].isalpha():
            end = html.find(">", at) + 1 or n
            at = (yield "", False, "", at, end) or end
        elif c == "/" or c.isascii() and c.isalpha():
            m = NAME.match(html, at + 1 + (c == "/"))
            if m is None:
                at += 1
                continue
            plain = html.find(">", m.end())
            if plain < 0:  # a tag cut short by the page's end
                yield "", False, "", at, n
                return
            end, here = plain, m.end()
            while wasted <= n:
                q = QUOTE_OR_END.search(html, here)
                if q is None:
                    wasted += n - at
                    break
                if q[0] == ">":
                    end = q.start()
                    break
                here = html.find(q[0], q.end()) + 1
                if not here:
                    wasted += n - at
                    break
            at = (yield m[0].lower(), c == "/", html[m.end() : end], at, end + 1) or end + 1
        else:
            at += 1


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def words_of(name: str) -> set[str]:
    return {w.lower() for w in PARTS.findall(name)}


def generalised(name: str) -> str:
    """A class name without its numbers: "part", "part2" and "part-17" are one."""
    return re.sub(r"[-_]*\d+", "", name) or "N"


#: How an element is dropped: not, unless its text overrules its tag or name, for certain.
KEPT, IN_DOUBT, GONE = 0, 1, 2


def sort_of(tag: str, attrs: dict[str, str], story: bool = False) -> tuple[int, bool, bool]:
    """How an element is dropped, whether as comments or links to other pages, and whether its names
    speak for the article. In a `story` (an article or main) headers are its own headlines."""
    names = [w for n in [*attrs.get("class", "").split(), attrs.get("id", "")] if not (w := words_of(n)) & ABOUT_WORDS]
    aside = set().union(*names) & ASIDE_WORDS - ({"header"} if story else set()) if names else set()
    main = any(n & MAIN_WORDS and not n & ASIDE_WORDS for n in names)
    if tag in ("html", "body", "main"):
        return KEPT, False, main
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    by_name = bool(aside) and not main
    by_tag = tag in DROPPED and not (story and tag == "header")
    if hidden or attrs.get("role", "").lower() in ROLES - {"form"} or by_tag and tag not in DOUBTED or by_name and aside & SAID_WORDS:
        drop = GONE
    else:
        drop = IN_DOUBT if by_tag or by_name or attrs.get("role", "").lower() == "form" else KEPT
    return drop, bool(aside & COMMENT_WORDS), main


@lru_cache(20_000)
def _known(tag: str, raw: str, story: bool) -> tuple[int, bool, float, str]:
    """Of an element with these attributes: how dropped, comments or links, boost, step of a path."""
    attrs = attributes(raw) if raw and raw != "/" else {}
    drop, talk, main = sort_of(tag, attrs, story)
    step = ".".join([tag, *sorted({generalised(c) for c in attrs.get("class", "").split()})])
    return drop, talk, BOOST.get(tag, 1.0) * (1.3 if main else 1.0), step


class Node:
    __slots__ = ("tag", "parent", "step", "key", "gone", "doubt", "chars", "prose", "entries", "talk", "boost", "depth", "sum", "score", "order", "link", "holder", "story")

    def __init__(self, tag: str, parent: Node | None, raw: str, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.depth = parent.depth + 1 if parent else 0
        known = _known if len(raw) <= 200 else _known.__wrapped__
        self.story = parent is not None and parent.holds_story()
        drop, talk, self.boost, self.step = known(tag, raw, self.story)
        self.talk = talk or bool(parent and parent.talk)
        # an article inside an unclosed menu or notice is read for itself
        alone = parent is not None and (parent.gone or parent.doubt) and (tag == "main" or tag == "article" and not drop and not self.talk)
        self.gone = drop == GONE or bool(parent and parent.gone and not alone)
        #: The nearest element around (or itself) whose text is kept only if it overrules what drops it.
        self.doubt = self if drop == IN_DOUBT else None if alone or parent is None else parent.doubt
        self.chars, self.prose, self.entries = 0, 0, Counter() if drop == IN_DOUBT else None
        if parent and parent.doubt and tag in ("li", "article", "div", "section"):
            parent.doubt.entries[parent.order, self.step] += 1
        self.link = tag == "a" or bool(parent and parent.link)
        self.key = parent.key if parent else ()
        if parent and (tag in CONTAINERS or tag == "html"):
            self.key = hash((self.key, self.step))
        self.holder = self if tag in CONTAINERS or parent is None else parent.holder
        self.sum = self.score = 0.0

    def holds_story(self) -> bool:
        """Whether this is in an article or main, whose headers are the article's own."""
        return self.tag in ("article", "main") or self.holder is not self and self.holder.tag in ("article", "main")

    def path(self) -> str:
        steps, node = [], self
        while node.parent:
            if node.tag in CONTAINERS or node.tag == "html":
                steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def key_of(path: str):
    """What nodes at this path have as their key."""
    key = ()
    for step in path.split(">"):
        key = hash((key, step))
    return key


class Page:
    """A parsed page: its blocks of text, each with the container it stands in."""

    def __init__(self, html: str | None):
        self.root = Node("", None, "", -1)
        self.found: list[tuple[Node, list[tuple[str, bool, Node | None]]]] = []  # innermost container, runs
        self.nodes: list[Node] = []
        self._read(html or "")
        kept = self._judged()
        self.blocks: list[tuple[Node, str, int]] = []  # innermost container, text, link characters
        for holder, runs in self.found:
            runs = [r for r in runs if r[2] is None or r[2].order in kept]
            if text := " ".join("".join(t for t, _, _ in runs).split()):
                self.blocks.append((holder, text, sum(len(t.strip()) for t, link, _ in runs if link)))
        # worth of all text inside: a good article's characters, less twice those of links
        for holder, text, links in self.blocks:
            holder.sum += len(text) - 2.0 * links
        for node in reversed(self.nodes):
            node.parent.sum += node.sum
            node.score = node.sum * node.boost if node.tag in CONTAINERS else 0.0

    def _judged(self) -> set[int]:
        """The elements in doubt, by their order, that keep their text, and all around them do."""
        doubted = [x for x in self.nodes if x.doubt is x]
        if not doubted:
            return set()
        everything = 0
        for _, runs in self.found:
            for doubt in {r[2] for r in runs}:
                own = [r for r in runs if r[2] is doubt]
                n, links = sum(len(t) for t, _, _ in own), sum(len(t.strip()) for t, link, _ in own if link)
                prose = n if n >= PROSE and links <= PROSE_LINKS * n else 0
                everything += prose
                if doubt:
                    doubt.chars += n
                    doubt.prose += prose
        fit = set()
        for x in reversed(doubted):
            around = x.parent.doubt
            if x.tag == "form" and not x.story:
                ok = x.prose * 2 > everything
            else:
                listed = x.talk and max(x.entries.values(), default=0) > 1
                ok = x.story and x.prose >= STORY and x.prose * 2 >= x.chars and not listed
            if ok:
                fit.add(x.order)
                if around:
                    around.chars, around.prose = around.chars + x.chars, around.prose + x.prose
        kept: set[int] = set()
        for x in doubted:
            if x.order in fit and (x.parent.doubt is None or x.parent.doubt.order in kept):
                kept.add(x.order)
        return kept

    def _read(self, html: str) -> None:
        stack = [self.root]
        open_: Counter[str] = Counter()
        runs: list[tuple[str, bool, Node | None]] = []
        at = 0

        def flush() -> None:
            if runs:
                self.found.append((stack[-1].holder, runs.copy()))
                runs.clear()

        def pop(k: int) -> None:
            if any(x.tag in BLOCK for x in stack[k:]):
                flush()
            for x in stack[k:]:
                open_[x.tag] -= 1
            del stack[k:]

        def put(text: str) -> None:
            top = stack[-1]
            if text and not top.gone:
                runs.append((unescape(text) if "&" in text else text, top.link, top.doubt))

        found = tokens(html)
        token = next(found, None)
        while token is not None:
            tag, is_end, raw, begin, end = token
            put(html[at:begin])
            at = end
            if is_end:
                self._close(tag, stack, open_, pop)
            elif tag:
                at = self._open(tag, raw, html, at, stack, open_, flush, pop, put)
            try:
                token = found.send(at)
            except StopIteration:
                token = None
        put(html[at:])
        flush()

    def _open(self, tag: str, raw: str, html: str, at: int, stack: list[Node], open_: Counter, flush, pop, put) -> int:
        """Opens an element, ending those that it ends; returns where to read on."""
        if tag in BLOCK or tag in DROPPED and tag not in ("button", "select", "option", "label", "input"):
            flush()
        elif tag == "br":
            put(" ")
        if tag in VOID or tag in ("html", "body") and open_[tag]:
            return at
        if tag in BLOCK and tag not in ("html", "head") and open_["head"]:
            pop(next(i for i, x in enumerate(stack) if x.tag == "head"))  # a block ends an open head
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in ends) else ():
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    pop(k)
        elif tag in BLOCK and tag not in ("html", "body"):
            # a block ends an open paragraph or heading with the inline elements left open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in HEADINGS and tag in HEADINGS:
                    pop(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in RAW:
            close = RAW_END[tag].search(html, at)
            return (html.find(">", close.end()) + 1 or len(html)) if close else len(html)
        if len(stack) >= DEEPEST:
            pop(len(stack) - 1)
        node = Node(tag, stack[-1], raw, len(self.nodes))
        self.nodes.append(node)
        if not (raw.endswith("/") and tag in ("svg", "math", "path")):
            stack.append(node)
            open_[tag] += 1
        return at

    def _close(self, tag: str, stack: list[Node], open_: Counter, pop) -> None:
        if tag in ("html", "body") or not (any(open_[h] for h in HEADINGS) if tag in HEADINGS else open_[tag]):
            return
        for k in range(len(stack) - 1, 0, -1):
            here = stack[k].tag
            if here == tag or tag in HEADINGS and here in HEADINGS:
                pop(k)
                return
            if tag not in BLOCK and here in BLOCK and here != "p" or here in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def best(self) -> Node | None:
        top = max((x for x in self.nodes if x.score > 0), key=lambda x: (x.score, x.depth, -x.order), default=None)
        node = top.parent if top is not None and top.tag not in ("article", "main") else None
        while node is not None and node.tag not in ("body", "html", ""):
            # headline, lead and further text beside an element of a telling name
            if node.tag in CONTAINERS:
                if node.boost < 1:
                    break
                if node.sum > top.sum:
                    top = node
                if node.tag in ("article", "main"):
                    break
            node = node.parent
        return top

    def within(self, tops: list[Node]) -> list[bool]:
        """Of every element, by its order, whether it is one of `tops` or inside one."""
        wanted, inside = {x.order for x in tops}, []
        for node in self.nodes:
            inside.append(node.order in wanted or node.parent.order >= 0 and inside[node.parent.order])
        return inside

    def beside(self, best: Node) -> list[Node]:
        """The outermost containers with text that are neither in `best` nor around it."""
        around, node = set(), best
        while node is not None:
            around.add(node.order)
            node = node.parent
        inside, out = self.within([best]), []
        taken = [False] * len(self.nodes)
        for x in self.nodes:
            up = x.parent.order
            taken[x.order] = inside[x.order] or up >= 0 and taken[up]
            if not taken[x.order] and x.order not in around and x.tag in CONTAINERS and x.sum > 0:
                out.append(x)
                taken[x.order] = True
        return out

    def taken(self, tops: list[Node]) -> Iterator[tuple[Node, str, int]]:
        """The containers' blocks, in page order; the whole page's if there are none. Text that stands in
        the body itself, beside containers that are no article or main, belongs to them."""
        inside = self.within(tops)
        loose = all(x.tag not in ("article", "main") and x.parent.holder.tag in ("body", "") for x in tops)
        for holder, text, links in self.blocks:
            if not tops or holder.order >= 0 and inside[holder.order] or loose and holder.tag in ("body", ""):
                yield holder, text, links

    def text_of(self, tops: list[Node]) -> str:
        return "\n\n".join(text for _, text, _ in self.taken(tops))

    def prose_of(self, tops: list[Node], but: list[Node]) -> int:
        """Characters of their blocks that are no furniture, those in `but` left out."""
        out = self.within(but)
        return sum(len(text) for holder, text, links in self.taken(tops) if len(text) >= PROSE and links <= PROSE_LINKS * len(text) and not (holder.order >= 0 and out[holder.order]))


def extract(html: str | None, winners: list[str], furniture: list[str] | tuple[str, ...] = ()) -> tuple[str, str | None]:
    """(main text, path it was taken from) of a page, given its host's winning paths and those of its furniture."""
    page = Page(html)
    best = page.best()
    if best is None:
        return page.text_of([]), None
    by_key: dict[int, list[Node]] = {}
    for node in page.nodes:
        if node.score > 0:
            by_key.setdefault(node.key, []).append(node)
    inside = page.within([best])
    for path in winners:
        nodes = by_key.get(key_of(path), [])
        if nodes and sum(x.score for x in nodes) >= KEEP * best.score:
            if all(inside[x.order] for x in nodes):
                # more text of the article may stand around them
                if best.tag != "body" and sum(x.sum for x in nodes) < best.sum - 0.5:
                    break
                known = [x for p in furniture for x in by_key.get(key_of(p), [])]
                if page.prose_of([best], [*nodes, *known]) > (1 - NEARLY_ALL) * page.prose_of([best], known):
                    break
            return page.text_of(nodes), path
    return page.text_of(by_key[best.key]), best.path()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, n, against): how many of a host's pages score this container path best, and in how
    many it stands beside the best."""

    def make():
        def rows(hosts, htmls):
            for host, html in zip(hosts, htmls, strict=True):
                page = Page(html)
                best = page.best()
                if best is not None:
                    yield host, best.path(), 1, 0
                    yield from ((host, path, 0, 1) for path in {x.path() for x in page.beside(best)})

        return rows

    cast = map_rows(pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)), make, "host string, path string, n long, against long")
    # written, so that the join with the hosts' totals has a plain shuffle, which can be split for a host of very many paths
    return stored(cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("against").alias("against")), "html-votes")


def winning_paths(voted: DataFrame) -> DataFrame:
    """(host, paths, furniture): a host's paths with at least `SHARE` of its votes (1 / `SHARE` at most),
    most first, and those which have not, but stand beside the best in as many pages."""
    totals = stored(voted.groupBy("host").agg(F.sum("n").alias("all")), "html-hosts")
    wins = F.col("n") >= F.col("all") * SHARE
    kept = voted.join(totals, "host").filter(wins | (F.col("against") >= F.col("all") * SHARE))
    entry = F.when(wins, F.struct((-F.col("n")).alias("n"), (-F.length("path")).alias("l"), "path"))
    listed = kept.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("w"), F.sort_array(F.collect_list(F.when(~wins, F.col("path")))).alias("furniture"))
    return listed.select("host", F.transform("w", lambda x: x["path"]).alias("paths"), "furniture")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, path) of every page."""
    winners = stored(winning_paths(votes(pages, url_col, html_col)), "html-paths")
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col), host_of(F.col(url_col)).alias("host_"))
    hosts, chars = winners.agg(F.count("*"), F.coalesce(F.sum(F.length("host") + F.length(F.array_join("paths", "")) + F.length(F.array_join("furniture", ""))), F.lit(0))).first()
    if hosts <= BROADCAST_PATHS and chars <= BROADCAST_CHARS:
        rows = rows.join(F.broadcast(winners), rows["host_"] == winners["host"], "left")
    else:
        salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS))
        salted = winners.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.withColumn("at_", salt).join(salted, (F.col("host_") == F.col("host")) & (F.col("at_") == F.col("salt_")), "left")

    def make():
        def out(keys, urls, htmls, paths, furniture):
            for key, url, html, own, known in zip(keys, urls, htmls, paths, furniture, strict=True):
                yield key, url, *extract(html, own or [], known or [])

        return out

    kind = pages.schema[id_col].dataType.simpleString()
    return map_rows(rows.select(id_col, url_col, html_col, "paths", "furniture"), make, f"`{id_col}` {kind}, `{url_col}` string, text string, path string")
