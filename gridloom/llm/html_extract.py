"""Main text of web pages by the consensus of their host.

Pages of a host come from few templates.  Every page scores its containers by the text they
hold near them and names the best by a generalised path, the tags and classes from the root
with digits taken out.  Spark counts the votes per host; paths with at least ``LEAST_SHARE`` of
a host's pages win (so there are at most ten, whatever the host's size), and every page is
extracted again from the first winning path that it has with a fair part of the text of its own
best container.  A page for which none will do keeps its own best: hosts without a consensus
lose nothing.

Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments of readers, told by tag, role or the words in class and id.  A wrapper that is called
so but holds the article stays.  Character references are decoded once, white space inside a
block becomes one space, blocks follow each other in page order.

Defined cases: null or empty html gives an empty text; a null address is the host ''; broken or
unclosed markup is read as far as it goes; repeated rows are pages of their own and vote each;
an empty table gives an empty table; other columns pass through, one called as the result is
replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm.line_dedup import host_of
from gridloom.plans.joins import salted_join

#: Part of a host's pages that a path needs.
LEAST_SHARE = 0.1
#: Part of the text of a page's own best container that a winning path must have there.
FAIR_PART = 0.25
#: What a block's text counts for its next container, by how far that is from it.
DECAY = 0.75
#: Containers nested deeper share the path of their ancestor at this depth.
DEEPEST = 64

# Names of HTML elements, and words that classes and ids use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody template tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article blockquote body center div fieldset form html main section td th".split())
CLOSES_P = BLOCKS - frozenset("caption head html body legend optgroup option tbody tfoot thead tr".split())
#: Which open elements an opening tag ends, and which elements hide them from it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select",)),
}
DROPPED_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog footer form head header iframe input math menu nav noembed noframes noscript "
    "object script search select style svg template textarea title video xmp".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus discussion replies reply respond".split())
DROPPED_WORDS = COMMENT_WORDS | frozenset(
    "ad adbox ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs consent cookie cookies "
    "disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager "
    "pagination paywall popup promo promotion recommendations recommended related search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+|=)*+)>"""
)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-zA-Z]+")
_HUMPS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """The elements of a page and the texts of its blocks, in page order."""

    def __init__(self, source: str):
        # By element; the root, which no tag opens, is 0 and its own parent.
        self.parent, self.tag, self.label = [0], [""], [""]
        self.named, self.by_tag, self.main = [False], [False], [False]
        self.remark = [False]
        #: Blocks: pieces of text with the element each stands in.
        self.blocks: list[list[tuple[int, str]]] = []
        self._stack, self._open = [0], Counter()
        self._fresh = True
        self._read(source)
        self._mark()

    # --- reading ------------------------------------------------------------------------
    def _text(self, text: str) -> None:
        if self._fresh:
            self.blocks.append([])
            self._fresh = False
        self.blocks[-1].append((self._stack[-1], entities.unescape(text) if "&" in text else text))

    def _pop(self, depth: int) -> None:
        """Close the elements from a place of the stack on."""
        for node in self._stack[depth:]:
            name = self.tag[node]
            self._open[name] -= 1
            self._fresh |= name in BLOCKS
        del self._stack[depth:]

    def _end_open(self, names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        if not any(self._open[n] for n in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tag[self._stack[depth]]
            if name in names:
                self._pop(depth)
                return
            if name in barrier:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end_open(("p",), ("td", "th", "caption", "button", "object"))
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name in BLOCKS or name == "hr":
            self._fresh = True
        elif name in ("br", "td", "th"):
            self._space()
        if name in VOID:
            return
        node = len(self.tag)
        self.parent.append(self._stack[-1])
        self.tag.append(name)
        self._describe(name, attributes)
        self._stack.append(node)
        self._open[name] += 1

    def _space(self) -> None:
        if not self._fresh:
            self.blocks[-1].append((self._stack[-1], " "))

    def _describe(self, name: str, attributes: str) -> None:
        """Path label of a new element, and what its tag, role, class and id say of it."""
        label, words, role, hidden, prop = name, [], "", False, ""
        if attributes and not attributes.isspace():
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    words += [w.lower() for w in (*_WORDS.findall(value), *_HUMPS.findall(value))]
                    if key == "class" and name not in ("html", "body"):
                        classes = sorted({_DIGITS.sub("#", w.lower()) for w in value.split()})
                        label = ".".join([name, *classes])
                elif key == "role":
                    role = value.lower()
                elif key == "itemprop":
                    prop = value.lower()
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    hidden = True
                elif key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                    hidden = True
        whole = name in ("html", "body", "main", "article")
        told = set(words)
        called = bool(told & DROPPED_WORDS) and name not in ("html", "body", "main")
        self.label.append(label)
        self.by_tag.append(hidden or name in DROPPED_TAGS or (role in DROPPED_ROLES and not whole))
        self.named.append(called)
        self.remark.append(bool(told & COMMENT_WORDS) and name not in ("html", "body", "main"))
        self.main.append(name in ("article", "main") or role == "main" or prop == "articlebody")

    def _end(self, name: str) -> None:
        if name == "br":
            self._space()
        if not self._open[name]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            found = self.tag[self._stack[depth]]
            if found == name:
                self._pop(depth)
                return
            if name not in BLOCKS and found in BLOCKS:
                return  # an inline end tag closes no block

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self._text(source[at:])
                return
            if lt > at:
                self._text(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 2)
                at = end + 3 if end >= 0 else size
                continue
            found = _TAG.match(source, lt) or _LOOSE_TAG.match(source, lt)
            if not found:
                if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = source.find(">", lt)
                    at = end + 1 if end >= 0 else size
                elif source[lt + 1 : lt + 2].isalpha() and source[lt + 1].isascii():
                    return  # a tag that never ends
                else:
                    self._text("<")
                    at = lt + 1
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, found[3])
            if name in RAW:
                close = _RAW_END[name].search(source, at)
                at = close.start() if close else size
            elif found[3].endswith("/") and name in ("svg", "math", "path"):
                self._end(name)

    # --- what is left out ---------------------------------------------------------------
    def _mark(self) -> None:
        """Which elements are left out: ``out``; text of links: ``link``."""
        count = len(self.tag)
        inside = [0] * count  # characters of the subtree
        for block in self.blocks:
            for node, text in block:
                inside[node] += len(text)
        holds = [False] * count  # an article of its own, or the page's heading
        for node in range(count - 1, 0, -1):
            up = self.parent[node]
            inside[up] += inside[node]
            own = (self.main[node] and not self.named[node] and not self.by_tag[node]) or self.tag[node] == "h1"
            holds[up] |= holds[node] or own
        half = inside[0] / 2
        self.out, self.link = [False] * count, [False] * count
        for node in range(1, count):
            up = self.parent[node]
            wraps = holds[node] and inside[node] > half and not self.remark[node]
            told = self.by_tag[node] or self.named[node]
            if wraps and self.tag[node] not in ("nav", "footer", "aside", "head"):
                told = False
            self.out[node] = self.out[up] or told
            self.link[node] = self.link[up] or self.tag[node] == "a"

    def block_text(self, block: list[tuple[int, str]], within: list[bool] | None = None) -> str:
        parts = [t for node, t in block if not self.out[node] and (within is None or within[node])]
        return " ".join("".join(parts).split())

    # --- containers -----------------------------------------------------------------------
    def _containers(self) -> tuple[list[int], list[str]]:
        """Nearest container of every element, itself included, and its path."""
        near, path, depth = [0], [""], [0]
        for node in range(1, len(self.tag)):
            up = self.parent[node]
            deep = depth[up] >= DEEPEST
            path.append(path[up] if deep else f"{path[up]}>{self.label[node]}")
            depth.append(depth[up] + 1)
            near.append(node if self.tag[node] in CONTAINERS else near[up])
        return near, path

    def best(self) -> tuple[int, list[str]]:
        """The container with the best score (0, the page, if no text is left), and all paths."""
        near, path = self._containers()
        score: dict[int, float] = {}
        heading = set()
        for block in self.blocks:
            told = [(node, t) for node, t in block if not self.out[node]]
            if not told:
                continue
            size = len(" ".join("".join(t for node, t in told if not self.link[node]).split()))
            at, weight = near[told[0][0]], 1.0
            for node, _ in told:  # the cells of a row are one block: up to what holds them all
                other = near[node]
                while at != other:
                    if at > other:
                        at = near[self.parent[at]]
                    else:
                        other = near[self.parent[other]]
            while weight > 0.01:
                score[at] = score.get(at, 0.0) + size * weight
                if not at:
                    break
                weight *= DECAY
                at = near[self.parent[at]]
        for node in range(1, len(self.tag)):
            if self.tag[node] == "h1" and not self.out[node]:
                at = near[node]
                while at and at not in heading:
                    heading.add(at)
                    at = near[self.parent[at]]
        best, most = 0, 0.0
        for node, points in score.items():
            name = self.tag[node]
            if name == "article" or (self.main[node] and name != "main"):
                points *= 2.0
            elif self.main[node]:
                points *= 1.5
            elif name in ("", "html", "body"):
                points *= 0.6
            elif MAIN_WORDS & set(re.split(r"[^a-z]+", self.label[node])):
                points *= 1.25
            if node in heading:
                points *= 1.3
            if points > most or (points == most and node < best):
                best, most = node, points
        return best, path

    def text_of(self, roots: list[int]) -> str:
        """Text of some elements, in page order."""
        within = [False] * len(self.tag)
        for node in roots:
            within[node] = True
        for node in range(1, len(self.tag)):
            within[node] |= within[self.parent[node]]
        texts = [self.block_text(block, within) for block in self.blocks]
        return "\n\n".join(t for t in texts if t)


def vote(source: str) -> tuple[str, int] | None:
    """Generalised path of a page's best container and its characters; None without text."""
    page = Page(source)
    best, path = page.best()
    return (path[best], len(page.text_of([best]))) if best else None


def extract(source: str, paths: list[str]) -> str:
    """Main text of a page whose host's winning paths are these, the first being the best."""
    page = Page(source)
    best, path = page.best()
    own = page.text_of([best])
    for wanted in paths:
        if wanted == path[best] and path.count(wanted) == 1:
            return own
        roots = [n for n in range(1, len(path)) if path[n] == wanted and page.tag[n] in CONTAINERS and not page.out[n]]
        text = page.text_of(roots) if roots else ""
        if text and len(text) >= FAIR_PART * len(own):
            return text
    return own


def _votes(html: pa.Array) -> pa.Array:
    found = [vote(s.as_py()) for s in html]
    return pa.array([None if v is None else {"path": v[0], "chars": v[1]} for v in found], pa.struct([("path", pa.string()), ("chars", pa.int64())]))


def _extracted(html: pa.Array, paths: pa.Array) -> pa.Array:
    return pa.array([extract(s.as_py(), p.as_py() or []) for s, p in zip(html, paths, strict=True)], pa.string())


def host_paths(pages: DataFrame, host: Column, html: Column, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(host, pages, paths)``: each host's winning paths, most votes first."""
    # Said to be non-deterministic, so that no filter on the vote makes Spark parse a page twice.
    voting = F.arrow_udf(_votes, "struct<path: string, chars: bigint>").asNondeterministic()
    told = pages.select(host.alias("host"), voting(html).alias("vote")).where("vote IS NOT NULL")
    votes = common.put(
        told.groupBy("host", "vote.path").agg(F.count(F.lit(1)).alias("n"), F.sum("vote.chars").alias("chars")), "votes"
    )
    totals = votes.groupBy("host").agg(F.sum("n").alias("pages"))
    winners = votes.join(totals, "host").where(F.col("n") >= F.col("pages") * least_share)
    order = F.struct((-F.col("n")).alias("n"), (-F.col("chars")).alias("chars"), "path")
    ranked = winners.groupBy("host", "pages").agg(F.sort_array(F.collect_list(order)).alias("w"))
    return ranked.select("host", "pages", F.col("w.path").alias("paths"))


def main_text(
    pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", least_share: float = LEAST_SHARE
) -> DataFrame:
    """All rows and columns of ``pages``, with the main text of the page as ``out``."""
    spark = pages.sparkSession
    common.ship(spark)
    row, site, held, paths = "_row", "_site", "_html", "_paths"
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != out.lower()]).alias(row),
        host_of(F.col(f"`{url_col}`")).alias(site), common.text_or_empty(F.col(f"`{html_col}`")).alias(held),
    )
    won = common.put(host_paths(rows, F.col(site), F.col(held), least_share), "paths")
    size = won.agg(F.coalesce(F.sum(F.octet_length(F.array_join("paths", "\n")) + F.octet_length("host") + 64), F.lit(0))).first()[0]
    table = won.select(F.col("host").alias(site), F.col("paths").alias(paths))
    if size <= common.BROADCAST_BYTES:
        met = rows.join(F.broadcast(table), site, "left")
    else:
        heavy = common.heavy_of(won.select(F.col("host").alias(site), "pages"), site, "pages")
        met = salted_join(rows.withColumn("_salted", F.xxhash64(held)), table, site, "left", heavy=heavy)
    extracted = F.arrow_udf(_extracted, "string")(held, paths)
    return met.select(row, extracted.alias(out)).select(f"{row}.*", out)
