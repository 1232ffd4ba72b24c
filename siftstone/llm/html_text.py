"""Main text of web pages by consensus host paths.

1. Each page is read into blocks of text and the containers that hold them. Every container has a
   path of tags and classes with digits generalised. A container's score is the text of its own blocks, less
   linked text, and half of its children's scores. From the best container the page climbs to the whole article: to an
   enclosing article element, out of parts (lists, tables, quotes, figures, sections) and into a parent that has text
   blocks of its own beside it, but never from a division into the body.
2. A page votes for the path of that container. Votes are added up per host in Spark.
3. Every page is read again and gives the blocks of the containers on its host's winning path; a page
   without such a container, or where it holds less than ``HOLDS`` of the text that the page's own holds, uses its own.

Blocks inside menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments never count: they are known by tag, role or the names of class and id. A name counts if all its words say so
(``ad-box``, ``left-sidebar``, but not ``share-price`` or ``notice-period``); names that may also stand in an article
(``related``, ``share``, ``promo``) count only where half of the text is linked. Elements that are not displayed (hidden,
display:none) and templates are markup. Text of formulas, drawings and buttons stays.

Defined results: null or empty html, or a page without such text, gives an empty text; a null or odd url
has the host ""; repeated rows give one row each and vote each; ties of scores and votes go to the smaller path, paths
of more than ``LONG_PATH`` signs being written and compared as hashes.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import appended, byte_slices, materialize, table, without

OUTPUTS = ("text", "n_chars")
#: Share of the text of the page's own container that the winning path must hold to be used.
HOLDS = 0.3
LONG_PATH = 1000
#: Winning paths are broadcast up to this many hosts (a path has at most LONG_PATH signs), else joined salted.
BROADCAST_HOSTS = 50_000
SALTS = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody tfoot thead tr ul head hr".split()
)
CONTAINER = frozenset("article body div main section td blockquote center details figure table tbody tr ul ol dl li html".split())
#: Parts of an article, from which a page climbs on.
PARTS = frozenset("section td blockquote center details figure table tbody tr ul ol dl li".split())
LEFT_OUT = frozenset("aside dialog footer form head menu nav optgroup option search select".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices pagination pager popup replies reply respond sidebar sidebars signup skip sponsor sponsored "
    "subscribe subscription alert".split()
)
#: Names that are left out only where half of the text is linked.
LINKED_WORDS = frozenset("copyright disclaimer notification promo promoted promotion related share sharing social tags toc toolbar widget widgets".split())
#: Words that say nothing beside the others of a name.
PLACE_WORDS = frozenset(
    "a area bar block body bottom box center column container content div entry first form global group inner item items "
    "js left links list main new outer page panel post posts primary reader right row secondary section site slot sub "
    "text the thread top unit user wrap wrapper".split()
)
WITHOUT = frozenset("no with has without".split())
#: An element that opens while one of these is open ends it.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
INLINE_WALL = frozenset("article aside body div footer form header html main nav section table td th ul ol li".split())


KEPT, GONE, IF_LINKED = range(3)


def named(name: str, inside_article: bool) -> int:
    """What a class or id says about an element."""
    parts = {p for p in re.split(r"[^a-z]+", name) if p} - PLACE_WORDS
    if not parts or WITHOUT & parts or inside_article and "header" in parts:
        return KEPT
    if parts <= LEFT_OUT_WORDS:
        return GONE
    return IF_LINKED if parts <= LEFT_OUT_WORDS | LINKED_WORDS else KEPT


def left_out(tag: str, attributes: str, inside_article: bool) -> int:
    if tag in LEFT_OUT:
        return GONE
    if tag == "header":
        return KEPT if inside_article else GONE
    if not attributes or tag in ("html", "body", "main", "article"):
        return GONE if tag == "article" and attributes and any(named(x, False) == GONE for x in names_of(attributes)) else KEPT
    if HIDDEN.search(attributes):
        return GONE
    out = KEPT
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "role" and value.strip("\"'").lower() in ROLES:
            return GONE
    for one in names_of(attributes):
        says = named(one, inside_article)
        if says == GONE:
            return GONE
        out = out or says
    return out


def names_of(attributes: str) -> list[str]:
    """The words of class and id."""
    return [x for name, value in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for x in value.strip("\"'").lower().split()]


def generalised(tag: str, attributes: str) -> str:
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        if name.lower() == "class":
            classes = sorted({re.sub(r"\d+", "#", c) for c in value.strip("\"'").lower().split()})
            return ".".join([tag, *classes])
    return tag


class Page:
    """blocks: [text, linked characters, container]; containers: (parent, path, tag)."""

    def __init__(self, source: str):
        self.blocks: list[list] = []
        self.containers: list[tuple[int, str, str]] = [(-1, "", "")]
        self.linked_only: list[int] = []  # for each block the innermost element that stays only if it isn't linked
        self.read(source)
        self.drop_linked()

    def read(self, source: str) -> None:
        # An open element: tag, its container, whether it is left out, whether it is within an article, IF_LINKED element.
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]
        elements = 0
        out, linked, links, at = [], 0, 0, 0

        def close_block():
            nonlocal out, linked
            if out:
                text = " ".join(entities.unescape("".join(out)).split())
                if text:
                    self.blocks.append([text, linked, stack[-1][1]])
                    self.linked_only.append(stack[-1][4])
            out, linked = [], 0

        def pop_to(n):
            nonlocal links
            for tag, *_ in stack[n:]:
                links -= tag == "a"
            del stack[n:]

        end = len(source)
        while at < end:
            found = TOKEN.search(source, at)
            upto = found.start() if found else end
            if upto > at and not stack[-1][2]:
                piece = source[at:upto]
                out.append(piece)
                if links:
                    linked += len(piece.strip())
            if not found:
                break
            at = found.end()
            closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == tag:
                        if tag in BLOCK or tag in ("td", "th"):
                            close_block() if tag in BLOCK else out.append(" ")
                        pop_to(n)
                        break
                    if stack[n][0] in INLINE_WALL and tag not in BLOCK:
                        break
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    close_block() if tag == "hr" else out.append(" ")
                continue
            if tag in BLOCK:
                close_block()
                for n in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                    if stack[n][0] == "p":
                        pop_to(n)
                        break
                    if stack[n][0] in BLOCK or stack[n][0] in ("td", "th"):
                        break
            elif tag in ("td", "th"):
                out.append(" ")
            if tag in ENDED_BY:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] in ENDED_BY[tag]:
                        pop_to(n)
                        break
                    if stack[n][0] in WALLS[tag]:
                        break
            if attributes.endswith("/") and tag not in BLOCK:
                continue
            _, container, gone, article, weak = stack[-1]
            says = KEPT if gone else left_out(tag, attributes, article)
            gone = gone or says == GONE
            if says == IF_LINKED and weak < 0:
                elements, weak = elements + 1, elements
                if tag not in BLOCK:  # its text is judged apart from what stands before it
                    close_block()
            if tag in CONTAINER and not gone:
                path = f"{self.containers[container][1]}>{generalised(tag, attributes)}"
                if len(path) > LONG_PATH:  # deep nesting must not take memory by the square of its depth
                    path = "#" + hashlib.md5(path.encode()).hexdigest()
                self.containers.append((container, path, tag))
                container = len(self.containers) - 1
            links += tag == "a"
            stack.append((tag, container, gone, article or tag in ("article", "main"), weak))
        close_block()

    def drop_linked(self) -> None:
        """Leaves out the elements named as links about the article, if half of their text is linked."""
        text: dict[int, int] = {}
        for (own, linked, _), weak in zip(self.blocks, self.linked_only):
            text[weak] = text.get(weak, 0) + 2 * linked - len(own)
        self.blocks = [b for b, weak in zip(self.blocks, self.linked_only) if weak < 0 or text[weak] < 0]

    def scores(self) -> list[float]:
        out = [0.0] * len(self.containers)
        for text, linked, container in self.blocks:
            out[container] += max(0.0, len(text) - 2.0 * linked)
        for i in range(len(out) - 1, 0, -1):  # children come after their parents
            out[self.containers[i][0]] += out[i] / 2
        return out

    def best(self) -> int:
        """The container of the article: the one of best score (of equal ones that on the smaller path, then the first),
        and from there up."""
        scores = self.scores()
        at = min(range(len(scores)), key=lambda i: (-scores[i], self.containers[i][1], i))
        direct = {container for text, linked, container in self.blocks if 2 * linked < len(text)}
        above, i = [], at
        while i > 0:
            above.append(i)
            i = self.containers[i][0]
        article = next((i for i in above if self.containers[i][2] == "article"), -1)
        if article >= 0:
            return article
        while (parent := self.containers[at][0]) > 0:
            if self.containers[at][2] not in PARTS and (parent not in direct or self.containers[parent][2] in ("body", "html")):
                break
            at = parent
        return at

    def inside(self, tops: set[int]) -> list[tuple[str, int]]:
        held = [i in tops for i in range(len(self.containers))]
        for i, (parent, _, _) in enumerate(self.containers):
            held[i] = held[i] or parent >= 0 and held[parent]
        return [(text, linked) for text, linked, container in self.blocks if held[container]]

    def text(self, path: str | None, holds: float = HOLDS) -> str:
        """The blocks on a path, or those of the page's own container."""
        if not self.blocks:
            return ""
        own = self.best()
        found = self.inside({own})
        tops = {i for i, (_, p, _) in enumerate(self.containers) if p == path}
        if tops and own not in tops:
            worth = lambda blocks: sum(max(0, len(t) - 2 * linked) for t, linked in blocks)
            agreed = self.inside(tops)
            if agreed and worth(agreed) >= holds * worth(found):
                found = agreed
        elif tops:
            found = self.inside(tops)
        return "\n".join(t for t, _ in found)


def host_of(url: str) -> Column:
    """The host of a url in lower case, "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(__host, path, votes) of all pages, summed per host."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            count: Counter = Counter()
            for part, sources in byte_slices(batch, "__html"):
                for host, source in zip(part.column(0).to_pylist(), sources):
                    page = Page((source or b"").decode())
                    if page.blocks:
                        count[host, page.containers[page.best()][1]] += 1
            if count:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in count]), pa.array([p for _, p in count]), pa.array(count.values(), pa.int64())],
                    names=["host", "path", "votes"],
                )

    cast = pages.select(host_of(url).alias("__host"), F.col(html).alias("__html"))
    return cast.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def with_paths(pages: DataFrame, won: DataFrame, broadcast_hosts: int) -> DataFrame:
    """Adds __path. Pages are never dealt by host alone: one host may have a third of them."""
    if won.count() <= broadcast_hosts:
        joined = pages.join(F.broadcast(won), F.col("__host") == won["host"], "left")
    else:
        salted = won.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("__s", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)).cast("int"))
        joined = pages.join(salted, (F.col("__host") == salted["host"]) & (F.col("__s") == F.col("__salt")), "left").drop("__s", "__salt")
    return joined.drop("host", "__host")


def extract(pages: DataFrame, url: str = "url", html: str = "html", broadcast_hosts: int = BROADCAST_HOSTS, holds: float = HOLDS) -> DataFrame:
    """The pages with their main text and its code points."""
    pages = without(pages, *OUTPUTS, "__host", "__path")
    won = materialize(winners(votes(pages, url, html)), "host-paths")
    joined = with_paths(pages.withColumn("__host", host_of(url)), won, broadcast_hosts)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, sources in byte_slices(batch, html):
                paths = part.column(part.schema.get_field_index("__path")).to_pylist()
                texts = [Page((s or b"").decode()).text(p, holds) for s, p in zip(sources, paths)]
                yield appended(
                    part.drop_columns(["__path"]), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64())
                )

    return joined.mapInArrow(run, pages.selectExpr("*", "'' as text", "0L as n_chars").schema)


def winners(counted: DataFrame) -> DataFrame:
    """One path per host: most votes, then the smaller path."""
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("__path"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", *OUTPUTS)
