"""Main text of web pages by consensus paths of their hosts.

Every page is cut into blocks, and the containers around them are scored: a block's text
outside links counts fully for its nearest container, half for the next and so on.  The
best container votes with its generalised path of tags and classes; votes are summed by
host in Spark.  Each page is then extracted again from the container that its host's
leading paths name, or from its own best one where none of them holds a fair part of it.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are known by tag,
role and the words of class and id; scripts, styles and markup never become text.

Defined results: null or empty html gives an empty text.  A page without a host (null or
odd url) votes with all others like it.  Repeated rows are extracted alike.  An empty
table gives no rows.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_BYTES, read, stored

#: Leading paths of a host that are tried, and the part of a page's best score that a
#: path's container must reach.
LEADERS, FAIR = 3, 0.4
#: A container whose siblings of equal path reach this part of its score is one section of many.
TWINS = 0.25
#: Copies of a host's paths, and shares its pages are dealt into, if they are joined by shuffle.
SALTS = 32

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_WORD = re.compile(r"[A-Z]?[a-z]+|[0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Tags by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOX = frozenset("article body center div main section td".split())
_NOISE = frozenset("aside button dialog footer form head menu nav object".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class and id that name what is no article, or what is one.
_BAD = frozenset(
    "adbox adsense adslot alert alerts announcement captcha commentlist cookiebanner cookiebar copyright disclaimer donate donation drawer feedback legal lightbox notification notifications offcanvas outbrain overlay poll popover sitenav subnav survey taboola tooltip topbar "
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended recommendations related reply replies respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
_GOOD = frozenset("article body content entry main post story text".split())


class Page:
    """Blocks and scored containers of one page, in time and memory that grow with its length.

    Containers are numbered in page order, so those within container ``i`` are ``i`` to
    ``last[i]``.  A path is kept as the digest of the paths above and its own last part.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.path, self.tag, self.bonus = [-1], [""], ["html"], [1.0]
        self.score: dict[int, float] = {}
        self.blocks: list[tuple[str, int, bool]] = []  # text, nearest container, whether a heading
        self._parse(source)
        self.last = list(range(len(self.parent)))
        for i in range(len(self.parent) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def _parse(self, source: str) -> None:
        stack, noise, links, text, linked = [(0, "html", False)], 0, 0, [], 0
        header = heading = 0  # inside a header of an article, and inside a heading there
        open_tags: Counter[str] = Counter()

        def end_block() -> None:
            nonlocal linked
            words = " ".join(html.unescape("".join(text)).split()) if text else ""
            text.clear()
            if words:
                box = stack[-1][0]
                self.blocks.append((words, box, heading > 0))
                gain, step = max(0.0, len(words) - 1.0 * linked), 1.0
                while box >= 0 and step > 0.05:
                    self.score[box] = self.score.get(box, 0.0) + gain * step
                    box, step = self.parent[box], step / 2 if self.tag[box] in _BOX else step
            linked = 0

        def put(piece: str) -> None:
            nonlocal linked
            if piece and not noise and not (header and not heading):
                text.append(piece)
                if links:
                    linked += len(piece.strip())

        def pop() -> str:
            nonlocal noise, links, header, heading
            _, t, bad = stack.pop()
            open_tags[t] -= 1
            noise -= bad
            links -= t == "a"
            header -= t == "header"
            heading -= t in _HEADING
            return t

        at, end = 0, source.rfind(">") + 1  # no tag can end later
        for m in _MARKUP.finditer(source, 0, end):
            put(source[at : m.start()])
            at = m.end()
            name = m[3]
            if not name:
                if at == end and (source.startswith("<!--", m.start()) and not m[0].endswith("-->") or m[1] and not m[0].lower().rstrip("> \t\r\n").endswith(f"</{m[1].lower()}")):
                    at = end = len(source)  # a comment or raw text that nothing closes
                continue
            name = name.lower()
            if m[2]:
                if name in _BLOCK:
                    end_block()
                if open_tags[name]:
                    while pop() != name:
                        pass
                continue
            if name == "br":
                put(" ")
                continue
            if name in _BLOCK:
                end_block()
                closes = "p" if name not in ("li", "td", "th", "tr", "dt", "dd") else name
                while len(stack) > 1 and (stack[-1][1] == closes or stack[-1][1] not in _BLOCK and open_tags[closes] or closes != "p" and stack[-1][1] == "p"):
                    if pop() == closes:
                        break
            if name in _VOID or m[4].endswith("/") and name not in _BLOCK:
                continue
            attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(m[4])} if "=" in m[4] else {}
            words = {w.lower() for w in _WORD.findall(attrs.get("class", "") + " " + attrs.get("id", ""))} if attrs else set()
            within = open_tags["article"] + open_tags["main"] > 0
            bad = name in _NOISE or name == "header" and not within
            if not bad and name not in ("html", "body") and (attrs or m[4].strip()):
                bad = bool(words & _BAD and not (name in ("article", "main") and not within)) or attrs.get("role", "").lower() in _ROLES
                bad = bad or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", ""))) or " hidden" in _QUOTED.sub("", m[4])
            node = stack[-1][0]
            if name in _BOX and not bad and not noise:
                above = node
                node = len(self.parent)
                classes = ".".join(sorted(_NUMBER.sub("0", c) for c in attrs.get("class", "").split()))
                part = f"{name}{'.' + classes if classes else ''}"
                self.parent.append(above)
                self.path.append(f"{xxhash.xxh3_128_hexdigest(f'{self.path[above]}>{part}')}>{part}")
                self.tag.append(name)
                self.bonus.append((1.5 if name in ("article", "main") else 1.0) * (1.25 if words & _GOOD else 1.0))
            open_tags[name] += 1
            noise += bad
            links += name == "a"
            header += name == "header"
            heading += name in _HEADING
            stack.append((node, name, bad))
        if end < len(source) and "<!--" in source[end:]:
            put(source[at : source.index("<!--", end)])
        else:
            put(source[at:])
        end_block()

    def best(self) -> int:
        """The container with the highest score, widened to the article that it is a part of."""
        if not self.score:
            return 0
        return self._whole(max(self.score, key=lambda i: (self.score[i] * self.bonus[i], -i)))

    def _whole(self, top: int) -> int:
        """The article (or main part) around a container, if any; else the container with the
        siblings that repeat its path and with headings that stand alone around it."""
        for wanted in ("article", "main"):
            i = found = top
            while i > 0:
                found, i = (i if self.tag[i] == wanted else found), self.parent[i]
            if self.tag[found] == wanted:
                return found
        ahead = [[0, 0] for _ in range(len(self.parent) + 1)]  # blocks and headings in containers before each
        for _, box, head in self.blocks:
            ahead[box + 1][0] += 1
            ahead[box + 1][1] += head
        for a, b in zip(ahead, ahead[1:]):
            b[0] += a[0]
            b[1] += a[1]
        below: dict[int, list[int]] = {}
        for i in self.score:
            below.setdefault(self.parent[i], []).append(i)

        def held(i: int, k: int) -> int:
            return ahead[self.last[i] + 1][k] - ahead[i][k]

        while self.parent[top] > 0 and self.tag[self.parent[top]] != "body":
            above = self.parent[top]
            around, heads = (held(above, k) - held(top, k) for k in (0, 1))
            twins = sum(self.score[i] for i in below.get(above, ()) if i != top and self.path[i] == self.path[top])
            if not 0 < around == heads and twins < TWINS * self.score.get(top, 0.0):
                break
            top = above
        return top

    def within(self, i: int, root: int) -> bool:
        return root <= i <= self.last[root]

    def weight(self, i: int) -> float:
        return self.score.get(i, 0.0) * self.bonus[i]

    def chosen(self, leaders: list[str]) -> list[int]:
        """The containers of the first leading path whose best one holds enough of the page,
        in page order; of a path that ends without a class, which layout boxes share, those
        in the best one's article or in the page's own choice."""
        own = self.best()
        for path in leaders:
            same = [i for i in self.score if self.path[i] == path]
            if same:
                i = max(same, key=lambda i: (self.weight(i), -i))
                if self.weight(i) >= FAIR * self.weight(own):
                    last = path.rpartition(">")[2]
                    if len(same) > 1 and "." not in last and last not in ("article", "main", "section"):
                        whole = self._whole(i)
                        same = [j for j in same if j == i or self.within(j, own) or self.within(j, whole)]
                    return sorted(same)
        return [own]

    def text(self, *roots: int) -> str:
        inside, reach = bytearray(len(self.parent)), -1
        for root in sorted(roots):
            if self.last[root] > reach:
                inside[root : self.last[root] + 1] = b"\1" * (self.last[root] + 1 - root)
                reach = self.last[root]
        return "\n".join(t for t, box, _ in self.blocks if inside[box])


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def leading_paths(pages: DataFrame) -> DataFrame:
    """``host, paths``: at most ``LEADERS`` paths of each host, by votes."""

    def vote(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(source)
                if page.blocks:
                    key = (h, page.path[page.best()])
                    found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["host", "path", "votes"])

    votes = pages.select(host(F.col("url")).alias("host"), "html").where("html is not null").mapInArrow(vote, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    leaders = votes.withColumn("place", place).where(F.col("place") <= LEADERS).groupBy("host")
    return leaders.agg(F.array_sort(F.collect_list(F.struct("place", "path")))["path"].alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def pull(batches):
        for b in batches:
            texts = []
            for source, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                page = Page(source) if source else None
                texts.append(page.text(*page.chosen(paths or [])) if page and page.blocks else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    leaders = stored(leading_paths(pages), "paths")
    size = leaders.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "")) + 64)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("host", host(F.col("url")))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(leaders), "host", "left")
    else:  # a host may hold a third of all pages
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(leaders, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "paths").mapInArrow(pull, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
