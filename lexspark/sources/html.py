"""HTML documents as rows: links, attachments and readable text, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as X

# Tags without text of the page, tags that end a line, empty tags, places of the content in order.
DROPPED = frozenset(("script", "style", "noscript", "nav", "footer", "header"))
BREAKS = frozenset("article br dd div dl dt figure form h1 h2 h3 h4 h5 h6 hr li main ol option p pre section table td th tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTENT = ("main", "article", "#content", ".content", ".law-content", ".detail", "#ctl00_ContentPlaceHolder1", "#form1")
GENERIC_TITLES = frozenset(("消防法令查詢系統", "內政部消防署法令查詢系統", "法規查詢", "法令查詢", "所有條文"))


_SIMPLE = re.compile(r"([#.\[]?)([\w*-]+)(?:=(\"[^\"]*\"|'[^']*'|[^\]]*))?\]?")


@lru_cache(maxsize=1024)
def _simple(selector: str) -> list[tuple[str, str, str]]:
    return _SIMPLE.findall(selector)


class Node:
    """An element: tag, attributes, children (elements and strings)."""

    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def fits(self, selector: str) -> bool:
        """Whether the element is what a selector without blanks names: a tag, ids, classes and attributes, together."""
        for sign, name, value in _simple(selector):
            if sign == "#" and self.attrs.get("id") != name or sign == "." and name not in (self.attrs.get("class") or "").split():
                return False
            if sign == "[" and (name not in self.attrs or value and self.attrs[name] != value.strip("\"'")):
                return False
            if not sign and name != "*" and self.tag != name.lower():
                return False
        return True

    def select(self, selector: str) -> Iterator[Node]:
        """The elements below that a CSS selector names, in order: compounds, descendants (blank), children (>), lists (comma)."""
        wanted = [re.findall(r"(>?)\s*([^\s>]+)", one.strip()) for one in selector.split(",") if one.strip()]
        if len(wanted) == 1 and len(wanted[0]) == 1:  # no ancestors to look at
            yield from (n for n in self.walk() if n is not self and n.fits(wanted[0][0][1]))
            return

        def reached(path: tuple[Node, ...], steps: list[tuple[str, str]]) -> bool:
            if not path[-1].fits(steps[-1][1]):
                return False
            if len(steps) == 1:
                return True
            above = [len(path) - 2] if steps[-1][0] else range(len(path) - 2, 0, -1)
            return any(i > 0 and reached(path[: i + 1], steps[:-1]) for i in above)

        stack: list[tuple[Node, ...]] = [(self, k) for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            path = stack.pop()
            if any(reached(path, steps) for steps in wanted):
                yield path[-1]
            stack.extend((*path, k) for k in reversed(path[-1].kids) if isinstance(k, Node))

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)

    def text(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in DROPPED:
                if n.tag in BREAKS:
                    out.append("\n")
                    stack.append("\n")
                stack.extend(reversed(n.kids))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "td", "tr") and self.open[-1].tag == tag:
            self.open.pop()
        n = Node(tag, dict(attrs))
        self.open[-1].kids.append(n)
        if tag not in EMPTY:
            self.open.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def content_node(root: Node, selector: str | None = None) -> Node:
    """The chosen selector's element, else the first known place with more than 100 characters, else the body or all."""
    if selector and (n := root.first(selector)):
        return n
    for s in CONTENT:
        n = root.first(s)
        if n is not None and len(" ".join(n.text().split())) > 100:
            return n
    return root.first("body") or root


def page_text(html: Column, selector: str | None = None) -> Column:
    """A page's readable text, a block a line; null for null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else "\n".join(x.strip() for x in content_node(parse(h), selector).text().split("\n") if x.strip()))

    return convert(html)


def page_title(html: Column, fallback: Column | None = None) -> Column:
    """A page's title: its first heading or title class that isn't the site's own, else the fallback, else its title element."""
    from pyspark.sql.functions import pandas_udf

    def choose(h: str | None, other: str | None) -> str | None:
        if h is None:
            return other
        root = parse(h)
        for s in ("h1", "h2", ".title", ".law-title"):
            if n := root.first(s):
                t = " ".join(n.text().split())
                if t not in GENERIC_TITLES and 2 <= len(t) <= 500:
                    return t
        if other and " ".join(other.split()) not in GENERIC_TITLES:
            return " ".join(other.split())
        n = root.first("title")
        t = " ".join("".join(k for k in n.kids if isinstance(k, str)).split()) if n else ""
        return t if t and t not in GENERIC_TITLES else other or "未命名法規"

    @pandas_udf("string")
    def convert(s: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([choose(h, x if isinstance(x, str) else None) for h, x in zip(s, o)])

    return convert(html, F.lit(None).cast("string") if fallback is None else fallback)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tags: tuple[tuple[str, tuple[str, ...]], ...] = (("a", ("href",)),)) -> DataFrame:
    """``page_id, pos, text, link``: every link of every page in order, absolute; without script and mail links."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("u"), F.col(html_col).alias("h")).where("h is not null")
    want = dict(tags)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, u, h in zip(pdf["page_id"], pdf["u"], pdf["h"]):
                n = 0
                for e in parse(h).walk():
                    for a in want.get(e.tag, ()):
                        v = (e.attrs.get(a) or "").strip()
                        if v and not v.lower().startswith(("javascript:", "mailto:", "#", "data:")):
                            rows.append((i, n, " ".join(e.text().split()), urljoin(u or "", v)))
                            n += 1
                            break
            yield pd.DataFrame(rows, columns=["page_id", "pos", "text", "link"])

    return src.mapInPandas(run, "page_id long, pos int, text string, link string")


# Words of links that lead to no law, and words in the addresses of attachments (below).
def law_links(pages: DataFrame, prefix: str = "lsid:", noise: tuple[str, ...] = ("回首頁", "回上一頁", "下一頁", "上一頁", "更多"), **cols) -> DataFrame:
    """The links of category pages to laws: on the page's own host, with a title, not repealed (廢…); one a law, the first."""
    from pyspark.sql.window import Window

    from lexspark.functions import urls as U

    found = links(pages, **cols).join(pages.select(F.col(cols.get("id_col", "page_id")).cast("long").alias("page_id"), F.col(cols.get("url_col", "url")).alias("base")).dropDuplicates(["page_id"]), "page_id")
    title = F.regexp_replace(X.normalize_query(F.col("text")), r"^\d{1,4}[.、]\s*", "")
    c = found.withColumn("title", title).where((U.host(F.col("link")) == U.host(F.col("base"))) & (F.length("title") >= 2) & ~F.col("title").isin(*noise) & ~F.col("title").rlike("^[（(]?廢") & U.is_detail_url(F.col("link")))
    c = c.withColumn("source_key", U.source_key(F.col("link"), prefix))
    w = Window.partitionBy("page_id", "source_key").orderBy("pos")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("page_id", "pos", "title", F.col("link").alias("url"), "source_key")


def attachments(pages: DataFrame, hints: tuple[str, ...] = ("attach", "download", "file", ".pdf"), **cols) -> DataFrame:
    """``page_id, link``: the attachments that pages link to or embed, on their own host."""
    from lexspark.functions import urls as U

    tags = (("a", ("href",)), ("iframe", ("src",)), ("embed", ("src",)), ("object", ("data",)))
    base = pages.select(F.col(cols.get("id_col", "page_id")).cast("long").alias("page_id"), F.col(cols.get("url_col", "url")).alias("base")).dropDuplicates(["page_id"])
    found = links(pages, tags=tags, **cols).join(base, "page_id")
    return found.where((U.host(F.col("link")) == U.host(F.col("base"))) & X.has_any(F.lower("link"), hints)).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))


def labelled_rows(html: Column) -> Column:
    """The two-cell rows of a page's tables as an array of (label, value)."""
    from pyspark.sql.functions import pandas_udf

    def rows(h: str | None) -> list:
        out = []
        for tr in parse(h).walk() if h else ():
            cells = [k for k in tr.kids if isinstance(k, Node) and k.tag in ("td", "th")] if tr.tag == "tr" else []
            if len(cells) == 2:
                out.append({"label": re.sub(r"[\s：:]+", "", cells[0].text()), "value": cells[1].text().strip()})
        return out

    @pandas_udf("array<struct<label: string, value: string>>")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(rows)

    return convert(html)


def same_host(url: str, allowed: str) -> bool:
    return (urlparse(url).hostname or "").lower() == allowed.lower()
