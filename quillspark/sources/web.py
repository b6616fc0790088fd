"""Captured web pages: which to take, and their text as Markdown. Nothing here reaches for a network."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import store as K

DROPPED = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg", "button"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "blockquote", "body", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}


# What a crawl leaves out unless told otherwise.
DEFAULT_EXCLUDES = r"""
**/CHANGELOG.md **/changelog.md **/CHANGELOG.mdx **/changelog.mdx **/LICENSE **/LICENSE.md **/license.md **/CODE_OF_CONDUCT.md **/code_of_conduct.md
**/*.test.* **/*.spec.* **/*_test.py **/*_test.go
**/*.lock **/package-lock.json **/yarn.lock **/pnpm-lock.yaml **/go.sum
**/*.min.js **/*.min.css **/*.map **/*.d.ts
**/.DS_Store **/Thumbs.db **/*.swp **/*.swo
/.*\.(ini|cfg|conf|log|pid)$/
**/archive/** **/archived/** **/deprecated/** **/legacy/** **/old/** **/outdated/** **/previous/** **/superseded/** docs/old/**
**/test/** **/tests/** **/__tests__/** **/spec/**
**/dist/** **/build/** **/out/** **/target/** **/.next/** **/.nuxt/** **/.vscode/** **/.idea/**
**/i18n/ar*/** **/i18n/de*/** **/i18n/es*/** **/i18n/fr*/** **/i18n/hi*/** **/i18n/it*/** **/i18n/ja*/** **/i18n/ko*/** **/i18n/nl*/**
**/i18n/pl*/** **/i18n/pt*/** **/i18n/ru*/** **/i18n/sv*/** **/i18n/th*/** **/i18n/tr*/** **/i18n/vi*/** **/i18n/zh*/**
**/zh-cn/** **/zh-hk/** **/zh-mo/** **/zh-sg/** **/zh-tw/**
""".split()


def pattern_passes(url: Column, pattern: str) -> Column:
    """/literal/ is a part of the URL, /regex/ (with a sign that literals lack) is searched, all else is a glob; tried on the
    URL, its path, the path without its slash, and the path with its query."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    ask = F.try_parse_url(url, F.lit("QUERY"))
    tried = F.array(url, path, F.regexp_replace(path, "^/+", ""), F.concat(path, F.coalesce(F.concat(F.lit("?"), ask), F.lit(""))))
    p = pattern.strip()
    if not p:
        return F.lit(False)
    if len(p) > 1 and p[0] == p[-1] == "/":
        if re.fullmatch(r"[\w./~%$()+-]*", p[1:-1]):
            return F.exists(tried, lambda t: F.contains(t, F.lit(p)))
        try:
            re.compile(p[1:-1])
        except re.error:
            return F.lit(False)
        return F.exists(tried, lambda t: t.rlike(p[1:-1]))
    glob = fnmatch.translate(p).replace("\\Z", "\\z").replace("(?s:", "(?s:")
    return F.exists(tried, lambda t: t.rlike("^" + glob))


def url_passes(url: Column, include: list[str], exclude: list[str]) -> Column:
    """Matched by any include, if there are any, and by no exclude."""
    some = F.lit(not [p for p in include if p.strip()])
    for p in include:
        some = some | pattern_passes(url, p)
    for p in exclude:
        some = some & ~pattern_passes(url, p)
    return some


def in_scope(url: Column, start: str, scope: str = "host") -> Column:
    """Whether a crawl that began at start may go to a URL: subpages (below start), host (the same), or domain (its last two labels)."""
    if scope == "subpages":
        return F.coalesce(F.startswith(url, F.lit(start.rstrip("/"))), F.lit(False))
    if scope not in ("host", "domain"):
        raise ValueError(f"not a scope: {scope}")
    own = (lambda u: F.lower(F.try_parse_url(u, F.lit("HOST")))) if scope == "host" else (lambda u: F.lower(T.root_domain(u)))
    return F.coalesce(own(url) == own(F.lit(start)), F.lit(False))


def page_links(pages: DataFrame, *also: str) -> DataFrame:
    """url, link: the distinct targets of a page's anchors as absolute http URLs without fragments, as far as they are written in its html.

    also: columns that stay with the links, such as a page's id: several pages may have one URL, each with links of its own.
    """
    url, href = F.col("url"), F.col("_href")
    site = F.regexp_extract(url, r"^(?i:https?)://[^/?#]+", 0)
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?<=[^/]/)(?!/)[^/]*$", "")
    link = (
        F.when(href.rlike("^(?i:https?)://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, "^[^:]+:", 0), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(url, r"[?#].*$", ""), href))
        .when(~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), F.regexp_replace(href, r"^(\./)+", "")))
    )
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'#>]+)"), F.lit(1))
    rows = pages.filter(site != "").select(*also, "url", F.explode(F.array_distinct(hrefs)).alias("_href")).withColumn("_href", F.trim(F.replace(href, F.lit("&amp;"), F.lit("&"))))
    return rows.filter(href != "").select(*also, "url", link.alias("link")).filter(F.col("link").isNotNull()).distinct()


def frontier(links: DataFrame, start: str, max_depth: int, max_pages: int) -> DataFrame:
    """url, depth: pages by breadth-first search over (url, link), at most max_depth steps away, the first max_pages by depth and URL.

    A step joins the last step's pages with the links and is written into a partition of its own, in the folder that all executors
    share; what was seen is a scan of these. So plans don't grow with the depth, a lost executor costs one step's tasks, and the
    search ends with the first step that finds nothing or fills the cap. links: a table, since each step reads it.
    """
    spark, folder = links.sparkSession, K.kept_folder(links.sparkSession)
    pages = lambda: spark.read.schema("url string, depth int").parquet(folder)
    step, room = spark.createDataFrame([(start,)], "url string"), max_pages
    for depth in range(max_depth + 1):
        if room <= 0:
            break
        if depth:
            last = pages().filter(F.col("depth") == depth - 1)
            found = links.join(last.select("url"), "url", "left_semi").filter(F.col("link").isNotNull()).select(F.col("link").alias("url")).distinct()
            step = found.join(pages().select("url"), "url", "left_anti")
        step.write.parquet(f"{folder}/depth={depth}")
        n = spark.read.schema("url string").parquet(f"{folder}/depth={depth}").count()
        if n > room:  # the last step: its first URLs only
            spark.read.schema("url string").parquet(f"{folder}/depth={depth}").orderBy("url").limit(room).write.parquet(f"{folder}-last/depth={depth}")
            whole = pages().filter(F.col("depth") < depth)
            return whole.union(spark.read.schema("url string, depth int").parquet(f"{folder}-last")).orderBy("depth", "url")
        room -= n
        if not n:
            break
    return pages().orderBy("depth", "url") if max_pages > 0 else spark.createDataFrame([], "url string, depth int")


def crawled(pages: DataFrame, start: str, max_depth: int, max_pages: int, scope: str = "host", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The captured pages (page_id, url, html) that a crawl from start reaches, with their depth: over links in scope that pass the
    patterns, as far as there are pages."""
    newest = latest_captures(pages)
    fit = lambda c: in_scope(c, start, scope) & url_passes(c, include or [], exclude or [])
    there = newest.select(F.col("url").alias("link"))
    links = K.kept(page_links(newest).filter(fit(F.col("link"))).join(there, "link", "left_semi").select("url", "link"))
    return newest.join(frontier(links, start, max_depth, max_pages), "url")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in BLOCKS:
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in BLOCKS and tag != "li":
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(page: str | None) -> str:
    """A page's main part (main, else article, else all) as Markdown: headings, bullets, fences, links, emphasis."""
    page = page or ""
    for tag in ("main", "article"):
        if m := re.search(rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\Z)", page):
            page = m[1]
            break
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    rows = [r.strip() if not r.startswith(("    ", "\t")) else r.rstrip() for r in "".join(parser.out).splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()


def markdown(html: Column) -> Column:
    """Column form of to_markdown, over Arrow batches."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(to_markdown)

    return convert(html)


def extracted(markdown_of: Column) -> Column:
    """The content of a page whose main part is this Markdown: its blocks that aren't menus if they are substantial, else all."""
    return T.let(markdown_of, lambda md: T.let(T.without_link_blocks(md), lambda own: F.when(T.substantial(own), own).otherwise(md)))


def chosen(pages: DataFrame, extract: Callable[[Column], Column] | None = None) -> DataFrame:
    """pages with choice and content: of the texts fit, cited and raw (columns; blank counts as none) the first, unless two of its lines
    are page furniture; then what is extracted from html, if anything; else that first text, or "" where there is none.

    choice: fit, cited, raw, html, or none. extract: html to Markdown (the default parser if None); it sees null for the pages that are
    decided, so only the others are parsed, in one pass over the pages. Columns of the names _first, _which and _own are taken.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    names = ("fit", "cited", "raw")
    told = pages.withColumns({"_first": F.coalesce(*map(blank, names)), "_which": F.coalesce(*(F.when(blank(n).isNotNull(), n) for n in names))})
    own = F.coalesce(F.col("_first").isNotNull() & ~T.web_chrome(F.col("_first")), F.lit(False))
    needed = told.withColumn("_own", F.when(~own, F.col("html")))
    parsed = needed.withColumn("_own", blank((extract or markdown)(F.col("_own"))))
    parsed = parsed.withColumn("_own", extracted(F.col("_own")))
    choice = F.when(F.col("_own").isNotNull(), "html").otherwise(F.coalesce("_which", F.lit("none")))
    return parsed.withColumns({"choice": choice, "content": F.coalesce("_own", "_first", F.lit(""))}).drop("_first", "_which", "_own")


def markdown_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, content of the pages that have text: Markdown without menus and page furniture; what isn't HTML is only cleaned."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([to_markdown(h) if is_html else h or "" for h, is_html in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.string())], ["page_id", "url", "content"])

    kinds = dict(pages.dtypes)
    d = pages.select("page_id", "url", "html", T.looks_like_html(F.col("html")).alias("is_html")).mapInArrow(apply, f"page_id {kinds['page_id']}, url {kinds['url']}, content string")
    d = d.withColumn("content", T.clean_web(extracted(F.col("content")))).filter(F.col("content") != "")
    return d.select("page_id", "url", F.coalesce(T.title(F.col("content")), T.web_title(F.col("url"))).alias("title"), "content")


def latest_captures(pages: DataFrame) -> DataFrame:
    """One capture of each URL, that of the highest page_id."""
    return pages.withColumn("_r", F.row_number().over(W.partitionBy("url").orderBy(F.desc("page_id")))).filter(F.col("_r") == 1).drop("_r")
