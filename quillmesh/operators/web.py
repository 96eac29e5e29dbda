"""Operators on crawled pages: links, main content, crawling over a link table."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.functions import urls
from quillmesh.functions.html import START, Page
from quillmesh.operators.relational import running_total

# Elements that hold no content.
CRUFT_TAGS = ["script", "style", "nav", "footer", "svg"]
CRUFT_CLASSES = [
    "toctree-wrapper", "related", "sphinxsidebar", "footer", "edit-this-page", "md-source-file", "prev-next-area", "prev-next-bottom", "prev-next-top", "bd-toc",
    "bd-sidebar-secondary", "feedback-widget", "pagination-links", "footer-version", "try_examples_button_container", "try_examples_outer_iframe", "sidemenu", "banner", "sr-only",
]
CRUFT_IDS = ["indices-and-tables", "search", "footerDisclaimer"]
CRUFT_HEADINGS = ["copyright", "copyrights", "license", "licenses"]
PAGER_WORDS = ["prev", "previous", "next"]

# Where each kind of documentation site keeps its main content: tag and attributes; of several classes one is enough.
SELECTORS: dict[str, tuple[str, dict[str, str | tuple[str, ...]]]] = {
    "huggingface": ("div", {"class": "prose-doc prose relative mx-auto max-w-4xl break-words"}),
    "readthedocs": ("div", {"class": "rst-content"}),
    "pytorch": ("article", {"id": "pytorch-article"}),
    "tiledb": ("main", {"id": "content"}),
    "furo": ("article", {"id": "furo-main-content"}),
    "pydata": ("article", {"class": "bd-article"}),
    "fastcore": ("main", {"id": "quarto-document-content", "class": "content"}),
    "rtd": ("div", {"itemprop": "articleBody"}),
    "body_role_main": ("div", {"class": "body", "role": "main"}),
    "md_typeset": ("article", {"class": "md-content__inner md-typeset"}),
    "div_document": ("div", {"class": "document"}),
    "main_main_content": ("main", {"id": "main-content", "role": "main"}),
    "div_main_content": ("div", {"id": "main-content", "role": "main"}),
    "main": ("main", {}),
    "theme_doc_markdown": ("div", {"class": ("theme-doc-markdown", "markdown")}),
    "div_content": ("div", {"id": "content"}),
    "docs_body": ("div", {"id": "docs-body"}),
    "td_content": ("div", {"class": "td-content"}),
    "body": ("body", {}),
    "article_role_main": ("article", {"role": "main"}),
    "article_main_content": ("article", {"class": "main_content__8zFCH"}),
    "article_container": ("div", {"class": "article-container"}),
}

_HEADINGS = {f"h{k}" for k in range(1, 7)}


def cruft(page: Page, start: int, end: int) -> set[int]:
    """Where elements without content start in a range: by tag, id or class, sections about rights, paragraphs that only turn pages."""
    tags, ids, classes = set(CRUFT_TAGS), set(CRUFT_IDS), set(CRUFT_CLASSES)
    dropped: set[int] = set()
    headings = [i for i in range(start, end) if page.kinds[i] == START and page.values[i] in _HEADINGS]
    next_heading, i = 0, start
    while i < end:
        if page.kinds[i] == START:
            own, tag = page.attributes[i], page.values[i]
            while next_heading < len(headings) and headings[next_heading] <= i:
                next_heading += 1
            title = headings[next_heading] if next_heading < len(headings) else end
            if (
                tag in tags
                or own.get("id") in ids
                or not classes.isdisjoint(own.get("class", "").split())
                or tag == "section" and title < page.ends[i] and "".join(page.texts(title, page.ends[title])).strip().lower() in CRUFT_HEADINGS
                or tag == "p" and _turns_pages(page, i)
            ):
                dropped.add(i)
                i = page.ends[i]
                continue
        i += 1
    return dropped


def _turns_pages(page: Page, at: int) -> bool:
    """Whether a paragraph holds nothing but links named after the page before or after."""
    words: list[str] = []
    i, end = at + 1, page.ends[at]
    while i < end:
        if page.kinds[i] == START:
            if page.values[i] != "a":
                return False
            words += "".join(page.texts(i, page.ends[i])).lower().split()
        elif page.values[i].strip():
            return False
        if words and words[-1] not in PAGER_WORDS:
            return False
        i = page.ends[i]
    return bool(words) and set(words) <= set(PAGER_WORDS)


_NOTHING = "<html><body></body></html>"


def read_page(source: str | None, selector: str | None) -> tuple[str | None, str | None]:
    """(main content, visible text) of a page from one parse."""
    if source is None:
        return None, None
    page = Page(source)
    whole = len(page.kinds)
    text = " ".join(" ".join(page.texts(dropped=cruft(page, 0, whole))).split())
    if not selector:
        return source, text
    found = page.find(*SELECTORS[selector])
    if found is None:
        return _NOTHING, text
    inside = cruft(page, found + 1, page.ends[found])
    return f"<html><body>{page.serialize(found, page.ends[found], inside)}</body></html>", text


def main_content_of(page: str | None, selector: str | None) -> str | None:
    """The main element without cruft; an empty page if the selector misses; the page itself without a selector."""
    return read_page(page, selector)[0]


def visible_text_of(page: str | None) -> str | None:
    """Text of a page: scripts and other cruft dropped, entities resolved, blanks collapsed."""
    return read_page(page, None)[1]


def content_and_text(page: Column, selector: str | None) -> Column:
    """STRUCT<content, text>: main content and visible text of a page, parsed once. Pages of any depth are read."""
    kind = StructType([StructField("content", StringType()), StructField("text", StringType())])

    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(p, selector) for p in pages], columns=["content", "text"])

    read.__annotations__ = {"pages": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, kind)(page)


class SiteRegistry:
    """Documentation sites and where their main content is: (host, path prefix) -> selector. A site of a longer path wins."""

    def __init__(self) -> None:
        self._sites: dict[tuple[str, str], str] = {}

    def register(self, url: str, selector: str) -> None:
        """Pages at or below ``url`` are read with a selector of ``SELECTORS``; an unknown selector is an error."""
        if selector not in SELECTORS:
            raise KeyError(selector)
        host, _, path = url.partition("://")[2].partition("/")
        self._sites[host.removeprefix("www."), "/" + path.rstrip("/") if path.rstrip("/") else ""] = selector

    def selector(self, url: Column) -> Column:
        """The selector of a page's site; null for pages of no registered site."""
        host, path, found = urls.bare_host(url), urls.path(url), F.lit(None).cast("string")
        for (site, prefix), name in sorted(self._sites.items(), key=lambda item: len(item[0][1])):
            found = F.when((host == site) & urls.path_within(path, F.lit(prefix)), name).otherwise(found)
        return found


def content_by_site(pages: DataFrame, registry: SiteRegistry, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` plus ``content``: the main content by the selector of each page's site, the whole page where no site is registered."""
    read = F.pandas_udf(lambda pages, names: pd.Series([main_content_of(p, n) for p, n in zip(pages, names)]), StringType())
    return pages.withColumn("content", read(F.col(html_col), registry.selector(F.col(url_col))))


def main_content(page: Column, selector: str | None) -> Column:
    return content_and_text(page, selector).content


def visible_text(page: Column) -> Column:
    return content_and_text(page, None).text


def strip_tag_blocks(page: Column) -> Column:
    """The native form of cruft removal: whole script, style, nav, footer and svg blocks, and comments."""
    return F.regexp_replace(page, r"(?is)<(script|style|nav|footer|svg)\b.*?</(script|style|nav|footer|svg)>|<!--.*?-->", "")


def tags_to_text(page: Column) -> Column:
    """Native text of a page: cruft blocks out, tags to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(strip_tag_blocks(page), r"<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html", base_path: str = "") -> DataFrame:
    """(url, link): the distinct valid links of every page, canonical. Null pages have none."""
    found = pages.select(F.col(url_col).alias("url"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), 1))).alias("href"))
    full = found.select("url", urls.canonical(urls.absolute(F.col("url"), F.col("href"))).alias("link"))
    return full.where(urls.is_valid(F.col("link"), urls.host(F.col("url")), F.lit(base_path))).distinct()


def frontier(link_table: DataFrame, visited: DataFrame) -> DataFrame:
    """(link): links not visited yet."""
    return link_table.select("link").distinct().join(visited.select(F.col("url").alias("link")), "link", "left_anti")


def crawl(link_table: DataFrame, seeds: DataFrame, checkpoint, rounds: int | None = None, limit: int | None = None) -> DataFrame:
    """(url, depth): breadth-first over a table of links (url, link), seeds at depth 0, until no new page appears.

    ``rounds`` asks for the pages of that depth at most. Each round joins the new pages only and cuts its lineage with ``checkpoint``.
    ``limit`` ends the crawl once so many pages are visited, as a crawler's page limit.
    """
    visited = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    new = visited
    for depth in itertools.count(1) if rounds is None else range(1, rounds + 1):
        reached = new.join(link_table, "url").select(F.col("link").alias("url")).distinct()
        new = checkpoint(reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        visited = checkpoint(visited.unionAll(new))
        if limit is not None and visited.count() >= limit:
            return visited.orderBy("depth", "url").limit(limit)
    return visited


def unsaved(queue: DataFrame, saved: DataFrame) -> DataFrame:
    """The pages of a queue (url) whose file isn't saved yet (file_name)."""
    named = queue.withColumn("file_name", urls.file_name(F.col("url")))
    return named.join(saved.select("file_name").distinct(), "file_name", "left_anti")


def after_tries(responses: DataFrame, tries: int = 3) -> DataFrame:
    """(url, status, attempts, failed): what became of each page after at most ``tries`` requests. Expects url, attempt (from 1) and status.

    The first 200 among the first ``tries`` counts; without one the page is failed
    with its last status: the log of failed pages.
    """
    within = responses.where(F.col("attempt") <= tries)
    good = F.when(F.col("status") == 200, F.col("attempt"))
    done = within.groupBy("url").agg(F.min(good).alias("_first"), F.max("attempt").alias("_last"), F.max_by("status", "attempt").alias("_status"))
    return done.select("url", F.when(F.col("_first").isNotNull(), 200).otherwise(F.col("_status")).alias("status"), F.coalesce("_first", "_last").alias("attempts"), F.col("_first").isNull().alias("failed"))


def links_beside(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file_name, links): what is kept beside each saved page, its valid links sorted and one a line; pages without links have an empty text."""
    found = links(pages, url_col, html_col).groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("link")), "\n").alias("links"))
    named = pages.select(F.col(url_col).alias("url")).distinct().join(found, "url", "left")
    by_file = named.groupBy(urls.file_name(F.col("url")).alias("file_name")).agg(F.min_by(F.struct(F.coalesce("links", F.lit("")).alias("links")), "url").alias("p"))
    return by_file.select("file_name", "p.links")


def resume_queue(saved_links: DataFrame, failed: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url): what a resumed crawl starts from."""
    return saved_links.select(F.col("link").alias("url")).unionAll(failed.select("url")).unionAll(seeds.select("url")).distinct()


def merge_seeds(first: DataFrame, second: DataFrame, width: int = 100_000) -> DataFrame:
    """(url, position): both lists in their order, each URL once, numbered from 1. Both have url and position, which need not be unique.

    Positions are counted slice by slice of ``width``; no task holds a whole list.
    """
    both = first.select("url", F.lit(0).alias("_list"), "position").unionAll(second.select("url", F.lit(1).alias("_list"), "position"))
    once = both.groupBy("url").agg(F.min(F.struct("_list", "position")).alias("_at")).withColumn("_all", F.lit(0))
    by = F.struct(F.col("_at._list"), F.floor(F.col("_at.position") / width))
    return running_total(once, ["_all"], ["_at", "url"], by, F.lit(1), "position").select("url", F.col("position").cast("int").alias("position"))


def seeds_of_index(text: Column, host: str, prefix: str = "") -> Column:
    """Markdown links of an index file, one per line, that lead to the same host below a prefix; without .md."""
    per_line = F.transform(F.split(text, "\n"), lambda line: F.regexp_extract(line, r"\((https?://[^)\s]+)\.md\)", 1))
    return F.filter(per_line, lambda u: (u != "") & (urls.host(u) == host) & F.startswith(urls.path(u), F.lit(prefix)))


def rate_limited(responses: DataFrame, allowed: int = 5, width: int = 100_000) -> DataFrame:
    """(site, stopped_at): where a crawl stops, at the n-th 429 since the last 200. Expects site, seq and status.

    Runs between two 200s are numbered slice by slice of ``width`` sequence numbers;
    of each run only its first ``allowed`` 429s leave a task. Other statuses are
    dropped before anything is shuffled.
    """
    counted = responses.where(F.col("status").isin(200, 429)).select("site", "seq", "status")
    run = running_total(counted, ["site"], ["seq"], F.floor(F.col("seq") / width), F.when(F.col("status") == 200, 1).otherwise(0), "_run")
    nth = F.row_number().over(Window.partitionBy("site", "_run").orderBy("seq"))
    stops = run.where("status = 429").withColumn("_n", nth).where(F.col("_n") <= allowed).where(F.col("_n") == allowed)
    return stops.groupBy("site").agg(F.min("seq").alias("stopped_at"))


def with_source_link(page: Column, url: Column) -> Column:
    """A page with a link to its source first in the body."""
    link = F.concat(F.lit('<body$1><a href="'), url, F.lit('">Original Source</a>'))
    return F.regexp_replace(page, F.lit(r"(?i)<body([^>]*)>"), link)


def saved_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(file_name, url, html): one page per file name, the least URL; with the source link."""
    named = pages.select(urls.file_name(F.col(url_col)).alias("file_name"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    first = named.groupBy("file_name").agg(F.min_by(F.struct("url", "html"), "url").alias("p")).select("file_name", "p.url", "p.html")
    return first.withColumn("html", with_source_link(F.col("html"), F.col("url")))


def save_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Append the pages that aren't saved yet to the table (file_name, url, html, links) in ``folder``; returns the table.

    A page is one row, written once whatever the number of runs; its links are what is kept beside it.
    """
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    kept = saved_pages(pages).join(links_beside(pages), "file_name")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        kept = kept.join(spark.read.parquet(folder).select("file_name"), "file_name", "left_anti")
    kept.select("file_name", "url", "html", "links").write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
