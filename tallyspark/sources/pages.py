"""Links, stubs and assets of listing and article pages.

A page is parsed once, by the standard library's parser in mapInPandas, into one row per element of interest; which
elements make a release stub or an asset is then decided by DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ascii_lower, blog_date, normalize_text, text_date

ELEMENT = "page_id long, ordinal int, tag string, href string, text string, css string"
#: Elements whose text is kept.
TEXT_TAGS = frozenset("title h1 h2 h3 h4 a time p span li iframe".split())


class _Elements(HTMLParser):
    """Collects elements with their link, class and inner text, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int]] = []
        self.skip = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip = tag
        if tag not in TEXT_TAGS:
            return
        named = dict(attrs)
        self.rows.append([tag, named.get("href") or named.get("data-src") or named.get("src"), [], named.get("class") or named.get("title")])
        if tag != "iframe":
            self.open.append((tag, len(self.rows) - 1))

    def handle_endtag(self, tag: str) -> None:
        if tag == self.skip:
            self.skip = ""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            for _, i in self.open:
                self.rows[i][2].append(data)


def parse_elements(html: str) -> list[tuple]:
    """ordinal, tag, href, text and css of a page's elements."""
    parser = _Elements()
    parser.feed(html)
    parser.close()
    return [(i, tag, href, " ".join("".join(text).split()), css) for i, (tag, href, text, css) in enumerate(parser.rows)]


def elements(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, tag, href, text and css of the elements of each page (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                rows += [(page_id, *found) for found in parse_elements(html or "")]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "tag", "href", "text", "css"])

    return pages.select("page_id", "html").mapInPandas(run, ELEMENT)


def absolute_url(href: Column, base: str) -> Column:
    """Relative links on the base host."""
    return F.when(href.startswith("http://") | href.startswith("https://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(base), href)).otherwise(F.concat(F.lit(base + "/"), href))


def clean_url(url: Column) -> Column:
    """Up to the first "#" or "?"."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def strip_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def is_article_url(url: Column, host: str, needed: str, barred: tuple[str, ...] = ()) -> Column:
    """Links of a host whose path holds what articles hold and nothing that others do."""
    out = url_host(ascii_lower(url)).endswith(host) & url.contains(needed)
    for b in barred:
        out = out & ~url.contains(b)
    return out


def is_crosstab_pdf(url: Column) -> Column:
    return clean_url(ascii_lower(url)).endswith(".pdf") & ascii_lower(url).contains("econtabreport")


def dataset_url(url: Column) -> Column:
    """CSV of a chart frame."""
    return F.concat(strip_slash(clean_url(url)), F.lit("/dataset.csv"))


def sheet_id(url: Column) -> Column:
    """Id in a sheet's link; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"/spreadsheets/d/([^/?#]+)", 1), F.lit(""))


def release_stubs(found: DataFrame, base: str, needed: str = "") -> DataFrame:
    """page_id, ordinal, title, article_url and published_on: for each heading the first link and date before the next.

    A heading without title, link or date gives nothing.
    """
    heading = F.col("tag").isin("h2", "h3")
    block = Window.partitionBy("page_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.withColumn("block", F.sum(heading.cast("int")).over(block)).where("block > 0")
    link = F.when((F.col("tag") == "a") & F.col("href").contains(needed), absolute_url(F.col("href"), base))
    date = F.coalesce(text_date(F.col("text")), blog_date(F.col("text")))
    first = marked.groupBy("page_id", "block").agg(
        F.min("ordinal").alias("ordinal"), F.min_by(F.when(heading, normalize_text(F.col("text"))), F.when(heading, F.col("ordinal"))).alias("title"), F.min_by(link, F.when(link.isNotNull(), F.col("ordinal"))).alias("article_url"), F.min_by(date, F.when(date.isNotNull(), F.col("ordinal"))).alias("published_on")
    )
    return first.where("title <> '' and article_url is not null and published_on is not null").drop("block")


def page_assets(found: DataFrame, base: str) -> DataFrame:
    """page_id, kind, ordinal, title and url: the first PDF link, every chart frame, and sheets."""
    link = F.col("tag").isin("a", "iframe") & F.col("href").isNotNull()
    url = absolute_url(F.col("href"), base)
    kind = F.when((F.col("tag") == "a") & clean_url(ascii_lower(F.col("href"))).endswith(".pdf"), "pdf").when((F.col("tag") == "iframe") & F.col("href").contains("datawrapper"), "chart").when(sheet_id(F.col("href")).isNotNull(), "sheet")
    named = found.where(link).select("page_id", kind.alias("kind"), "ordinal", F.when(kind == "chart", F.coalesce(F.nullif(F.col("css"), F.lit("")), F.lit("Gallup chart"))).otherwise(F.col("text")).alias("title"), F.when(kind == "pdf", clean_url(url)).when(kind == "chart", dataset_url(url)).otherwise(url).alias("url")).where("kind is not null")
    first = Window.partitionBy("page_id", "kind").orderBy("ordinal")
    return named.withColumn("_k", F.row_number().over(first)).where("kind = 'chart' or _k = 1").drop("_k")
