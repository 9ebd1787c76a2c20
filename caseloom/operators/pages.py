"""Web pages: visible text, links, joined addresses, and which pages to read next.

Tags are found by one pattern per page; which text is furniture follows from the
depth of skipped elements, a running sum over the tags. Pages come in Arrow
batches. Everything about addresses stays in the JVM but the joining itself.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import text as X

# Elements whose content is no prose, and elements that begin a new line.
SKIPPED = frozenset("script style noscript template head nav header footer aside svg".split())
BLOCKS = frozenset("p div section article main li ul ol table tr br h1 h2 h3 h4 h5 h6 blockquote".split())
# What the path of a page about the company contains.
ABOUT_PATHS = ("about", "company", "team")

#: Comments and declarations; scripts and styles as a whole; tags with their name and attributes.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S | re.I
)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def visible_text(page: str | None) -> str | None:
    """The prose of a page: skipped elements left out, a line per block, blanks collapsed, no blank lines; null for null.

    An element that is skipped and never closed hides the rest of the page.
    """
    if page is None:
        return None
    out, depth, at = [], 0, 0
    for tag in _TAG.finditer(page):
        between = page[at : tag.start()]
        if depth == 0 and between.strip():
            out.append(html.unescape(between))
        at = tag.end()
        name = (tag[3] or "").lower()
        if name in SKIPPED:
            depth = max(depth - 1, 0) if tag[2] else depth + 1
        elif name in BLOCKS and depth == 0:
            out.append("\n")
    if depth == 0 and page[at:].strip():
        out.append(html.unescape(page[at:]))
    lines = (" ".join(line.split()) for line in "".join(out).splitlines())
    return "\n".join(line for line in lines if line)


def anchor_links(page: str | None) -> list[str]:
    """Every link of a page's anchors in order, furniture included; empty ones left out, character references resolved."""
    out = []
    for tag in _TAG.finditer(page or ""):
        if not tag[2] and (tag[3] or "").lower() == "a":
            found = _HREF.search(tag[4])
            link = html.unescape(next((g for g in found.groups() if g is not None), "")) if found else ""
            if link:
                out.append(link)
    return out


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(pages: pd.Series) -> pd.Series:
    return pages.map(anchor_links)


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as seen from its page; null where either is null or the link can't be read."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x.strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def linked_pages(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(key, url, body) -> (key, pos, href, target): every anchor's link, joined to its page's address."""
    links = pages.select(key, url, F.posexplode(page_links(body)).alias("pos", "href"))
    return links.select(key, F.col("pos").cast("bigint").alias("pos"), "href", join_url(url, "href").alias("target"))


def about_pages(links: DataFrame, key: str, entry: str, target: str, order: str) -> DataFrame:
    """(key, entry address, absolute target, order) -> (key, url): pages about the company, each path once, in order of first mention.

    Of the entry's own host, by http or https; query and fragment are dropped;
    the entry's own path is no other page.
    """
    path = X.url_path(F.col(target))
    scheme = F.lower(F.regexp_extract(F.trim(target), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    told = F.lit(False)
    for token in ABOUT_PATHS:
        told = told | F.lower(path).contains(token)
    own = links.where(
        scheme.isin("http", "https") & (F.lower(X.authority(F.col(target))) == F.lower(X.authority(F.col(entry)))) & (path != X.url_path(F.col(entry))) & told
    )
    first = Window.partitionBy(key, "path").orderBy(order)
    named = own.select(key, order, path.alias("path"), F.concat(scheme, F.lit("://"), X.authority(F.col(target)), path).alias("url"))
    return named.withColumn("k", F.row_number().over(first)).where("k = 1").select(key, "url")


def clean_lines(c: Column) -> Column:
    """Every line's blanks collapsed, blank lines dropped."""
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), X.collapse_space)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
