"""Links of web pages (SRC7).

Everything about a page is in its row: links are found, made absolute and made
unique with array functions, so there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _unescaped(value: Column) -> Column:
    for entity, character in ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(character))
    return value


def _without_dots(path: Column) -> Column:
    """Path with its '.' and '..' steps resolved."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    last = F.element_at(steps, -1)
    closed = F.when(last.isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    kept = F.aggregate(
        closed,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(step == ".", done)
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute_url(base: Column, href: Column) -> Column:
    """A reference of a page as an absolute URL (RFC 3986, hierarchical URLs)."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+:)", 1)
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    document = F.regexp_extract(base, r"^([^?#]*)", 1)
    without_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(document, r"^[^:/?#]+://[^/]*(/.*)$", 1), r"^(.*/)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    from_folder = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(without_fragment, href))
        .when(href.startswith("?"), F.concat(document, href))
        .when(href.startswith("/"), F.concat(site, _without_dots(path), rest))
        .otherwise(F.concat(site, _without_dots(from_folder), rest))
    )


def extract_links(pages: DataFrame, suffix: str = ".zip", page_id: str = "page_id") -> DataFrame:
    """SRC7: unique absolute links per page in order of first appearance.

    Keeps the links whose text ends with ``suffix`` in any letter case. Columns:
    the page id, ``position`` from 0 and ``link``.
    """
    quoted = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    texts = F.transform(quoted, lambda q: _unescaped(F.regexp_replace(q, r"""^["']|["']$""", "")))
    wanted = F.filter(texts, lambda t: (t != "") & F.lower(t).endswith(suffix.lower()))
    links = F.array_distinct(F.transform(wanted, lambda t: absolute_url(F.col("url"), t)))
    return pages.select(page_id, F.posexplode(links).alias("position", "link"))
