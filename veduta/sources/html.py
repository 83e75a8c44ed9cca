"""Parts of raw HTML as Column expressions: links, paragraphs, titles, dates and discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.functions.urls import canonical_url, country_of, country_of_language, resolved, url_host

_LINK = r"(?s)<a\s[^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>"
#: The entities that plain text needs.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def plain(c: Column) -> Column:
    """Markup dropped, common entities decoded, white space squeezed."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def escaped(c: Column) -> Column:
    """Text as markup: the characters that markup uses are written as entities."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def links(html: Column) -> Column:
    """array<struct<href, title>> of a page's anchors in order."""
    return F.transform(
        F.arrays_zip(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)).alias("h"), F.regexp_extract_all(html, F.lit(_LINK), F.lit(2)).alias("t")),
        lambda x: F.struct(x["h"].alias("href"), plain(x["t"]).alias("title")),
    )


def absolute(base: Column, href: Column) -> Column:
    """A root-relative link under the page's origin; absolute links stay; others give null."""
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    return F.when(href.rlike(r"(?i)^https?://"), href).when(href.startswith("/") & (origin != ""), F.concat(origin, href))


def paragraphs(html: Column, least: int = 50) -> Column:
    """Distinct paragraphs of ``least`` characters or more, first appearance first."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, plain), lambda p: F.length(p) >= least))


def titles(html: Column, most: int = 180) -> Column:
    """Distinct headings h1 to h4 of fewer than ``most`` characters, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<h[1-4][^>]*>(.*?)</h[1-4]>"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, plain), lambda t: (t != "") & (F.length(t) < most)))


def date_tokens(html: Column) -> Column:
    """Distinct date-like tokens."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"), F.lit(0)))


def source_kind(html: Column) -> Column:
    """``rss`` for a feed, ``alternate`` for a page that links one, else ``website``."""
    return F.when(html.rlike(r"(?is)^\s*(?:<\?xml[^>]*>\s*)?<(?:rss|feed)\b"), "rss").when(html.rlike(r"(?i)application/(?:rss|atom)\+xml"), "alternate").otherwise("website")


def page_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang=\"([A-Za-z]{2})", 1))


def heading_links(pages: DataFrame, page: str, url: str, html: str, seen: DataFrame, least: int = 12) -> DataFrame:
    """page, link, title of the anchors in headings of level 1 to 3: canonical links to the page's own host,
    with titles of ``least`` characters, that ``seen`` (column link) lacks and that are no listings by
    author, tag, category or page. Of equal links on a page the first counts."""
    headings = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<h([1-3])[^>]*>(.*?)</h\1>"), F.lit(2))
    rows = pages.select(page, url, F.posexplode(F.flatten(F.transform(headings, links))).alias("_n", "_l"))
    titled = rows.select(page, url, "_n", F.col("_l.href").alias("_href"), F.col("_l.title").alias("title")).where(F.length("title") >= least)
    # one element each: what is behind an explode is worked out once, not again in every condition on it
    whole = titled.select(page, url, "_n", "title", F.explode(F.array(resolved(F.col(url), F.col("_href")))).alias("_whole"))
    found = whole.select(page, url, "_n", "title", F.explode(F.array(canonical_url(F.col("_whole")))).alias("link"))
    own = found.where((url_host(F.col("link")) == url_host(F.col(url))) & ~F.lower("link").rlike("/(author|tag|category|page)/"))
    first = own.groupBy(page, "link").agg(F.min_by("title", "_n").alias("title"))
    return first.join(seen.select("link").distinct(), "link", "left_anti").select(page, "link", "title")


def discovered(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """page, source_url, kind, country: a feed document is ``rss``, and so is a page that names one, whose
    url then counts; any other page is a ``website``. The country is told by the url's domain, or else by
    the page's language."""
    c, own = F.col(html), canonical_url(F.col(url))
    sample = F.lower(F.substring(html, 1, 800))
    feed = sample.contains("<rss") | sample.contains("<feed")
    link = F.regexp_extract(c, r'(?i)<link[^>]*rel="alternate"[^>]*type="application/(?:rss|atom)\+xml"[^>]*href="([^"]*)"', 1)
    named = F.when(~feed & (link != ""), canonical_url(resolved(F.col(url), link)))
    by_domain = country_of(F.col(url))
    language = F.regexp_extract(c, r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    country = F.when(by_domain != "other", by_domain).otherwise(country_of_language(language))
    kind = F.when(feed | named.isNotNull(), "rss").otherwise("website")
    return pages.select(page, F.coalesce(named, own).alias("source_url"), kind.alias("kind"), country.alias("country"))
