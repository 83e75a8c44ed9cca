"""Queries over the nodes of real pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.plans.registry import query
from veduta.sources import dom

#: Pages in which code and comments are blanked, as regular expressions see them.
_CODE_FREE = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g')"
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(
    "element_counts",
    rf"""
    WITH e AS (SELECT page_id, lower(unnest(regexp_extract_all({_CODE_FREE}, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS elements FROM e GROUP BY page_id, tag""",
)
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every page by tag."""
    nodes = dom.nodes(binding.pages(spark, sf_dir), "page_id", "html").where("tag not like '#%'")
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


@query(
    "menu_links",
    rf"""
    WITH m AS (SELECT page_id, regexp_extract_all({_CODE_FREE}, '(?s)<nav[^>]*>(.*?)</nav>', 1) AS navs FROM pages),
    n AS (SELECT page_id, unnest(navs) AS nav FROM m),
    i AS (SELECT page_id, unnest(regexp_extract_all(nav, '(?s)<li[^>]*>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(nav, '(?s)<li[^>]*>(.*?)</li>', 1), 1) AS child FROM n)
    SELECT page_id, child::INTEGER AS child, regexp_extract(item, 'href="([^"]*)"', 1) AS href, {_TEXT.format(x='item')} AS title FROM i""",
)
def menu_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside menus with their item's number in its list: joins of anchors, items and menus."""
    nodes = dom.nodes(binding.pages(spark, sf_dir), "page_id", "html")
    items = dom.within(dom.numbered_children(nodes.where("tag = 'li'"), "page_id"), nodes.where("tag = 'nav'"), "page_id").drop("outer")
    anchors = dom.within(nodes.where("tag = 'a'"), items, "page_id").select("page_id", "pre", F.col("outer").alias("item"), dom.attribute("href").alias("href"))
    texts = dom.text_of(nodes, anchors, "page_id")
    numbers = items.select("page_id", F.col("pre").alias("item"), "child")
    return anchors.join(numbers, ["page_id", "item"]).join(texts, ["page_id", "pre"]).select("page_id", "child", "href", F.col("text").alias("title"))


@query(
    "paragraphs_outside_boilerplate",
    rf"""
    WITH c AS (SELECT page_id, regexp_replace({_CODE_FREE}, '(?is)<(?:nav|footer|header|aside|form)[^>]*>.*?</(?:nav|footer|header|aside|form)>', ' ', 'g') AS h FROM pages),
    s AS (SELECT page_id, unnest(string_split_regex(h, '<p(?:\s[^>]*)?>')[2:]) AS piece, generate_subscripts(string_split_regex(h, '<p(?:\s[^>]*)?>')[2:], 1) AS i FROM c),
    t AS (SELECT page_id, i, {_TEXT.format(x="regexp_replace(piece, '(?s)(</p>|</article>|</body>).*$', '')")} AS t FROM s),
    d AS (SELECT page_id, t, min(i) AS i FROM t WHERE length(t) >= 50 GROUP BY page_id, t)
    SELECT page_id, count(*) AS paragraphs, md5(string_agg(t, chr(10) ORDER BY i)) AS body FROM d GROUP BY page_id""",
)
def paragraphs_outside_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paragraphs outside menus, footers and the like, also those that are never closed."""
    found = dom.article_texts(binding.pages(spark, sf_dir), "page_id", "html")
    return found.select("page_id", "paragraphs", F.md5(F.col("body").cast("binary")).alias("body"))


@query(
    "titles_beside_articles",
    rf"""
    SELECT page_id, {_TEXT.format(x="regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title, {_TEXT.format(x="regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
           (length({_CODE_FREE}) - length(replace({_CODE_FREE}, '<p>', ''))) // 3 AS following FROM pages""",
)
def titles_beside_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title, its first heading, and the paragraphs that have the heading's parent."""
    nodes = dom.nodes(binding.pages(spark, sf_dir), "page_id", "html")
    titles = dom.text_of(nodes, nodes.where("tag = 'title'"), "page_id").select("page_id", F.col("text").alias("title"))
    headings = nodes.where("tag = 'h1'")
    following = dom.beside(headings, nodes.where("tag = 'p'"), "page_id", "pre").groupBy("page_id").agg(F.count(F.lit(1)).alias("following"))
    heading = dom.text_of(nodes, headings, "page_id").select("page_id", F.col("text").alias("heading"))
    return titles.join(heading, "page_id").join(following, "page_id")
