"""Small cases of review findings, each of which failed before its change."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.oracle import connect, same
from veduta import plans
from veduta.functions import text
from veduta.operators.dedup import unique_match
from veduta.operators.matching import candidate_names
from veduta.sources import calendar, dom, html


def with_table(spark, sf_dir, folder, name, rows):
    """A folder with one table of its own and links to the others, and its DuckDB connection."""
    from pathlib import Path

    for p in Path(sf_dir).glob("*.parquet"):
        if p.name != f"{name}.parquet":
            (folder / p.name).symlink_to(p)
    rows.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), connect(str(folder))


def test_articles_cut_behind_a_space(spark, sf_dir, tmp_path):
    line = "x" * 19_999 + " " + "y" * 50
    docs = spark.createDataFrame([(1, line), (2, None), (3, "a\x0bb  c\n\na\x0bb c"), (5, line)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    path, con = with_table(spark, sf_dir, tmp_path, "documents", docs)
    same(plans.QUERIES["overridden_articles"](spark, path), con, plans.SQL["overridden_articles"])


def test_number_words_in_a_row(spark):
    rows = spark.createDataFrame([(1, "No no no si"), (2, "op. 9 no 2"), (3, "no"), (4, "no, no")], "i int, v string")
    assert [r[0] for r in rows.orderBy("i").select(text.title_key(F.col("v"))).collect()] == ["no si", "9 2", "", ""]


def test_references_without_semicolon_stay(spark):
    html = "<title>A &amp; b&amp</title><h1 title='x&copy'>c&&&amp</h1><p>d</p><script>a&amp b</script>"
    nodes = dom.nodes(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html")
    found = {r["tag"]: r for r in nodes.collect()}
    assert [r["text"] for r in nodes.where("tag = '#text'").orderBy("pre").collect()] == ["A & b&amp", "c&&&amp", "d"]
    assert found["h1"]["attributes"] == {"title": "x&copy"} and found["#code"]["text"] == "a&amp b"


def test_names_of_one_word_meet_by_the_rest(spark):
    """4,000 misspelt names that share their first word: candidates grow with names, not with their pairs."""
    letters = F.translate((F.col("id") + 100_000).cast("string"), "0123456789", "aeioulnrst")
    right = spark.range(4_000).select(F.concat(F.lit("automobile "), letters).alias("name"))
    left = right.select(F.concat(F.substring("name", 2, 4), F.lit("x"), F.expr("substring(name, 7)")).alias("name"))
    pairs = candidate_names(left, right, "name", 0.86)
    assert pairs.count() < 10 * 4_000
    own = F.concat(F.lit("a"), F.substring("_a", 1, 4), F.lit("o"), F.expr("substring(_a, 6)"))
    assert pairs.where(own == F.col("_b")).count() == 4_000


def test_halves_miss_no_common_subsequence(spark):
    from random import Random

    r = Random(5)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 18))) for _ in range(40)]

    def near(w):
        w = list(w)
        for _ in range(r.randint(0, 4)):
            p = r.randint(0, len(w))
            w[p : p + r.randint(0, 1)] = r.choice(["", "a", "b", "x"])
        return "".join(w)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    left, right = ({near(w) for w in words for _ in range(3)} - {""} for _ in range(2))
    want = {(a, b) for a in left for b in right if 2 * common(a, b) >= 0.86 * (len(a) + len(b)) - 1e-9}
    frames = [spark.createDataFrame([(n,) for n in sorted(side)], "name string") for side in (left, right)]
    assert want <= {tuple(p) for p in candidate_names(*frames, "name", 0.86).collect()}


def test_copies_of_works_do_not_multiply(spark, sf_dir, tmp_path):
    """3,000 works and candidates of one title: joined by key to one row each, not nine million."""
    sizes = F.when(F.col("id") == 0, 1).otherwise(F.col("id") % 3).cast("int")
    part = spark.range(3_000).select(F.col("id").alias("p_partkey"), F.lit("one title").alias("p_name"), F.when(F.col("id") > 0, F.lit("Brand#1")).alias("p_brand"), sizes.alias("p_size"))
    path, con = with_table(spark, sf_dir, tmp_path, "part", part)
    found = plans.QUERIES["work_match_cascade"](spark, path)
    same(found, con, plans.SQL["work_match_cascade"])


def test_detail_credits_look_at_a_page_once(spark):
    html = '<h1 class="title">W</h1><p class="composer">C</p><ul class="team"><li>Light: A</li></ul><ul class="cast"><li>Leo: A</li><li>Ina: B</li></ul>'
    pages = spark.createDataFrame([(1, html), (None, html)], "page long, html string")
    found = calendar.detail_credits(pages, "page", "html")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r["page"]), r["side"], r["label"], r["person"]) for r in found.collect())
    assert got == [("1", "cast", "Ina", "B"), ("1", "team", "Light", "A"), ("None", "cast", "Ina", "B"), ("None", "cast", "Leo", "A"), ("None", "team", "Light", "A")]


def test_staged_programme_reads_its_second_works_once(spark, sf_dir):
    """Keys of titles are worked out once a work and the event's name by a window, not by a join of rows with rows."""
    plan = plans.QUERIES["staged_programme"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan


def test_links_are_resolved_once(spark):
    pages = spark.createDataFrame([(1, "https://h.org/list/", '<h2><a href="../news/1?q">A long enough title</a></h2>')], "page int, url string, html string")
    found = html.heading_links(pages, "page", "url", "html", spark.createDataFrame([("https://h.org/x",)], "link string"))
    conditions = [part for part in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in part]
    assert conditions and not any("aggregate(" in part for part in conditions)
    assert [tuple(r) for r in found.collect()] == [(1, "https://h.org/news/1", "A long enough title")]


def test_listing_pages_are_dealt_to_all_cores(spark, sf_dir):
    plan = plans.QUERIES["site_links"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_pairs_are_dealt_out_before_they_are_told_apart(spark):
    rows = spark.range(1_000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 7 == 1, F.lit(5)).otherwise(F.col("id")).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([(9, None), (None, 3), (None, 3)], "k long, t long"))
    found = unique_match(rows, ["k"], "t")
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    last = lambda word: max(i for i, part in enumerate(plan) if word in part)
    assert last("REPARTITION_BY_NUM") > last("HashAggregate")
    want = {k: (len({i for i in range(1_000) if i % 7 == k}), None) for k in range(7)} | {1: (1, 5), 9: (0, None), None: (1, 3)}
    assert {r["k"]: (r["matches"], r["t"]) for r in found.collect()} == want
