from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from veduta.sources import events, files, html

PAGE = """<html lang="ES"><head><link type="application/rss+xml" href="/feed"></head><body><h1>Temporada</h1><h2>Temporada</h2>
<a href="/x/1">Una gala larga</a> <a class="k" href="http://o.es/2">Otra &amp; m&#39;s</a><p>%s</p><p>%s</p><p>corto</p> 2026-09-12 12/09/2026 2026-09-12
<script type="application/ld+json">[{"@id": "a1", "name": " Gala ", "startDate": "2026-09-12T9:30:00", "url": "https://o.es/a1", "location": {"name": "Sala"}}, {"name": "Sin id", "startDate": "x"}]</script>
<script type="application/ld+json">{broken</script></body></html>""" % ("b" * 60, "b" * 60)


def test_html_parts(spark):
    df = spark.createDataFrame([("https://o.es/cal?x=1", PAGE), ("https://o.es", "<rss version='2'></rss>")], "url string, html string")
    c = F.col("html")
    row = df.select(html.links(c), html.paragraphs(c), html.titles(c), html.date_tokens(c), html.source_kind(c), html.page_language(c)).first()
    assert [(x["href"], x["title"]) for x in row[0]] == [("/x/1", "Una gala larga"), ("http://o.es/2", "Otra & m's")]
    assert row[1] == ["b" * 60] and row[2] == ["Temporada"] and row[3] == ["2026-09-12", "12/09/2026"]
    assert (row[4], row[5]) == ("alternate", "es")
    assert [r[0] for r in df.select(html.source_kind(c)).collect()] == ["alternate", "rss"]
    assert df.select(html.absolute(F.col("url"), F.lit("/x/1"))).first()[0] == "https://o.es/x/1"


def test_json_ld_quarantine(spark):
    found = events.canonical_events(spark.createDataFrame([(PAGE,)], "html string"), "teatro")
    sound, lost = events.split_quarantine(found)
    row = sound.first()
    assert sound.count() == 1 and (row["title"], row["date"], row["start_time"], row["venue"]) == ("Gala", date(2026, 9, 12), "09:30", "Sala")
    assert row["event_key"].startswith("teatro:") and len(row["event_key"]) == 31
    assert [sorted(r["errors"]) for r in lost.collect()] == [["bad_date", "bad_url", "missing_id"]]
    report = files.ingestion_report(sound, lost).first()
    assert (report["events"], report["quarantined"], report["status"]) == (1, 1, "PARTIAL")
    again = sound.withColumn("n", F.lit(1)).unionByName(sound.withColumn("n", F.lit(2)).withColumn("title", F.lit("New")).withColumn("date", F.date_add("date", -1)))
    again = again.unionByName(sound.withColumn("n", F.lit(0)).withColumn("date", F.date_add("date", 3)))
    last = events.season_rows(again, date(2026, 9, 1), date(2027, 8, 31), "n").collect()
    assert [(r["title"], r["n"]) for r in last] == [("New", 2)]


def test_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"articles": [{"id": 3}]}, indent=1))
    assert sorted(r["id"] for r in files.json_documents(spark, f"{tmp_path}/*.json", "id: int").collect()) == [1, 2, 3]
    files.stage_json_lines(spark.range(4), f"{tmp_path}/staged")
    assert files.json_lines(spark, f"{tmp_path}/staged", "id long").count() == 4


@pytest.mark.parametrize("document", ['{"items": []}', '{"articles": [{"id": 1}', "7"])
def test_documents_of_another_shape_raise(spark, tmp_path, document):
    (tmp_path / "a.json").write_text(document)
    with pytest.raises(Exception, match="neither a list|MALFORMED|PARSE|FAILFAST"):
        files.json_documents(spark, f"{tmp_path}/*.json", "id: int").collect()


def test_feed(spark):
    xml = "<rss><channel><item><link> http://a/1 </link><title>T</title><pubDate>Fri, 02 Jan 2026 03:04:05 +0000</pubDate><summary> </summary><description>d</description></item></channel></rss>"
    row = files.feed_entries(spark.createDataFrame([("f", xml)], "feed string, xml string")).first()
    assert (row["feed"], row["link"], row["title"], str(row["published"]), row["body"]) == ("f", "http://a/1", "T", "2026-01-02 03:04:05", "d")
