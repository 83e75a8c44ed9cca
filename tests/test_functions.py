from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from veduta.functions import dates, identity, text, urls


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_search_keys(spark):
    assert values(spark, text.search_key_unicode, "François", "Œuvre  d’été!", None, "Straße_1") == ["francois", "oeuvre d'ete", "", "strasse_1"]
    assert values(spark, text.search_key_ascii, "Théâtre: Opéra", "žlutý kůň") == ["theatre opera", "zluty kun"]
    assert values(spark, text.compact_key, "Don Giovanni, K. 527") == ["dongiovannik527"]


def test_titles_and_names(spark):
    assert values(spark, text.title_key, "Nocturne No 2 (arr.) [live]", "Notturno op. 9") == ["nocturne 2", "notturno 9"]
    assert values(spark, text.person_key, "Johann Sebastian Bach (1685-1750)") == ["johann sebastian bach"]
    assert values(spark, text.festival_title, "Siegfried (Festival RING)", "Tosca (new)") == ["siegfried", "tosca new"]
    assert values(spark, text.catalogue_tokens, "Sonata Op. 27 and BWV  1007, kop 3") == [["op 27", "bwv 1007"]]


def test_excerpts(spark):
    long = "a" * 700
    assert values(spark, text.excerpt, long, "b  c") == ["a" * 600 + "…", "b c"]
    assert values(spark, text.value_summary, "x" * 81, "y" * 80) == ["x" * 77 + "...", "y" * 80]
    assert values(spark, text.ics_escape, "a;b,c\\d\ne") == ["a\\;b\\,c\\\\d\\ne"]
    assert values(spark, text.safe_name, "My plan / 2026", "", None) == ["My_plan_2026", "schedule", "schedule"]


def test_urls(spark):
    assert values(spark, urls.canonical_url, "HTTPS://User@Ex.COM:80//a//b/?q#f", "http://x.org", " http://x.org// ", "ftp://x/y", "no", None) == ["https://user@ex.com:80/a/b", "http://x.org/", "http://x.org/", None, None, None]
    assert values(spark, urls.url_host, "http://u:p@Ex.com:8080/a") == ["ex.com"]
    assert values(spark, urls.country_of, "https://a.fr/x", "https://a.com", "http://b.co.uk", "http://b.nl", "http://fr/") == ["fr", "other", "gb", "other", "other"]
    assert values(spark, urls.country_of_language, "PT_br", "de", "en-GB", None) == ["pt", "de", "other", "other"]
    assert values(spark, urls.safe_link, "javascript:x", " https://a ", None) == ["#", "https://a", "#"]
    assert values(spark, lambda c: urls.canonical_keeping_query(c, "w.org"), "https://W.org:443/s//?a=1#x", "https://v.org/?a") == ["https://w.org/s?a=1", None]


def test_dates(spark):
    got = values(spark, dates.parse_moment, "2026-01-02T03:04:05Z", "Fri, 02 Jan 2026 03:04:05 +0100", "nonsense", None)
    assert [str(g) if g else None for g in got] == ["2026-01-02 03:04:05", "2026-01-02 02:04:05", None, None]
    assert values(spark, dates.clock, "9:05", "19:00:00", "19:00:30", "later") == ["09:05", "19:00", "19:00:30", "later"]
    assert values(spark, dates.strict_iso_date, "2026-02-28", "2026-02-30", "2026-2-3") == [date(2026, 2, 28), None, None]
    assert dates.season_bounds("2026-27") == (date(2026, 9, 1), date(2027, 8, 31))
    assert dates.season_bounds("2026-27", start="2026-08-28")[0] == date(2026, 8, 28)
    for bad in (("",), ("1999-01",), ("99-00",), ("2031-32", "31 December"), ("2031-32", None, "2033-01-01"), ("2031-32", "2032-01-01"), ("2031-32", "2031-12-31", "2031-12-30")):
        with pytest.raises(ValueError):
            dates.season_bounds(*bad)


SHAPES = [
    ("000", "numeric"), ("٣٤", "numeric"), (" 7 ", "numeric"), ("7.0", "other"),
    ("00000000-0000-1000-8000-00000000000a", "uuid"), ("00000000-0000-5000-B000-00000000000A", "uuid"), ("00000000-0000-6000-8000-00000000000a", "slug_or_text"), ("00000000-0000-1000-c000-00000000000a", "slug_or_text"),
    ("hall:x", "source_prefixed"), ("hall:", "slug_or_text"), ("HALL:9", "slug_or_text"),
    ("HTTP://h", "url_like"), ("//cdn/a", "url_like"), ("www.h.at", "url_like"), ("wwwx", "slug_or_text"), ("httpx://h", "slug_or_text"),
    ("2031-04-05", "date_composite"), ("tosca_2031-04-05T20", "date_composite"), ("32031-04-05", "other"), ("2031-04-056", "other"),
    ("Élektra (II)", "slug_or_text"), ("a+b/c'd", "slug_or_text"), ("___", "other"), ("(a)", "other"), ("a?b", "other"), ("", "other"), (None, "other"),
]


def test_identity_shapes(spark):
    df = spark.createDataFrame([(i, v, "hall") for i, (v, _) in enumerate(SHAPES)], "i int, v string, s string")
    got = [r[0] for r in df.orderBy("i").select(identity.identity_shape(F.col("v"), F.col("s"))).collect()]
    assert got == [shape for _, shape in SHAPES]


def test_resolved_urls(spark):
    from urllib.parse import urljoin

    bases = ("https://h.at/a/b/c.html?q=1#f", "http://h.at", "http://h.at/", "https://h.at/a/b/")
    hrefs = ("", "x", "./x", "../x", "../../../x/", "/y/../z", "//o.fr/p", "mailto:a@b", "?r=2", "#g", "x?y#z", "..", "a/./b")
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    wrong = [(r[0], r[1], r[2], urljoin(r[0], r[1])) for r in df.select("b", "h", urls.resolved(F.col("b"), F.col("h"))).collect() if r[2] != urljoin(r[0], r[1])]
    assert not wrong


def test_uuid5_and_titles(spark):
    import uuid

    assert values(spark, identity.uuid5, "http://a/é", "") == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in ("http://a/é", "")]
    assert values(spark, text.smart_title, "LA FLAUTA DE LA REINA", "Don Giovanni", "") == ["La Flauta de la Reina", "Don Giovanni", ""]
