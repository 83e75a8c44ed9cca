"""Catalogue queries: filters, joins, searches and intersections over events and their entities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions.dates import year_month
from veduta.functions.text import ics_escape, search_key_ascii
from veduta.operators.dedup import pick_best
from veduta.operators.matching import search_parts, search_score, similar_names, tier_score
from veduta.operators.rules import cascade
from veduta.plans.registry import query

FIRST, LAST = date(1996, 9, 1), date(1997, 8, 31)
CITIES = ("nation_1", "nation_7", "nation_12")
ARTIST = "Supplier#000000007"
#: A misspelled title.
KEYWORD = "blu gadgte"


def in_season(events: DataFrame) -> DataFrame:
    return events.where(F.col("date").between(F.lit(FIRST), F.lit(LAST)))


@query(
    "schedule_events",
    """
    SELECT event_id, date, CASE WHEN contains(event_type, 'URGENT') THEN 'opera' WHEN contains(event_type, 'HIGH') OR contains(event_type, 'MEDIUM') THEN 'concert' ELSE 'other' END AS event_type,
           organization, venue, city
    FROM ev LEFT JOIN ve ON ev.venue_id = ve.venue_id
    WHERE date BETWEEN DATE '1996-09-01' AND DATE '1997-08-31' AND lower(city) IN ('nation_1', 'nation_7', 'nation_12')
    ORDER BY date, event_id LIMIT 1000""",
    "ev ve",
)
def schedule_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a season in some cities, canonical types, first row per event, by date.

    All filters come before the limit, which is the page of the listing."""
    key = search_key_ascii(F.col("event_type"))
    kind = cascade([(key.contains("urgent"), "opera"), (key.contains("high") | key.contains("medium"), "concert")], "other")
    found = in_season(binding.occurrences(spark, sf_dir)).join(binding.venues(spark, sf_dir), "venue_id", "left")
    found = found.where(F.lower("city").isin(*CITIES)).select("event_id", "date", kind.alias("event_type"), "organization", "venue", "city")
    first = pick_best(found, ["event_id"], [F.col("date"), F.col("venue")], keep_keyless=True)
    return first.orderBy(F.col("date").asc_nulls_last(), "event_id").limit(1000)


@query(
    "venue_active_pairs",
    "SELECT DISTINCT organization, venue, city FROM ve WHERE venue_id IN (SELECT venue_id FROM ev WHERE date BETWEEN DATE '1996-09-01' AND DATE '1997-08-31')",
    "ev ve",
)
def venue_active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organization and venue pairs with an event in the season (semi-join)."""
    return binding.venues(spark, sf_dir).join(in_season(binding.occurrences(spark, sf_dir)), "venue_id", "left_semi").select("organization", "venue", "city").distinct()


@query(
    "character_catalog_view",
    """
    WITH first_work AS (SELECT event_id, min(work_id) AS work_id FROM pr WHERE position = 1 GROUP BY event_id)
    SELECT cr.event_id, ev.date, venue, city, artist_name, role, title, composer
    FROM cr JOIN ev ON cr.event_id = ev.event_id JOIN ar ON cr.artist_id = ar.artist_id JOIN ve ON ev.venue_id = ve.venue_id
         LEFT JOIN first_work f ON f.event_id = cr.event_id LEFT JOIN wk ON wk.work_id = f.work_id""",
    "ev pr cr wk ar ve",
)
def character_catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credit-level catalogue view: a star of events, credits, artists, venues and first works."""
    first_work = binding.programme(spark, sf_dir).where("position = 1").groupBy("event_id").agg(F.min("work_id").alias("work_id"))
    star = binding.credits(spark, sf_dir).join(binding.occurrences(spark, sf_dir), "event_id").join(binding.artists(spark, sf_dir), "artist_id")
    star = star.join(binding.venues(spark, sf_dir), "venue_id").join(first_work, "event_id", "left").join(binding.works(spark, sf_dir), "work_id", "left")
    return star.select("event_id", "date", "venue", "city", "artist_name", "role", "title", "composer")


def events_of_works(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    on_bill = binding.programme(spark, sf_dir).join(chosen, "work_id", "left_semi")
    return binding.occurrences(spark, sf_dir).join(on_bill, "event_id", "left_semi")


@query(
    "work_events",
    "SELECT event_id, date, status FROM ev WHERE event_id IN (SELECT event_id FROM pr JOIN wk ON pr.work_id = wk.work_id WHERE composer ILIKE '%brand#1%' AND kind = 'PROMO')",
    "ev pr wk",
)
def work_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a work of a composer matched by substring (semi-join chain)."""
    chosen = binding.works(spark, sf_dir).where(F.col("composer").ilike("%brand#1%") & (F.col("kind") == "PROMO"))
    return events_of_works(spark, sf_dir, chosen).select("event_id", "date", "status")


@query(
    "artist_events_first_credit",
    """
    SELECT event_id, artist_name, role, position FROM (
      SELECT cr.event_id, artist_name, role, position,
             row_number() OVER (PARTITION BY cr.event_id ORDER BY CASE WHEN artist_name = 'Supplier#000000007' THEN 0 ELSE 1 END, position, cr.artist_id, role) AS n
      FROM cr JOIN ar ON cr.artist_id = ar.artist_id) WHERE n = 1""",
    "cr ar",
)
def artist_events_first_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event the requested artist's first credit, else its first credit."""
    named = binding.credits(spark, sf_dir).join(binding.artists(spark, sf_dir), "artist_id")
    wanted = F.when(F.col("artist_name") == ARTIST, 0).otherwise(1)
    return pick_best(named, ["event_id"], [wanted, F.col("position"), F.col("artist_id"), F.col("role")]).select("event_id", "artist_name", "role", "position")


@query(
    "artist_context_last_credit",
    """
    SELECT event_id, artist_id, role, position FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY position DESC, artist_id DESC, role) AS n FROM cr) WHERE n = 1""",
    "cr",
)
def artist_context_last_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event its last credit."""
    return pick_best(binding.credits(spark, sf_dir), ["event_id"], [-F.col("position"), -F.col("artist_id"), F.col("role")]).select("event_id", "artist_id", "role", "position")


@query(
    "entity_options",
    """
    WITH n AS (SELECT wk.work_id, title, composer, kind, count(DISTINCT pr.event_id) AS events FROM wk LEFT JOIN pr ON pr.work_id = wk.work_id GROUP BY ALL)
    SELECT kind, work_id, title, composer, events, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY events DESC, title, work_id) AS rank FROM n) WHERE rank <= 30""",
    "wk pr",
)
def entity_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind the 30 works on most bills (a top-k report)."""
    counts = binding.programme(spark, sf_dir).groupBy("work_id").agg(F.count_distinct("event_id").alias("events"))
    listed = binding.works(spark, sf_dir).join(counts, "work_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("events"), "title", "work_id")).cast("long")
    return listed.withColumn("rank", rank).where("rank <= 30").select("kind", "work_id", "title", "composer", "events", "rank")


@query(
    "artist_roles",
    "SELECT ar.artist_id, artist_name, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT event_id) AS events FROM ar LEFT JOIN cr ON cr.artist_id = ar.artist_id GROUP BY ALL",
    "ar cr",
)
def artist_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist with sorted roles and number of events (group join, zero kept)."""
    per_role = binding.credits(spark, sf_dir).select("artist_id", "event_id", "role").distinct()
    grouped = per_role.groupBy("artist_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("event_id").alias("events"))
    return binding.artists(spark, sf_dir).join(grouped, "artist_id", "left").select("artist_id", "artist_name", "roles", F.coalesce("events", F.lit(0)).alias("events"))


@query(
    "combined_entity_events",
    """
    SELECT event_id, date, city FROM ev JOIN ve ON ev.venue_id = ve.venue_id
    WHERE event_id IN (SELECT event_id FROM pr JOIN wk ON pr.work_id = wk.work_id WHERE composer = 'Brand#1')
      AND event_id IN (SELECT event_id FROM cr JOIN ar ON cr.artist_id = ar.artist_id WHERE role = 'A')
      AND event_id IN (SELECT event_id FROM ev WHERE date >= DATE '1996-01-01')""",
    "ev pr cr wk ar ve",
)
def combined_entity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection of the events of a composer, of a role and of a period; rows of the first."""
    works = binding.works(spark, sf_dir).where(F.col("composer") == "Brand#1")
    first = events_of_works(spark, sf_dir, works)
    second = binding.credits(spark, sf_dir).where("role = 'A'").join(binding.artists(spark, sf_dir), "artist_id", "left_semi")
    third = binding.occurrences(spark, sf_dir).where(F.col("date") >= F.lit(date(1996, 1, 1)))
    both = first.join(second, "event_id", "left_semi").join(third.select("event_id"), "event_id", "left_semi")
    return both.join(binding.venues(spark, sf_dir), "venue_id").select("event_id", "date", "city")


@query(
    "mark_join_search",
    """
    WITH by_artist AS (SELECT DISTINCT work_id FROM lineitem l JOIN pr ON l.l_orderkey = pr.event_id AND l.l_linenumber = pr.position AND l.l_partkey = pr.work_id WHERE l_suppkey = 7),
    s AS (SELECT wk.work_id, title, CASE WHEN title = 'red' THEN 1.0 WHEN prefix(title, 'red') THEN 0.9 WHEN contains(title, 'red') THEN 0.8 ELSE 0.0 END::DOUBLE AS score, b.work_id IS NOT NULL AS via_artist
          FROM wk LEFT JOIN by_artist b ON b.work_id = wk.work_id)
    SELECT * FROM s WHERE score >= 0.6 OR via_artist""",
    "wk pr",
)
def mark_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose title scores 0.6 or more for a needle, or that an artist performs (mark join)."""
    by_artist = binding.table(spark, sf_dir, "lineitem").where("l_suppkey = 7").select(F.col("l_partkey").alias("work_id")).distinct().withColumn("_hit", F.lit(True))
    scored = binding.works(spark, sf_dir).join(by_artist, "work_id", "left").withColumn("score", tier_score(search_key_ascii(F.col("title")), F.lit("red")))
    scored = scored.withColumn("via_artist", F.col("_hit").isNotNull())
    return scored.where((F.col("score") >= 0.6) | F.col("via_artist")).select("work_id", "title", "score", "via_artist")


@query("keyword_search_fuzzy")
def keyword_search_fuzzy(spark: SparkSession, sf_dir: str, needle: str = KEYWORD, least: float = 0.6) -> DataFrame:
    """Events that score ``least`` or more for a needle in title, composer, organization, venue or
    artist name of any of their slots, or in which ARTIST performs (mark join).

    The tables have one title, that of the work, which stands for the event's title as well. Each
    work, venue and artist is compared once."""
    word = F.lit(needle)
    works = binding.works(spark, sf_dir).select("work_id", search_parts([F.col("title"), F.col("composer")], word).alias("_work"))
    venues = binding.venues(spark, sf_dir).select("venue_id", search_parts([F.col("organization"), F.col("venue")], word).alias("_venue"))
    artists = binding.artists(spark, sf_dir).select("artist_id", search_parts([F.col("artist_name")], word).alias("_artist"), (F.col("artist_name") == ARTIST).alias("_hit"))
    slots = binding.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("artist_id"))
    rows = binding.occurrences(spark, sf_dir).select("event_id", "venue_id").join(slots, "event_id", "left")
    rows = rows.join(venues, "venue_id", "left").join(works, "work_id", "left").join(artists, "artist_id", "left")
    score = search_score(F.col("_work"), F.col("_venue"), F.col("_artist"))
    found = rows.groupBy("event_id").agg(F.max(score).alias("score"), F.max(F.coalesce("_hit", F.lit(False))).alias("via_artist"))
    return found.where((F.col("score") >= least) | F.col("via_artist"))


@query("artist_options_fuzzy")
def artist_options_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the five titles of other names most like theirs (similarity 0.60 or more)."""
    titles = binding.works(spark, sf_dir).select(search_key_ascii(F.col("title")).alias("name")).distinct()
    pairs = similar_names(titles.select(F.col("name").alias("left_name"), "name"), titles.select(F.col("name").alias("right_name"), "name"), "name", "left_name", "right_name", 0.6, 6)
    return pairs.where("left_name != right_name")


@query("composer_candidates")
def composer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every misspelt name the five composers most like it (similarity 0.86 or more): evidence for a
    review, never a match."""
    letters = F.translate(F.col("c_custkey").cast("string"), "0123456789", "aeioulnrst")
    names = binding.table(spark, sf_dir, "customer").select(F.concat_ws(" ", F.lower("c_mktsegment"), letters).alias("name")).distinct()
    misspelt = F.concat(F.substring("name", 2, 4), F.lit("x"), F.expr("substring(name, 7)"))
    raw = names.select("name", misspelt.alias("raw"))
    return similar_names(raw.select("raw", F.col("raw").alias("key")), names.select(F.col("name").alias("composer"), F.col("name").alias("key")), "key", "raw", "composer", 0.86, 5)


@query(
    "effective_subscriptions",
    """
    WITH sub AS (SELECT s_suppkey AS user_id, s_nationkey AS source_id, 'NATION_' || (s_suppkey % 25) AS feed FROM supplier),
    hit AS (SELECT user_id, n_nationkey, n_name FROM sub JOIN nation ON source_id = n_nationkey UNION SELECT user_id, n_nationkey, n_name FROM sub JOIN nation ON feed = n_name)
    SELECT user_id, n_nationkey AS source_id, n_name AS feed FROM hit
    WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_nationkey = n_nationkey)""",
)
def effective_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions matched to sources by id or by feed (two equi-joins), less personal ones."""
    sub = binding.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("_id"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25).alias("_feed"))
    source = binding.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("feed"))
    by_id = sub.join(source, F.col("_id") == F.col("source_id")).select("user_id", "source_id", "feed")
    by_feed = sub.join(source, F.col("_feed") == F.col("feed")).select("user_id", "source_id", "feed")
    personal = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("source_id"))
    return by_id.unionByName(by_feed).distinct().join(personal, ["user_id", "source_id"], "left_anti")


@query(
    "schedule_summary",
    "SELECT ve.venue_id, venue, count(event_id) AS events, min(date) AS first_date, max(date) AS last_date, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types FROM ve LEFT JOIN ev ON ev.venue_id = ve.venue_id GROUP BY ALL",
    "ve ev",
)
def schedule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue: number of events, first and last date, sorted distinct types."""
    grouped = binding.occurrences(spark, sf_dir).groupBy("venue_id").agg(
        F.count("event_id").alias("events"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types")
    )
    return binding.venues(spark, sf_dir).join(grouped, "venue_id", "left").select("venue_id", "venue", F.coalesce("events", F.lit(0)).alias("events"), "first_date", "last_date", "types")


@query(
    "schedule_ics",
    r"""
    SELECT venue_id, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || string_agg('BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || event_id || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || replace(event_type, ',', '\,') || chr(13) || chr(10) || 'END:VEVENT', chr(13) || chr(10) ORDER BY date, event_id) || chr(13) || chr(10) || 'END:VCALENDAR' AS ics
    FROM ev WHERE date BETWEEN DATE '1996-09-01' AND DATE '1997-08-31' GROUP BY venue_id""",
    "ev",
)
def schedule_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue its season as calendar text, events by date. A venue has a season's events at most."""
    end = F.lit("\r\n")
    entry = F.concat(F.lit("BEGIN:VEVENT"), end, F.lit("UID:"), F.col("event_id"), end, F.lit("DTSTART;VALUE=DATE:"), F.date_format("date", "yyyyMMdd"), end, F.lit("SUMMARY:"), ics_escape(F.col("event_type")), end, F.lit("END:VEVENT"))
    listed = F.array_sort(F.collect_list(F.struct("date", "event_id", entry.alias("entry"))))
    grouped = in_season(binding.occurrences(spark, sf_dir)).groupBy("venue_id").agg(listed.alias("l"))
    return grouped.select("venue_id", F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.array_join(F.col("l.entry"), "\r\n"), F.lit("END:VCALENDAR")).alias("ics"))


@query(
    "event_detail",
    """
    WITH p AS (SELECT event_id, string_agg(position || ':' || title, ';' ORDER BY position, title) AS bill FROM pr JOIN wk ON pr.work_id = wk.work_id GROUP BY event_id),
    c AS (SELECT event_id, string_agg(artist_name || '/' || role, ';' ORDER BY artist_name, role) AS people FROM cr JOIN ar ON cr.artist_id = ar.artist_id GROUP BY event_id)
    SELECT ev.event_id, date, venue, city, bill, people FROM ev LEFT JOIN ve ON ev.venue_id = ve.venue_id LEFT JOIN p ON p.event_id = ev.event_id LEFT JOIN c ON c.event_id = ev.event_id""",
    "ev pr cr wk ar ve",
)
def event_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its venue, ordered programme and credits (nested joins)."""
    # Programme and credits are one scan and one grouping of the same rows.
    lines = binding.bill(spark, sf_dir).join(binding.works(spark, sf_dir).select("work_id", "title"), "work_id", "left").join(binding.artists(spark, sf_dir), "artist_id", "left")
    entry = F.when(F.col("title").isNotNull(), F.struct("position", "title"))
    person = F.when(F.col("artist_name").isNotNull(), F.struct("artist_name", "role"))
    both = lines.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("b"), F.array_sort(F.collect_list(person)).alias("p"))
    joined = lambda c, f: F.when(F.size(c) > 0, F.array_join(F.transform(c, f), ";"))
    bill = joined("b", lambda x: F.concat(x["position"], F.lit(":"), x["title"])).alias("bill")
    people = joined("p", lambda x: F.concat(x["artist_name"], F.lit("/"), x["role"])).alias("people")
    events = binding.occurrences(spark, sf_dir).join(binding.venues(spark, sf_dir), "venue_id", "left")
    return events.join(both.select("event_id", bill, people), "event_id", "left").select("event_id", "date", "venue", "city", "bill", "people")


@query(
    "user_event_relations",
    "SELECT user_id, CASE event_type WHEN 'view' THEN 'optional' WHEN 'click' THEN 'maybe_go' ELSE event_type END AS intent, count(*) AS n FROM events GROUP BY ALL",
)
def user_event_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations per user with intent codes translated."""
    intent = cascade([(F.col("event_type") == "view", "optional"), (F.col("event_type") == "click", "maybe_go")], F.col("event_type"))
    return binding.usage(spark, sf_dir).groupBy("user_id", intent.alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "visible_rows",
    "SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 100)",
)
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level visibility: rows of users who own a purchase over 100 (EXISTS as semi-join)."""
    rows = binding.usage(spark, sf_dir)
    owners = rows.where("event_type = 'purchase' and value > 100").select("user_id").distinct()
    return rows.join(owners, "user_id", "left_semi").select("event_id", "user_id")


@query(
    "city_derivation",
    """
    SELECT venue_id, coalesce(CASE WHEN contains(venue, '00000') THEN NULL ELSE city END, country) AS city_by_directory,
           CASE WHEN contains(lower(venue || ' ' || organization), 'machinery') THEN 'Works' ELSE city END AS city_by_name FROM ve""",
    "ve",
)
def city_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both city rules: explicit value else directory; and a rule on venue and organization names."""
    explicit = F.when(~F.col("venue").contains("00000"), F.col("city"))
    by_name = F.when(F.lower(F.concat_ws(" ", "venue", "organization")).contains("machinery"), "Works").otherwise(F.col("city"))
    return binding.venues(spark, sf_dir).select("venue_id", F.coalesce(explicit, "country").alias("city_by_directory"), by_name.alias("city_by_name"))


@query(
    "month_histogram",
    "SELECT strftime(date, '%Y-%m') AS month, event_type, count(*) AS events FROM ev GROUP BY ALL",
    "ev",
)
def month_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by month and type."""
    return binding.occurrences(spark, sf_dir).groupBy(year_month(F.col("date")).alias("month"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "schedule_email",
    """
    WITH d AS (SELECT venue_id, date, string_agg(event_type || ' #' || event_id, ', ' ORDER BY event_type, event_id) AS entry FROM ev WHERE date BETWEEN DATE '1996-09-01' AND DATE '1997-08-31' GROUP BY venue_id, date)
    SELECT venue_id, string_agg(strftime(date, '%Y-%m-%d') || ': ' || entry, chr(10) ORDER BY date) AS body, count(*) AS days FROM d GROUP BY venue_id""",
    "ev",
)
def schedule_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per venue a text of its season: one line a day, entries of a day in order (group, then sort inside)."""
    item = F.struct("event_type", "event_id", F.concat_ws(" #", "event_type", "event_id").alias("text"))
    days = in_season(binding.occurrences(spark, sf_dir)).groupBy("venue_id", "date").agg(F.array_sort(F.collect_list(item))["text"].alias("e"))
    line = F.struct("date", F.concat(F.col("date").cast("string"), F.lit(": "), F.array_join("e", ", ")).alias("line"))
    return days.groupBy("venue_id").agg(F.array_join(F.array_sort(F.collect_list(line))["line"], "\n").alias("body"), F.count(F.lit(1)).alias("days"))
