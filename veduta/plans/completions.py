"""Whole forms of lookups, reports and documents whose parts other queries hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions import text, urls
from veduta.functions.dates import parse_moment
from veduta.operators.reconcile import PATCHABLE, field_plan, same_value
from veduta.operators.rules import cascade
from veduta.operators.titles import debris_reason, header_like
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql
from veduta.sources import html


@query(
    "duplicate_samples",
    """
    WITH g AS (SELECT source || '/' || (n_chars % 300) AS key, count(*) AS occurrences, list_sort(list(DISTINCT doc_id)) AS members FROM documents GROUP BY 1 HAVING count(*) > 1)
    SELECT 'first' AS report, key, occurrences, list_slice(members, 1, 20) AS members FROM (SELECT *, row_number() OVER (ORDER BY key) AS r FROM g) WHERE r <= 20
    UNION ALL SELECT 'most', key, occurrences, list_slice(members, 1, 20) FROM (SELECT *, row_number() OVER (ORDER BY occurrences DESC, key) AS r FROM g) WHERE r <= 10
    UNION ALL SELECT 'blank', lang, count(*), list_slice(list_sort(list(doc_id)), 1, 20) FROM documents WHERE n_chars % 50 = 0 GROUP BY lang""",
)
def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one key: the first twenty by key, the ten largest, and samples of blank values, each with
    twenty members at most (the limits are the reports')."""
    docs = binding.articles(spark, sf_dir).select("doc_id", "lang", F.concat_ws("/", "source", (F.col("n_chars") % 300).cast("string")).alias("key"), "n_chars")
    counts = docs.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
    first = counts.orderBy("key").limit(20).withColumn("report", F.lit("first"))
    most = counts.orderBy(F.desc("occurrences"), "key").limit(10).withColumn("report", F.lit("most"))
    least = Window.partitionBy("report", "key").orderBy("doc_id")
    members = first.unionByName(most).join(docs.select("key", "doc_id").distinct(), "key")
    blank = docs.where("n_chars % 50 = 0")
    blanks = blank.groupBy(F.col("lang").alias("key")).agg(F.count(F.lit(1)).alias("occurrences")).withColumn("report", F.lit("blank")).join(blank.select(F.col("lang").alias("key"), "doc_id"), "key")
    every = members.unionByName(blanks).withColumn("_r", F.row_number().over(least)).where("_r <= 20")
    return every.groupBy("report", "key", "occurrences").agg(F.array_sort(F.collect_list("doc_id")).alias("members"))


_DROPPED = ("script", "style", "nav", "footer", "header", "aside", "form")
_CLEAN_SQL = "html"
for _tag in _DROPPED:
    _CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(
    "article_bodies",
    f"""
    WITH c AS (SELECT page_id, {_CLEAN_SQL} AS h FROM pages),
    p AS (SELECT page_id, unnest(regexp_extract_all(h, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1)) AS raw, generate_subscripts(regexp_extract_all(h, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), 1) AS i FROM c),
    t AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM p),
    q AS (SELECT page_id, t, min(i) AS i FROM t WHERE length(t) >= 50 GROUP BY 1, 2),
    b AS (SELECT page_id, left(string_agg(t, chr(10) ORDER BY i), 12000) AS body FROM q GROUP BY page_id)
    SELECT page_id, CASE WHEN length(body) >= 200 THEN md5(body) END AS body, coalesce(length(body), 0) >= 200 AS readable, strftime(DATE '2024-01-01' + (page_id % 28)::INTEGER, '%Y-%m-%d') AS published FROM pages LEFT JOIN b USING (page_id)""",
)
def article_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article texts without boilerplate elements: distinct paragraphs of fifty characters, 12,000 at most
    (the feature's limit), two hundred at least; and the first date that a page's metadata give."""
    c = F.col("html")
    for tag in _DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    body = F.substring(F.array_join(html.paragraphs(c), "\n"), 1, 12000)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")), "yyyy-MM-dd")
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta property="article:published_time" content="soon"><time datetime="'), day, F.lit('T10:00:00Z">'))).otherwise(F.concat(F.lit('<meta name="date" content="'), day, F.lit('">')))
    dated = F.concat(head, "html")
    found = [parse_moment(F.regexp_extract(dated, p, 1)) for p in (r'<meta property="article:published_time" content="([^"]*)"', r'<meta name="date" content="([^"]*)"', r'<time datetime="([^"]*)"')]
    enough = F.length(body) >= 200
    return binding.pages(spark, sf_dir).select("page_id", F.when(enough, F.md5(body.cast("binary"))).alias("body"), enough.alias("readable"), F.date_format(F.coalesce(*found), "yyyy-MM-dd").alias("published"))


@query(
    "site_links",
    """
    SELECT p_partkey AS page, 'https://h' || (p_partkey % 9) || '.org/news/' || p_partkey AS link, 'A long title ' || p_partkey AS title FROM part WHERE p_partkey % 7 > 0""",
)
def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the headings of listing pages: titles of twelve characters, the page's own host, not seen
    before, no author, tag, category or page listings, each once."""
    n = F.col("p_partkey").cast("string")
    site = F.concat(F.lit("https://H"), (F.col("p_partkey") % 9).cast("string"), F.lit(".org"))
    anchor = lambda href, title: F.concat(F.lit('<h2 class="x"><a href="'), href, F.lit('">'), title, F.lit("</a></h2>"))
    long = F.concat(F.lit("A long  title "), n)
    page = F.concat(
        anchor(F.concat(F.lit("../news/"), n, F.lit("?utm=1")), long), anchor(F.concat(F.lit("/news/"), n, F.lit("/")), F.lit("Another long title")), anchor(F.concat(F.lit("/tag/"), n), long),
        anchor(F.concat(F.lit("https://other.org/"), n), long), anchor(F.concat(F.lit("/s/"), n), F.lit("short")), F.lit('<a href="/plain">A long title without heading</a>'),
    )
    parts = 4 * spark.sparkContext.defaultParallelism  # the keys of many pages may be in one row group
    pages = binding.table(spark, sf_dir, "part").select("p_partkey").repartition(parts, "p_partkey").select(F.col("p_partkey").alias("page"), F.concat(site, F.lit("/list/")).alias("url"), page.alias("html"))
    seen = pages.where("page % 7 = 0").select(urls.canonical_url(F.concat("url", F.lit("../news/"), F.col("page").cast("string"))).alias("link"))
    seen = seen.select(F.replace("link", F.lit("/list/.."), F.lit("")).alias("link"))
    return html.heading_links(pages, "page", "url", "html", seen)


@query(
    "master_occurrences",
    """
    WITH s AS (SELECT event_id AS n, venue_id, date, event_type, status, round(price) AS price FROM ev),
    k AS (SELECT venue_id, date, event_type, status, round(price) AS price, count(DISTINCT event_id) AS c, min(event_id) AS id FROM ev WHERE event_id % 5 > 0 GROUP BY ALL)
    SELECT n, CASE WHEN c = 1 THEN id END AS event_id, CASE WHEN c = 1 THEN 'unique' WHEN c > 1 THEN 'several' ELSE 'none' END AS found FROM s LEFT JOIN k ON s.venue_id = k.venue_id AND s.date = k.date AND s.event_type = k.event_type AND s.status = k.status AND s.price = k.price""",
    "ev",
)
def master_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged occurrences looked up in a master by five columns: accepted if exactly one event has them."""
    keys = ["venue_id", "date", "event_type", "status", "price"]
    rows = binding.occurrences(spark, sf_dir).withColumn("price", F.round("price"))
    master = rows.where("event_id % 5 > 0").groupBy(*keys).agg(F.count_distinct("event_id").alias("_c"), F.min("event_id").alias("event_id"))
    staged = rows.withColumnRenamed("event_id", "n").join(master, keys, "left")
    found = cascade([(F.col("_c") == 1, "unique"), (F.col("_c") > 1, "several")], "none")
    return staged.select("n", F.when(F.col("_c") == 1, F.col("event_id")).alias("event_id"), found.alias("found"))


@query(
    "catalogue_cascade",
    """
    WITH m AS (SELECT work_id, composer, work_id % 400 AS op FROM wk WHERE work_id % 3 > 0), c AS (SELECT work_id AS n, composer, work_id % 400 AS op FROM wk),
    a AS (SELECT n, count(DISTINCT m.work_id) AS k, min(m.work_id) AS id FROM c JOIN m ON m.composer = c.composer AND m.op = c.op GROUP BY n),
    b AS (SELECT n, count(DISTINCT m.work_id) AS k, min(m.work_id) AS id FROM c JOIN m ON m.op = c.op GROUP BY n)
    SELECT c.n, CASE WHEN a.k = 1 THEN a.id WHEN b.k = 1 THEN b.id END AS work_id, CASE WHEN a.k = 1 THEN 'composer_catalogue_number' WHEN b.k = 1 THEN 'unique_catalogue_number' ELSE 'no_match' END AS via FROM c LEFT JOIN a USING (n) LEFT JOIN b USING (n)""",
    "wk",
)
def catalogue_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue numbers in titles matched among a composer's works, then among all; each step unique only.

    The master is reduced to one row per number before it is joined."""
    title = F.concat(F.lit("Suite, Op. "), (F.col("work_id") % 400).cast("string"))
    rows = binding.works(spark, sf_dir).select("work_id", "composer", F.get(text.strong_tokens(title), F.lit(0)).alias("token"))
    master, wanted = rows.where("work_id % 3 > 0"), rows.withColumnRenamed("work_id", "n")
    unique = lambda *keys: master.groupBy(*keys).agg(F.count_distinct("work_id").alias("_k"), F.min("work_id").alias("_id")).where("_k = 1").drop("_k")
    found = wanted.join(unique("composer", "token").withColumnRenamed("_id", "_own"), ["composer", "token"], "left").join(unique("token"), "token", "left")
    via = cascade([(F.col("_own").isNotNull(), "composer_catalogue_number"), (F.col("_id").isNotNull(), "unique_catalogue_number")], "no_match")
    return found.select("n", F.coalesce("_own", "_id").alias("work_id"), via.alias("via"))


@query(
    "official_ranks",
    """
    WITH o AS (SELECT event_id AS n, venue_id, event_type AS grp, event_id % 4 AS url FROM ev WHERE event_id % 9 = 0), d AS (SELECT event_id, venue_id, event_type AS grp, event_id % 4 AS url FROM ev WHERE event_id % 9 > 0),
    r AS (SELECT n, event_id, row_number() OVER (PARTITION BY n ORDER BY CASE WHEN o.grp = d.grp THEN 0 ELSE 1 END, CASE WHEN o.url = d.url THEN 0 ELSE 1 END, event_id) AS rank, count(*) OVER (PARTITION BY n) AS c FROM o JOIN d USING (venue_id))
    SELECT n, event_id, (c - 1)::BIGINT AS ambiguous FROM r WHERE rank = 1""",
    "ev",
)
def official_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored event that fits an official one best: of its group first, then of its url, then the least
    id; and how many others there were."""
    rows = binding.occurrences(spark, sf_dir).select("event_id", "venue_id", F.col("event_type").alias("grp"), (F.col("event_id") % 4).alias("url"))
    official = rows.where("event_id % 9 = 0").select(F.col("event_id").alias("n"), "venue_id", F.col("grp").alias("_g"), F.col("url").alias("_u"))
    order = F.struct((F.col("grp") != F.col("_g")).cast("int"), (F.col("url") != F.col("_u")).cast("int"), "event_id")
    best = official.join(rows.where("event_id % 9 > 0"), "venue_id").groupBy("n").agg(F.min(order)["event_id"].alias("event_id"), (F.count(F.lit(1)) - 1).alias("ambiguous"))
    return best.select("n", "event_id", "ambiguous")


@query(
    "event_json",
    """
    SELECT event_id, '{"event_id":' || event_id || ',"works":' || (SELECT count(*) FROM pr WHERE pr.event_id = ev.event_id) || ',"ids":[' || coalesce((SELECT string_agg(work_id::VARCHAR, ',' ORDER BY position, work_id) FROM pr WHERE pr.event_id = ev.event_id), '') || ']}' AS document FROM ev""",
    "ev pr",
)
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as one JSON object, with a count and an ordered list from its programme."""
    listed = binding.programme(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("works"), F.array_sort(F.collect_list(F.struct("position", "work_id")))["work_id"].alias("ids"))
    rows = binding.occurrences(spark, sf_dir).select("event_id").join(listed, "event_id", "left")
    document = F.struct("event_id", F.coalesce("works", F.lit(0)).alias("works"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
    return rows.select("event_id", F.to_json(document).alias("document"))


@query(
    "schedule_cities",
    "SELECT user_id AS schedule_id, count(*) AS events, list_sort(list(DISTINCT n_name) FILTER (WHERE n_nationkey % 5 > 0)) AS cities FROM events JOIN nation ON n_nationkey = event_id % 25 GROUP BY user_id",
)
def schedule_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per schedule its events and their cities, sorted, once each, without blanks."""
    nation = binding.table(spark, sf_dir, "nation").select((F.col("n_nationkey")).alias("_n"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).otherwise("").alias("city"))
    rows = binding.usage(spark, sf_dir).select(F.col("user_id").alias("schedule_id"), (F.col("event_id") % 25).alias("_n")).join(nation, "_n")
    cities = F.array_sort(F.collect_set(F.when(F.col("city") != "", F.col("city"))))
    return rows.groupBy("schedule_id").agg(F.count(F.lit(1)).alias("events"), cities.alias("cities"))


@query(
    "productive_turns",
    """
    WITH s AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS k FROM s),
    t AS (SELECT *, (i - user_id % k + k) % k AS turn, (length(event_type) + user_id) % 3 = 0 AS productive FROM n)
    SELECT user_id, arg_min(event_type, turn) FILTER (WHERE productive) AS source, (user_id % k + coalesce(min(turn) FILTER (WHERE productive), k - 1) + 1) % k AS next FROM t GROUP BY user_id, k""",
)
def productive_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source in turn from a stored pointer that yields anything, and where the pointer goes."""
    sources = binding.usage(spark, sf_dir).select("user_id", "event_type").distinct()
    listed = sources.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s")).withColumn("k", F.size("s"))
    each = listed.select("user_id", "k", F.posexplode("s").alias("i", "source"))
    turn = F.pmod(F.col("i") - F.col("user_id") % F.col("k"), F.col("k"))
    yields = (F.length("source") + F.col("user_id")) % 3 == 0
    first = each.groupBy("user_id", "k").agg(F.min(F.when(yields, F.struct(turn.alias("turn"), "source"))).alias("f"))
    return first.select("user_id", "f.source", ((F.col("user_id") % F.col("k") + F.coalesce("f.turn", F.col("k") - 1) + 1) % F.col("k")).alias("next"))


@query(
    "event_sets",
    """
    WITH a AS (SELECT event_id, list_sort(list(DISTINCT work_id)) AS current FROM pr GROUP BY 1), b AS (SELECT event_id, list_sort(list(DISTINCT work_id)) AS desired, count(*) AS n FROM pr WHERE position < 5 GROUP BY 1)
    SELECT event_id, current = desired AS same, n AS desired, CASE WHEN current = desired THEN 'complete' WHEN desired IS NULL THEN 'empty' ELSE 'deferred' END AS outcome FROM a LEFT JOIN b USING (event_id)""",
    "pr",
)
def event_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's current works are the desired ones, and how many those are."""
    rows = binding.programme(spark, sf_dir)
    sets = lambda d, name: d.groupBy("event_id").agg(F.array_sort(F.collect_set("work_id")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    both = sets(rows, "current").join(sets(rows.where("position < 5"), "desired"), "event_id", "left")
    same = F.col("current") == F.col("desired")
    return both.select("event_id", same.alias("same"), F.col("n_desired").alias("_n"), cascade([(same, "complete"), (F.col("desired").isNull(), "empty")], "deferred").alias("outcome")).withColumnRenamed("_n", "desired")


#: A title, whether it looks like a header of names, and why it is debris.
_DEBRIS = (
    ("Piano: Anna Roe", 0, "artist_or_role_credit"), ("Anna Roe, soprano", 0, "artist_or_role_credit"), ("A. Roe", 1, "person_or_composer_header"), ("Arr. de Juan", 0, "arrangement_annotation"),
    ("Anna María Roe", 1, None), ("Sinfonía 5", 0, None), ("La mer", 0, None), ("W. Byrd", 1, "composer_or_ensemble_header"), ("", 0, None),
)


@query(
    "debris_titles",
    f"SELECT event_id, position, header = 1 AS header, reason FROM (SELECT event_id, position, {dealt_sql([d[0] for d in _DEBRIS], 'event_id + position')} AS t FROM pr) JOIN {values_sql(_DEBRIS, 'd', 'title, header, reason')} ON t = title",
    "pr",
)
def debris_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that look like headers of names, and why some are debris of a page."""
    t = dealt([d[0] for d in _DEBRIS], F.col("event_id") + F.col("position"))
    return binding.programme(spark, sf_dir).select("event_id", "position", header_like(t).alias("header"), debris_reason(t).alias("reason"))


@query(
    "new_relations",
    """
    WITH k AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS artist_id, lower(l_returnflag) AS role FROM lineitem WHERE l_linenumber % 2 = 0), m AS (SELECT l_orderkey AS event_id, max(l_linenumber) AS last FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
    SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS artist_id, lower(l_returnflag) AS role, coalesce(last, 0) AS last FROM lineitem LEFT JOIN m ON m.event_id = l_orderkey
    WHERE l_linenumber % 2 = 1 AND (l_orderkey, l_suppkey, lower(l_returnflag)) NOT IN (SELECT * FROM k)""",
)
def new_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits that an event does not have yet by artist and folded role, with its last position."""
    rows = binding.credits(spark, sf_dir).select("event_id", "position", "artist_id", text.folded_accents(F.col("role")).alias("role"))
    stored, staged = rows.where("position % 2 = 0"), rows.where("position % 2 = 1")
    last = stored.groupBy("event_id").agg(F.max("position").alias("last"))
    fresh = staged.select("event_id", "artist_id", "role").distinct().join(stored, ["event_id", "artist_id", "role"], "left_anti")
    return fresh.join(last, "event_id", "left").select("event_id", "artist_id", "role", F.coalesce("last", F.lit(0)).alias("last"))


@query(
    "event_patches",
    """
    WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '19:00' END AS o1, CASE event_id % 4 WHEN 0 THEN '19:00:00' WHEN 1 THEN '20:30' WHEN 2 THEN '' ELSE '9:15' END AS n1,
        CASE WHEN event_id % 2 = 0 THEN 'Sala A' END AS o2, CASE WHEN event_id % 5 = 0 THEN 'Sala B' ELSE 'Sala A' END AS n2, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'opera' END AS o3, 'concert' AS n3 FROM ev),
    p AS (SELECT event_id, CASE WHEN n1 = '' THEN NULL WHEN n1 = '9:15' THEN '09:15' ELSE left(n1, 5) END AS v1, o1, n2, o2, n3, nullif(o3, '') AS o3 FROM x)
    SELECT event_id, CASE WHEN v1 IS NOT NULL AND v1 IS DISTINCT FROM o1 THEN v1 END AS start_time, CASE WHEN n2 IS DISTINCT FROM o2 THEN n2 END AS room, CASE WHEN o3 IS NULL THEN n3 END AS event_type FROM p
    WHERE (v1 IS NOT NULL AND v1 IS DISTINCT FROM o1) OR n2 IS DISTINCT FROM o2 OR o3 IS NULL""",
    "ev",
)
def event_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written of matched events: changed and filled fields alone, and no row without any."""
    n = F.col("event_id")
    times = F.get(F.array(*map(F.lit, ("19:00:00", "20:30", "", "9:15"))), (n % 4).cast("int"))
    fields = {
        "start_time": (F.when(n % 3 > 0, "19:00"), times), "room": (F.when(n % 2 == 0, "Sala A"), F.when(n % 5 == 0, "Sala B").otherwise("Sala A")),
        "event_type": (F.when(n % 7 == 0, "").otherwise("opera"), F.lit("concert")),
    }
    yes, rank = F.lit(True), F.lit(1)
    patches = []
    for name in (f for f in PATCHABLE if f in fields):
        old, new = (same_value(name, c) for c in fields[name])
        plan = field_plan(old, new, yes, yes, rank, rank, F.lit(name == "event_type"))
        patches.append(F.when(plan.isin("change", "fill_missing"), new).alias(name))
    rows = binding.occurrences(spark, sf_dir).select("event_id", *patches)
    return rows.where("start_time is not null or room is not null or event_type is not null")


@query(
    "foreign_key_actions",
    """
    SELECT l_orderkey AS event_id, l_linenumber AS position, CASE WHEN s_suppkey IS NOT NULL THEN l_suppkey END AS artist_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 10 > 0 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 8 > 0""",
)
def foreign_key_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after parents went: those of a deleted event go with it, a deleted artist leaves a null."""
    rows = binding.credits(spark, sf_dir).select("event_id", "position", "artist_id")
    events = binding.occurrences(spark, sf_dir).where("event_id % 10 > 0").select("event_id")
    artists = binding.artists(spark, sf_dir).where("artist_id % 8 > 0").select("artist_id", F.col("artist_id").alias("_kept"))
    kept = rows.join(events, "event_id", "left_semi").join(artists, "artist_id", "left")
    return kept.select("event_id", "position", F.col("_kept").alias("artist_id"))


@query(
    "new_profiles",
    "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey ELSE c_name END AS display_name, CASE WHEN c_custkey % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def new_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles made for users who have none, from metadata with defaults."""
    n = F.col("c_custkey")
    meta = F.to_json(F.struct(F.when(n % 3 > 0, F.col("c_name")).alias("name"), F.when(n % 2 == 0, "de").alias("language")))
    mail = F.concat(F.lit("user"), n.cast("string"), F.lit("@h.org"))
    name = text.first_non_empty(F.get_json_object(meta, "$.name"), F.substring_index(mail, "@", 1))
    rows = binding.table(spark, sf_dir, "customer").select(n.alias("user_id"), name.alias("display_name"), F.coalesce(F.get_json_object(meta, "$.language"), F.lit("en")).alias("language"))
    return rows.join(binding.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id", "left_anti")


@query(
    "calendar_texts",
    """
    SELECT e.event_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || e.event_id || '@h' || chr(13) || chr(10) || 'DTSTART:' || strftime(ts, '%Y%m%dT%H%M') || '00' || chr(13) || chr(10) || 'DTEND:' || strftime(ts, '%Y%m%d') || 'T' || strftime(ts + INTERVAL 2 HOUR, '%H%M') || '00' || chr(13) || chr(10)
      || 'SUMMARY:' || event_type || '\\, ' || e.event_id || chr(13) || chr(10) || CASE WHEN e.event_id % 4 > 0 THEN 'LOCATION:' || n_name || '\\; hall' || chr(13) || chr(10) ELSE '' END || 'END:VEVENT' AS entry
    FROM events e JOIN nation ON n_nationkey = e.event_id % 25""",
)
def calendar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar entries: start, an end two hours later by the clock where none is known, summary, and the
    location where there is one."""
    n, ts = F.col("event_id"), F.col("ts")
    rows = binding.usage(spark, sf_dir).join(binding.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_n"), "n_name"), F.col("event_id") % 25 == F.col("_n"))
    place = F.when(n % 4 > 0, F.concat(F.lit("LOCATION:"), text.ics_escape(F.concat("n_name", F.lit("; hall")))))
    parts = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), n.cast("string"), F.lit("@h")), F.concat(F.lit("DTSTART:"), F.date_format(ts, "yyyyMMdd'T'HHmm'00'")),
        F.concat(F.lit("DTEND:"), F.date_format(ts, "yyyyMMdd'T'"), F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "HHmm'00'")),
        F.concat(F.lit("SUMMARY:"), text.ics_escape(F.concat_ws(", ", "event_type", n.cast("string")))), place, F.lit("END:VEVENT"),
    ]
    return rows.select("event_id", F.concat_ws("\r\n", *parts).alias("entry"))


@query(
    "title_keys_compat",
    r"""
    WITH h AS (SELECT doc_id, lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1))) || CASE doc_id % 3 WHEN 0 THEN ' Notturno no. 5' WHEN 1 THEN ' «x» (1685-1750) nocturne' ELSE ' [live] numero 7' END AS t FROM documents)
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '\s*\((ca\.\s*)?\d{3,4}(\s*[-–—]\s*(ca\.\s*)?\d{2,4})?\s*\)', ' ', 'g'), '\[[^\]]*\]|\([^)]*\)|[«»“”"*+†]', ' ', 'g'), '\b(numero|no\.?)\s*', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key FROM h""",
)
def title_keys_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys as older data have them, where number words also go at the beginning of longer words."""
    n = F.col("doc_id")
    end = F.when(n % 3 == 0, " Notturno no. 5").when(n % 3 == 1, " «x» (1685-1750) nocturne").otherwise(" [live] numero 7")
    heading = F.concat(F.substring_index(text.text_or_empty(F.col("text")), "\n", 1), end)
    return binding.articles(spark, sf_dir).select("doc_id", text.title_key_compat(heading).alias("title_key"))


_ITEMS = ("Concierto 5", "(arreglo)", "Suite", "violín, piano", "(bis)", "Obertura")


@query(
    "continued_items",
    f"""
    WITH l AS (SELECT event_id, position, min({dealt_sql(_ITEMS, 'event_id + position')}) AS t FROM pr GROUP BY ALL), g AS (SELECT *, prefix(t, '(') OR prefix(lower(t), 'violín,') AS more FROM l),
    s AS (SELECT *, sum(CASE WHEN more THEN 0 ELSE 1 END) OVER (PARTITION BY event_id ORDER BY position) AS item FROM g)
    SELECT event_id, item::BIGINT AS item, string_agg(t, ' ' ORDER BY position) AS text FROM s WHERE item > 0 GROUP BY event_id, item""",
    "pr",
)
def continued_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a programme with the lines that go on from them; what continues nothing is left out."""
    line = dealt(_ITEMS, F.col("event_id") + F.col("position"))
    lines = binding.programme(spark, sf_dir).select("event_id", "position", line.alias("t")).distinct()
    more = F.col("t").startswith("(") | F.lower("t").startswith("violín,")
    item = F.sum(F.when(more, 0).otherwise(1)).over(Window.partitionBy("event_id").orderBy("position"))
    rows = lines.withColumn("item", item).where("item > 0")
    return rows.groupBy("event_id", "item").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "t")))["t"], " ").alias("text"))


@query(
    "fetch_outcomes",
    """
    WITH o AS (SELECT event_id, 'https://h.org/' || (event_id % 300) AS url FROM ev)
    SELECT event_id, url, CASE WHEN event_id % 300 % 7 > 0 THEN 'body of ' || url ELSE '' END AS body, CASE WHEN event_id % 300 % 7 = 0 THEN 'status 404' END AS error FROM o""",
    "ev",
)
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of every distinct page joined to all its occurrences; a page that failed is an empty record
    with its error, never a lost row."""
    url = F.concat(F.lit("https://h.org/"), (F.col("event_id") % 300).cast("string"))
    rows = binding.occurrences(spark, sf_dir).select("event_id", url.alias("url"))
    once = rows.select("url").distinct()
    failed = F.substring_index("url", "/", -1).cast("int") % 7 == 0
    got = once.select("url", F.when(failed, "").otherwise(F.concat(F.lit("body of "), "url")).alias("body"), F.when(failed, "status 404").alias("error"))
    return rows.join(got, "url", "left").select("event_id", "url", "body", "error")


@query(
    "schedule_html",
    """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, '<h3>' || strftime(ts, '%Y-%m-%d') || '</h3><ul>' || string_agg('<li>' || strftime(ts, '%H:%M') || ' ' || event_type || ' &amp; ' || event_id || '</li>', '' ORDER BY ts, event_id) || '</ul>' AS part FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id, CAST(ts AS DATE), strftime(ts, '%Y-%m-%d'))
    SELECT user_id, string_agg(part, '' ORDER BY day) AS body FROM d GROUP BY user_id""",
)
def schedule_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule's mail as HTML: by date, and by time within a date."""
    rows = binding.usage(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    item = F.concat(F.lit("<li>"), F.date_format("ts", "HH:mm"), F.lit(" "), html.escaped(F.concat_ws(" & ", "event_type", F.col("event_id").cast("string"))), F.lit("</li>"))
    days = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ts", "event_id", item.alias("t"))))["t"], "").alias("items"))
    part = F.concat(F.lit("<h3>"), F.col("day").cast("string"), F.lit("</h3><ul>"), "items", F.lit("</ul>"))
    return days.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("day", part.alias("t"))))["t"], "").alias("body"))


@query(
    "parser_conflicts",
    """
    WITH l AS (SELECT event_id, position, (event_id + position) % 3 AS k FROM pr)
    SELECT event_id, bool_or((k = 0 AND position <= 3) OR (k = 1 AND position > 3)) AS conflict FROM l GROUP BY event_id""",
    "pr",
)
def parser_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which one parser took a line for an artist's and the other for a programme's, or the reverse."""
    artist = ("artist_candidate", "role_candidate", "cast_candidate", "artistic_team_candidate")
    programme = ("composer_candidate", "composer_attribution", "work_candidate", "movement_candidate", "programme_heading", "section_heading", "annotation", "freeform_programme")
    kind = dealt(["work_candidate", "role_candidate", "unknown"], F.col("event_id") + F.col("position"))
    pages = binding.programme(spark, sf_dir).groupBy("event_id").agg(F.collect_list(F.struct("position", kind.alias("class"), (F.col("position") <= 3).alias("as_artist"))).alias("lines"))
    conflict = F.exists("lines", lambda x: (x["as_artist"] & x["class"].isin(*programme)) | (~x["as_artist"] & x["class"].isin(*artist)))
    return pages.select("event_id", conflict.alias("conflict"))


@query(
    "outcome_branches",
    """
    WITH s AS (SELECT event_id, status || '/' || event_id // 2 AS key, event_id // 3 AS url, count(*) OVER (PARTITION BY status || '/' || event_id // 2) AS c FROM ev),
    t AS (SELECT status || '/' || event_id // 2 AS key, count(DISTINCT event_id) AS n, min(event_id) AS id FROM ev WHERE event_id % 4 > 1 GROUP BY 1), u AS (SELECT DISTINCT event_id // 3 AS url FROM ev WHERE event_id % 4 > 1)
    SELECT s.event_id, CASE WHEN c > 1 THEN 'many_to_one' WHEN t.n > 1 THEN 'one_to_many' WHEN t.n = 1 AND t.id % 5 = 0 THEN 'must_reconcile' WHEN t.n = 1 AND t.id % 7 = 0 THEN 'configuration_error' WHEN t.n = 1 AND s.event_id % 3 = 0 THEN 'blocked' WHEN t.n = 1 THEN 'safe_update'
           WHEN u.url IS NOT NULL THEN 'url_only' ELSE 'safe_insert' END AS outcome
    FROM s LEFT JOIN t ON t.key = s.key LEFT JOIN u ON u.url = s.url""",
    "ev",
)
def outcome_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged events by every branch of reconciliation: an identity staged twice or found more than once; of
    one match a stored row without event key, one that was not loaded, a field that would be downgraded, or
    an update; without a match an url that is known, for review, or an insert."""
    n = F.col("event_id")
    rows = binding.occurrences(spark, sf_dir).select("event_id", F.concat_ws("/", "status", F.expr("cast(event_id div 2 as string)")).alias("key"), F.expr("event_id div 3").alias("url"))
    stored = rows.where(n % 4 > 1)
    found = stored.groupBy("key").agg(F.count_distinct("event_id").alias("_n"), F.min("event_id").alias("_id"))
    twice = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_staged"))
    known = rows.join(twice, "key").join(found, "key", "left").join(stored.select("url", F.lit(True).alias("_url")).distinct(), "url", "left")
    one = F.col("_n") == 1
    outcome = cascade(
        [
            (F.col("_staged") > 1, "many_to_one"),
            (F.col("_n") > 1, "one_to_many"),
            (one & (F.col("_id") % 5 == 0), "must_reconcile"),
            (one & (F.col("_id") % 7 == 0), "configuration_error"),
            (one & (n % 3 == 0), "blocked"),
            (one, "safe_update"),
            (F.col("_url"), "url_only"),
        ],
        "safe_insert",
    )
    return known.select("event_id", outcome.alias("outcome"))
