"""Names, keys and lookups: normalisers side by side, aliases, cascades of lookups, needles and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.functions import dates, text, urls
from veduta.functions.identity import work_identity
from veduta.operators.matching import last_alias, lookup_statuses
from veduta.operators.rules import cascade
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql
from veduta.sources import html

_NAMES = ("Frédéric CHOPIN (1810–1849)", "ŁÓDŹ Þór Ørsted", "Haydn/ Mozart ", "SINFONÍA DE LA TARDE", "«Eroica» [live] núm. 3, op. 55", "BWV 1007 y K. 331; Hob. XVI", "Siegfried (Festival RING)", "  a_b | c; ", "Œuvre n.º 5", "")
#: The names above by every normaliser, worked out by hand.
_KEYS = (
    (_NAMES[0], "frederic chopin", "frédéric chopin", "frederic chopin 1810 1849", "frederic chopin 1810 1849", "frederic chopin (1810–1849)", "frédéric chopin (1810–1849)", "(1810–1849)", "Frédéric CHOPIN (1810–1849)", "frederic chopin 1810 1849", ""),
    (_NAMES[1], "łodz þor ørsted", "łódź þór ørsted", "odz or rsted", "lodz thor orsted", "łodz þor ørsted", "łódź þór ørsted", None, "ŁÓDŹ Þór Ørsted", "odz or rsted", ""),
    (_NAMES[2], "haydn mozart", "haydn/ mozart", "haydn mozart", "haydn mozart", "haydn/ mozart", "haydn/ mozart", None, "Haydn/ Mozart", "haydn mozart", ""),
    (_NAMES[3], "sinfonia de la tarde", "sinfonía de la tarde", "sinfonia de la tarde", "sinfonia de la tarde", "sinfonia de la tarde", "sinfonía de la tarde", None, "Sinfonía de la Tarde", "sinfonia de la tarde", ""),
    (_NAMES[4], "eroica live num 3 op 55", "«eroica» [live] núm. 3, op. 55", "eroica live num 3 op 55", "eroica live num 3 op 55", "«eroica» [live] num. 3, op. 55", "«eroica» [live] núm. 3, op. 55", None, "«Eroica» [live] núm. 3, op. 55", "eroica live num 3 op 55", "op. 55"),
    (_NAMES[5], "bwv 1007 y k 331 hob xvi", "bwv 1007 y k. 331; hob. xvi", "bwv 1007 y k 331 hob xvi", "bwv 1007 y k 331 hob xvi", "bwv 1007 y k. 331; hob. xvi", "bwv 1007 y k. 331; hob. xvi", None, "BWV 1007 y K. 331; Hob. XVI", "bwv 1007 y k 331 hob xvi", "bwv 1007|k. 331|hob. xvi"),
    (_NAMES[6], "siegfried festival ring", "siegfried (festival ring)", "siegfried festival ring", "siegfried festival ring", "siegfried (festival ring)", "siegfried (festival ring)", None, "Siegfried (Festival RING)", "siegfried", ""),
    (_NAMES[7], "a_b c", "a_b | c;", "a b c", "a b c", "a_b | c;", "a_b | c;", None, "a b | c", "a b c", ""),
    (_NAMES[8], "œuvre n o 5", "œuvre n.º 5", "uvre n o 5", "oeuvre n o 5", "œuvre n.o 5", "œuvre n.º 5", None, "Œuvre n.º 5", "oeuvre n o 5", ""),
    ("", "", "", "", "", "", "", None, "", "", ""),
)
_KEY_COLUMNS = ("composer_lookup", "composer_exact", "relation_norm", "translit_norm", "fold_accents", "fold_case", "lifespan", "smart", "programme_identity", "catalogue")


@query("name_keys", f"SELECT doc_id, {', '.join(_KEY_COLUMNS)} FROM (SELECT doc_id, {dealt_sql(_NAMES, 'doc_id')} AS n FROM documents) JOIN {values_sql(_KEYS, 't', ', '.join(('name', *_KEY_COLUMNS)))} ON n = name")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name by each of ten normalisers, which differ in what they fold and keep."""
    n = F.col("n")
    keys = (
        text.person_key(n), text.exact_name(n), text.relation_key(n), text.transliterated_key(n), text.folded_accents(n), text.folded_case(n),
        text.lifespan(n), text.smart_title(text.clean_label(n)), text.festival_title(n), F.array_join(text.strong_tokens(n), "|"),
    )
    rows = binding.articles(spark, sf_dir).select("doc_id", dealt(_NAMES, F.col("doc_id")).alias("n"))
    return rows.select("doc_id", *[k.alias(c) for k, c in zip(keys, _KEY_COLUMNS, strict=True)])


@query(
    "safe_names",
    "SELECT event_id, 'Plan_' || event_id || '_1' AS file, CASE WHEN event_id % 3 = 0 THEN 'Left_Part' ELSE 'whole' END AS part, list_value('a', 'b', 'c') AS once FROM ev",
    "ev",
)
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, the first of the parts between slashes, and lists without repeats in first order."""
    n = F.col("event_id")
    file = text.safe_name(F.concat(F.lit(" Plan: "), n.cast("string"), F.lit("/#1 ")))
    raw = F.when(n % 3 == 0, "Left Part / right / ").otherwise("/ whole /")
    part = F.replace(text.slash_parts(raw)[0], F.lit(" "), F.lit("_"))
    return binding.occurrences(spark, sf_dir).select("event_id", file.alias("file"), part.alias("part"), F.array_distinct(F.array(*map(F.lit, "abacb"))).alias("once"))


_PERSON = "(upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij'))"


def _person(segment: str, key: str) -> Column:
    letters = F.translate(F.col(key).cast("string"), "0123456789", "abcdefghij")
    return F.concat_ws(" ", F.initcap(F.lower(F.col(segment))), letters)


def _composers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw names, the master's composers and its aliases, all made of customers."""
    rows = binding.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), _person("c_mktsegment", "c_custkey").alias("name"), _person("c_mktsegment", "c_nationkey").alias("clash"))
    n, name = F.col("n"), F.col("name")
    raw = dealt_columns(
        n, name, F.upper(name), F.concat(name, F.lit(" (1810–1849)")), F.concat(F.lit("«"), name, F.lit("»")), F.concat(F.lit("Maestro "), name), F.concat(F.lit("MAESTRO, "), name), F.concat(F.lit("Coro de "), name),
        F.concat(name, F.lit(" Unknown")), F.col("clash"),
    )
    inputs = rows.select(n.alias("occurrence_id"), raw.alias("raw"))
    master = rows.where("n % 11 > 0").select(n.alias("composer_id"), name.alias("canonical_name"))
    aliases = rows.where("n % 11 > 0").select(n.alias("composer_id"), F.concat(F.lit("Maestro "), name).alias("alias"))
    shared = rows.where("n % 11 > 0").select(n.alias("composer_id"), F.col("clash").alias("alias"))
    return inputs, master, aliases.unionByName(shared)


def dealt_columns(key: Column, *values: Column) -> Column:
    return F.get(F.array(*values), F.pmod(key, F.lit(len(values))).cast("int"))


_COMPOSER_SQL = f"""
    WITH c AS (SELECT c_custkey AS n, {_PERSON} AS name, {_PERSON.replace('c_custkey', 'c_nationkey')} AS clash FROM customer),
    i AS (SELECT n AS occurrence_id, CASE n % 9 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN name || ' (1810–1849)' WHEN 3 THEN '«' || name || '»' WHEN 4 THEN 'Maestro ' || name WHEN 5 THEN 'MAESTRO, ' || name
          WHEN 6 THEN 'Coro de ' || name WHEN 7 THEN name || ' Unknown' ELSE clash END AS raw, n % 9 = 6 AS gate FROM c),
    k AS (SELECT n AS composer_id, name AS key, false AS alias FROM c WHERE n % 11 > 0 UNION ALL SELECT n, 'Maestro ' || name, true FROM c WHERE n % 11 > 0 UNION ALL SELECT n, clash, true FROM c WHERE n % 11 > 0),
    e AS (SELECT occurrence_id, 1 AS step, composer_id, bool_and(alias) AS alias FROM i JOIN k ON lower(trim(replace(raw, ' (1810–1849)', ''))) = lower(key) WHERE NOT gate GROUP BY ALL
          UNION ALL SELECT occurrence_id, 2, composer_id, bool_and(alias) FROM i JOIN k ON trim(regexp_replace(lower(replace(raw, ' (1810–1849)', '')), '[^a-z]+', ' ', 'g')) = lower(key) WHERE NOT gate GROUP BY ALL),
    g AS (SELECT occurrence_id, step, count(*) AS n, min(composer_id) AS composer_id, bool_and(alias) AS alias, row_number() OVER (PARTITION BY occurrence_id ORDER BY step) AS r FROM (SELECT occurrence_id, step, composer_id, alias FROM e) GROUP BY occurrence_id, step)
    SELECT i.occurrence_id, CASE WHEN gate THEN 'false_positive_input' WHEN g.n IS NULL THEN 'unmatched' WHEN g.n > 1 THEN 'ambiguous' WHEN g.alias AND step = 1 THEN 'alias' WHEN g.alias THEN 'normalized_alias' WHEN step = 1 THEN 'exact' ELSE 'normalized_exact' END AS status,
           CASE WHEN g.n = 1 THEN g.composer_id END AS composer_id, gate, raw
    FROM i LEFT JOIN g ON g.occurrence_id = i.occurrence_id AND g.r = 1"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, master, aliases = _composers(spark, sf_dir)
    gate = cascade([(F.trim("raw") == "", "empty_composer_input"), (F.lower("raw").rlike(r"(?<!\w)(coro|orquesta|ensemble)(?!\w)"), "ensemble_input")], F.lit(None).cast("string"))
    return lookup_statuses(inputs, "occurrence_id", "raw", gate, master, aliases)


@query("composer_matches", f"SELECT occurrence_id, status, composer_id FROM ({_COMPOSER_SQL})")
def composer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names looked up among names and aliases, exactly and then normalised: unique or for review."""
    return _matched(spark, sf_dir).select("occurrence_id", "status", "composer_id")


@query(
    "match_summary",
    f"""
    SELECT count(*) AS components, count(DISTINCT raw) AS raw_names, count(*) FILTER (WHERE status = 'exact') AS exact, count(*) FILTER (WHERE status = 'alias') AS alias, count(*) FILTER (WHERE status = 'normalized_exact') AS normalized_exact,
      count(*) FILTER (WHERE status = 'normalized_alias') AS normalized_alias, count(*) FILTER (WHERE status = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE status = 'unmatched') AS unmatched, count(*) FILTER (WHERE status = 'false_positive_input') AS false_positive_input,
      count(DISTINCT composer_id) AS composers, count(*) FILTER (WHERE raw LIKE '%(1810–1849)%' AND composer_id IS NOT NULL) AS lifespan_assisted,
      round(100.0 * count(*) FILTER (WHERE status IN ('exact', 'alias', 'normalized_exact', 'normalized_alias')) / count(*), 2)::DOUBLE AS matched_percentage, round(100.0 * count(*) FILTER (WHERE status = 'unmatched') / count(*), 2)::DOUBLE AS unmatched_percentage
    FROM ({_COMPOSER_SQL})""",
)
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and shares of a matching run, in one aggregate."""
    rows = _matched(spark, sf_dir)
    named = ("exact", "alias", "normalized_exact", "normalized_alias")
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    share = lambda *s: F.bround(100.0 * count(*s) / F.count(F.lit(1)), 2)
    return rows.agg(
        F.count(F.lit(1)).alias("components"), F.count_distinct("raw").alias("raw_names"), *[count(s).alias(s) for s in (*named, "ambiguous", "unmatched", "false_positive_input")], F.count_distinct("composer_id").alias("composers"),
        F.count_if(text.lifespan(F.col("raw")).isNotNull() & F.col("composer_id").isNotNull()).alias("lifespan_assisted"), share(*named).alias("matched_percentage"), share("unmatched").alias("unmatched_percentage"),
    )


@query(
    "supplements_by_alias",
    """
    WITH s AS (SELECT p_partkey AS id, p_name AS alias FROM part), a AS (SELECT alias, max(id) AS id FROM s GROUP BY alias)
    SELECT e.event_id, a.id AS supplement, e.event_id % 3 = 1 AND a.id IS NOT NULL AS second_attempt FROM (SELECT event_id, (SELECT min(title) FROM pr JOIN wk USING (work_id) WHERE pr.event_id = ev.event_id AND position = 1) AS title FROM ev) e LEFT JOIN a ON a.alias = e.title AND e.event_id % 3 < 2""",
    "ev pr wk",
)
def supplements_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events joined to supplements by alias, where of equal aliases the last one counts; the title inside
    quotes is the second attempt."""
    supplements = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.upper("p_name"), "p_name").alias("aliases"))
    first = binding.programme(spark, sf_dir).where("position = 1").join(binding.works(spark, sf_dir).select("work_id", "title"), "work_id").groupBy("event_id").agg(F.min("title").alias("title"))
    n = F.col("event_id")
    shown = F.when(n % 3 == 1, F.concat(F.lit("Preestreno Joven ‘"), "title", F.lit("’"))).when(n % 3 == 2, F.concat(F.lit("Gala "), "title")).otherwise(F.col("title"))
    rows = binding.occurrences(spark, sf_dir).select("event_id").join(first, "event_id", "left").select("event_id", shown.alias("shown"))
    keys = last_alias(supplements, "aliases", "id", text.search_key_ascii)
    inner = F.regexp_extract("shown", r"^Preestreno Joven\s+['‘](.+?)['’]$", 1)
    tried = rows.select("event_id", text.search_key_ascii(F.col("shown")).alias("_one"), F.when(inner != "", text.search_key_ascii(inner)).alias("_two"))
    one, two = keys.select(F.col("key").alias("_one"), F.col("id").alias("_first")), keys.select(F.col("key").alias("_two"), F.col("id").alias("_second"))
    found = tried.join(one, "_one", "left").join(two, "_two", "left")
    return found.select("event_id", F.coalesce("_first", "_second").alias("supplement"), (F.col("_first").isNull() & F.col("_second").isNotNull()).alias("second_attempt"))


@query(
    "two_master_lookup",
    "SELECT p_partkey AS work_id, coalesce(s1.s_suppkey, s2.s_suppkey) AS composer_id, CASE WHEN s1.s_suppkey IS NOT NULL THEN 'master' WHEN s2.s_suppkey IS NOT NULL THEN 'alias' END AS via FROM part LEFT JOIN supplier s1 ON s1.s_suppkey = p_partkey % 150 AND s1.s_suppkey % 2 = 0 LEFT JOIN supplier s2 ON s2.s_suppkey = p_partkey % 150",
)
def two_master_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key looked up among composers and then, where they lack it, among their aliases."""
    supplier = binding.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    key = F.concat(F.lit("k"), "id")
    master = supplier.where("id % 2 = 0").select(key.alias("key"), F.col("id").alias("_master"))
    aliases = supplier.select(key.alias("key"), F.col("id").alias("_alias"))
    rows = binding.works(spark, sf_dir).select("work_id", F.concat(F.lit("k"), F.col("work_id") % 150).alias("key")).join(master, "key", "left").join(aliases, "key", "left")
    return rows.select("work_id", F.coalesce("_master", "_alias").alias("composer_id"), cascade([(F.col("_master").isNotNull(), "master"), (F.col("_alias").isNotNull(), "alias")], F.lit(None).cast("string")).alias("via"))


#: Evidence rules in order: a word and what it proves.
_NEEDLES = (("red rod", "colour of a thing"), ("RING", "cycle"), ("small", "size"), ("brand#1", "maker"), ("blue", "colour"))


@query(
    "needle_rules",
    f"SELECT work_id, arg_min(evidence, n) AS evidence, min(n) AS rule FROM wk LEFT JOIN {values_sql([(i, *r) for i, r in enumerate(_NEEDLES)], 'r', 'n, needle, evidence')} ON contains(lower(title || ' ' || composer), lower(needle)) GROUP BY work_id",
    "wk",
)
def needle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose words a text holds, in any case."""
    c = F.lower(F.concat_ws(" ", "title", "composer"))
    rules = [(c.contains(word.lower()), i) for i, (word, _) in enumerate(_NEEDLES)]
    evidence = [(c.contains(word.lower()), what) for word, what in _NEEDLES]
    return binding.works(spark, sf_dir).select("work_id", cascade(evidence, F.lit(None).cast("string")).alias("evidence"), cascade(rules, F.lit(None).cast("int")).alias("rule"))


@query(
    "contained_either_way",
    """
    WITH i AS (SELECT event_id, position, replace(title, ' ', '') || CASE WHEN position % 2 = 0 THEN 'suite' ELSE '' END AS item FROM pr JOIN wk USING (work_id)),
    c AS (SELECT event_id, work_id, replace(title, ' ', '') AS key FROM pr JOIN wk USING (work_id) WHERE position <= 3)
    SELECT i.event_id, i.position, count(DISTINCT c.work_id) AS candidates, CASE WHEN count(DISTINCT c.work_id) = 1 THEN min(c.work_id) END AS work_id FROM i JOIN c ON c.event_id = i.event_id AND (contains(item, key) OR contains(key, item)) GROUP BY i.event_id, i.position""",
    "pr wk",
)
def contained_either_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an event and the works of the same event that contain them or lie in them; one is a match."""
    rows = binding.programme(spark, sf_dir).join(binding.works(spark, sf_dir).select("work_id", "title"), "work_id")
    items = rows.select("event_id", "position", text.compact_key(F.concat("title", F.when(F.col("position") % 2 == 0, " Suite").otherwise(""))).alias("_item"))
    works = rows.where("position <= 3").select("event_id", "work_id", text.compact_key(F.col("title")).alias("_key"))
    near = items.join(works, "event_id").where(F.col("_item").contains(F.col("_key")) | F.col("_key").contains(F.col("_item")))
    found = near.groupBy("event_id", "position").agg(F.count_distinct("work_id").alias("candidates"), F.min("work_id").alias("work_id"))
    return found.withColumn("work_id", F.when(F.col("candidates") == 1, F.col("work_id")))


@query(
    "identity_guards",
    """
    WITH w AS (SELECT work_id, 'work:' || md5(composer || '|' || title) AS expected, CASE WHEN work_id % 50 = 0 THEN 'work:stale' ELSE 'work:' || md5(composer || '|' || title) END AS stored FROM wk)
    SELECT 'stale_key' AS guard, count(*) AS offenders FROM w WHERE stored <> expected
    UNION ALL SELECT 'shared_key', count(*) FROM (SELECT expected FROM w GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'alias_of_two', count(*) FROM (SELECT title FROM wk GROUP BY title HAVING count(DISTINCT composer) > 1)
    UNION ALL SELECT 'affected_count', abs((SELECT count(*) FROM w WHERE work_id % 50 = 0) - (SELECT count(*) FROM w WHERE stored = 'work:stale'))""",
    "wk",
)
def identity_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys that are stale or shared, aliases of two composers, and whether a change touches as
    many rows as planned."""
    works = binding.works(spark, sf_dir)
    key = work_identity(F.col("composer"), F.col("title"))
    rows = works.select("work_id", "title", "composer", key.alias("expected"), F.when(F.col("work_id") % 50 == 0, "work:stale").otherwise(key).alias("stored"))
    counts = (
        ("stale_key", rows.where("stored != expected")),
        ("shared_key", rows.groupBy("expected").count().where("count > 1")),
        ("alias_of_two", rows.groupBy("title").agg(F.count_distinct("composer").alias("n")).where("n > 1")),
    )
    out = rows.agg(F.abs(F.count_if(F.col("work_id") % 50 == 0) - F.count_if(F.col("stored") == "work:stale")).alias("offenders")).select(F.lit("affected_count").alias("guard"), "offenders")
    for name, offenders in counts:
        out = out.unionByName(offenders.agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("guard"), "offenders"))
    return out


@query(
    "resolved_links",
    r"""
    WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*', 0) AS origin, unnest(regexp_extract_all(html, '(?s)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href FROM pages WHERE regexp_matches(url, '^https?://'))
    SELECT page_id, href, CASE WHEN prefix(href, '/') THEN lower(origin) || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(href, '^[^?#]*', 0), '/{2,}', '/', 'g'), '/$', ''), ''), '/') END AS canonical FROM l WHERE prefix(href, '/') AND NOT regexp_matches(href, '(^/|/)\.\.?(/|$)')""",
)
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the root of their page's site, resolved and made canonical."""
    rows = binding.pages(spark, sf_dir).where(F.col("url").rlike("^https?://")).select("page_id", "url", F.explode(html.links(F.col("html"))).alias("l"))
    inner = rows.where(F.col("l.href").startswith("/") & ~F.col("l.href").rlike(r"(^/|/)\.\.?(/|$)"))
    return inner.select("page_id", F.col("l.href").alias("href"), urls.canonical_url(urls.resolved(F.col("url"), F.col("l.href"))).alias("canonical")).distinct()


@query(
    "parsed_moments",
    """
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment, CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day,
           CASE WHEN month(ts) >= 9 THEN year(ts) ELSE year(ts) - 1 END || '-09-01' AS season_start, CASE WHEN month(ts) >= 9 THEN month(ts) - 8 ELSE month(ts) + 4 END AS season_month
    FROM events""",
)
def parsed_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments read from ISO and mail forms, strict dates, and the season and season month of each."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    forms = dealt_columns(n, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts + F.expr("INTERVAL 1 HOUR"), "dd MMM yyyy HH:mm:ss '+0100'"), F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss '+0000'")), F.lit("soon"))
    day = dealt_columns(n, F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-M-d "), F.lit("2024-02-30"), F.date_format(ts, "dd/MM/yyyy"))
    first = dates.season_start(ts)
    months = dates.season_months(first)
    place = F.array_position(F.transform(months, lambda m: F.date_format(m, "yyyy-MM")), F.date_format(ts, "yyyy-MM"))
    return binding.usage(spark, sf_dir).select(
        "event_id", F.date_format(dates.parse_moment(forms), "yyyy-MM-dd HH:mm:ss").alias("moment"), F.date_format(dates.strict_iso_date(day), "yyyy-MM-dd").alias("day"),
        first.cast("string").alias("season_start"), place.cast("long").alias("season_month"),
    )


@query(
    "availability_dates",
    """
    WITH e AS (SELECT DISTINCT venue_id, date, CASE WHEN month(date) >= 9 THEN year(date) ELSE year(date) - 1 END AS season FROM ev)
    SELECT venue_id, season, list_sort(list(strftime(date, '%Y-%m-%d'))) AS dates FROM e GROUP BY venue_id, season""",
    "ev",
)
def availability_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days written out by month, in two languages, read back as dates of their season."""
    rows = binding.occurrences(spark, sf_dir).select("venue_id", "date", F.year(dates.season_start(F.col("date"))).alias("season")).distinct()
    month = F.when(F.col("venue_id") % 2 == 0, dealt(dates.MONTHS["es"], F.month("date") - 1)).otherwise(dealt(dates.MONTHS["en"], F.month("date") - 1))
    written = rows.groupBy("venue_id", "season", month.alias("month")).agg(F.concat(F.array_join(F.array_sort(F.collect_list(F.dayofmonth("date"))).cast("array<string>"), ", "), F.lit(" "), F.upper("month")).alias("t"))
    texts = written.groupBy("venue_id", "season").agg(F.array_join(F.collect_list("t"), "; ").alias("t"))
    return texts.select("venue_id", "season", dates.availability(F.col("t"), F.col("season")).alias("dates"))
