"""Programme pages read line by line: classes, page structures, split names and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta import binding
from veduta.functions import lines as L
from veduta.operators.page_structure import classify_programme, page_structures
from veduta.plans.registry import query
from veduta.plans.vocabulary import dealt, dealt_sql, values_sql

#: Pages by title and structure; of every line its block and its class, worked out by hand from the rules.
_PAGES = (
    ("Ciclo sinfónico 4", "SEPARATE_ARTIST_PROGRAMME_BLOCKS", (
        (0, "Orquesta Nacional", "artist_candidate"), (0, "Marta Gil, director", "artist_candidate"), (1, "Gustav Mahler", "composer_candidate"), (1, "Titan", "work_candidate"),
        (1, "I. Langsam", "composer_candidate"), (1, "Johannes Brahms", "work_candidate"), (1, "Obertura trágica", "work_candidate"))),
    ("Recital", "ARTIST_ROLE_ALTERNATING", (
        (0, "Anna Roe", "artist_candidate"), (0, "piano", "role_candidate"), (0, "John Doe", "artist_candidate"), (0, "violín", "role_candidate"),
        (0, "Ludwig van Beethoven", "composer_candidate"), (0, "Sonata op. 5", "work_candidate"), (0, "Allegro", "movement_candidate"))),
    ("Noche de ópera: Il trovatore", "CAST_OR_STAGED_WORK", (
        (0, "Leonora – Maria Pia", "cast_candidate"), (0, "Movimiento escénico – Juan Sanz", "artistic_team_candidate"), (0, "Giuseppe Verdi (1813–1901)", "composer_candidate"),
        (0, "Il trovatore", "work_candidate"), (0, "PAUSA", "section_heading"))),
    ("Programa de mano", "PROGRAMME_MARKER_MIXED_BLOCK", (
        (0, "Programa:", "programme_heading"), (0, "BACH Suite francesa", "work_candidate"), (0, "W. A. Mozart: Concierto 21", "work_candidate"), (0, "Obras de varios autores", "annotation"),
        (0, "*Estreno absoluto", "annotation"), (0, "II", "section_heading"))),
    ("Red Bull Symphonic 2031", "FREEFORM_PROGRAMME", (
        (0, "Orchestra Nova", "artist_candidate"), (0, "Pau Roca-Vidal, dirección", "artist_candidate"), (0, "Star Wars", "freeform_programme"), (0, '"E.T."', "section_heading"))),
    ("Aula de cámara", "STATUS_NOTICE_PLUS_CONTENT", (
        (0, "Concierto aplazado", "status_notice"), (0, "al 3 de mayo", "status_notice"), (0, "Clara Roe, soprano", "artist_candidate"), (0, "Variaciones", "artist_candidate"),
        (0, "J. S. Bach variaciones", "work_candidate"), (0, "sobre un tema", "work_candidate"))),
    ("Ciclo", "COMPOSER_LIFESPAN_SEQUENCE", (
        (0, "Tradicional de Galicia/Juan Pérez (1950)", "composer_attribution"), (0, "Clara Schumann (1819-1896)", "composer_candidate"), (0, "Tres romanzas", "work_candidate"),
        (0, "Franz Liszt (1811-1886)", "composer_candidate"), (0, "Arreglo de Juan", "annotation"), (0, "andante", "movement_candidate"))),
    ("Gala", "INLINE_COMPOSER_WORK", (
        (0, "Coro de la ciudad", "artist_candidate"), (0, "una velada larga sin nombre propio de nadie en absoluto hoy", "unknown"), (0, "Lili Boulanger Nocturne", "work_candidate"),
        (0, "Pablo Casals (cello)", "work_candidate"), (0, "CASALS", "section_heading"))),
)
_CLASSES = values_sql([(i, n, kind) for i, (_, _, lines) in enumerate(_PAGES) for n, (_, _, kind) in enumerate(lines)], "k", "template, n, class")
_STRUCTURES = values_sql([(i, s, len(lines)) for i, (_, s, lines) in enumerate(_PAGES)], "s", "template, structure, lines")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, title, block, line, text: every event has one of the pages above."""
    pages = F.array(*[F.struct(F.lit(t).alias("title"), F.array(*[F.struct(F.lit(b).alias("block"), F.lit(n).alias("line"), F.lit(v).alias("text")) for n, (b, v, _) in enumerate(ls)]).alias("lines")) for t, _, ls in _PAGES])
    own = binding.occurrences(spark, sf_dir).select(F.col("event_id").alias("page"), F.get(pages, F.pmod("event_id", F.lit(len(_PAGES))).cast("int")).alias("_p"))
    return own.select("page", F.col("_p.title").alias("title"), F.inline("_p.lines"))


def _classified(spark: SparkSession, sf_dir: str, *keep: str, features: tuple[str, ...] = ()) -> DataFrame:
    return classify_programme(_lines(spark, sf_dir), "page", "block", "line", "text", "title", keep=keep, features=features)


@query("programme_line_classes", f"SELECT event_id AS page, n AS line, class FROM ev JOIN {_CLASSES} ON template = event_id % {len(_PAGES)}", "ev")
def programme_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line of every programme page."""
    return _classified(spark, sf_dir, "line").select("page", "line", "class")


@query("programme_structures", f"SELECT event_id AS page, structure, lines FROM ev JOIN {_STRUCTURES} ON template = event_id % {len(_PAGES)}", "ev")
def programme_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of every programme page."""
    return page_structures(_classified(spark, sf_dir, "block", "title", features=("spanned",)), "page", "block", "text", "title")


@query(
    "structure_summary",
    f"""
    WITH l AS (SELECT event_id, class FROM ev JOIN {_CLASSES} ON template = event_id % {len(_PAGES)})
    SELECT class, count(*) AS lines, count(DISTINCT event_id) AS pages, round(100.0 * count(*) / (SELECT count(*) FROM l), 2)::DOUBLE AS percentage, 0::BIGINT AS risky FROM l GROUP BY class""",
    "ev",
)
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and pages by class, and composers' lines that may be something else."""
    risky = (F.col("class") == "composer_candidate") & F.col("_risk")
    rows = _classified(spark, sf_dir, features=("risk",)).select("page", "class", risky.alias("risk"))
    by_page = rows.groupBy("page", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if("risk").alias("r"))  # lines lie by page: no shuffle
    by_class = by_page.groupBy("class").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("pages"), F.sum("r").alias("risky"))
    whole = F.sum("lines").over(Window.partitionBy())  # over the classes, fourteen rows at most
    return by_class.select("class", "lines", "pages", F.round(100.0 * F.col("lines") / whole, 2).alias("percentage"), "risky")


#: A line, and its composer and work where it holds both.
_INLINE = (
    ("El amor brujo. Manuel de Falla (1876–1946)", "Manuel de Falla (1876–1946)", "El amor brujo"),
    ("RAVEL – Bolero", "RAVEL", "Bolero"),
    ("Bolero, Ludwig van Beethoven", "Ludwig van Beethoven", "Bolero"),
    ("Pavana (Gabriel Fauré)", "Gabriel Fauré", "Pavana"),
    ("Igor Stravinsky Tango", "Igor Stravinsky", "Tango"),
    ("HAYDN Trío", "HAYDN", "Trío"),
    ("Anna Roe, piano", None, None),
    ("Johann Sebastian Bach (1685-1750)", None, None),
)


@query("inline_names", f"SELECT event_id, composer, work FROM (SELECT event_id, {dealt_sql([x[0] for x in _INLINE], 'event_id')} AS t FROM ev) JOIN {values_sql(_INLINE, 'x', 'line, composer, work')} ON t = line", "ev")
def inline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composer and work of lines that hold both."""
    rows = binding.occurrences(spark, sf_dir).select("event_id", L.split_names(dealt([x[0] for x in _INLINE], F.col("event_id"))).alias("n"))
    return rows.select("event_id", "n.composer", "n.work")


#: A line and what each predicate says of it: role, role after a name, work, composer, artist, ensemble, cast, person.
_SIGNALS = (
    ("Violín", 1, 0, 0, 0, 0, 0, 0, 1),
    ("Anna Roe, violín y viola", 0, 1, 0, 0, 1, 0, 0, 0),
    ("Sinfonía de cámara", 0, 0, 1, 0, 0, 0, 0, 0),
    ("Gustav Mahler", 0, 0, 0, 1, 0, 0, 0, 1),
    ("Orquesta de Cámara", 0, 0, 0, 0, 1, 1, 0, 1),
    ("Leonora - Ana Roe", 0, 0, 0, 0, 0, 0, 1, 0),
    ("BWV 1007", 0, 0, 1, 1, 0, 0, 0, 0),
    ("J. S. BACH", 0, 0, 0, 1, 0, 0, 0, 1),
    ("Spark de 5 músicos", 0, 0, 0, 0, 0, 1, 0, 0),
    ("Ana Roe (1920-1990)", 0, 0, 0, 1, 0, 0, 0, 0),
    ("Concierto de Ana Roe, piano", 0, 1, 1, 0, 0, 0, 0, 0),
    ("", 0, 0, 0, 0, 0, 0, 0, 0),
)
_SIGNAL_COLUMNS = ("role", "suffix", "work", "composer", "artist", "ensemble", "actor", "person")


@query(
    "line_signals",
    f"SELECT event_id, {', '.join(f'{c} = 1 AS {c}' for c in _SIGNAL_COLUMNS)} FROM (SELECT event_id, {dealt_sql([s[0] for s in _SIGNALS], 'event_id')} AS t FROM ev) JOIN {values_sql(_SIGNALS, 'x', ', '.join(('line', *_SIGNAL_COLUMNS)))} ON t = line",
    "ev",
)
def line_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight predicates of lines."""
    rows = binding.occurrences(spark, sf_dir).select("event_id", dealt([s[0] for s in _SIGNALS], F.col("event_id")).alias("text"))
    rows, f = L.with_features(rows, "text", "artist", "cast")
    return rows.select("event_id", *[f["cast" if c == "actor" else c].alias(c) for c in _SIGNAL_COLUMNS])


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, title, block, line, text: a conversation is a page, its turns are blocks, cut at full stops and line ends;
    the first turn's beginning is the title."""
    said = binding.lines(spark, sf_dir).select("page", F.col("line_no").alias("block"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.\n]+")).alias("line", "text"))
    first = binding.lines(spark, sf_dir).groupBy("page").agg(F.substring(F.min_by("text", "line_no"), 1, 20).alias("title"))
    return said.withColumn("text", F.trim("text")).join(first, "page")


_JOINTS = ", ".join(f"'{j}'" for j in L.NAME_JOINTS)


@query(
    "spoken_line_features",
    f"""
    WITH s AS (SELECT page, line_no AS block, unnest(regexp_split_to_array(coalesce(text, ''), '[.\\n]+')) AS raw, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.\\n]+'), 1) - 1 AS line FROM li),
    t AS (SELECT page, block, line, trim(raw) AS text, regexp_extract_all(trim(raw), '[A-Za-zÀ-ÿ.’''-]+') AS ws FROM s)
    SELECT page, block, line::INTEGER AS line,
           NOT regexp_matches(text, '\\p{{Nd}}') AND len(ws) BETWEEN 1 AND 6 AND len(list_filter(ws, lambda w: NOT (trim(lower(w), '.') IN ({_JOINTS}) OR regexp_matches(w, '^\\p{{Lu}}')))) = 0 AS person,
           regexp_matches(trim(text), '^[ivxlcdmIVXLCDM]+$') AS numeral,
           len(regexp_split_to_array(trim(text), '\\s+')) <= 8 AS brief,
           regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '\\p{{Ll}}') AND len(regexp_split_to_array(trim(text), '\\s+')) <= 6 AS capitals
    FROM t""",
    "li",
)
def spoken_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sentence of the conversations says of itself, worked out once for each distinct one."""
    lines = _spoken(spark, sf_dir).drop("title")
    names = ("person", "numeral", "brief", "capitals")
    return lines.join(L.features_of(lines, "text", *names), "text").select("page", "block", "line", *[F.col(f"_{n}").alias(n) for n in names])


@query("spoken_line_classes")
def spoken_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every sentence of every conversation, read as a programme page."""
    return classify_programme(_spoken(spark, sf_dir), "page", "block", "line", "text", "title").select("page", "block", "line", "class")
