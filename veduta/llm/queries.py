"""The queries of this subpackage over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.decontamination import contaminated
from veduta.llm.exact_dedup import exact_duplicates
from veduta.llm.fingerprints import fingerprint_documents
from veduta.llm.html_extraction import extract_pages
from veduta.llm.language_id import identify_languages
from veduta.llm.lexical_search import rank_documents
from veduta.llm.mixing import mix_documents
from veduta.llm.near_dedup import near_duplicates
from veduta.llm.quality import score_quality
from veduta.llm.samples import held_out
from veduta.llm.sharding import shard_documents
from veduta.llm.tables import table
from veduta.llm.toxicity import score_toxicity
from veduta.llm.url_filters import judge_urls
from veduta.llm.whitening import whiten


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = identify_languages(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_mixing": op4_mixing,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op5_near_dedup": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), sh AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5
                   THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
          FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
          FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), e AS (
          SELECT x, y FROM common JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id
          WHERE 100 * i >= 75 * (p.n + q.n - i)
        ), r AS (
          SELECT doc_id, doc_id AS c FROM w
          UNION
          SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x
        ), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, m.doc_id = component_id AS kept
        FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
    "op11_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
        c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
        p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
        i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
        w AS (
          SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
          FROM p CROSS JOIN c WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs
        ), m AS (SELECT r, doc_id, 75 + (25 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM d CROSS JOIN c),
        s AS (
          SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
          FROM i JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id
        ), k AS (
          SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score
          FROM s WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d""",
    "op3_url_filters": r"""
        WITH u AS (
          SELECT page_id,
                 CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(url, '^.*?://', '', 's'), '[?#].*$', '', 's') END AS rest
          FROM pages
        ), p AS (
          SELECT page_id,
                 coalesce(translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
          FROM u
        ), j AS (
          SELECT *, CASE
            WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
            WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/'
          END AS rule FROM p
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM j""",
    "op4_mixing": r"""
        WITH lab AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (
          SELECT documents.doc_id, source,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 -ln((('0x' || substr(md5(coalesce(documents.doc_id::VARCHAR, md5(coalesce(text, ''))) || ':7'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
                   / CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS key
          FROM documents LEFT JOIN lab ON documents.doc_id = lab.doc_id
        ), s AS (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no
          FROM d GROUP BY source
        ), w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
        r AS (
          SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER b, 0) AS rest,
                 sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lft
          FROM w WINDOW b AS (ORDER BY source_size / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), c AS (SELECT *, w * rest > 4 * source_size * lft AS capped FROM r),
        lev AS (SELECT rest AS rest0, lft AS lft0 FROM c WHERE NOT capped ORDER BY source_size / w, no LIMIT 1),
        t AS (
          SELECT source, source_size,
                 CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (w * rest0)::DOUBLE / (2 * lft0)::DOUBLE END AS target
          FROM c CROSS JOIN lev
        ), x AS (
          SELECT d.doc_id, d.size, t.source_size, t.target,
                 CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               (epochs * size + least(size, greatest(0, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
        FROM x""",
}
