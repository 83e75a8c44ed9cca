"""Searches of many words in many texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta import binding
from veduta.operators.needles import first_needles, needle_hits
from veduta.plans.registry import query

_WORDS = """
    n AS (SELECT needle, min(rank) AS rank FROM (
            SELECT 2 * p_partkey AS rank, p_name AS needle FROM part UNION ALL SELECT 2 * s_suppkey + 1, s_name FROM supplier
            UNION ALL SELECT 1000000 + conv_id * 100 + turn, substr(text, 2, 8) FROM conversations) WHERE needle <> '' GROUP BY needle)"""


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, needle): names of works and artists, and eight characters of what was said."""
    works = binding.works(spark, sf_dir).select((2 * F.col("work_id")).alias("rank"), F.col("title").alias("needle"))
    artists = binding.artists(spark, sf_dir).select((2 * F.col("artist_id") + 1).alias("rank"), F.col("artist_name").alias("needle"))
    said = binding.lines(spark, sf_dir).select((1_000_000 + F.col("page") * 100 + F.col("line_no")).alias("rank"), F.substring("text", 2, 8).alias("needle"))
    return works.unionByName(artists).unionByName(said)


@query(
    "first_needle_of_documents",
    f"""
    WITH {_WORDS.strip()},
    h AS (SELECT doc_id, rank, needle FROM documents JOIN n ON contains(text, needle)),
    b AS (SELECT doc_id, min(rank) AS rank, count(*) AS needles FROM h GROUP BY doc_id)
    SELECT doc_id, b.rank, (SELECT min(h.needle) FROM h WHERE h.doc_id = documents.doc_id AND h.rank = b.rank) AS needle, coalesce(needles, 0) AS needles FROM documents LEFT JOIN b USING (doc_id)""",
)
def first_needle_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of some thousand rules whose words a document holds, and how many it holds."""
    return first_needles(binding.articles(spark, sf_dir), "doc_id", "text", _needles(spark, sf_dir), "needle", "rank")


@query(
    "titles_holding_words",
    """
    WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part WHERE p_size = 7) WHERE length(word) >= 3),
    h AS (SELECT p_partkey AS work_id, word FROM part JOIN w ON contains(lower(p_name || ' ' || p_type), word))
    SELECT work_id, count(*) AS words, string_agg(word, ',' ORDER BY word) AS held FROM h GROUP BY work_id""",
)
def titles_holding_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a vocabulary that are contained in titles, as parts of words too."""
    works = binding.works(spark, sf_dir)
    sizes = binding.table(spark, sf_dir, "part").where("p_size = 7").select(F.explode(F.split("p_name", " ")).alias("word"))
    words = works.select(F.explode(F.split(F.lower("kind"), " ")).alias("word")).unionByName(sizes).where(F.length("word") >= 3).withColumn("rank", F.lit(0))
    texts = works.select("work_id", F.lower(F.concat_ws(" ", "title", "kind")).alias("text"))
    hits = needle_hits(texts, "work_id", "text", words, "word", "rank")
    return hits.groupBy("work_id").agg(F.count(F.lit(1)).alias("words"), F.array_join(F.sort_array(F.collect_list("needle")), ",").alias("held"))
