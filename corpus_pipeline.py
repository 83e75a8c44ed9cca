"""A corpus pipeline of five stages over ``documents``.

Every stage works on all that its predecessor kept, and all but the last return the columns of
``documents``. Edge cases are those of the operators: texts that are null, empty or without letters
are rejected by the first stage; repeated rows stay repeated until near-dedup and mixing decide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.decontamination import decontaminated
from veduta.llm.language_id import UNDETERMINED, identify_languages
from veduta.llm.mixing import mixed_documents
from veduta.llm.near_dedup import without_near_duplicates
from veduta.llm.sharding import with_shards, with_slots
from veduta.llm.tables import shared_folder, table

#: Least score of the predicted language.
LEAST_SCORE = 0.5
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; null, empty and letterless texts go."""
    return identify_languages(docs).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least doc_id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples whole documents so that sources come nearest to their target weights."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"), whole=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row into a shard and a slot of it."""
    return with_slots(with_shards(docs, "doc_id", [1.0] * SHARDS), "doc_id", ["n_chars"])


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: SQL expresses neither the classifier nor the near-duplicate search; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; what each one keeps is written as Parquet and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
