"""Small helpers shared by the operators: reading tables, cutting lineage, ASCII folding."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary one is made in local mode (tests), which is one machine; on a
    cluster that is an error, as executors would not see a folder of the driver."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="veduta-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table of its own in the shared folder and reads it.

    Unlike a checkpoint, a table has statistics of its own. After several rounds of joins, the
    estimates that a checkpoint inherits grow beyond all measure and hold up planning. A table that
    nothing reads any more goes by ``discard``; what a returned DataFrame reads stays as long as
    the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veduta-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored`` that no DataFrame still to be run reads."""
    for df in frames:
        if path := df.__dict__.pop("_stored_at", None):
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII text (bytes = characters) takes the fast ``lower``."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009-U+000D; null counts 0."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns whose name (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
