"""Review of names against masters and retrieved evidence, and indexes that keep ambiguity as a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veduta.operators.rules import cascade

#: Kinds of evidence, the strongest first, and what a name is if nothing stronger is known.
EVIDENCE = {
    "verified": "confirmed_new_global_composer",
    "other_role": "not_a_composer",
    "attribution": "source_attribution_review",
    "malformed": "malformed_source",
    "fragment": "incomplete_identity_review",
}


def key_multimap(rows: DataFrame, id_: str, *keys: Column) -> DataFrame:
    """(key, ids, ambiguous): the sorted distinct ids of every non-empty key; several ids are ambiguous.

    A row is indexed by each of ``keys``, for instance by a name and by its normalised form."""
    each = rows.select(F.col(id_).alias("_id"), F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("key != ''")
    counted = each.groupBy("key").agg(F.sort_array(F.collect_set("_id")).alias("ids"))
    return counted.withColumn("ambiguous", F.size("ids") > 1)


def identity_statuses(names: DataFrame, name: str, masters: DataFrame, aliases: DataFrame, evidence: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """(name, status, composer_id, proposed_alias) of distinct names: one of eight outcomes.

    ``masters``: composer_id and canonical_name; ``aliases``: composer_id and alias; ``evidence``: name, kind (of
    EVIDENCE) and canonical. A name verified as a canonical one that the master has, while its own spelling is unknown,
    is a ``global_alias_gap``; a known name or alias is an ``existing_global_identity``; then the strongest evidence
    decides, and without any a name is ``unresolved_identity``. Of several masters or pieces of evidence the least counts."""
    order = F.create_map(*[F.lit(x) for i, kind in enumerate(EVIDENCE) for x in (kind, i)])
    best = evidence.where(F.col("kind").isin(*EVIDENCE)).groupBy(F.col("name").alias("_name")).agg(F.min(F.struct(order[F.col("kind")].alias("o"), "canonical", "kind")).alias("_e"))
    known = masters.groupBy(normal(F.col("canonical_name")).alias("_k")).agg(F.min("composer_id").alias("_id"))
    other = aliases.groupBy(normal(F.col("alias")).alias("_k")).agg(F.min("composer_id").alias("_id"))
    own = known.select("_k", F.col("_id").alias("_own")).join(other.select("_k", F.col("_id").alias("_alias")), "_k", "full")
    rows = names.select(F.col(name).alias("name")).distinct().withColumn("_k", normal(F.col("name")))
    rows = rows.join(best, rows["name"] == best["_name"], "left").join(own, "_k", "left")
    verified = F.col("_e.kind") == "verified"
    hint = F.when(verified, normal(F.col("_e.canonical")))
    rows = rows.withColumn("_h", hint).join(known.select(F.col("_k").alias("_h"), F.col("_id").alias("_hinted")), "_h", "left")
    gap = F.col("_hinted").isNotNull() & F.col("_alias").isNull() & (F.col("_h") != F.col("_k"))
    existing = F.coalesce("_own", "_alias")
    status = cascade([(gap, "global_alias_gap"), (existing.isNotNull(), "existing_global_identity"), *[(F.col("_e.kind") == k, s) for k, s in EVIDENCE.items()]], "unresolved_identity")
    proposed = F.when((gap | (verified & existing.isNull())) & (F.col("_h") != F.col("_k")), F.col("name"))
    return rows.select("name", status.alias("status"), F.when(gap, F.col("_hinted")).otherwise(existing).alias("composer_id"), proposed.alias("proposed_alias"))
