"""Reconciliation of staged records against stored state: outcomes, field plans and the guard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veduta.functions.dates import clock
from veduta.functions.text import squeeze
from veduta.operators.rules import cascade


def reconcile(staged: DataFrame, stored: DataFrame, identity: Sequence[str], url: str, stored_id: str, urls: DataFrame | None = None) -> DataFrame:
    """Staged rows with ``outcome`` and the stored row each is matched with (``stored_id`` or null).

    Order of tests: staged identity repeated (``duplicate_staging``); identity found more than once
    (``one_to_many``); identity found (``identity_match``); url found (``manual_review``: an url alone
    never identifies); else ``safe_insert``. Multiplicities are counted on each side before any
    join, so that repeated keys do not multiply; staged rows are dealt by identity once, for their
    count and the join. ``urls`` may give the urls of ``stored``, with repeats, where they can be had
    without making its rows."""
    keys = list(identity)
    named = reduce(and_, [F.col(k).isNotNull() for k in keys])
    counted = staged.withColumn("_staged", F.when(named, F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    by_identity = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("_stored"), F.min(stored_id).alias("_id"))
    by_url = (stored if urls is None else urls).where(F.col(url).isNotNull()).select(url).distinct().withColumn("_known", F.lit(True))
    joined = counted.join(by_identity, keys, "left").join(by_url, url, "left")
    outcome = cascade(
        [
            (F.col("_staged") > 1, "duplicate_staging"),
            (F.col("_stored") > 1, "one_to_many"),
            (F.col("_stored") == 1, "identity_match"),
            (F.col("_known"), "manual_review"),
        ],
        "safe_insert",
    )
    matched = F.when(outcome == "identity_match", F.col("_id")).alias(stored_id)
    return joined.select(*staged.columns, outcome.alias("outcome"), matched)


def unmatched_stored(staged: DataFrame, stored: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Stored rows without a staged counterpart: reported, never deleted."""
    return stored.join(staged.select(*identity).distinct(), list(identity), "left_anti")


def field_plan(old: Column, new: Column, present: Column, loaded: Column, old_rank: Column, new_rank: Column, curated: Column) -> Column:
    """What to do with one field of a matched row, first rule that fits:

    absent (not staged), configuration_error (stored value was not loaded), preserved (a curated
    field that has a value), unchanged, protected_from_null, fill_missing, quality_downgrade (both
    ranks known, the staged one lower), change. Empty means null or ''."""
    old_empty, new_empty = old.isNull() | (old == ""), new.isNull() | (new == "")
    return cascade(
        [
            (~present, "absent"),
            (~loaded, "configuration_error"),
            (curated & ~old_empty & ~old.eqNullSafe(new), "preserved"),
            ((old_empty & new_empty) | old.eqNullSafe(new), "unchanged"),
            (new_empty, "protected_from_null"),
            (old_empty, "fill_missing"),
            (new_rank < old_rank, "quality_downgrade"),
        ],
        "change",
    )


#: Ranks of verification states; any other state ranks 1.
QUALITY_RANKS = {"incomplete_source_data": 0, "review_required": 0, "source_verified": 1, "canonical_verified": 2, "human_confirmed": 3, "manually_confirmed": 3}


def quality_rank(state: Column) -> Column:
    """Rank of a state in any case; null, which gives no verdict, has none."""
    return cascade([(state.isNull() | (state == ""), F.lit(None).cast("int")), *[(F.lower(state) == k, v) for k, v in QUALITY_RANKS.items()]], 1)


def worst_rank(states: Column) -> Column:
    """Rank of the worst member of an array that has a state; null if none has."""
    return F.array_min(F.filter(F.transform(states, quality_rank), lambda r: r.isNotNull()))


def same_value(name: str, c: Column) -> Column:
    """What two values of a field are compared by, and what is written: times lose seconds of zero,
    titles extra white space; an empty value is null."""
    if name in ("start_time", "end_time"):
        c = clock(F.trim(c))
    elif name == "title":
        c = squeeze(c)
    return F.when(c != "", c)


#: Fields that a staged record may patch, and those that are only observed.
PATCHABLE = ("start_time", "end_time", "room", "event_type")
OBSERVED = ("artists", "classification", "credits", "data_quality", "normalization_status", "programme", "verification_status")


def observation(old: Column, new: Column) -> Column:
    """What a staged value says of a field that is never written."""
    return cascade([(old.eqNullSafe(new), "unchanged"), (new.isNull() | (new == ""), "empty_staging")], "changed_or_quality_review")


def collision_guard(outcomes: DataFrame) -> DataFrame:
    """One row: counts by outcome and ``blocked``, true unless every row is an identity match."""
    names = ("duplicate_staging", "one_to_many", "identity_match", "manual_review", "safe_insert")
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    return outcomes.agg(F.count(F.lit(1)).alias("rows"), *counts).withColumn("blocked", F.col("rows") > F.col("identity_match"))
