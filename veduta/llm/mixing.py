"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.llm.tables import stored, without, word_count

#: Weights of the sources in code-point order (null last), repeating.
SOURCE_WEIGHTS = (5, 2, 1)
#: Numerator and denominator of the mix's size against all sizes, and a source's epochs at most.
SHARE, MOST_EPOCHS = (3, 2), 2
#: Quality weight of a document by its label; unlabelled documents weigh 1.
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
#: Ranges of the sampling key in which prefix sums run independently of each other.
KEY_RANGES = 1024


def source_targets(sources: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS) -> DataFrame:
    """(source, source_size) -> also ``target``: the words the mix should take of each source.

    Targets are in proportion to the weights and add up to SHARE of all sizes; a target stops at
    MOST_EPOCHS times its source's size and the excess is shared again by weight. That fixed point
    is reached in one pass: in order of cap / weight the capped sources form a prefix, and a
    source is capped if the level left by those before it would lift it above its cap. One row per
    source enters, so these unpartitioned windows see as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("_no"), F.lit(len(weights))) + 1)
    ranked = sources.withColumn("_no", F.row_number().over(by_name) - 1).withColumn("_w", pick.cast("long"))
    filling = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_no").asc())
    before, whole = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    num, den = SHARE
    levelled = ranked.select(
        "source", "source_size", "_w", "_no",
        (F.lit(num) * F.sum("source_size").over(whole) - F.lit(den * MOST_EPOCHS) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_rest"),
        (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_left"),
    )
    capped = F.col("_w") * F.col("_rest") > F.lit(den * MOST_EPOCHS) * F.col("source_size") * F.col("_left")
    level = levelled.withColumn("_capped", capped)
    after = Window.orderBy(F.col("_capped").asc(), (F.col("source_size") / F.col("_w")).asc(), F.col("_no").asc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = level.withColumn("_level", F.first(F.struct("_rest", "_left")).over(after))
    even = (F.col("_w") * F.col("_level._rest")).cast("double") / (F.lit(den) * F.col("_level._left")).cast("double")
    most = (F.lit(MOST_EPOCHS) * F.col("source_size")).cast("double")
    return shared.select("source", "source_size", F.when(F.col("_capped"), most).otherwise(even).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """Uniform in (0, 1) from an MD5 of key and seed, the same in every run."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(2.0**48)


def mix_documents(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[int] = SOURCE_WEIGHTS, seed: int = 7, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs, fraction_words (and the
    column ``row`` that numbers rows, where given).

    size is the number of words (null or blank text: 0), target that of the document's source, and
    taken the words the mix takes of it. A source is first taken whole as often as its target
    allows (``epochs``); the rest of the budget goes to its documents in the order of their
    Efraimidis-Spirakis keys -ln(u) / quality weight, by prefix sums of sizes, the last document
    up to the budget (``fraction_words``). So a source's taken words equal its target rounded down.

    Prefix sums run inside KEY_RANGES ranges of the key and are offset by the sums of the ranges
    before, so a source with a third of all rows is spread over as many groups. A null source is a
    source; rows with equal keys are ordered by doc_id and size, and repeated rows count each, one
    after the other. A row without doc_id is keyed by its text, so that such rows spread as well.
    Sources themselves are few: one row of each passes through one task (``source_targets``).
    Without ``labels`` (doc_id, quality) every document weighs 1; a document with several labels
    takes the largest."""
    number = F.lit(0).cast("long") if row is None else F.col(row)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    thin = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), name.alias("_name"), number.alias("_row"))
    if labels is None:
        thin = thin.withColumn("_quality", F.lit(None).cast("int"))
    else:
        one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_quality"))
        thin = thin.join(one, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    weight = F.lit(1.0)
    for label, w in QUALITY_WEIGHTS.items():
        weight = F.when(F.col("_quality") == label, F.lit(w)).otherwise(weight)
    key = -F.log(uniform(F.col("_name"), seed)) / weight
    keyed = thin.select("doc_id", "source", "size", "_row", key.alias("_key")).withColumn(
        "_range", F.least(F.lit(KEY_RANGES - 1), F.floor((1 - F.exp(-F.col("_key"))) * KEY_RANGES).cast("int"))
    )
    rows = stored(keyed)
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("_source"), F.col("_range").alias("_in"), "_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = summed.join(plan, summed["source"].eqNullSafe(plan["_source"]) & (summed["_range"] == plan["_in"]))
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("epochs", epochs).withColumn("_budget", whole - F.col("epochs") * F.col("source_size"))
    room = F.col("_budget") - F.col("_before") - F.col("_inside")
    out = out.withColumn("fraction_words", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), room)))
    columns = ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("fraction_words")).alias("taken"), "epochs", "fraction_words"]
    return out.select(*columns, *([] if row is None else [F.col("_row").alias(row)]))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, weights: Sequence[int] = SOURCE_WEIGHTS, seed: int = 7, whole: bool = False) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``.

    A document comes once per epoch of its source, and once more if the source's last, fractional
    epoch takes it. The one document of a source that crosses the budget's end is cut to the words
    within it (``n_chars``, where there is such a column, follows), so that rows hold the words of
    ``mix_documents``; with ``whole`` it comes with its full text if that ends nearer to the budget
    than leaving it out, or else not once more, and every row is one of ``docs``. Documents that the mix takes
    nothing of, those without words among them, do not come. Rows that repeat a doc_id are taken
    one by one, so that together they never pass the budget.

    The rows are numbered and stored once; numbers and word counts alone are mixed, and the texts
    taken are joined by their number, which spreads them evenly whatever their ids are."""
    rows = stored(without(docs, "_mix_row", "_mix_epochs", "_mix_fraction", "_mix_words", "_mix_take").withColumn("_mix_row", F.monotonically_increasing_id()))
    mixed = mix_documents(rows, labels, weights, seed, "_mix_row").where("epochs > 0 or fraction_words > 0")
    wanted = mixed.select("_mix_row", F.col("size").alias("_mix_words"), F.col("epochs").alias("_mix_epochs"), F.col("fraction_words").alias("_mix_fraction")).where("_mix_words > 0")
    joined = rows.join(wanted, "_mix_row")
    if whole:
        taken_whole = 2 * F.col("_mix_fraction") >= F.col("_mix_words")
        joined = joined.withColumn("_mix_fraction", F.when(taken_whole, F.col("_mix_words")).otherwise(F.lit(0).cast("long")))
    copies = F.transform(F.sequence(F.lit(1), F.col("_mix_epochs")), lambda _: F.col("_mix_words"))
    copies = F.when(F.col("_mix_epochs") > 0, copies).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(copies, F.when(F.col("_mix_fraction") > 0, F.array("_mix_fraction")).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn("_mix_take", F.explode(copies))
    if whole:
        return each.select(*[F.col(f"`{c}`") for c in docs.columns])
    head = F.array_join(F.slice(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"), F.lit(1), F.col("_mix_take").cast("int")), " ")
    cut = each.withColumn("text", F.when(F.col("_mix_take") < F.col("_mix_words"), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        uncut = F.col("_mix_take") == F.col("_mix_words")
        cut = cut.withColumn("n_chars", F.when(uncut, F.col("n_chars")).otherwise(F.length("text").cast("long")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])
