"""Matching of noisy names to masters: unique match or review, never a guess.

Fuzzy similarity is evidence for a reviewer; it assigns nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veduta.functions.text import exact_name, person_key, search_key_unicode
from veduta.operators.rules import cascade


def last_alias(masters: DataFrame, aliases: str, key: str, normal: Callable[[Column], Column]) -> DataFrame:
    """(key, id): every alias in an array column by its normalised key; of equal keys the last id counts."""
    each = masters.select(F.col(key).alias("id"), F.explode(aliases).alias("_a"))
    return each.groupBy(normal(F.col("_a")).alias("key")).agg(F.max("id").alias("id"))


def lookup_statuses(inputs: DataFrame, key: str, raw: str, gate: Column, master: DataFrame, aliases: DataFrame) -> DataFrame:
    """Inputs with ``status`` and ``composer_id``, looked up among canonical names and aliases.

    A reason from ``gate`` makes a ``false_positive_input``. Names in lower case without life span are
    tried first, then keys of letters and digits. The first of the two steps that finds anyone decides:
    one composer is a match (``exact`` or ``alias``, ``normalized_exact`` or ``normalized_alias``; by alias
    if no canonical name fits), several are ``ambiguous``, and so is a single word that would stand for
    a canonical name of several words. Nothing found is ``unmatched``. Similar names are never assigned.

    ``master`` has composer_id and canonical_name, ``aliases`` composer_id and alias. Both are reduced to
    one row per key before the join, so that a key of many composers and inputs does not multiply."""
    names = master.select("composer_id", F.col("canonical_name").alias("_name"), F.lit(0).alias("_alias"), "canonical_name")
    known = names.unionByName(aliases.join(master, "composer_id").select("composer_id", F.col("alias").alias("_name"), F.lit(1).alias("_alias"), "canonical_name"))
    gated = inputs.withColumn("_gate", gate)
    open_ = gated.where(F.col("_gate").isNull())
    found = None
    for step, normal in enumerate((exact_name, person_key)):
        right = known.groupBy(normal(F.col("_name")).alias("_k")).agg(
            F.count_distinct("composer_id").alias("_n"), F.min("composer_id").alias("composer_id"), F.min("_alias").alias("_alias"),
            F.max((F.col("_alias") == 0) & person_key(F.col("canonical_name")).contains(" ")).alias("_several_words"),
        )
        single = ~person_key(F.col(raw)).contains(" ")
        hit = open_.select(key, normal(F.col(raw)).alias("_k"), single.alias("_single")).join(right, "_k")
        one = hit.select(key, "_n", "composer_id", "_alias", (F.col("_single") & F.col("_several_words")).alias("_surname"), F.lit(step).alias("_step"))
        found = one if found is None else found.unionByName(one)
    assert found is not None
    first = found.groupBy(key).agg(F.min_by(F.struct("_n", "composer_id", "_alias", "_surname", "_step"), F.col("_step")).alias("_f"))
    rows = gated.join(first, key, "left")
    f = F.col("_f")
    status = cascade(
        [
            (F.col("_gate").isNotNull(), "false_positive_input"),
            (f.isNull(), "unmatched"),
            ((f["_n"] > 1) | f["_surname"], "ambiguous"),
            ((f["_alias"] == 1) & (f["_step"] == 0), "alias"),
            (f["_alias"] == 1, "normalized_alias"),
            (f["_step"] == 0, "exact"),
        ],
        "normalized_exact",
    )
    matched = status.isin("alias", "normalized_alias", "exact", "normalized_exact")
    return rows.select(*inputs.columns, F.col("_gate").alias("reason"), status.alias("status"), F.when(matched, f["composer_id"]).alias("composer_id"))


def match_steps(candidates: DataFrame, candidate: str, steps: Sequence[tuple[str, DataFrame]], target: str) -> DataFrame:
    """candidate, target, status, matches.

    Every step is a relation (candidate, target) made by an equi-join of its own. The first step
    with any target decides: one distinct target is a match with the step's name as status,
    several are ``ambiguous``; candidates that no step finds are ``unmatched``."""
    found: DataFrame | None = None
    for no, (name, pairs) in enumerate(steps):
        one = pairs.groupBy(candidate).agg(F.count_distinct(target).alias("matches"), F.min(target).alias(target)).withColumn("_step", F.lit(no)).withColumn("_name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    assert found is not None
    best = found.groupBy(candidate).agg(F.min(F.struct("_step", "_name", "matches", target)).alias("b"))
    joined = candidates.select(candidate).distinct().join(best, candidate, "left")
    matches = F.coalesce("b.matches", F.lit(0))
    status = cascade([(matches == 0, "unmatched"), (matches > 1, "ambiguous")], F.col("b._name"))
    return joined.select(candidate, F.when(matches == 1, F.col(f"b.{target}")).alias(target), status.alias("status"), matches.cast("long").alias("matches"))


def match_keys(candidates: DataFrame, candidate: str, masters: DataFrame, target: str, steps: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """As ``match_steps``, each step being (name, key of a candidate, key of a master), for candidates and masters that
    have one row each. Masters are reduced to one row a key before they are joined, so that a key of many masters and
    candidates does not multiply; null keys match nothing."""
    rows = candidates
    for no, (_, own, known) in enumerate(steps):
        one = masters.groupBy(known.alias(f"_k{no}")).agg(F.count_distinct(target).alias(f"_n{no}"), F.min(target).alias(f"_t{no}"))
        rows = rows.withColumn(f"_k{no}", own).join(one, f"_k{no}", "left")
    first = lambda c: F.coalesce(*[F.when(F.col(f"_n{no}") > 0, c(no, name)) for no, (name, _, _) in enumerate(steps)])
    matches = F.coalesce(first(lambda no, _: F.col(f"_n{no}")), F.lit(0))
    status = cascade([(matches == 0, "unmatched"), (matches > 1, "ambiguous")], first(lambda _, name: F.lit(name)))
    return rows.select(candidate, F.when(matches == 1, first(lambda no, _: F.col(f"_t{no}"))).alias(target), status.alias("status"), matches.cast("long").alias("matches"))


def _letter_counts(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.length(c) - F.length(F.replace(c, F.char(i), F.lit(""))))


def sequence_ratio(a: Column, b: Column, in_place: bool = False) -> Column:
    """Similarity 2M / (|a| + |b|) of two texts, M being the characters in matching blocks; 0 for a null.

    ``in_place`` keeps the optimizer from moving it below joins and filters that leave few pairs."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, p, q).ratio() if isinstance(p, str) and isinstance(q, str) else 0.0 for p, q in zip(x, y, strict=True)], dtype=float)

    return (ratio.asNondeterministic() if in_place else ratio)(a, b)


def common_run(least: float, longest: int = 400) -> int:
    """Characters in a row that two different names of similarity ``least`` share at the very least.

    M matching characters of L in both leave L - 2M unmatched, which part the match into L - 2M + 1
    blocks at most, so the longest block has M / (L - 2M + 1) characters or more."""
    found = longest
    for total in range(2, 2 * longest):
        matching = ceil(least * total / 2 - 1e-9)
        if (gap := total - 2 * matching) > 0:
            found = min(found, ceil(matching / (gap + 1)))
    return found


#: Lengths of the runs of characters in which names meet, the most selective first, and the parts into
#: which names are dealt that can only meet by their lengths.
RUNS, PARTS = (3, 2), 32


def _shared_rule(n: Column, m: Column, least: float) -> dict[str, Column]:
    """What two names of lengths ``n`` and ``m`` and similarity ``least`` must share.

    M matching characters are a common subsequence, so at least ``common`` = least (n + m) / 2 characters
    stay in order and the others are ``lost``. One that is lost destroys q runs of q characters of its own name
    and parts q - 1 runs of the other, so ``kept`` runs are in both; ``q`` is the longest run that leaves one
    (0: none does), and a run that stays moves by ``shift`` places at the most."""
    common = F.ceil(least * (n + m) / 2 - 1e-9).cast("int")
    lost = n + m - 2 * common
    kept = {q: common - (q - 1) * lost - q + 1 for q in RUNS}
    q = cascade([(kept[q] >= 1, F.lit(q)) for q in RUNS], F.lit(0))
    return {"common": common, "lost": lost, "q": q, "kept": cascade([(q == r, kept[r]) for r in RUNS], F.lit(0)), "shift": F.greatest(n, m) - common}


def positional_runs(names: DataFrame, key: str) -> DataFrame:
    """(key, q, run, at): all runs of the lengths RUNS of distinct names, with their places."""
    each = None
    for q in RUNS:
        at = F.explode(F.sequence(F.lit(1), F.length(key) - q + 1)).alias("at")
        one = names.where(F.length(key) >= q).select(key, F.lit(q).alias("q"), at).withColumn("run", F.substring(F.col(key), F.col("at"), F.lit(q)))
        each = one if each is None else each.unionByName(one)
    assert each is not None
    return each.select(key, "q", "run", "at")


def rarest_first(runs: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """(key, q2, q3, ...): per name its runs of each length by frequency, run and place."""
    ranked = runs.join(often, ["q", "run"]).groupBy(key, "q").agg(F.sort_array(F.collect_list(F.struct("n", "run", "at"))).alias("_r"))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("q") == q, F.col("_r"))).alias(f"q{q}") for q in RUNS])


def meeting_keys(ranked: DataFrame, key: str, least: float, left: bool, beyond: int = -1) -> DataFrame:
    """(key, grp, at, shift): the keys in which a name meets names of each length that it may be like.

    Of the runs in both names the rarest is among the first of either name that exceed by one the runs which
    may be missing, so only these are keys, one set for each length of the other name. Lengths that
    ensure no common run are keys themselves, dealt to PARTS on the left and repeated on the right. Only lengths at which more than ``beyond`` characters
    may be lost have keys."""
    n, share = F.length(key), least / (2 - least)
    lengths = F.sequence(F.greatest(F.ceil(n * share - 1e-9), F.lit(1)).cast("int"), F.floor(n / share + 1e-9).cast("int"))
    rows = ranked.withColumn("_m", F.explode(lengths))
    rule = _shared_rule(n, F.col("_m"), least)
    pair = (n, F.col("_m")) if left else (F.col("_m"), n)
    rows = rows.select("*", *[c.alias(f"_{name}") for name, c in rule.items()]).where((F.col("_common") <= F.least(n, F.col("_m"))) & (F.col("_lost") > beyond))
    own = cascade([(F.col("_q") == q, F.col(f"q{q}")) for q in RUNS], F.lit(None))
    by_run = rows.where("_q > 0").withColumn("_e", F.explode(F.slice(own, F.lit(1), n - F.col("_q") + 1 - F.col("_kept") + 1)))
    grp = lambda run: F.struct(*[c.cast("int").alias(name) for c, name in zip(pair, "nm", strict=True)], "_q", run.alias("run")).alias("grp")
    by_run = by_run.select(key, grp(F.col("_e.run")), F.col("_e.at").alias("at"), F.col("_shift").alias("shift"))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int") if left else F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    by_length = rows.where("_q = 0").withColumn("_part", part)
    return by_run.unionByName(by_length.select(key, grp(F.col("_part").cast("string")), F.lit(0).alias("at"), F.lit(0).alias("shift")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have: few bytes may still be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Lost characters up to which names meet in halves: a half then loses two at the most.
HALVED = 5


def shortest_beyond(least: float, most: int = HALVED) -> int:
    """The least length of a name that may lose, with another of similarity ``least``, more than ``most`` characters."""
    share, n = least / (2 - least), 1
    while least < 1:
        for m in range(max(ceil(n * share - 1e-9), 1), int(n / share + 1e-9) + 1):
            common = ceil(least * (n + m) / 2 - 1e-9)
            if common <= min(n, m) and n + m - 2 * common > most:
                return n
        n += 1
    return 1 << 30


def _without(s: Column, k: int) -> Column:
    """array<string>: a text without any ``k`` of its characters (0 to 2), each choice of them."""
    if k == 0:
        return F.array(s)
    cut = lambda p, r: s.substr(p + 1, r - p - 1)  # noqa: E731 - what lies between two places
    n = F.length(s)
    places = F.sequence(F.lit(1), n - (k - 1))
    if k == 1:
        each = F.transform(places, lambda p: F.concat(cut(F.lit(0), p), cut(p, n + 1)))
    else:
        each = F.flatten(F.transform(places, lambda p: F.transform(F.sequence(p + 1, n), lambda r: F.concat(cut(F.lit(0), p), cut(p, r), cut(r, n + 1)))))
    return F.when(n >= k, each).otherwise(F.array().cast("array<string>"))


def half_keys(names: DataFrame, key: str, lengths: DataFrame, least: float, left: bool, most: int = HALVED) -> DataFrame:
    """(key, grp): the halves in which a name meets names of the ``lengths`` (column m) where ``most`` characters are lost at most.

    Take a common subsequence of exactly ``common`` characters and cut the left name in the middle, the right one
    accordingly. Of the characters lost by both, either at most half are in the first parts or fewer than half in the
    second ones. So the left name's half without x characters is the right name's beginning or end without y for
    an x + y that is small; the greatest y that fits covers the smaller ones. Half a name is long and loses little, so
    it is rare where single runs are not, such as those of a first word that many names share."""
    own, other = F.length(key), F.col("m")
    n, m = (own, other) if left else (other, own)
    rule = _shared_rule(n, m, least)
    rows = spread(names.select(key), key).crossJoin(F.broadcast(lengths)).select(key, n.alias("_n"), m.alias("_m"), rule["common"].alias("_c"), rule["lost"].alias("_lost"))
    rows = rows.where((F.col("_c") <= F.least("_n", "_m")) & (F.col("_lost") <= most))
    n, m, common, lost = (F.col(c) for c in ("_n", "_m", "_c", "_lost"))
    middle = F.floor(n / 2).cast("int")
    none = F.array().cast("array<string>")
    hashed = lambda part, texts: F.transform(F.array_distinct(texts), lambda t: F.xxhash64(n, m, F.lit(part), t))
    keys = []
    for part, long_, most_lost in ((1, middle, F.floor(lost / 2)), (2, n - middle, F.floor((lost - 1) / 2))):
        for x in range(most // 2 + 1):
            stays = long_ - x
            y = F.least(m - common, most_lost - x).cast("int")
            fits = (F.lit(x) <= n - common) & (F.lit(x) <= most_lost) & stays.between(0, common)
            if left:
                texts = _without(F.substring(key, F.lit(1), long_) if part == 1 else F.substring(key, middle + 1, long_), x)
            else:
                held = F.substring(key, F.lit(1), stays + y) if part == 1 else F.substring(key, m - stays - y + 1, stays + y)
                texts = cascade([(y == k, _without(held, k)) for k in range(most // 2 + 1)], none)
            keys.append(F.when(fits, hashed(part, texts)).otherwise(F.array().cast("array<bigint>")))
    return rows.select(key, F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("grp"))


def candidate_names(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """(_a, _b): distinct pairs of names that may have a similarity of ``least`` or more; none is missed.

    Every name is looked at once, however many rows have it. Names of exact lengths at which few characters may be lost meet
    in halves, others in their rarest runs of characters, at nearly the same place; then the letters they have in
    common, counted once a name, must be enough."""
    both = [df.select(F.col(key).alias("_name"), F.lit(side).alias("_s")) for side, df in ((1, left), (2, right))]
    names = both[0].unionByName(both[1]).where("_name != ''").groupBy("_name").agg(F.bit_or("_s").alias("_s"))
    long_ = spread(names.where(F.length("_name") >= shortest_beyond(least)), "_name")
    runs = positional_runs(long_, "_name")
    often = runs.groupBy("q", "run").agg(F.count(F.lit(1)).alias("n"))
    letters = F.struct(_letter_counts(F.col("_name")).alias("n"), F.length(F.regexp_replace("_name", "[a-z]", "")).alias("o"))
    ranked = long_.join(rarest_first(runs, "_name", often), "_name", "left")
    of = lambda side: F.col("_s").bitwiseAND(side) > 0
    keys = {c: meeting_keys(ranked.where(of(side)), "_name", least, side == 1, HALVED).withColumnRenamed("_name", c) for c, side in (("_a", 1), ("_b", 2))}
    met = keys["_a"].join(keys["_b"].select("_b", "grp", F.col("at").alias("_at")), "grp").where(F.abs(F.col("at") - F.col("_at")) <= F.col("shift"))
    counted = names.select("_name", letters.alias("_l"))
    lengths = {side: names.where(of(side)).select(F.length("_name").alias("m")).distinct() for side in (1, 2)}
    halves = [half_keys(names.where(of(side)), "_name", lengths[3 - side], least, side == 1).withColumnRenamed("_name", c) for c, side in (("_a", 1), ("_b", 2))]
    pairs = met.select("_a", "_b").unionByName(halves[0].join(halves[1], "grp").select("_a", "_b")).distinct()
    for c in ("_a", "_b"):
        pairs = pairs.join(counted.withColumnsRenamed({"_name": c, "_l": f"{c}l"}), c)
    common = F.aggregate(F.zip_with("_al.n", "_bl.n", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return pairs.where(2.0 * (common + F.least("_al.o", "_bl.o")) >= least * (F.length("_a") + F.length("_b")) - 1e-9).select("_a", "_b")


def similar_names(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, least: float, top: int) -> DataFrame:
    """(left_id, right_id, score, rank): for every left key its ``top`` right keys of similarity
    2M / (|a| + |b|) at ``least`` or more (M: characters in matching blocks), equal scores by right_id.

    ``candidate_names`` gives the pairs to compare, without loss. From a similarity of about 0.7 a
    common run is certain and candidates are few; below, names meet by length alone, which is for
    vocabularies, as pairs then grow with the square of the names of a length."""
    pairs = candidate_names(left, right, key, least)
    scored = spread(pairs, "_a").withColumn("score", sequence_ratio(F.col("_a"), F.col("_b"), in_place=True)).where(F.col("score") >= least)
    rows = lambda df, i, c: df.select(F.col(i).alias(f"{c}i"), F.col(key).alias(c)).where(f"{c} != ''").distinct()
    named = scored.join(rows(left, left_id, "_a"), "_a").join(rows(right, right_id, "_b"), "_b").select(F.col("_ai").alias(left_id), F.col("_bi").alias(right_id), "score")
    order = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def tier_score(value: Column, needle: Column) -> Column:
    """1.0 equal, 0.9 prefix, 0.8 contained, else 0; an empty needle scores 0."""
    return cascade([(needle == "", 0.0), (value == needle, 1.0), (value.startswith(needle), 0.9), (value.contains(needle), 0.8)], 0.0)


def search_parts(values: Sequence[Column], needle: Column) -> Column:
    """Struct (tier, ratio) of some columns of a row for a needle: the best tier of any of them, and
    the best sequence ratio. Keys are compared; null and empty values score 0."""
    key = search_key_unicode(needle)
    keys = [search_key_unicode(v) for v in values]
    tier = F.greatest(F.lit(0.0), *[tier_score(k, key) for k in keys], F.lit(0.0))
    # An empty needle or value scores 0 without being compared.
    ratios = [sequence_ratio(F.when(key != "", key), F.when(k != "", k)) for k in keys]
    return F.struct(tier.alias("tier"), F.greatest(F.lit(0.0), *ratios, F.lit(0.0)).alias("ratio"))


def search_score(*parts: Column) -> Column:
    """The best tier of all searched columns, or where none of them has a tier the best ratio.

    ``parts`` are results of ``search_parts``, so entities can be scored once before they are joined."""
    tier = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(p["tier"], F.lit(0.0)) for p in parts])
    return F.when(tier > 0, tier).otherwise(F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(p["ratio"], F.lit(0.0)) for p in parts]))
