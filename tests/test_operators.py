from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veduta.operators import merge
from veduta.operators.dedup import pick_best, unique_match
from veduta.operators.line_classes import classify_lines, split_lines
from veduta.operators.matching import candidate_names, match_steps, meeting_keys, positional_runs, rarest_first, similar_names, tier_score
from veduta.operators.reconcile import collision_guard, field_plan, reconcile, same_value, worst_rank
from veduta.operators.rules import canonical_event_type
from veduta.operators.sequences import anchored_groups, carry_forward, round_robin, running_budget

ROWS = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=8)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pick_best_keeps_rows_without_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "p"), (None, 5, "q")], "k string, o int, v string")
    got = rows(pick_best(df, ["k"], [F.col("o")], keep_keyless=True).select(F.coalesce("k", F.lit("-")), "v"))
    assert got == [("-", "p"), ("-", "q"), ("a", "y")]


@FEW
@given(data=ROWS)
def test_pick_best_ignores_row_order(spark, data):
    schema = "k int, o int"
    one = rows(pick_best(spark.createDataFrame(data, schema), ["k"], [F.col("o")]))
    two = rows(pick_best(spark.createDataFrame(data[::-1], schema), ["k"], [F.col("o")]))
    assert one == two == sorted({k: min(o for q, o in data if q == k) for k, _ in data}.items())


@FEW
@given(target=ROWS, source=ROWS)
def test_merges_are_idempotent(spark, target, source):
    t = spark.createDataFrame(sorted(dict(target).items()), "k int, v int")
    s = spark.createDataFrame(sorted(dict(source).items()), "k int, v int")
    once = merge.upsert(t, s, ["k"])
    assert rows(once) == rows(merge.upsert(once, s, ["k"])) == sorted((dict(target) | dict(source)).items())
    added = merge.insert_ignore(t, s, ["k"])
    assert rows(added) == rows(merge.insert_ignore(added, s, ["k"])) == sorted((dict(source) | dict(target)).items())
    assert merge.set_difference(merge.replace_groups(t, s, ["k"]), once, ("a", "b")).count() == 0


def test_swap_table_checks_before_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        merge.swap_table(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3
    merge.swap_table(spark.read.parquet(path).unionByName(spark.range(5, 7).toDF("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_guards(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    report = merge.guard_report({"unique": merge.duplicate_keys(df, ["k"]), "fk": merge.orphans(df, spark.range(3).toDF("id"), "k", "id")})
    assert {r[0]: r[1] for r in report.collect()} == {"unique": 1, "fk": 0}
    with pytest.raises(ValueError, match="unique"):
        merge.assert_guards(report)


STAGED = "source string, source_event_id string, url string"
STORED = "source string, source_event_id string, url string, event_id string"


@pytest.mark.parametrize(
    "staged, stored, outcome",
    [
        ([("s", "1", "u")], [("s", "1", "u", "e1")], ["identity_match"]),
        ([("s", "1", "u"), ("s", "2", "u")], [("s", "1", "u", "e1"), ("s", "2", "u", "e2")], ["identity_match"] * 2),
        ([("s", "9", "u")], [("s", "1", "u", "e1")], ["manual_review"]),
        ([("s", "9", "v")], [("s", "1", "u", "e1")], ["safe_insert"]),
        ([("s", "1", "u"), ("s", "1", "u")], [("s", "1", "u", "e1")], ["duplicate_staging"] * 2),
        ([("s", "1", "u")], [("s", "1", "u", "e1"), ("s", "1", "w", "e2")], ["one_to_many"]),
    ],
)
def test_reconcile(spark, staged, stored, outcome):
    out = reconcile(spark.createDataFrame(staged, STAGED), spark.createDataFrame(stored, STORED), ["source", "source_event_id"], "url", "event_id")
    got = [r["outcome"] for r in out.collect()]
    assert got == outcome
    guard = collision_guard(out).first()
    assert guard["blocked"] == (set(outcome) != {"identity_match"})


def test_reconcile_deals_staged_rows_once_by_identity_and_once_by_url(spark):
    rows = [("s", "1", "u"), ("s", "1", "u"), ("s", "2", "v"), (None, "1", "u"), (None, "1", "u"), (None, "1", None), ("s", "3", "w"), ("s", "4", None)]
    staged = spark.createDataFrame(rows, STAGED)
    stored = spark.createDataFrame([("s", "2", "v", "e2"), ("s", "1", "u", "e1"), (None, "1", "u", "e3"), ("s", "5", None, "e4")], STORED)
    want = sorted(["duplicate_staging", "duplicate_staging", "identity_match", "manual_review", "manual_review", "safe_insert", "safe_insert", "safe_insert"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for urls in (None, stored.unionAll(stored).select("url")):
            out = reconcile(staged, stored, ["source", "source_event_id"], "url", "event_id", urls)
            assert sorted(r["outcome"] for r in out.collect()) == want
            assert {r["event_id"] for r in out.collect()} == {"e2", None}
            assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 2
            assert out._jdf.queryExecution().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_field_plan(spark):
    cases = [
        ("19:00", None, True, True, 1, 1, False, "protected_from_null"),
        ("19:00", "19:00", True, True, 1, 1, False, "unchanged"),
        (None, "19:00", True, True, 1, 1, False, "fill_missing"),
        (None, "19:00", True, False, 1, 1, False, "configuration_error"),
        ("opera", "concert", True, True, 1, 1, True, "preserved"),
        ("a", "b", True, True, 3, 1, False, "quality_downgrade"),
        ("a", "b", True, True, 1, 3, False, "change"),
        ("a", "b", False, True, 1, 1, False, "absent"),
        (None, "", True, True, 1, 1, False, "unchanged"),
    ]
    df = spark.createDataFrame(cases, "o string, n string, p boolean, l boolean, a int, b int, c boolean, want string")
    plan = field_plan(*[F.col(c) for c in ("o", "n", "p", "l", "a", "b", "c")])
    assert all(r[0] == r[1] for r in df.select(plan, "want").collect())


def test_matching_is_unique_or_review(spark):
    cand = spark.createDataFrame([(1,), (2,), (3,)], "candidate int")
    exact = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "candidate int, id string")
    alias = spark.createDataFrame([(1, "z"), (3, "d"), (3, "d")], "candidate int, id string")
    got = rows(match_steps(cand, "candidate", [("exact", exact), ("alias", alias)], "id").select("candidate", F.coalesce("id", F.lit("-")), "status"))
    assert got == [(1, "a", "exact"), (2, "-", "ambiguous"), (3, "d", "alias")]
    assert rows(unique_match(exact, ["candidate"], "id").select("candidate", "matches")) == [(1, 1), (2, 2)]


def _names(n, seed, length=(1, 24), letters="abcdefghij klmnop-é"):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        name = "".join(r.choice(letters) for _ in range(r.randint(*length))).strip()
        out.add(name)
        edited = list(name)
        for _ in range(r.randint(0, 4)):  # near copies, so that similar pairs exist at every level
            k = r.randrange(len(edited) + 1)
            edited[k : k + r.randint(0, 1)] = r.choice(["", "a", "zz"])
        out.add("".join(edited).strip())
    return sorted(x for x in out if x)


@pytest.mark.parametrize("least", [0.6, 0.7, 0.78, 0.86, 0.95, 1.0])
def test_candidate_names_miss_no_pair(spark, least):
    names = _names(220, int(least * 100))
    df = spark.createDataFrame([(n,) for n in [*names, "", *names[:9]]], "name string")
    got = {(r["_a"], r["_b"]) for r in candidate_names(df, df, "name", least).collect()}
    similar = {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= least}
    assert similar <= got
    assert len(got) < (0.9 if least < 0.7 else 0.12) * len(names) ** 2


def test_candidate_names_are_few_and_keys_are_small(spark):
    """12,000 names of common syllables: candidates below 0.1 % of all pairs, no key over 1 % of rows."""
    syllables = F.array(*[F.lit(a + b) for a in "bcdfglmnprstvz" for b in ("a", "e", "i", "on", "u")])
    part = lambda k: F.get(syllables, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(70)).cast("int"))
    names = spark.range(12_000).select(F.concat(*[F.lit(" ") if k == 3 else part(k) for k in range(7)]).alias("name"))
    assert candidate_names(names, names, "name", 0.86).count() < 0.001 * 12_000**2
    runs = positional_runs(names, "name")
    keys = meeting_keys(names.join(rarest_first(runs, "name", runs.groupBy("q", "run").count().withColumnRenamed("count", "n")), "name"), "name", 0.86, True)
    total, most = keys.groupBy("grp").count().agg(F.sum("count"), F.max("count")).first()
    assert most <= 0.01 * total


def test_similar_names_blocks_losslessly(spark):
    from difflib import SequenceMatcher

    names = ["verdi", "giuseppe verdi", "g verdi", "wagner", "wagnerr", "bach", "bacch", "j s bach"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r[0], r[1]) for r in similar_names(df.select(F.col("name").alias("l"), "name"), df.select(F.col("name").alias("r"), "name"), "name", "l", "r", 0.6, 99).collect()}
    assert got == {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.6}


def test_scores_and_types(spark):
    df = spark.createDataFrame([("red", "red"), ("red bolt", "red"), ("a red bolt", "red"), ("blue", "red"), ("x", "")], "v string, n string")
    assert [r[0] for r in df.select(tier_score(F.col("v"), F.col("n"))).collect()] == [1.0, 0.9, 0.8, 0.0, 0.0]


TYPES = {
    "Opéra en concert": "opera", "Opérette": "operetta", "operetta night": "operetta", "children_s_opera": "opera", "Drame musical": "opera", "Festival Ring": "opera",
    "Récital": "recital", "Concert recital": "recital", "chamber_music": "concert", "Symphonie": "concert", "musique_de_chambre": "chamber_music", "Ballet": "ballet", "dance-concert": "concert",
    "matinée": "matinee", "CHILDREN_FAMILY": "children_family", "talk": "other", None: "other",
}


def test_event_types(spark):
    kinds = spark.createDataFrame([(k,) for k in TYPES], "k string")
    assert {r[0]: r[1] for r in kinds.select("k", canonical_event_type(F.col("k"))).collect()} == TYPES


def test_states_without_verdict(spark):
    df = spark.createDataFrame([(["HUMAN_CONFIRMED", None, "odd"], 1), (["review_required", "canonical_verified"], 0), ([None], None), ([], None)], "s array<string>, want int")
    assert all(r[0] == r[1] for r in df.select(worst_rank(F.col("s")), "want").collect())
    times = spark.createDataFrame([("19:00", "19:00:00"), ("9:05", "09:05"), ("19:00", "19:00:30")], "o string, n string")
    same = [r[0] for r in times.select(same_value("start_time", F.col("o")).eqNullSafe(same_value("start_time", F.col("n")))).collect()]
    assert same == [True, True, False]


def test_sequences(spark):
    df = spark.createDataFrame([(1, 1, "c", "A"), (1, 2, "w", None), (1, 3, "c", None), (1, 4, "w", None)], "p int, n int, kind string, v string")
    carried = carry_forward(df, ["p"], [F.col("n")], F.col("kind") == "c", F.col("v"), "composer").orderBy("n")
    assert [r["composer"] for r in carried.collect()] == ["A", "A", None, None]
    spent = running_budget(df.withColumn("cost", F.lit(4)), ["p"], [F.col("n")], "cost", 9).orderBy("n")
    assert [r["accepted"] for r in spent.collect()] == [True, True, True, False]
    turns = round_robin(spark.createDataFrame([("a",), ("b",), ("c",)], "s string"), "s", F.col("s"), 2).orderBy("s")
    assert [r["turn"] for r in turns.collect()] == [1, 2, 0]


def test_line_classes(spark):
    page = "Season\n\nProgramme:\nSonata in A\n- encore\nJ Bach\nA long line of prose about the evening that follows the name\nRoom 12"
    lines = split_lines(spark.createDataFrame([(1, 0, page)], "page int, block int, text string"), "page", "block", "text")
    got = [r["class"] for r in classify_lines(lines, "page", ["block", "line"]).orderBy("block", "line").collect()]
    assert got == ["title", "blank", "header", "entry", "item", "name", "prose", "number"]


@FEW
@given(values=st.lists(st.integers(0, 60), max_size=12))
def test_anchored_groups(spark, values):
    values, want, anchor = sorted(float(v) for v in values), [], None
    for v in values:
        if anchor is None or v - anchor > 7:
            anchor = v
            want.append((want[-1] if want else -1) + 1)
        else:
            want.append(want[-1])
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(anchored_groups(F.col("v"), 7.0)).first()[0] == want
