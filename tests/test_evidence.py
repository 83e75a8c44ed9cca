from __future__ import annotations

from pyspark.sql import functions as F

from veduta.operators.evidence import identity_statuses, key_multimap


def test_each_of_eight_outcomes(spark):
    names = spark.createDataFrame([(n,) for n in ("Known", "Alias", "Spelt", "New", "Singer", "Maybe", "Broken", "A. B.", "Nobody", "Known")], "n string")
    masters = spark.createDataFrame([(1, "known"), (2, "Spelled")], "composer_id int, canonical_name string")
    aliases = spark.createDataFrame([(7, "ALIAS")], "composer_id int, alias string")
    evidence = spark.createDataFrame(
        [("Spelt", "verified", "spelled"), ("New", "verified", "New One"), ("New", "fragment", None), ("Singer", "other_role", None), ("Maybe", "attribution", None), ("Broken", "malformed", None), ("A. B.", "fragment", None), ("Known", "other_role", None), ("Nobody", "rumour", None)],
        "name string, kind string, canonical string",
    )
    got = {r["name"]: (r["status"], r["composer_id"], r["proposed_alias"]) for r in identity_statuses(names, "n", masters, aliases, evidence, lambda c: F.lower(F.trim(c))).collect()}
    assert got == {
        "Known": ("existing_global_identity", 1, None),
        "Alias": ("existing_global_identity", 7, None),
        "Spelt": ("global_alias_gap", 2, "Spelt"),
        "New": ("confirmed_new_global_composer", None, "New"),
        "Singer": ("not_a_composer", None, None),
        "Maybe": ("source_attribution_review", None, None),
        "Broken": ("malformed_source", None, None),
        "A. B.": ("incomplete_identity_review", None, None),
        "Nobody": ("unresolved_identity", None, None),
    }


def test_multimap_keeps_ambiguity(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "ab"), (3, ""), (4, None)], "id int, t string")
    got = {r["key"]: (r["ids"], r["ambiguous"]) for r in key_multimap(rows, "id", F.lower("t"), F.replace(F.lower("t"), F.lit(" "), F.lit(""))).collect()}
    assert got == {"a b": ([1], False), "ab": ([1, 2], True)}
