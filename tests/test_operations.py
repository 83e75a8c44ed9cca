from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veduta import plans
from veduta.operators import scripts
from veduta.operators.invites import register_invites
from veduta.operators.word_tables import carried_labels, in_columns, line_texts, words_to_lines
from veduta.sources.paged import Bound, pages_of, register_paged
from veduta.sources.runs import run_ingestion, source_verdicts


def test_a_run_counts_while_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "b", ""), (4, "b", None), (5, "c", "y")], "id int, source string, title string")
    scans = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    touched = rows.mapInArrow(touch, rows.schema)
    rules = {"missing": F.col("title").isNull(), "empty": F.col("title") == ""}
    sound, lost, counters = run_ingestion(touched, "source", rules, str(tmp_path / "run"), {"odd": F.col("id") % 2 == 1})
    assert counters == {"records": 5, "sound": 2, "quarantined": 3, "bad_missing": 2, "bad_empty": 1, "odd": 2}
    assert sorted(tuple(r) for r in source_verdicts(sound, lost, "source").collect()) == [("a", 1, 1, "PARTIAL"), ("b", 0, 2, "FAILED"), ("c", 1, 0, "READY")]
    assert sorted((r["id"], r["errors"]) for r in lost.collect()) == [(2, ["missing"]), (3, ["empty"]), (4, ["missing"])]
    assert scans.value == 5


def test_invites_laterally_and_beyond_credit(spark):
    register_invites(spark)
    spark.createDataFrame([(1, 10, 2, " ab "), (1, 11, 2, None), (1, 12, 2, "cd"), (1, 13, 2, "ef"), (2, 14, 0, "gh"), (3, 15, None, "ij")], "user_id long, request_id long, credits int, code string").createOrReplaceTempView("asked")
    got = spark.sql("SELECT * FROM generated_invites(TABLE(asked) PARTITION BY user_id ORDER BY request_id)").orderBy("request_id").collect()
    assert [tuple(r) for r in got] == [(1, 10, "AB", 1, True), (1, 11, None, 1, False), (1, 12, "CD", 0, True), (1, 13, None, 0, False), (2, 14, None, 0, False), (3, 15, None, 0, False)]
    lateral = spark.sql("SELECT a.request_id, g.code FROM asked a, LATERAL generated_invites(struct(a.user_id, a.request_id, a.credits, a.code)) g ORDER BY 1").collect()
    assert [r["code"] for r in lateral] == ["AB", None, "CD", "EF", None, None]  # a call for every row begins anew


def test_words_become_labelled_lines(spark):
    words = [(1, 0, 0.0, 20, "Cast"), (1, 1, 1.2, 9, "A"), (1, 9, 2.4, 9, "B"), (1, 60, 0.3, 20, "Team"), (1, 70, 1.0, 20, "lead"), (1, 61, 9.0, 9, "C"), (1, 0, 30.0, 9, "D"), (2, 3, 5.0, 9, "alone")]
    placed = words_to_lines(spark.createDataFrame(words, "p int, x int, y double, size int, t string"), "p", "x", "y")
    assert {r["t"]: r["line"] for r in placed.collect()} == {"Cast": 0, "Team": 0, "lead": 0, "A": 0, "B": 1, "C": 2, "D": 3, "alone": 0}
    lines = line_texts(in_columns(placed, "x", [50.0]), "p", "x", "t", "size")
    got = {(r["p"], r["column"], r["line"]): (r["text"], r["label"]) for r in carried_labels(lines, "p", F.col("size") > 12).collect()}
    assert got == {(1, 0, 1): ("B", "Cast A"), (1, 1, 2): ("C", "Team lead"), (1, 0, 3): ("D", "Cast A"), (2, 0, 0): ("alone", None)}


@pytest.fixture
def target(spark):
    spark.sql("DROP TABLE IF EXISTS scripted")
    spark.sql("CREATE TABLE scripted USING parquet AS SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS v(id, name)")
    yield "scripted"
    for t in ("scripted", "scripted_new"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def content(spark, table):
    spark.catalog.refreshTable(table)
    return sorted(tuple(r) for r in spark.table(table).collect())


def test_scripts_apply_or_leave_the_table_as_it_was(spark, target):
    before = content(spark, target)
    spark.createDataFrame([(2, "new"), (9, "it's")], "id int, name string").createOrReplaceTempView("staged")
    spark.createDataFrame([(2, "x"), (2, "y")], "id int, name string").createOrReplaceTempView("twice")
    for staged, baseline, guards in (("staged", 4, {}), ("twice", 3, {}), ("staged", 3, {"no_nine": "SELECT 1 FROM staged WHERE id = 9"})):
        with pytest.raises(Exception, match="baseline|twice|no_nine"):
            spark.sql(scripts.apply_script(target, staged, ["id"], ["name"], baseline, guards))
        assert content(spark, target) == before
    spark.sql(scripts.apply_script(target, "staged", ["id"], ["name"], 3, {"nothing": "SELECT 1 FROM staged WHERE id = 77"}))
    assert content(spark, target) == [(1, "a"), (2, "new"), (3, "c"), (9, "it's")]
    report = spark.sql(scripts.validate_script(target, {"nulls": f"SELECT 1 FROM {target} WHERE name IS NULL", "large": f"SELECT 1 FROM {target} WHERE id > 2"}))
    assert sorted(tuple(r) for r in report.collect()) == [("large", 2), ("nulls", 0)]


def test_generated_scripts_run(spark, sf_dir):
    spark.sql("DROP TABLE IF EXISTS programme")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag != 'R'").selectExpr("l_orderkey AS event_id", "l_linenumber AS position", "l_partkey AS work_id", "'kept' AS title")
    rows.write.format("parquet").saveAsTable("programme")
    try:
        some = plans.QUERIES["apply_scripts"](spark, sf_dir).orderBy("event_id").limit(2).collect()
        count = spark.table("programme").count()
        for r in some:
            spark.sql(r["script"])
        assert spark.table("programme").count() == count + sum(r["rows"] for r in some)
        with pytest.raises(Exception, match="before"):
            spark.sql(some[0]["script"])  # a second time its guard finds the rows
        assert spark.table("programme").count() == count + sum(r["rows"] for r in some)
    finally:
        spark.sql("DROP TABLE programme")


@pytest.fixture
def paged_file(tmp_path):
    path = str(tmp_path / "paged.parquet")
    pq.write_table(pa.table({"k": list(range(1000)), "day": [f"2024-{1 + i // 100:02d}" for i in range(1000)], "v": [i * i for i in range(1000)]}), path, row_group_size=50)
    return path


def test_pages_outside_the_range_are_not_read(spark, paged_file):
    assert len(pages_of([paged_file])) == 20
    assert [p.group for p in pages_of([paged_file], (Bound("k", low=120), Bound("k", high=250, strict=True)))] == [2, 3, 4]
    assert len(pages_of([paged_file], (Bound("day", low="2024-09"),))) == 4
    register_paged(spark)
    rows = spark.read.format("paged").option("columns", "k,day").load(paged_file)
    kept = rows.where("k >= 120 and k < 250 and day = '2024-02' and k % 2 = 0")
    assert rows.columns == ["k", "day"] and sorted(r["k"] for r in kept.collect()) == list(range(120, 200, 2))
    assert kept.rdd.getNumPartitions() == 2
    assert spark.read.format("paged").load(paged_file).where("k = 7").first()["v"] == 49


def test_pages_as_a_stream_go_on_from_their_offset(spark, tmp_path):
    register_paged(spark)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for part, rows in enumerate((300, 120, 80)):
        pq.write_table(pa.table({"k": [part * 1000 + i for i in range(rows)]}), str(folder / f"part-{part}.parquet"), row_group_size=50)
        stream = spark.readStream.format("paged").load(str(folder))
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        run.awaitTermination()
        assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == sum((300, 120, 80)[: part + 1])
