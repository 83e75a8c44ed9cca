"""The pipeline's stages, each against what its operator or brute force says of its own input."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.data import edge_docs, edge_rows, no_docs
from tests.llm.test_near import brute
from veduta.llm import tables
from veduta.llm.decontamination import contaminated


def test_stages_one_by_one(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.count()
        if name != "sharding":
            assert docs.columns == columns
        if name == "near_dedup":
            want = {r[0] for r in brute([tuple(r) for r in before.select("doc_id", "text").collect()]) if r[3]}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "decontamination":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert contaminated(docs, bench).count() == 0 and contaminated(before, bench).select("doc_id").distinct().count() == before.count() - docs.count()
            exact = [b["text"] for b in bench.collect()]
            assert not any(b in d["text"] for d in docs.collect() for b in exact)
    lettered = sum(any(c.isalpha() for c in r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert 0.98 * lettered <= kept["language_id"] <= lettered
    assert kept["sharding"] == kept["mixing"]
    final = docs.collect()
    assert all(0 <= r["shard"] < corpus_pipeline.SHARDS for r in final)
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["text"], r["shard"])
    assert Counter(map(key, again)) == Counter(map(key, final))


def test_final_rows_keep_their_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {(r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()}
    mixed = corpus_pipeline.mixing(spark, docs, sf_dir).collect()
    assert mixed and {(r["doc_id"], r["text"], r["n_chars"]) for r in mixed} <= texts


def ids(rows):
    return sorted(str(r["doc_id"]) for r in rows)


def test_stages_on_edge_cases(spark, sf_dir):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, sf_dir).collect()
    assert all(any(c.isalpha() for c in r["text"] or "") for r in told)
    rows = edge_rows()
    # 8 and 7 are near and exact copies of 1, 11 of 10, and so is a row without doc_id of 1.
    assert ids(stages["near_dedup"](spark, docs, sf_dir).collect()) == sorted(str(r[0]) for r in rows if r[0] not in (7, 8, 11) and (r[0] is not None or r[1] is None))
    assert ids(stages["decontamination"](spark, docs, sf_dir).collect()) == ids(docs.collect())
    mixed = stages["mixing"](spark, docs, sf_dir).collect()
    assert all(r["text"] and r["text"].split() for r in mixed)
    words = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    # A source is taken twice at most, and the mix holds half as many words again, but for one text a source.
    assert all(taken[s] <= 2 * words[s] for s in words)
    longest = {s: max((len((r[1] or "").split()) for r in rows if r[3] == s), default=0) for s in words}
    assert abs(sum(taken.values()) - 1.5 * sum(words.values())) <= sum(longest.values())
    placed = stages["sharding"](spark, docs, sf_dir).collect()
    assert ids(placed) == ids(docs.collect())
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = no_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())


def test_stored_tables_can_be_discarded(spark):
    kept = tables.stored(spark.range(3))
    path = kept.__dict__["_stored_at"]
    assert spark.read.parquet(path).count() == 3
    tables.discard(kept, spark.range(1))
    assert not Path(path.removeprefix("file:")).exists()
