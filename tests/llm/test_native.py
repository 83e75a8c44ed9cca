"""Sharding, exact dedup, url filters and mixing against brute force and their SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.data import edge_docs, edge_rows, no_docs, row
from tests.oracle import connect, same
from veduta.llm.exact_dedup import digested, exact_duplicates, merged_runs
from veduta.llm.mixing import mix_documents, mixed_documents, source_targets
from veduta.llm.queries import ORACLES, QUERIES
from veduta.llm.sharding import rendezvous_shard, shard_documents, with_shards, with_slots
from veduta.llm.url_filters import Rule, judge_urls


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_shards_of_edge_cases(spark):
    out = shard_documents(edge_docs(spark)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(no_docs(spark)).count() == 0


def spark_hash(key, shard):
    """Spark's 64-bit hash of a long and an int, by the public xxHash64."""
    h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)


def test_shards_by_brute_force(spark):
    def best(key, shards):
        return min((-math.log(((spark_hash(key, s) >> 11) + 0.5) / 2**53), s) for s in range(shards))[1]

    rows = [row(i, f"t{i}") for i in [*range(300), -5, 2**62, None]]
    for r in shard_documents(spark.createDataFrame(rows, edge_docs(spark).schema)).collect():
        assert (r["shard"], r["grown_shard"]) == (best(r["doc_id"], 24), best(r["doc_id"], 25))


def test_rows_without_a_key_spread_over_slot_ranges(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("c"), F.lit(0).alias("shard"))
    out = with_slots(docs, "k", ["c"])
    assert sorted(r["slot"] for r in out.collect()) == list(range(500))


def test_runs_are_sorted_and_merged_in_rounds(spark):
    docs = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id") % 40).alias("text")).withColumnRenamed("id", "doc_id").repartition(9)
    plan = merged_runs(digested(docs), F.max)._jdf.queryExecution().executedPlan().toString()
    rounds = 3  # 512 runs by eights
    assert plan.count("SortAggregate") == 2 * rounds and plan.count("Sort [") >= rounds and "HashAggregate" not in plan
    for runs, fan_in in ((1, 2), (2, 2), (9, 2), (512, 8)):
        got = {(r["keep_id"], r["group_size"]) for r in merged_runs(digested(docs), F.min, runs, fan_in).collect()}
        assert got == {(i, 25) for i in range(40)}


def test_sharding_is_fair_and_stable(spark):
    ids = spark.range(20_000).toDF("k")
    out = with_shards(ids, "k", [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 4.0]).collect()
    share = Counter(r["shard"] for r in out)
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {3} and abs(len(moved) / 20_000 - 0.5) < 0.02
    assert ids.select(rendezvous_shard(F.col("k"), [0.0, 1.0]).alias("s")).distinct().collect()[0]["s"] == 1
    with pytest.raises(ValueError):
        rendezvous_shard(F.col("k"), [0.0])
    kept = with_slots(with_shards(edge_docs(spark), "doc_id", [1.0] * 3), "doc_id", ["n_chars"])
    assert kept.columns.count("shard") == kept.columns.count("slot") == 1 and kept.count() == len(edge_rows())


def test_exact_duplicates_by_brute_force(spark):
    groups = defaultdict(list)
    for r in edge_rows():
        groups[folded(r[1])].append(r[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    for parts in (1, 5):
        assert Counter(tuple(r) for r in exact_duplicates(edge_docs(spark).repartition(parts)).collect()) == want
    smallest = {r["keep_id"] for r in exact_duplicates(edge_docs(spark), F.min).where("group_size = 4").collect()}
    assert smallest == {1}
    assert exact_duplicates(no_docs(spark)).count() == 0


URLS = [
    (1, "https://WWW.Example.com/en/x?q=/net/"), (2, "http://example.com/en/"), (3, "http://a.b.example.com/en"), (4, "http://x.net/es/1#top"), (5, "http://net/fr/"),
    (6, "http://notnet/fr/"), (7, "http://example.com?x=/en/"), (8, "no scheme/en/"), (9, None), (10, ""), (11, "http://evil-example.com/en/x"), (11, "http://evil-example.com/en/x"),
    (12, "a://b://c.net/es/"), (None, "ftp://q.com/"), (13, "http://u@h.net:80/fr/x"), (14, "http://éa.NET/es/\nx"),
]


def judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = re.split("[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host, path = folded(host), slash + path
    fits = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, best and best.name, best.verdict if best else default


def test_url_rules_by_brute_force(spark):
    from veduta.llm.url_filters import RULES

    pages = spark.createDataFrame([(i, u, "clash", 5) for i, u in URLS], "page_id long, url string, host string, _row long")
    loose = (Rule("block", "", "/x/"), Rule("allow", "", "/en"), Rule("block", "", ""), Rule("allow", "net", ""))
    for rules, default in ((RULES, "allow"), (loose, "allow"), (loose[:2], "block"), ((Rule("block", "x.net", ""), Rule("allow", "com", "/en/"), Rule("block", "c.net", "/es/")), "block")):
        got = Counter(tuple(r) for r in judge_urls(pages, rules, default).collect())
        assert got == Counter((i, *judge(u, rules, default)) for i, u in URLS)
    assert judge_urls(pages.limit(0)).count() == 0


def test_targets_fill_up_to_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 300}
    out = {r["source"]: r for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert out["a"]["target"] == 20 and out["d"]["target"] == 0
    assert abs(sum(r["target"] for r in out.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(r["target"] <= 2 * r["source_size"] for r in out.values())


def test_mix_of_edge_cases(spark):
    rows = edge_rows() + [row(100 + i, "w " * (i + 1), "en", "s%d" % (i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    labels = spark.createDataFrame([(100, 1), (101, 0), (100, 0), (None, 1)], "doc_id long, quality int")
    out = mix_documents(docs, labels).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
        target.setdefault(r["source_size"], set()).add(r["target"])
    assert all(sum(int(t) for t in target[s]) == taken[s] for s in taken)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mix_documents(docs.repartition(3), labels).collect()))
    assert mix_documents(no_docs(spark)).count() == 0


def test_repeated_rows_take_what_the_mix_says(spark):
    schema = edge_docs(spark).schema
    rows = [row(i % 7, " ".join(["w%d" % (i % 7)] * (3 + i % 7)), "en", "b") for i in range(70)] + [row(None, "n n n", "en", "b")] * 9
    rows += [row(500 + i, "x " * 9, "en", "a") for i in range(300)]
    docs = spark.createDataFrame(rows, schema)
    mixed = mix_documents(docs).collect()
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += r["taken"]
    got, by_source = Counter(), Counter()
    for r in mixed_documents(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
        by_source[r["source"]] += len(r["text"].split())
    assert got == +want
    targets = {r["source_size"]: int(r["target"]) for r in mixed}
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    assert by_source == {s: targets[sizes[s]] for s in "ab"}


def test_mixed_rows_hold_the_words_taken(spark):
    docs = spark.createDataFrame([row(i, " ".join(["w"] * (i + 1)), "en", "s%d" % (i % 4)) for i in range(50)], edge_docs(spark).schema)
    want = {r["doc_id"]: r["taken"] for r in mix_documents(docs).collect() if r["taken"]}
    got = Counter()
    for r in mixed_documents(docs).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == want


def test_whole_mix_keeps_texts(spark):
    r = random.Random(8)
    texts = {i: "\n ".join(["w%d" % i] * r.randint(1, 90)) for i in range(60)}
    docs = spark.createDataFrame([row(i, t, "en", "s%d" % (i % 4)) for i, t in texts.items()], edge_docs(spark).schema)
    sizes, target = {i: len(t.split()) for i, t in texts.items()}, {}
    cut = {}
    for x in mix_documents(docs).collect():
        target["s%d" % (x["doc_id"] % 4)] = int(x["target"])
        if 0 < x["fraction_words"] < x["size"]:
            cut[x["doc_id"] % 4] = x["size"]
    got = Counter()
    for x in mixed_documents(docs, whole=True).collect():
        assert x["text"] == texts[x["doc_id"]] and x["n_chars"] == len(x["text"])
        got["s%d" % (x["doc_id"] % 4)] += sizes[x["doc_id"]]
    assert cut and all(abs(got[s] - target[s]) * 2 <= cut.get(int(s[1:]), 0) for s in target)
